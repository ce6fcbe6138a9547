"""Texts as pieces that a byte-level tokenizer treats independently.

The pre-tokenizer's pattern always has a boundary before a space that a non-space character follows: no alternative runs over such a space
other than as its first character. Cutting texts there and encoding each distinct piece once gives the ids of whole texts.
Pieces are found on the raw bytes and told apart by Arrow's dictionary encoding; a cache of a bounded number of bytes keeps what a worker has encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _vec as V

#: Bytes of pieces and ids that a worker process remembers, unless told otherwise; then it starts anew. Longer pieces aren't remembered.
CACHE, LONGEST = 192 << 20, 256
#: Bytes of the objects around a remembered piece.
_AROUND = 240

#: Bytes that begin no white space character (lead bytes of U+0085, U+00A0 and U+1680 .. U+3000 are left out, which only makes pieces longer).
_GOES_ON = np.zeros(256, bool)
_GOES_ON[0x21:0x7F] = True
_GOES_ON[0xC3:0xE1] = True
_GOES_ON[0xE4:0xF5] = True


class Pieces:
    """Encodes slices of texts. ``encode`` gives the ids (uint32 bytes) of each piece of a list; ``encode_text`` those of a text with a special token in it."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], encode_text: Callable[[str], bytes], specials: list[str], most: int | None = None):
        self.encode, self.encode_text, self.specials, self.most = encode, encode_text, specials, most or CACHE
        self.cache: dict[bytes, bytes] = {}
        self.held = 0

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all rows, and where each row's begin."""
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        ids, offs = self._plain(pc.if_else(pa.array(special), "", texts) if special.any() else texts)
        if not special.any():
            return ids, offs
        parts = [ids[offs[i] : offs[i + 1]] if not special[i] else np.frombuffer(self.encode_text(texts[i].as_py()), np.uint32) for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offs = V.buffers(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        cut = np.zeros(n, bool)
        cut[:-1] = (data[:-1] == 32) & _GOES_ON[data[1:]]
        ends = offs[1:-1]
        cut[ends[(ends > 0)] - 1] = False  # a text's last byte: what follows is another text
        cut[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(cut)
        pieces = V.binary_array(data, np.append(starts, n)).dictionary_encode()
        found = pieces.dictionary.to_pylist()
        cache = self.cache
        values = [cache.get(x) for x in found]
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            new = self.encode([found[i] for i in missing])
            for i, v in zip(missing, new):
                values[i] = v
                if len(found[i]) > LONGEST:
                    continue
                self.held += len(found[i]) + len(v) + _AROUND
                if self.held > self.most:
                    cache.clear()
                    self.held = len(found[i]) + len(v) + _AROUND
                cache[found[i]] = v
        flat = np.frombuffer(b"".join(values), np.uint32)
        size = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        begin = np.cumsum(size) - size
        which = pieces.indices.to_numpy()
        each = size[which]
        total = np.concatenate([[0], np.cumsum(each)])
        return gather(flat, begin[which], each), total[np.searchsorted(starts, offs)]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """flat[start : start + length] of all rows, concatenated, a stretch of rows at a time."""
    out = np.empty(int(lengths.sum()), flat.dtype)
    at = 0
    for a in range(0, len(starts), step):
        idx = V.ragged(starts[a : a + step], lengths[a : a + step])
        np.take(flat, idx, out=out[at : at + len(idx)])
        at += len(idx)
    return out


def offset_table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of all items."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(lengths) - lengths, lengths

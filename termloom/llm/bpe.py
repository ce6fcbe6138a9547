"""BPE encoding and decoding: a backtracking encoder, and decoding by an offset table.

Encoding. An Aho-Corasick pass over a piece gives the longest token that begins at each byte. From left to right the longest token is taken if
it is compatible with the one before it: two tokens are compatible if merging their bytes never joins across their border, which is decided by undoing
merges on both sides (kept in a pair table). Otherwise the next shorter prefix token is tried; with none left, one step is taken back and the position
is marked as a dead end. Every position is entered and left at most once, so the time is linear, and the result is exactly that of
the merges in rank order.

Decoding. Token bytes lie one after another in one array; ids select (offset, length) pairs and one gather gives the text.

The vocabulary's path is a parameter. Defined cases: null counts as the empty text, which has no ids and decodes to the empty text; a special token's
string in a text becomes its id, as the tokenizers library has it; repeated rows give equal results; other columns are passed through
by the stage and not read otherwise. A very long text is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import _vec as V
from ._pieces import Pieces, gather, offset_table
from ._spark import batch, table

#: Contractions, words, numbers, other characters, and white space but for one space before a word.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?=\p{White_Space}|\z)|\p{White_Space}+".replace(r"\z", r"\Z"))
#: Entries that a worker process keeps of the pair table, and bytes of encoded pieces.
PAIRS, PIECES = 250_000, 48 << 20


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, pre = j["model"], j.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or j.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.specials = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        by_id = {i: raw(t) for t, i in model["vocab"].items() if t not in self.specials}
        self.token_bytes = [by_id.get(i, b"") for i in range(1 + max([*by_id, *self.specials.values()]))]
        for s, i in self.specials.items():
            self.token_bytes[i] = s.encode()
        ids = {b: i for i, b in by_id.items()}
        # ranks: single bytes, then merges in order
        self.bytes_of = [bytes([b]) for b in range(256)]
        self.split = [(b, b) for b in range(256)]
        rank = {b: i for i, b in enumerate(self.bytes_of)}
        self.joined: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair, both = (rank[a], rank[b]), a + b
            if both not in rank:
                rank[both] = len(self.bytes_of)
                self.bytes_of.append(both)
                self.split.append(pair)
            self.joined.setdefault(pair, rank[both])
        self.rank = rank
        self.id_of = np.array([ids[b] for b in self.bytes_of], np.uint32)
        self.length = [len(b) for b in self.bytes_of]
        self.shorter = [next((rank[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in rank), -1) for b in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        for b, r in rank.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), r))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self._encode_pieces, self._encode_with_specials, list(self.specials), PIECES)
        self.decode_table = offset_table(self.token_bytes)
        self.decimal_table = offset_table([b"%d," % i for i in range(len(self.token_bytes))])
        if self.specials:
            self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")")

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging never joins across the border of token ranks a and b."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is not None:
            return got
        joined, split = self.joined, self.split
        limit = 1 << 60
        while True:
            both = joined.get((a, b))
            if both is not None and both < limit:
                ok = False
                break
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        ok = True
                        break
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        ok = True
                        break
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_word(self, word: bytes) -> list[int]:
        """Token ranks of one pre-token."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        n, length, shorter, compatible = len(word), self.length, self.shorter, self.compatible
        longest = [0] * n
        for end, (size, r) in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - size] = r  # ends ascend, so the longest comes last
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if alive[end] and (last < 0 or compatible(last, token)):
                    out.append(token)
                    at = end
                    break
                token = shorter[token]
                if token < 0:
                    alive[at] = 0
                    token = out.pop()
                    at -= length[token]
                    break
            else:
                continue
            if alive[at] and at == end:
                if at == n:
                    return out
                token = longest[at]

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        ids, word, find = self.id_of, self.encode_word, PATTERN.findall
        out = []
        for p in pieces:
            ranks: list[int] = []
            for w in find(p.decode("utf-8")):
                ranks += word(w.encode("utf-8"))
            out.append(ids[ranks].tobytes())
        return out

    def _encode_with_specials(self, text: str) -> bytes:
        parts = []
        for p in self._special.split(text):
            if p in self.specials:
                parts.append(np.uint32(self.specials[p]).tobytes())
            elif p:
                parts += self._encode_pieces([p.encode("utf-8")])
        return b"".join(parts)

    def decode_bytes(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the rows of ids."""
        data, starts, lengths = self.decode_table
        total = np.concatenate([[0], np.cumsum(lengths[ids])])
        return gather(data, starts[ids], lengths[ids]), total[offs]

    def decimals(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids in decimal, each with a comma after it."""
        data, starts, lengths = self.decimal_table
        total = np.concatenate([[0], np.cumsum(lengths[ids])])
        return gather(data, starts[ids], lengths[ids]), total[offs]


@cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker process."""
    return Vocabulary(path)


def _valid(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows as UTF-8, with replacement characters where bytes don't make characters."""
    try:
        str(memoryview(data), "utf-8")
        lead = (data & 0xC0) != 0x80
        edges = offs[offs < len(data)]
        if lead[edges].all():
            return data, offs
    except UnicodeDecodeError:
        pass
    rows = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offs, offs[1:])]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def encode_column(path: str, keep: list[str]):
    def run(batches):
        v = vocabulary(path)
        for b in V.text_slices(batches, budget=V.SMALL_SLICE):
            ids, offs = v.pieces.ids(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], [*keep, "ids"])

    return run


def encode(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``ids`` array<int>."""
    schema = docs.select(*keep).schema.add(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(encode_column(path, keep), schema)


def decode(rows: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the ``text`` of ``ids`` array<int>; null ids give null."""

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            lists = b.column("ids")
            n = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, offs = _valid(*v.decode_bytes(flat, np.concatenate([[0], np.cumsum(n)])))
            text = V.binary_array(data, offs, pa.string())
            if lists.null_count:
                text = pa.array([None if not ok else t for t, ok in zip(text.to_pylist(), lists.is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), text], [*keep, "text"])

    schema = rows.select(*keep).schema.add(T.StructField("text", T.StringType()))
    return rows.select(*keep, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, each from encoding and then decoding these ids."""

    def run(batches):
        v, sha = vocabulary(path), hashlib.sha256
        for b in V.text_slices(batches, budget=V.SMALL_SLICE):
            ids, offs = v.pieces.ids(b.column("text"))
            written, at = v.decimals(ids, offs)
            mem = memoryview(written)
            first = [sha(mem[s : max(s, e - 1)]).hexdigest() for s, e in zip(at.tolist(), at[1:].tolist())]
            decoded, at = _valid(*v.decode_bytes(ids, offs))
            mem = memoryview(decoded)
            second = [sha(mem[s:e]).hexdigest() for s, e in zip(at.tolist(), at[1:].tolist())]
            yield batch("doc_id n_tokens ids_sha256 decoded_sha256", b.column("doc_id"), np.diff(offs), first, second)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), production_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, production_path())

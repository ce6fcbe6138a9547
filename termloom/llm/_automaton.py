"""The arcs of a backoff automaton in the shared folder.

A level holds the n-grams of one length. Its states are the numbers of the n-grams one word shorter; an arc is a (state, word) pair, and the number of an
arc is its place among all arcs in the order of buckets, states and words, which makes it a state of the next level. A bucket has four flat
files: where each state's arcs begin, the arcs' words, their counts in one byte, and the counts that don't fit into a byte with their places.
Buckets are ranges of states that hold about equally many tokens; a range that holds more is split by word into several.
"""

from __future__ import annotations

import uuid

import numpy as np
import zstandard

from ._spark import batch
from ._tables import Files, open_fs

#: Counts from here on lie in the file of large counts.
_LARGE = 255
#: Keys that a reducer holds before it sums them up.
_PENDING = 4 << 20


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, byte planes apart, and counts; both compressed."""
    z = zstandard.ZstdCompressor(level=1)
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return z.compress(steps.T.tobytes()), z.compress(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    steps = np.frombuffer(z.decompress(keys), np.uint8).reshape(8, -1)
    n = np.frombuffer(z.decompress(counts), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64), np.ascontiguousarray(n.T).view(np.uint32).ravel().astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Layout:
    """How (state, word) pairs are dealt to buckets: ranges of states from ``lo`` on, each in ``parts`` buckets by word."""

    def __init__(self, lo: np.ndarray, parts: np.ndarray, states: int, types: int):
        self.lo, self.parts, self.states, self.types = lo, parts, states, max(1, types)
        self.first = np.cumsum(parts) - parts
        self.range_of = np.repeat(np.arange(len(lo)), parts)
        self.shift = np.uint64(max(1, int(self.types).bit_length()))

    def __len__(self) -> int:
        return int(self.parts.sum())

    def width(self, bucket: int) -> int:
        """Number of states of a bucket."""
        r = int(self.range_of[bucket])
        return int((self.lo[r + 1] if r + 1 < len(self.lo) else self.states) - self.lo[r])

    def ranges(self, state: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, state, "right") - 1

    def bucket(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        r = self.ranges(state)
        return self.first[r] + word * self.parts[r] // self.types

    def blocks(self, state: np.ndarray, word: np.ndarray):
        """Sorted, summed and packed keys of each bucket that the pairs fall into."""
        b = self.bucket(state, word)
        order = np.argsort(b, kind="stable")
        b, key = b[order], ((state - self.lo[self.range_of[b]]).astype(np.uint64) << self.shift | word.astype(np.uint64))[order]
        cuts = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
        out = []
        for s, e in zip(cuts, cuts[1:]):
            k = np.sort(key[s:e])
            at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            out.append((int(b[s]), *_packed(k[at], np.diff(np.append(at, len(k))))))
        ids, keys, counts = zip(*out)
        return batch("bucket keys counts", np.array(ids, np.int64), list(keys), list(counts))

    def merge(self, uri: str, least: int):
        """Reducer: blocks that come by bucket are summed and written; one row of statistics a bucket."""
        word_type = np.uint32 if self.types < 1 << 32 else np.uint64

        def write(bucket: int, keys: np.ndarray, counts: np.ndarray):
            keep = counts >= least
            k, n = keys[keep], counts[keep]
            start = np.searchsorted(k >> self.shift, np.arange(self.width(bucket) + 1, dtype=np.uint64)).astype(np.uint32)
            large = np.flatnonzero(n >= _LARGE)
            sums = np.concatenate([[0], np.cumsum(n)])
            files = {
                "start": start,
                "word": (k & ((np.uint64(1) << self.shift) - np.uint64(1))).astype(word_type),
                "n": np.minimum(n, _LARGE).astype(np.uint8),
                "large": np.stack([large, n[large]]).astype(np.int64),
            }
            if least > 1:
                files["follow"] = np.diff(sums[start]).astype(np.int64)
            fs, path = open_fs(uri)
            for kind, x in files.items():
                tmp = f"{path}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(tmp) as f:
                    f.write(np.ascontiguousarray(x).data.cast("B") if x.size else b"")
                fs.move(tmp, f"{path}/{bucket}.{kind}")
            stats = [bucket, len(k), n.sum(), (counts == 1).sum(), (counts == 2).sum()]
            return batch("bucket kept tokens ones twos", *(np.array([x], np.int64) for x in stats))

        def run(batches):
            last, held, size = None, [], 0

            def close():
                return write(last, *_summed(*(np.concatenate(x) for x in zip(*held))))

            for b in batches:
                for bucket, k, c in zip(b.column("bucket").to_pylist(), b.column("keys"), b.column("counts")):
                    if bucket != last:
                        if held:
                            yield close()
                        last, held, size = bucket, [], 0
                    held.append(_unpacked(k.as_buffer(), c.as_buffer()))
                    size += len(held[-1][0])
                    if size > max(_PENDING, 2 * len(held[0][0])):
                        held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                        size = len(held[0][0])
            if held:
                yield close()

        return run


class Arcs:
    """The arcs of a level, for tasks that walk them."""

    def __init__(self, uri: str, layout: Layout, counts: np.ndarray, least: int):
        self.layout, self.counts, self.least = layout, counts, least
        self.before = np.cumsum(counts) - counts
        self.files = Files(uri)

    def __getstate__(self):
        return self.files.uri, self.layout, self.counts, self.least

    def __setstate__(self, state):
        self.__init__(*state)

    def __len__(self) -> int:
        return int(self.counts.sum())

    def _by_bucket(self, bucket: np.ndarray):
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order)) if len(order) else [0]
        for s, e in zip(cuts, cuts[1:]):
            yield int(bucket[order[s]]), order[s:e]

    def find(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of the arcs (state, word), -1 where there is none."""
        out = np.full(len(state), -1, np.int64)
        by_state = np.argsort(state, kind="stable")
        s, w = state[by_state], word[by_state]
        for b, at in self._by_bucket(self.layout.bucket(s, w)):
            if not self.counts[b]:
                continue
            start, words = self.files.read(f"{b}.start", np.uint32), self.files.read(f"{b}.word", np.uint32 if self.layout.types < 1 << 32 else np.uint64)
            own, want = s[at] - self.layout.lo[self.layout.range_of[b]], w[at]
            low, end = start[own].astype(np.int64), start[own + 1].astype(np.int64)
            high, live = end.copy(), np.flatnonzero(low < end)
            while len(live):
                mid = (low[live] + high[live]) >> 1
                less = words[mid] < want[live]
                low[live] = np.where(less, mid + 1, low[live])
                high[live] = np.where(less, high[live], mid)
                live = live[low[live] < high[live]]
            ok = np.flatnonzero(low < end)
            ok = ok[words[low[ok]] == want[ok]]
            out[by_state[at[ok]]] = self.before[b] + low[ok]
        return out

    def n(self, at: np.ndarray) -> np.ndarray:
        """Counts of the arcs of these numbers; 0 for -1."""
        out = np.zeros(len(at), np.int64)
        has = np.flatnonzero(at >= 0)
        for b, i in self._by_bucket(np.searchsorted(self.before, at[has], "right") - 1):
            local = at[has[i]] - self.before[b]
            n = self.files.read(f"{b}.n", np.uint8)[local].astype(np.int64)
            full = np.flatnonzero(n == _LARGE)
            if len(full):
                places, values = self.files.read(f"{b}.large", np.int64).reshape(2, -1)
                n[full] = values[np.searchsorted(places, local[full])]
            out[has[i]] = n
        return out

    def leaving(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of arcs, sum of their counts where rare ones aren't kept, else -1) of each state."""
        kinds, follow = np.zeros(len(state), np.int64), np.full(len(state), 0 if self.least > 1 else -1, np.int64)
        lay = self.layout
        for r, i in self._by_bucket(lay.ranges(state)):
            own = state[i] - lay.lo[r]
            for b in range(int(lay.first[r]), int(lay.first[r] + lay.parts[r])):
                if self.counts[b]:
                    start = self.files.read(f"{b}.start", np.uint32)
                    kinds[i] += start[own + 1].astype(np.int64) - start[own]
                    if self.least > 1:
                        follow[i] += self.files.read(f"{b}.follow", np.int64)[own]
        return kinds, follow

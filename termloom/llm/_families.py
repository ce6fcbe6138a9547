"""Families of look-alikes: sets that share shingles too frequent for one task, linked exactly and in blocks.

Sets that meet in a hot shingle are of one family (components over these shingles), so that every pair of it is compared once, however many
shingles the two share. A family is cut by size, in levels that similar sets don't lie more than one apart, and at random into blocks of bounded rows and shingles.
Blocks are written once to the shared folder; a task maps two of them, counts the common shingles of all their pairs (frequent shingles
by matrix products, others by their few pairs) and reports the exact links that join components, no more than there are rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.plans.shared import fresh_dir, materialize

from . import _vec as V
from ._spark import batch
from ._tables import Files, open_fs
from .components import connected_components

#: Rows and shingles of a block, about.
ROWS, SHINGLES = 1024, 1 << 20
#: Shingles of a matrix product, pairs up to which a shingle's pairs are listed, and listed pairs at a time.
COLUMNS, LISTED, PAIRS = 4096, 256, 4 << 20
_SCHEMA = "family long, level long, block long, file string, at long, rows long, shingles long"


def _cells(h: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the shingles that are among the keys."""
    slot = np.searchsorted(keys, h)
    has = keys[np.minimum(slot, len(keys) - 1)] == h
    return slot[has], np.repeat(np.arange(len(at) - 1), np.diff(at))[has]


def similar(ha: np.ndarray, aa: np.ndarray, hb: np.ndarray, ab: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of which sets of one block (hashes, first) reach the similarity with which of the other, exactly."""
    na, nb = np.diff(aa), np.diff(ab)
    out = np.zeros((len(na), len(nb)), bool)
    keys = np.intersect1d(ha, hb)
    if not len(keys):
        return out
    (ca, ra), (cb, rb) = _cells(ha, aa, keys), _cells(hb, ab, keys)
    # a set has to find so many of its shingles on the other side
    live_a = np.flatnonzero(100 * np.bincount(ra, minlength=len(na)) >= percent * na)
    live_b = np.flatnonzero(100 * np.bincount(rb, minlength=len(nb)) >= percent * nb)
    if not len(live_a) or not len(live_b):
        return out
    ok_a, ok_b = np.isin(ra, live_a), np.isin(rb, live_b)
    ca, ra, cb, rb = ca[ok_a], np.searchsorted(live_a, ra[ok_a]), cb[ok_b], np.searchsorted(live_b, rb[ok_b])
    shape = len(live_a), len(live_b)
    ta, tb = np.bincount(ca, minlength=len(keys)), np.bincount(cb, minlength=len(keys))
    both = np.zeros(shape)
    dense = ta * tb > LISTED
    number = np.cumsum(dense) - 1
    da, db = dense[ca], dense[cb]
    (xa, ya), (xb, yb) = (number[ca[da]], ra[da]), (number[cb[db]], rb[db])
    for s in range(0, int(dense.sum()), COLUMNS):
        a, b = (np.zeros((n, COLUMNS), np.float32) for n in shape)
        for m, x, y in ((a, xa, ya), (b, xb, yb)):
            now = (x >= s) & (x < s + COLUMNS)
            m[y[now], x[now] - s] = 1
        both += a @ b.T
    ca, ra, cb, rb = ca[~da], ra[~da], cb[~db], rb[~db]
    order = np.argsort(cb, kind="stable")
    rb, first = rb[order], np.searchsorted(cb[order], np.arange(len(keys)))
    n = np.where(dense, 0, tb)[ca]
    ends, s = np.cumsum(n), 0
    while s < len(n):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, "right")))
        at = np.repeat(ra[s:e], n[s:e]) * shape[1] + rb[V.ragged(first[ca[s:e]], n[s:e])]
        both += np.bincount(at, minlength=shape[0] * shape[1]).reshape(shape)
        s = e
    out[np.ix_(live_a, live_b)] = 100 * both >= percent * (na[live_a][:, None] + nb[live_b] - both)
    return out


def forest(like: np.ndarray, label: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) of the matrix that join all that it joins; labels (of rows, then of columns) tell what is joined already. same: columns are the rows."""
    label, out, right = label.copy(), [], 0 if same else len(like)
    for x in np.flatnonzero(like.any(1)):
        y = np.flatnonzero(like[x])
        y = y[label[right + y] != label[x]]
        if len(y):
            roots, where = np.unique(label[right + y], return_index=True)
            out += [(x, k) for k in y[where]]
            label[np.isin(label, roots)] = label[x]
    a = np.array(out, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def _write(uri: str, sets: Callable):
    """Rows come by family, level and block; each block goes behind the last one in the task's file: first places, hashes, nodes, labels as 64-bit words."""

    def run(batches):
        fs, path = open_fs(uri)
        name, at, last, held = uuid.uuid4().hex, 0, None, []

        def close(f):
            n = np.concatenate([x for x, *_ in held])
            h = np.concatenate([x for _, x, *_ in held])
            ids = [np.concatenate([x[k] for x in held]) for k in (2, 3)]
            words = np.concatenate([np.zeros(1, np.uint64), np.cumsum(n).astype(np.uint64), h, *ids])
            f.write(words.tobytes())
            return len(n), len(h), len(words)

        with fs.open_output_stream(f"{path}/{name}") as f:
            rows = []
            for b in V.text_slices(batches, budget=V.SMALL_SLICE):
                h, first = sets(b.column("text"))
                keys = np.stack([b.column(c).to_numpy() for c in ("family", "level", "block")])
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
                for s, e in zip(cuts, cuts[1:]):
                    now = tuple(keys[:, s].tolist())
                    if held and now != last:
                        n, m, size = close(f)
                        rows.append((*last, name, at, n, m))
                        at, held = at + size, []
                    ids = [V.buffers(b.column(c).slice(s, e - s))[0].view(np.uint64) for c in ("node", "label")]
                    held.append((np.diff(first[s : e + 1]), h[first[s] : first[e]].copy(), *[x.copy() for x in ids]))
                    last = now
            if held:
                n, m, _ = close(f)
                rows.append((*last, name, at, n, m))
        if rows:
            yield batch("family level block file at rows shingles", *[pa.array(list(x)) for x in zip(*rows)])

    return run


def _read(files: Files, file: str, at: int, rows: int, shingles: int):
    """(hashes, first, nodes, labels) of a block."""
    words = files.read(file, "u8")[at : at + 1 + 5 * rows + shingles]
    first, rest = words[: rows + 1].astype(np.int64), words[rows + 1 :]
    ids = rest[shingles:]
    return np.array(rest[:shingles]), first, np.array(ids[: 2 * rows]).reshape(-1, 2), np.array(ids[2 * rows :]).reshape(-1, 2)


def _meet(uri: str, percent: int):
    """Links of each two blocks."""

    def run(batches):
        files = Files(uri)
        for b in batches:
            for r in b.to_pylist():
                (ha, aa, ia, la), (hb, ab, ib, lb) = (_read(files, *(r[f"{c}_{s}"] for c in ("file", "at", "rows", "shingles"))) for s in "ab")
                _, label = np.unique(np.concatenate([la, lb]), axis=0, return_inverse=True)
                label = label.ravel()
                if (label == label[0]).all():
                    continue
                x, y = forest(similar(ha, aa, hb, ab, percent), label, r["same"])
                if len(x):
                    yield batch("a b", *(V.binary_array(i.view(np.uint8).ravel(), np.arange(len(i) + 1) * 16) for i in (ia[x], ib[y])))
        V.give_back()

    return run



def named(hot: DataFrame) -> DataFrame:
    """(node, family) of hot (band, node), where a band is a shingle that all its nodes hold."""
    first = hot.groupBy("band").agg(F.min("node").alias("b"))
    edges = hot.join(first, "band").select(F.col("node").alias("a"), "b").distinct()
    return connected_components(edges).select("node", F.xxhash64("component").alias("family"))


def links(families: DataFrame, nodes: DataFrame, labels: DataFrame, texts: DataFrame, percent: int, sets: Callable) -> DataFrame:
    """Exact links (a, b) that join what the similar pairs of each family join.

    families: (node, family); nodes: (node, n), the sizes; labels: (node, label), what is joined already; texts: (node, text); sets: the shingle sets of an array of texts."""
    spark = families.sparkSession
    own = families.join(nodes.select("node", "n"), "node").join(labels, "node")
    own = materialize(own.withColumn("level", F.floor(F.log("n") / (math.log(100 / percent) + 1e-6))), "family-rows")
    size = own.groupBy("family", "level").agg(F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("n") / SHINGLES)).alias("blocks"))
    own = own.join(size, ["family", "level"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = own.join(texts, "node").repartition("family", "level", "block").sortWithinPartitions("family", "level", "block")
    uri = fresh_dir(spark, "families")
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    blocks = materialize(rows.select("family", "level", "block", "node", "label", "text").mapInArrow(_write(uri, sets), _SCHEMA), "family-blocks")
    a, b = (blocks.select("family", *[F.col(c).alias(f"{c}_{s}") for c in blocks.columns[1:]]) for s in "ab")
    level = F.col("level_b") - F.col("level_a")
    pairs = a.join(b, "family").where((level == 1) | (level == 0) & (F.col("block_a") <= F.col("block_b")))
    pairs = materialize(pairs.withColumn("same", (level == 0) & (F.col("block_a") == F.col("block_b"))), "family-pairs")
    tasks = max(1, min(pairs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return pairs.repartition(tasks).mapInArrow(_meet(uri, percent), "a binary, b binary")

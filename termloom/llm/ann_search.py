"""Approximate nearest neighbours by largest inner product: a hash-prefix forest over blocks of rows.

Rows are gathered into blocks of at most ``BLOCK`` vectors; each block is written to the shared folder with its forest: for each of ``TREES`` trees the
sorted array of the rows' hash strings (``BITS`` signs of random projections) and the rows in that order. An inner product becomes an angle by one more
coordinate, sqrt(M^2 - |x|^2), where M is the largest norm.

A search descends by binary search to the rows that share the longest prefix with the query in each tree, then ascends in all trees at the same
time: one bit less, more rows. All rows met are scored exactly. It stops at the depth d where a row as near as the k-th best so far would have been met with
probability ``TARGET``: 1 - (1 - (1 - angle / pi)^d)^TREES; so near neighbours are found after a few rows, while scattered vectors, which no index tells
apart, cost up to the whole block. There is no cap on candidates. Blocks of queries meet runs of row blocks, and the best of each are merged. Within a run the best so
far tell at which depth a further block has to be met at all: where near neighbours are known, that is a few rows of each further block.

Defined cases: rows without a vec_id take no part; vectors that are null, zero, hold null or non-finite components, or are of another length than most, take no part, neither as queries nor
candidates; rows with the query's own id are left out; of repeated ids the best row counts; ties go to the smaller id; with fewer than k candidates all are returned; an empty table
gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.plans.shared import fresh_dir

from ._spark import batch, table
from ._tables import _local, open_fs

K, EVERY = 20, 20
TREES, BITS, TARGET = 24, 48, 0.9
BLOCK, RUN, QUERIES = 1 << 16, 64, 1024
#: An ascent begins where all trees together hold so many times k rows.
START = 64


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=4)
def planes(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dim)).standard_normal((dim + 1, TREES * BITS)).astype(np.float32)


def hash_strings(x: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """(trees, rows) hash strings, the first sign in the highest of 64 bits."""
    out = np.zeros((TREES, len(x)), np.uint64)
    shift = (np.uint64(63) - np.arange(BITS, dtype=np.uint64)).astype(np.uint64)
    p = planes(x.shape[1])
    for a in range(0, len(x), 4096):
        signs = (np.column_stack([x[a : a + 4096], extra[a : a + 4096]]).astype(np.float32) @ p) > 0
        for t in range(TREES):
            out[t, a : a + 4096] = (signs[:, t * BITS : (t + 1) * BITS].astype(np.uint64) << shift).sum(1, dtype=np.uint64)
    return out


def _build(uri: str, dim: int, largest: float, every: int):
    def run(batches):
        fs, path = open_fs(uri)
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def write(name, array):
            tmp = f"{path}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(tmp) as f:
                f.write(np.ascontiguousarray(array).data.cast("B") if array.size else b"")
            fs.move(tmp, f"{path}/{name}")

        def flush():
            ids, x = (np.concatenate(c) for c in zip(*held))
            name = f"{part}-{count}"
            codes = hash_strings(x, np.sqrt(np.maximum(0, largest**2 - (x * x).sum(1))))
            order = np.argsort(codes, 1).astype(np.int32)
            write(name + ".ids", ids)
            write(name + ".vectors", x)
            write(name + ".codes", np.take_along_axis(codes, order, 1))
            write(name + ".order", order)
            q = np.flatnonzero(ids % every == 0)
            return batch("block n queries", pa.array([name]), np.array([len(ids)]), np.array([len(q)]))

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("vec_id").to_numpy()
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            a = 0
            while a < len(ids):
                take = min(BLOCK - size, len(ids) - a)
                held.append((ids[a : a + take], x[a : a + take]))
                size += take
                a += take
                if size == BLOCK:
                    yield flush()
                    held, size, count = [], 0, count + 1
        if size:
            yield flush()

    return run


class Block:
    def __init__(self, uri: str, name: str, n: int, dim: int):
        local = _local(uri)
        fs, path = open_fs(uri)

        def load(kind, dtype, shape):
            if local is not None:
                return np.memmap(f"{local}/{name}.{kind}", dtype, "r", shape=shape)
            return np.frombuffer(fs.open_input_stream(f"{path}/{name}.{kind}").readall(), dtype).reshape(shape)

        self.ids, self.vectors = load("ids", np.int64, (n,)), load("vectors", np.float64, (n, dim))
        self.codes, self.order = load("codes", np.uint64, (TREES, n)), load("order", np.int32, (TREES, n))
        self.single = self.vectors.astype(np.float32)


def _ranges(codes: np.ndarray, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows lie that share the first ``depth`` bits with each query's string."""
    if depth == 0:
        return np.zeros(len(q), np.int64), np.full(len(q), len(codes))
    low = np.uint64((1 << (64 - depth)) - 1)
    return np.searchsorted(codes, q & ~low, "left"), np.searchsorted(codes, q | low, "right")


def met(score: np.ndarray, norm: np.ndarray, largest: float, depth: int) -> np.ndarray:
    """Probability that a row of that inner product shares ``depth`` bits with the query in some tree."""
    angle = np.arccos(np.clip(score / (norm * largest), -1, 1))
    return 1 - (1 - (1 - angle / np.pi) ** depth) ** TREES


def enough(score: np.ndarray, norm: np.ndarray, largest: float) -> np.ndarray:
    """The greatest depth at which a row of that inner product is met with the target's probability."""
    angle = np.arccos(np.clip(score / (norm * largest), -1, 1))
    least = np.log(1 - (1 - TARGET) ** (1 / TREES))
    return np.clip(np.floor(least / np.minimum(np.log1p(-angle / np.pi * (1 - 1e-15)), -1e-300)), 0, BITS).astype(np.int64)


def _near(s: np.ndarray, width: int, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns of each row's ``width`` largest values, rows in which more than these may be among the k largest within the slack)."""
    if s.shape[1] <= width:
        return np.broadcast_to(np.arange(s.shape[1]), s.shape), np.zeros(len(s), bool)
    top = np.argpartition(s, s.shape[1] - width, 1)[:, -width:]
    v = np.take_along_axis(s, top, 1)
    kth = np.partition(v, width - k - 1, 1)[:, width - k - 1]  # the k + 1st, as the query itself may be there
    return top, v.min(1) >= kth - slack


def search_block(block: Block, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, largest: float, k: int, best: tuple[np.ndarray, np.ndarray]) -> None:
    """Merge the block's rows into ``best``: (scores, ids) of each query, best first, -inf and -1 where there are none yet."""
    n, x32 = len(block.ids), x.astype(np.float32)
    norm = np.sqrt((x * x).sum(1))
    slack = 1e-5 * norm * largest
    # descend: the longest prefix at which all trees together hold enough rows
    depth = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    for d in range(min(BITS, max(1, int(np.log2(max(2, n))) + 2)), 0, -1):
        rows = np.zeros(len(live), np.int64)
        for t in range(TREES):
            lo, hi = _ranges(block.codes[t], codes[t, live], d)
            rows += hi - lo
        depth[live[rows >= START * k]] = d
        live = live[rows < START * k]
        if not len(live):
            break
    known = np.flatnonzero(best[1][:, k - 1] >= 0)
    depth[known] = np.maximum(depth[known], enough(best[0][known, k - 1], norm[known], largest))
    live = np.arange(len(x))
    while len(live):  # ascend in all trees at once
        for d in np.unique(depth[live]):
            _meet(block, int(d), live[depth[live] == d], ids, x, x32, codes, slack, k, best)
        worst = np.where(best[1][live, k - 1] >= 0, best[0][live, k - 1], -norm[live] * largest)
        p = met(worst, norm[live], largest, depth[live])
        go = (depth[live] > 0) & (p < TARGET)
        # as the k-th best only rises, two bits at a time while the goal is far
        depth[live] -= np.where(p < TARGET / 2, 2, 1)
        live = live[go]
        depth[live] = np.maximum(depth[live], 0)


def _meet(block: Block, d: int, at: np.ndarray, ids: np.ndarray, x: np.ndarray, x32: np.ndarray, codes: np.ndarray, slack: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> None:
    """Score the rows that share d bits with the queries ``at`` in any tree. Single precision finds those that may count; they are scored exactly."""
    width = 2 * k + 2
    rows = np.full((len(at), TREES * width), -1, np.int64)
    value = np.full(rows.shape, -np.inf, np.float32)
    extra: dict[int, list[np.ndarray]] = {}
    for t in range(TREES if d else 1):  # without bits one tree holds every row
        lo, hi = _ranges(block.codes[t], codes[t, at], d)
        order = np.argsort(lo, kind="stable")
        edges = np.flatnonzero(np.append(True, lo[order[1:]] != lo[order[:-1]]))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            own = order[a:b]
            start, stop = lo[own[0]], hi[own[0]]
            if stop <= start:
                continue
            r = block.order[t, start:stop]
            v = block.single[r]
            for c in range(0, len(own), 256):
                q = own[c : c + 256]
                s = x32[at[q]] @ v.T
                top, more = _near(s, width, k, slack[at[q]])
                cols = slice(t * width, t * width + top.shape[1])
                rows[q, cols] = r[top]
                value[q, cols] = np.take_along_axis(s, top, 1)
                for j in np.flatnonzero(more):
                    kth = np.partition(s[j], len(s[j]) - k - 1)[len(s[j]) - k - 1]
                    extra.setdefault(int(q[j]), []).append(r[s[j] >= kth - slack[at[q[j]]]])
    order = np.argsort(rows, 1)
    rows, value = np.take_along_axis(rows, order, 1), np.take_along_axis(value, order, 1)
    value[:, 1:][rows[:, 1:] == rows[:, :-1]] = -np.inf  # met in several trees
    top, more = _near(value, min(2 * width, value.shape[1]), k, slack[at])
    for i in range(len(at)):
        r = rows[i, top[i]][np.isfinite(value[i, top[i]])] if not more[i] else rows[i][np.isfinite(value[i])]
        if i in extra:
            r = np.unique(np.concatenate([r, *extra[i]]))
        g = at[i]
        r = r[block.ids[r] != ids[g]]
        exact = (block.vectors[r] * x[g]).sum(1)  # the same sum for equal vectors, so that ties are ties
        held = best[1][g] >= 0
        score, who = np.concatenate([best[0][g][held], exact]), np.concatenate([best[1][g][held], block.ids[r]])
        pick = np.lexsort((who, -score))
        score, who = score[pick], who[pick]
        _, firsts = np.unique(who, return_index=True)
        firsts = np.sort(firsts)[:k]
        best[0][g, : len(firsts)], best[1][g, : len(firsts)] = score[firsts], who[firsts]


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = v.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, largest, uri = sizes.dim, float(np.sqrt(sizes.m)), fresh_dir(spark, "forest")
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    blocks = v.where(F.size("embedding") == dim).mapInArrow(_build(uri, dim, largest, every), "block string, n long, queries long").collect()  # one row a block
    blocks = sorted((b.block, b.n, b.queries) for b in blocks)
    runs = [blocks[a : a + RUN] for a in range(0, len(blocks), RUN)]

    def run(batches):
        for t in batches:
            for name, n, a, r in zip(*(t.column(c).to_pylist() for c in ("block", "n", "start", "run"))):
                own = Block(uri, name, n, dim)
                at = np.flatnonzero(own.ids % every == 0)[a : a + QUERIES]
                ids, x = own.ids[at], np.array(own.vectors[at])
                codes = hash_strings(x, np.zeros(len(x)))
                best = np.full((len(at), k), -np.inf), np.full((len(at), k), -1, np.int64)
                for other, m, _ in runs[r]:
                    search_block(Block(uri, other, m, dim), ids, x, codes, largest, k, best)
                has = best[1] >= 0
                yield batch("query_id vec_id score", np.repeat(ids, has.sum(1)), best[1][has], best[0][has])

    asking = [b for b in blocks if b[2]]
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tasks = sum(-(-q // QUERIES) for *_, q in asking) * len(runs)
    listing = spark.createDataFrame(asking, "block string, n long, queries long")  # one row a block; its tasks are made by Spark
    listing = listing.select("block", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("queries") - 1, F.lit(QUERIES).cast("long"))).alias("start"))
    listing = listing.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1))))
    found = listing.repartition(max(1, min(tasks, 10_000)), "block", "start", "run").mapInArrow(run, schema)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))

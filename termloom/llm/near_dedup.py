"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document gets the set of its distinct five-word shingles (64-bit hashes), a 128-bit digest of the set and 80 minimum hashes.
   Documents of equal sets fall together by digest, so copies are never compared.
2. Distinct sets meet in 20 bands of 4 hashes; a pair of similarity 0.85 misses all of them with probability 4e-7, one of 0.8 with 3e-5.
3. First each set is compared with one centre, the smallest set of its buckets. Confirmed pairs are joined to components. Only buckets that
   still hold several components are compared further, only across components. In a large one (look-alikes that share a boilerplate) sets meet again only where they share
   one of their rarest shingles, as many as sets of the similarity have to share one of. Where such a shingle still brings too many together for one task, families
   of sets that share one are compared exactly and in blocks, each pair once (``_families.py``); only links that join components are kept of these.
4. A comparison reads the two signatures batch by batch and drops the pair once the posterior probability (uniform prior) of a similarity of
   at least the limit falls below ``miss``. Survivors are confirmed on their full shingle sets: 100 * intersection >= percent * union.
5. Components of confirmed links; each document gets the smallest doc_id of its component.

Defined cases: documents without words (null, empty, white space) have the empty set, link with nothing and stay; shorter than five words, the
whole sequence is the one shingle; repeated rows are members of the same set, and rows that share an id but not the text are judged by their text; a null id
never becomes a component's name unless there is no other. Columns other than doc_id and text are not read, and the stage passes them through.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.shared import materialize

from . import _families
from . import _vec as V
from ._spark import LOWER, UPPER, batch, row_key, table
from ._tables import store
from .components import connected_components

#: Links hold from 0.8 on unless a caller says otherwise; the query's contract says 0.85.
SHINGLE, PERCENT, PERCENT_OP9 = 5, 80, 85
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
STEP, MISS = 16, 1e-7
BLOCK, SPREAD = 256, 64
#: Shingles that a task gathers before it passes on their counts.
FLUSH = 2 << 20
_rng = np.random.Generator(np.random.PCG64(77))
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of each row, one after the other, and where each row's begin."""
    data, offs = V.buffers(texts)
    s, e, first = V.word_spans(data, offs)
    words = V.hash_spans(data, s, e, lower=True)
    n = np.diff(first)
    w = V.window_hashes(words, size)
    doc = np.repeat(np.arange(len(n)), n)[: len(w)]
    valid = np.arange(len(w)) + size <= first[1:][doc]
    short = np.flatnonzero((n > 0) & (n < size))
    h = np.concatenate([w[valid], V.span_hashes(words, first[short], first[short + 1])])
    d = np.concatenate([doc[valid], short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.searchsorted(d[new], np.arange(len(n) + 1))


def _signatures(batches):
    for b in V.text_slices(batches, budget=V.SMALL_SLICE):
        h, at = shingle_sets(b.column("text"))
        n = np.diff(at)
        has = np.flatnonzero(n)
        sig = np.zeros((b.num_rows, HASHES), np.uint32)
        digest = np.zeros((b.num_rows, 2), np.uint64)
        if len(has):
            v, starts = V._mix(h), at[has]
            for j in range(HASHES):
                sig[has, j] = np.minimum.reduceat((v ^ _XOR[j]) * _MUL[j], starts) >> np.uint64(32)
            digest[has, 0] = np.add.reduceat(V._mix(v + np.uint64(1)), starts)
            digest[has, 1] = np.add.reduceat(V._mix(v ^ np.uint64(0x5851F42D4C957F2D)), starts)
        node = V.binary_array(digest.view(np.uint8).ravel(), np.arange(b.num_rows + 1) * 16)
        yield batch("doc_id text_key node n sig", b.column("__id"), b.column("__text"), node, n.astype(np.int64), V.binary_array(sig.view(np.uint8).ravel(), np.arange(b.num_rows + 1) * 4 * HASHES))


def _matrix(a: pa.Array, kind, width: int) -> np.ndarray:
    data, _ = V.buffers(a)
    return data.view(kind).reshape(len(a), width)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, bands) keys of a (rows, hashes) signature matrix."""
    x = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for j in range(ROWS):
        out = V._mix(out * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
    return out


def _bands(batches):
    for b in batches:
        if b.num_rows:
            keys = band_keys(_matrix(b.column("sig"), np.uint32, HASHES))
            rep = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            yield batch("band node", keys.ravel().view(np.int64), b.column("node").take(rep))


@cache
def thresholds(percent: int, step: int = STEP, hashes: int = HASHES, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest equal hashes at which the posterior of similarity >= percent/100 is at least ``miss``."""
    t = percent / 100

    def tail(s: int, m: int) -> float:  # P(J >= t) for Beta(s + 1, m - s + 1)
        return sum(comb(m + 1, j) * t**j * (1 - t) ** (m + 1 - j) for j in range(s + 1))

    return tuple(next(s for s in range(m + 1) if tail(s, m) >= miss) for m in range(step, hashes + 1, step))


def survivors(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs (rows of two signature matrices) pass the length bound and every batch."""
    live = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    same = np.zeros(len(live), np.int64)
    for k, least in enumerate(thresholds(percent)):
        part = slice(k * STEP, (k + 1) * STEP)
        same += (a[live, part] == b[live, part]).sum(1)
        keep = same >= least
        live, same = live[keep], same[keep]
    return live


def _prune(percent: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                ok = pa.array(survivors(_matrix(b.column("sig_a"), np.uint32, HASHES), _matrix(b.column("sig_b"), np.uint32, HASHES), b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), percent))
                yield batch("a b", b.column("a").take(ok), b.column("b").take(ok))

    return run


def _confirm(percent: int):
    """Rows come by centre: its text first (role 0), then those to compare with it."""

    def run(batches):
        centre = None
        for b in V.text_slices(batches, budget=V.SMALL_SLICE):
            h, at = shingle_sets(b.column("text"))
            roles, ok = b.column("role").to_numpy(), []
            for i in range(b.num_rows):
                own = h[at[i] : at[i + 1]]
                if roles[i] == 0:
                    centre = own.copy()
                else:
                    slot = np.searchsorted(centre, own)
                    both = int((centre[np.minimum(slot, len(centre) - 1)] == own).sum())
                    if 100 * both >= percent * (len(centre) + len(own) - both):
                        ok.append(i)
            ok = pa.array(ok, pa.int64())
            yield batch("a b", b.column("key").take(ok), b.column("node").take(ok))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on their full sets. A centre's partners are spread over up to 64 groups and streamed."""
    p = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(SPREAD)))
    wanted = p.select(F.col("a").alias("key"), "chunk", F.col("a").alias("node"), F.lit(0).alias("role")).distinct().union(p.select("a", "chunk", "b", F.lit(1)))
    rows = wanted.join(texts, "node").select("key", "chunk", "role", "node", "text")
    rows = rows.repartition(F.col("key"), F.col("chunk")).sortWithinPartitions("key", "chunk", "role")
    return rows.select("key", "role", "node", "text").mapInArrow(_confirm(percent), "a binary, b binary")


def _across(percent: int):
    """Pairs of different components, and not of one family, in each (band, kind) group that pass the signatures; the group's rows come together."""

    def group(rows: pa.Table):
        band = rows.column("band")[0].as_py()
        sig = _matrix(rows.column("sig").combine_chunks(), np.uint32, HASHES)
        n, family = rows.column("n").to_numpy(), rows.column("family").to_numpy()
        _, label = np.unique(np.array(rows.column("label").to_pylist(), dtype=object), return_inverse=True)
        keys = band_keys(sig)
        which = np.flatnonzero((keys[0].view(np.int64) == band) & (rows.column("kind")[0].as_py() == 0))  # no band if they met by a shingle
        which = int(which[0]) if len(which) else 0
        nodes = rows.column("node").combine_chunks()
        out_a, out_b = [], []
        for x in range(len(n)):
            y = np.arange(x + 1, len(n))
            y = y[(label[y] != label[x]) & ((family[y] != family[x]) | (family[x] == 0))]
            y = y[~(keys[y][:, :which] == keys[x][:which]).any(1)]  # the first common band alone reports a pair
            if len(y):
                ok = y[survivors(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y], np.full(len(y), n[x]), n[y], percent)]
                out_a += [x] * len(ok)
                out_b += ok.tolist()
        a, b = nodes.take(pa.array(out_a, pa.int64())), nodes.take(pa.array(out_b, pa.int64()))
        return batch("a b", a, b)

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("band", "kind")])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                now = tuple(ids[:, s])
                if held and now != last:
                    yield group(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
                last = now
        if held:
            yield group(pa.Table.from_batches(held))

    return run


def _count_shingles(batches):
    """(key, n): in how many sets a shingle is, summed in tasks."""
    held, size = [], 0
    for b in V.text_slices(batches, budget=V.SMALL_SLICE):
        held.append(shingle_sets(b.column("text"))[0])
        size += len(held[-1])
        if size >= FLUSH:
            k, n = np.unique(np.concatenate(held), return_counts=True)
            yield batch("key n", k.view(np.int64), n)
            held, size = [], 0
    if size:
        k, n = np.unique(np.concatenate(held), return_counts=True)
        yield batch("key n", k.view(np.int64), n)


def prefix_of(h: np.ndarray, at: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each set's prefix: its rarest shingles, so many that two sets of the similarity share one of them; those of one set alone are left out."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, often, row))
    length = n - -(-percent * n // 100) + 1
    take = order[np.arange(len(order)) - at[:-1][row] < length[row]]
    take = take[often[take] > 1]
    return row[take], take


def _shingle_buckets(large: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of buckets that are too large to compare all: they meet again by the shingles of their prefixes, the rarest first, so that what a boilerplate shares brings nobody together.

    (band, node, size, label, kind): shingles as ``band`` (kind 1) in which several components meet; (band, node): those of them that are too large again."""
    own = texts.join(large, "node", "left_semi")
    counts = own.mapInArrow(_count_shingles, "key long, n long").groupBy("key").agg(F.sum("n").alias("value")).where("value > 1")
    often = store(counts, "near-shingles", "i8")

    def run(batches):
        for b in V.text_slices(batches, budget=V.SMALL_SLICE):
            h, at = shingle_sets(b.column("text"))
            row, place = prefix_of(h, at, often.lookup(h, 1), percent)
            yield batch("band node", h[place].view(np.int64), b.column("node").take(pa.array(row)))

    met = materialize(own.mapInArrow(run, "band long, node binary").join(large, "node"), "near-prefixes")
    several = met.groupBy("band").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band", "size")
    several = materialize(several, "near-several")
    hot = met.join(several.where(F.col("size") > BLOCK), "band").select("band", "node")
    return met.join(several.where(F.col("size") <= BLOCK), "band").select("band", "node", "size", "label", F.lit(1).alias("kind")), materialize(hot, "near-hot")


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, labels, confirmed): each row's set, the distinct sets, their components, and the confirmed links."""
    keyed = docs.select(*row_key(F.col("doc_id").cast("long"), F.col("text")), "text")
    rows = materialize(keyed.mapInArrow(_signatures, "doc_id long, text_key long, node binary, n long, sig binary"), "near-rows")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = materialize(nodes.select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"), "n", "sig"), "near-nodes")
    bands = materialize(nodes.select("node", "sig").mapInArrow(_bands, "band long, node binary"), "near-bands")
    buckets = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("centre")).where("size > 1")
    members = materialize(bands.join(buckets, "band"), "near-members")
    met = members.select("node").distinct()
    wanted = nodes.join(met, "node").select("node", F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"))
    texts = keyed.join(wanted, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__text") == F.col("__t"))).select("node", "text").dropDuplicates(["node"])
    texts = materialize(texts, "near-texts")
    sides = [nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}")) for s in "ab"]
    stars = members.where("node != centre").groupBy("node").agg(F.min("centre").alias("a")).withColumnRenamed("node", "b")
    stars = stars.join(sides[1], "b").join(sides[0], "a").mapInArrow(_prune(percent), "a binary, b binary")
    first = materialize(confirm(stars, texts, percent), "near-links")
    labels = connected_components(first)
    # buckets in which several components are left
    tagged = members.join(labels, "node", "left").select("band", "node", "size", F.coalesce("component", "node").alias("label"))
    tagged = materialize(tagged, "near-tagged")
    open_ = tagged.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band")
    left = tagged.join(open_, "band", "left_semi").select("band", "node", "size", "label", F.lit(0).alias("kind"))
    large = materialize(left.where(F.col("size") > BLOCK).select("node", "label").distinct(), "near-large")
    by_shingle, hot = _shingle_buckets(large, texts, percent)
    left = left.where(F.col("size") <= BLOCK).unionByName(by_shingle).join(nodes.select("node", "n", "sig"), "node")
    families = None if hot.isEmpty() else materialize(_families.named(hot), "near-families")
    if families is None:
        left = left.withColumn("family", F.lit(0).cast("long"))
    else:  # compared as a whole
        left = left.join(families, "node", "left").withColumn("family", F.coalesce("family", F.lit(0).cast("long")))
    left = left.repartition("band", "kind").sortWithinPartitions("band", "kind", "node")
    pairs = materialize(left.select("band", "kind", "node", "label", "n", "sig", "family").mapInArrow(_across(percent), "a binary, b binary"), "near-pairs")
    second = materialize(confirm(pairs.distinct(), texts, percent), "near-links")
    confirmed = first.union(second)
    if families is not None:
        confirmed = confirmed.union(materialize(_families.links(families, nodes, large, texts, percent, shingle_sets), "near-links"))
    return rows, nodes, connected_components(confirmed), confirmed


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, text_key, n_shingles, component_id, kept."""
    rows, nodes, labels, _ = links(docs, percent)
    named = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = named.select("node", "component").join(names, "component").select("node", "component_id")
    out = rows.select("doc_id", "text_key", F.when(F.col("n") > 0, F.col("node")).alias("node"), "n").join(by_node, "node", "left")
    name = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), PERCENT_OP9).drop("text_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one of the smallest id; of rows with the same id and text one stays."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).distinct()
    key, text = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(*[docs[c] for c in docs.columns], key, text)
    return keyed.join(kept, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__text") == F.col("__t")), "left_semi").dropDuplicates(["__id", "__text"]).select(*docs.columns)


ORACLE = rf"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, array_to_string(w[s:s + 4], ' ') as t from (select doc_id, w, unnest(generate_series(1, case when len(w) = 0 then 0 else greatest(len(w) - 4, 1) end)) as s from d)),
size as (select doc_id, count(*) as n from sh group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.t = b.t and a.doc_id <> b.doc_id group by all),
link as (select a, b from both_ join size x on x.doc_id = a join size y on y.doc_id = b where 100 * k >= {PERCENT_OP9} * (x.n + y.n - k)),
reach(a, b) as (select doc_id, doc_id from d union select reach.a, link.b from reach join link on reach.b = link.a),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from d left join size using (doc_id) left join c using (doc_id)
"""

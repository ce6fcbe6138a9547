"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Training. Each labelled training row counts once for each distinct word that it holds. Rows are grouped by their smallest five-word
shingle hash, and a group of copies weighs as one row, so that a text copied a thousand times does not make its ordinary words look toxic. Two thirds of
the groups teach the words, one third the calibration. Every word of the former gets its log-odds between toxic and clean rows under Dirichlet priors of ``prior``
pseudo-rows, shared between the classes as their words are; its score is the lower posterior bound of that, ``z`` deviations below, so that a word that
says nothing lowers a passage a little. A word never seen scores the bound of the prior alone. All words' scores lie in a sorted table in the shared folder.

Scoring. A scan that is linear in the words finds all maximal scoring segments of a document (Ruzzo and Tompa, with links back to the nearest lower
start). A segment of score S in a document of n words has the extreme-value statistic lambda*S - ln(K*n): lambda solves sum(p*exp(lambda*s)) = 1
for the words of clean rows, K is the rate of segments in the clean rows of the calibration third, taken where as many segments are as count by chance (0.05 a row): the few
clean rows that hold toxic passages, by a wrong label or in another sense, are all that lies farther out, and they don't fix K however many there are in a large table. The document's statistic is the sum over its
significant segments, those that clean rows of that length have less than 0.05 times. An isotonic fit over all calibration rows, from a histogram of fixed bins, turns it into a probability.

Defined cases: null and empty texts have no segments and get the score of that statistic (0); repeated rows count as rows; where one of the two parts has no rows of
a class, the calibration takes all labelled rows; without any labelled training row every score is 0.5 and nothing is predicted toxic; other columns are not read. A very
long text is scanned in one pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.plans.shared import materialize

from . import _vec as V
from ._spark import batch, held_out, table
from ._tables import Table, store

#: Pseudo-rows of a word's prior, and deviations from its log-odds to their bound.
PRIOR, Z = 20.0, 2.5
#: One in so many groups of copies is for the calibration.
CALIBRATE = 3
#: Least statistic of a significant segment: clean rows of that length have less than 0.05 such segments.
SIGNIFICANT = 3.0
CUT = 0.7
_BIN, _BINS = 0.25, 400
#: Bins of word scores and of segment statistics.
_SCORE_BIN, _TAIL_BIN = 0.01, 0.5
#: Weighted segments of clean rows that the tail has to hold for K: so many, and so many a row.
_TAIL, _TAIL_SHARE = 30, math.exp(-SIGNIFICANT)

#: All ASCII but letters and digits separates words here, so that punctuation doesn't hide a word.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = True
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


@dataclass(frozen=True)
class Model:
    table: Table | None  # a word's score
    unknown: float
    lam: float
    log_k: float
    knots: np.ndarray  # statistic
    values: np.ndarray  # probability

    @property
    def words(self) -> np.ndarray:
        """Hashes of the words that are telling by themselves (score from 1.5 on), read from the table; for inspection."""
        if self.table is None:
            return np.zeros(0, np.uint64)
        at = np.arange(len(self.table))
        scores = self.table.values(at, 0.0)
        keys = [self.table._file(k, "key") for k in np.flatnonzero(self.table.counts)]
        return np.concatenate([np.zeros(0, np.uint64), *keys])[scores >= 1.5]


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = V.buffers(texts)
    s, e, first = V.word_spans(data, offs, SEPARATORS)
    return V.hash_spans(data, s, e, lower=True), first


def _group_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Smallest hash of five consecutive words in each row (of the whole row, if shorter)."""
    n = np.diff(first)
    h = V.window_hashes(words, 5)
    out = np.zeros(len(n), np.uint64)
    for i in range(len(n)):
        a, b = first[i], first[i + 1]
        if b - a >= 5:
            out[i] = h[a : b - 4].min()
        elif b > a:
            out[i] = V.span_hashes(words[a:b], np.array([0]), np.array([b - a]))[0]
    return out


def _labelled(batches, labels: Table):
    """(slice, label) of the rows that have a label; ids are looked up, so that no text is shuffled."""
    for b in V.text_slices(batches):
        ids = b.column("doc_id")
        label = labels.lookup(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).view(np.uint64), -1)
        label[~ids.is_valid().to_numpy(zero_copy_only=False)] = -1
        has = np.flatnonzero(label >= 0)
        if len(has):
            yield b.column("text").take(pa.array(has)), label[has]


def _group(keys: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    return (keys & ~np.uint64(1)) | (toxic == 1).astype(np.uint64)


def _groups(labels: Table):
    """How many labelled rows share a group key and label."""

    def run(batches):
        for texts, toxic in _labelled(batches, labels):
            u, n = np.unique(_group(_group_keys(*_hashes(texts)), toxic), return_counts=True)
            yield batch("key n", u.view(np.int64), n)

    return run


def _side(keys: np.ndarray) -> np.ndarray:
    """Which groups of copies are for the calibration."""
    return V._mix(keys ^ np.uint64(0x5BD1E995)) % np.uint64(CALIBRATE) == 0


def _presence(labels: Table, sizes: Table):
    """Weighted numbers of toxic and clean rows that hold a word, outside the calibration."""

    def run(batches):
        for texts, toxic in _labelled(batches, labels):
            words, first = _hashes(texts)
            keys = _group_keys(words, first)
            weight = np.where(_side(keys), 0.0, 1.0 / sizes.lookup(_group(keys, toxic), 1))
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            order = np.lexsort((words, doc))
            w, d = words[order], doc[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
            w, d = w[new], d[new].astype(np.int64)
            w, d = w[weight[d] > 0], d[weight[d] > 0]
            u, inv = np.unique(w, return_inverse=True)
            yield batch("word t c", u.view(np.int64), np.bincount(inv, weight[d] * (toxic[d] == 1), len(u)), np.bincount(inv, weight[d] * (toxic[d] != 1), len(u)))

    return run


def segments(scores: np.ndarray, at: np.ndarray, other: float | np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence in which positions ``at`` (ascending) have the positive ``scores``: (start, end, score), end exclusive.

    All others score ``other`` <= 0, or ``other`` has the sum of all scores before each of the positions. Each segment links to the nearest one before it
    that begins lower, so that the list is never searched twice: the time is linear in the positions."""
    if not isinstance(other, np.ndarray):
        own = np.concatenate([[0.0], np.cumsum(scores)])[:-1]
        other = own + other * (at - np.arange(len(at)))
    begin, end, left, right, link = [], [], [], [], []
    for p, low, high in zip(at.tolist(), other.tolist(), (other + scores).tolist()):
        a, j = p, len(begin) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                break
            a, low = begin[j], left[j]  # it grows to the left, over all segments from j on
            del begin[j:], end[j:], left[j:], right[j:]
            j = link[j]
            del link[len(begin) :]
        begin.append(a)
        end.append(p + 1)
        left.append(low)
        right.append(high)
        link.append(j)
    return list(zip(begin, end, [r - x for r, x in zip(right, left)]))


def scored_segments(texts: pa.Array, model: Model):
    """(number of words of each row, (row, start, end, score) of all maximal segments)."""
    words, first = _hashes(texts)
    out = []
    if model.table is not None and len(words):
        scores = model.table.lookup(words, model.unknown)
        hit = np.flatnonzero(scores > 0)
        before = np.concatenate([[0.0], np.cumsum(scores)])[:-1]
        row = np.searchsorted(first, hit, "right") - 1
        edges = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(hit) else []
        for a, b in zip(edges, [*edges[1:], len(hit)]):
            i = int(row[a])
            out += [(i, s, e, x) for s, e, x in segments(scores[hit[a:b]], hit[a:b] - first[i], before[hit[a:b]])]
    return np.diff(first), out


def passages(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Statistic of each row, and its significant passages as (first word, end word, extreme-value statistic)."""
    n, found = scored_segments(texts, model)
    stat, out = np.zeros(len(n)), [[] for _ in range(len(n))]
    for i, start, end, s in found:
        e = model.lam * s - model.log_k - math.log(n[i])
        if e > SIGNIFICANT:
            out[i].append((start, end, e))
            stat[i] += e
    return stat, out


def _calibration(batches, labels: Table, sizes: Table, everything: bool):
    """(texts, label, weight) of the calibration's rows."""
    for texts, toxic in _labelled(batches, labels):
        keys = _group_keys(*_hashes(texts))
        weight = 1.0 / sizes.lookup(_group(keys, toxic), 1)
        take = np.flatnonzero(_side(keys) | everything)
        if len(take):
            yield texts.take(pa.array(take)), toxic[take], weight[take]


def _tails(model: Model, labels: Table, sizes: Table, everything: bool):
    """Rows (bin -2), words (bin -1) and segments by lambda * S of clean rows, weighted."""

    def run(batches):
        for texts, toxic, weight in _calibration(batches, labels, sizes, everything):
            weight = np.where(toxic == 1, 0.0, weight)
            n, found = scored_segments(texts, model)
            bins = np.array([-2, -1, *(int(model.lam * s / _TAIL_BIN) for *_, s in found)], np.int64)
            values = np.array([weight.sum(), (n * weight).sum(), *(weight[i] for i, *_ in found)])
            u, inv = np.unique(bins, return_inverse=True)
            yield batch("bin n", u, np.bincount(inv, values))

    return run


def _statistics(model: Model, labels: Table, sizes: Table, everything: bool):
    def run(batches):
        for texts, toxic, weight in _calibration(batches, labels, sizes, everything):
            stat, _ = passages(texts, model)
            bins = np.minimum(np.ceil(stat / _BIN), _BINS).astype(np.int64)
            pairs, inv = np.unique(bins * 2 + (toxic == 1), return_inverse=True)
            yield batch("bin toxic n", pairs // 2, pairs % 2, np.bincount(inv, weight))

    return run


def _lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * s)) = 1 for a distribution p of scores s; a small one where the mean isn't negative, a large one without positive scores."""
    if (p * s).sum() >= 0:
        return 0.1
    f = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum()) - 1
    lo, hi = 1e-6, 0.01
    while f(hi) < 0 and hi < 20:
        lo, hi = hi, hi * 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def tail_constant(bins: np.ndarray, n: np.ndarray, least: float = _TAIL) -> float:
    """ln K: so many segments a word reach x as K * exp(-x) says, at the highest x that at least ``least`` of them reach."""
    words = float(n[bins < 0].sum())
    order = np.argsort(-bins[bins >= 0])
    x, reached = bins[bins >= 0][order] * _TAIL_BIN, np.cumsum(n[bins >= 0][order])
    if not words or not len(x) or not reached[-1]:
        return 0.0
    k = min(int(np.searchsorted(reached, least)), len(x) - 1)
    return float(np.log(reached[k]) + x[k] - np.log(words))


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted pool-adjacent-violators fit, non-decreasing."""
    blocks: list[list[float]] = []
    for a, b in zip(y, n):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], t)]
    return np.concatenate([np.full(int(k), a / b) for a, b, k in blocks])


def log_odds(t: Column, c: Column, share: float, prior: float = PRIOR, z: float = Z) -> Column:
    """Lower posterior bound of the log-odds of a word in so many toxic and clean rows, where toxic rows have that share of all."""
    x, y = t + prior * share, c + prior * (1 - share)
    return F.log(x / y) - math.log(share / (1 - share)) - z * F.sqrt(1 / x + 1 / y)


def train(docs: DataFrame, labels: DataFrame, prior: float = PRIOR, z: float = Z) -> Model:
    """Fit on the rows of docs (doc_id, text) that labels (doc_id, toxic) name; of several labels of an id the highest counts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.col("toxic") == 1).cast("tinyint").alias("value"))
    known = store(own, "toxic-labels", "i1")
    sizes = materialize(rows.mapInArrow(_groups(known), "key long, n long").groupBy("key").agg(F.sum("n").alias("value")), "toxic-sizes")
    copies = store(sizes.where("value > 1"), "toxic-groups", "f8")
    counts = rows.mapInArrow(_presence(known, copies), "word long, t double, c double").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = materialize(counts, "toxic-counts")
    total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    nt, nc = total["t"] or 0.0, total["c"] or 0.0
    if nt and nc:
        share = nt / (nt + nc)
        scored = counts.select("word", "c", log_odds(F.col("t"), F.col("c"), share, prior, z).alias("value"))
        words = store(scored.select(F.col("word").alias("key"), "value"), "toxic-words", "f8")
        hist = scored.groupBy(F.floor(F.col("value") / _SCORE_BIN).alias("bin")).agg(F.sum(F.col("c") + 0.5).alias("c")).toPandas()  # one row a bin; half a row for words that clean rows lack
        lam = _lambda(hist["c"].to_numpy() / hist["c"].sum(), (hist["bin"].to_numpy() + 0.5) * _SCORE_BIN)
        model = Model(words, -z * math.sqrt(1 / (prior * share) + 1 / (prior * (1 - share))), lam, 0.0, np.zeros(1), np.full(1, 0.5))
    else:
        model = Model(None, 0.0, 1.0, 0.0, np.zeros(1), np.full(1, 0.5))
    tails = statistics = None
    for everything in (False, True):
        tails = rows.mapInArrow(_tails(model, known, copies, everything), "bin long, n double").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
        bins, n = tails["bin"].to_numpy(), tails["n"].to_numpy()
        model = replace(model, log_k=tail_constant(bins[bins > -2], n[bins > -2], max(_TAIL, _TAIL_SHARE * n[bins == -2].sum())))
        statistics = rows.mapInArrow(_statistics(model, known, copies, everything), "bin long, toxic long, n double").groupBy("bin", "toxic").agg(F.sum("n").alias("n")).toPandas()
        if statistics["toxic"].nunique() == 2:
            break
    if not len(statistics):
        return model
    y, n = np.zeros(_BINS + 1), np.zeros(_BINS + 1)
    for b, t, k in statistics.itertuples(index=False):
        y[int(b)] += t * k
        n[int(b)] += k
    used = np.flatnonzero(n)
    fit = isotonic(y[used] + 0.1 * y.sum() / n.sum(), n[used] + 0.1)
    return replace(model, knots=used * _BIN, values=fit)


def _score(model: Model, keep: list[str]):
    def run(batches):
        for b in V.text_slices(batches):
            stat, found = passages(b.column("text"), model)
            p = np.interp(stat, model.knots, model.values)
            arrays = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(p), pa.array([len(x) for x in found], pa.int32())], [*keep, "__score", "__passages"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but none lost, in order) with ``__score`` and ``__passages``; docs need a ``text`` column."""
    keep = docs.columns if keep is None else keep
    schema = docs.select(*keep).schema.add("__score", T.DoubleType()).add("__passages", T.IntegerType())
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_score(model, keep), schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels outside the held-out third."""
    return labels.where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "toxic")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= CUT).cast("int").alias("predicted"), F.col("__passages").alias("n_passages"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. The classifier is fitted on the labelled rows of the stage's own input."""
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, model).where(F.col("__score") < CUT).select(*docs.columns)

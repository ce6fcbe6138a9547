"""Substring dedup: repeated word sequences by De Bruijn compaction.

Windows of 35 words are the edges of a De Bruijn graph whose nodes are the 34 words that neighbouring windows share.

1. Consecutive windows with the same minimizer (the smallest hash of 16 words in them) are an unbranched run of at most 20 edges, one path. Equal windows
   have equal minimizers at equal places, so paths are counted by content; pre-aggregated in every task. A path whose content occurs again repeats
   whole. Where a minimizer has several contents, the single windows of these are edges of their own and are counted too.
2. Compaction: repeated paths follow each other in the sources. Joins of these links with both ends' counts find the links without a branch, those that
   occur as often as either end. A path that no such link leads to is the head of a span; the others continue the span of their predecessor.
3. Source coordinates: at every place of a head, the source is cut into the span from there to the next head or the last repeated path. The span's place, its
   length and a second, independent hash of its very words are counted; spans of equal head and equal hashes are the same words.
4. A last pass over the documents cuts them into spans again and removes those that occur at least twice by step 3, and the repeated single windows.

What the passes look up is in sorted tables in the shared folder, mapped by executors: no window travels to the driver and nothing is broadcast. Counts are
summed in tasks and then by Spark on the whole key, so a minimizer of many contents (boilerplate with a varying field) is no hot group.

Defined cases: null and empty texts have no words and keep none; texts of fewer than 35 words lose nothing; a window that recurs in its own document
counts as repeated; repeated rows repeat each other's windows; an empty table gives an empty result. Only doc_id and text are read. A very long text is worked
on whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.shared import materialize, release

from . import _vec as V
from ._spark import batch, table
from ._tables import Table, store

WINDOW, MINIMIZER = 35, 16
#: Rows that a task gathers before it passes on what it has aggregated.
FLUSH = 1 << 21
_POS = 26


class Paths:
    """The paths of a slice: windows ``start`` .. ``start + n - 1`` (word numbers) share the minimizer ``key``."""

    def __init__(self, texts: pa.Array, window: int, minimizer: int):
        self.data, offs = V.buffers(texts)
        self.starts, self.ends, self.first = V.word_spans(self.data, offs)
        self.words = V.hash_spans(self.data, self.starts, self.ends)
        self.window = window
        m, span = V.window_hashes(self.words, minimizer), window - minimizer + 1
        count = len(self.words) - window + 1
        if count <= 0:
            self.start = self.n = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        low = np.uint64((1 << _POS) - 1)
        x = (m & ~low) | (np.arange(len(m), dtype=np.uint64) & low)  # ties go to the first
        width = 1
        while width * 2 <= span:
            x = np.minimum(x[:-width], x[width:])
            width *= 2
        if width < span:
            x = np.minimum(x[: len(x) - (span - width)], x[span - width :])
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[:count]
        at = np.flatnonzero(np.arange(count) + window <= self.first[1:][doc])
        p, d = x[at] & low, doc[at]
        new = np.ones(len(at), bool)
        new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
        edge = np.flatnonzero(new)
        self.start = at[edge]
        self.n = np.diff(np.append(edge, len(at)))
        place = (self.start & ~np.int64(low)) | p[edge].astype(np.int64)
        self.key = m[np.where(place < self.start, place + (1 << _POS), place)]

    def contents(self, seed: int = 0, words: np.ndarray | None = None) -> np.ndarray:
        return V.span_hashes(self.words if words is None else words, self.start, self.start + self.n + self.window - 1, seed)

    def adjacent(self) -> np.ndarray:
        """Whether each path but the first follows the one before it in the same text."""
        return self.start[1:] == self.start[:-1] + self.n[:-1]

    def second(self) -> np.ndarray:
        return V.hash_spans(self.data, self.starts, self.ends, seed=1)


def _sum_by(keys: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a representative, sum of n) of each distinct key tuple."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    edge = np.flatnonzero(new)
    return order[edge], (np.add.reduceat(n[order], edge) if len(edge) else n[:0])


def _count_paths(window: int, minimizer: int):
    def flush(parts):
        key, content = (np.concatenate(x) for x in zip(*parts))
        rep, n = _sum_by([content], np.ones(len(key), np.int64))  # equal contents have equal keys
        return batch("key content n", key[rep].view(np.int64), content[rep].view(np.int64), n)

    def run(batches):
        parts, held = [], 0
        for b in V.text_slices(batches):
            p = Paths(b.column("text"), window, minimizer)
            if len(p.start):
                parts.append((p.key, p.contents()))
                held += len(p.start)
            if held >= FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


@dataclass
class Repeats:
    """What is known of repeats: paths that occur again, minimizers of several contents, and, when found, heads, spans and single windows."""

    paths: Table
    several: Table
    follows: Table | None = None  # paths that continue a span
    spans: Table | None = None  # spans that occur again
    windows: Table | None = None  # windows that occur again, with their second hash


def _windows_and_links(window: int, minimizer: int, known: Repeats):
    """Windows of paths whose minimizer has several contents (kind 0), and successions of repeated paths (kind 1)."""

    def flush(windows, links):
        if windows:
            key, second, n = (np.concatenate(x) for x in zip(*windows))
            rep, total = _sum_by([key, second], n)
            single = np.zeros(len(key), np.int64)
            single[n == 1] = 1
            _, any_single = _sum_by([key, second], single)
            yield batch("kind a b n m", np.zeros(len(rep), np.int8), key[rep].view(np.int64), second[rep].view(np.int64), np.minimum(total, 2), np.minimum(any_single, 1))
        if links:
            a, b = (np.concatenate(x) for x in zip(*links))
            rep, total = _sum_by([a, b], np.ones(len(a), np.int64))
            yield batch("kind a b n m", np.ones(len(rep), np.int8), a[rep].view(np.int64), b[rep].view(np.int64), total, np.zeros(len(rep), np.int64))

    def run(batches):
        windows, links, held = [], [], 0
        for b in V.text_slices(batches):
            p = Paths(b.column("text"), window, minimizer)
            if not len(p.start):
                continue
            content = p.contents()
            full = known.paths.find(content) >= 0
            next_to = np.flatnonzero(full[:-1] & full[1:] & p.adjacent())
            if len(next_to):
                links.append((content[next_to], content[next_to + 1]))
                held += len(next_to)
            probe = np.flatnonzero(known.several.find(p.key) >= 0)
            if len(probe):
                at = V.ragged(p.start[probe], p.n[probe])
                n = np.where(np.repeat(full[probe], p.n[probe]), 2, 1)
                windows.append((V.span_hashes(p.words, at, at + window), V.span_hashes(p.second(), at, at + window, 1), n))
                held += len(at)
            if held >= FLUSH:
                yield from flush(windows, links)
                windows, links, held = [], [], 0
        yield from flush(windows, links)

    return run


def spans_of(p: Paths, known: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, identity) of the compacted spans of a slice, in words, and which paths are repeated.

    A span begins at a head and runs over the adjacent repeated paths that continue it; its identity is a hash of the head, its length and the second hash of its words."""
    content = p.contents()
    full = known.paths.find(content) >= 0
    led = np.zeros(len(full), bool)  # a repeated path is right before it
    led[1:] = full[:-1] & p.adjacent()
    head = full & ((known.follows.find(content) < 0) | ~led)
    begins = np.flatnonzero(head)
    if not len(begins):
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64), full
    goes_on = full & ~head
    stops = np.flatnonzero(np.append(~goes_on[1:], True))
    last = stops[np.searchsorted(stops, begins)]
    start, end = p.start[begins], p.start[last] + p.n[last] + p.window - 1
    own = V._mix(content[begins] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return start, end, V._mix(own ^ V.span_hashes(p.second(), start, end, 1)), full


def _count_spans(window: int, minimizer: int, known: Repeats):
    def run(batches):
        held, size = [], 0
        for b in V.text_slices(batches):
            held.append(spans_of(Paths(b.column("text"), window, minimizer), known)[2])
            size += len(held[-1])
            if size >= FLUSH:
                k, n = np.unique(np.concatenate(held), return_counts=True)
                yield batch("key n", k.view(np.int64), n)
                held, size = [], 0
        if size:
            k, n = np.unique(np.concatenate(held), return_counts=True)
            yield batch("key n", k.view(np.int64), n)

    return run


def repeated_words(p: Paths, known: Repeats) -> np.ndarray:
    """Which words a repeated window covers."""
    start, end, identity, full = spans_of(p, known)
    cover = np.zeros(len(p.words) + 1, np.int64)
    again = np.flatnonzero(known.spans.find(identity) >= 0)
    np.add.at(cover, start[again], 1)
    np.add.at(cover, end[again], -1)
    probe = np.flatnonzero(~full)
    probe = probe[known.several.find(p.key[probe]) >= 0]
    at = V.ragged(p.start[probe], p.n[probe])
    if len(at):
        number = known.windows.find(V.span_hashes(p.words, at, at + p.window))
        at, number = at[number >= 0], number[number >= 0]
        at = at[known.windows.values(number, 0) == V.span_hashes(p.second(), at, at + p.window, 1).view(np.int64)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + p.window, -1)
    return np.cumsum(cover[:-1]) > 0


def _kept_text(p: Paths, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each row's kept words joined by one space."""
    doc = np.repeat(np.arange(len(p.first) - 1), np.diff(p.first))
    k = np.flatnonzero(kept)
    rows = len(p.first) - 1
    inner = np.zeros(len(k), bool)  # another kept word of the same row follows
    inner[:-1] = doc[k[1:]] == doc[k[:-1]]
    mark = np.zeros(len(p.data) + 1, "i1")
    mark[p.starts[k]] = 1
    np.add.at(mark, p.ends[k], -1)
    take = np.cumsum(mark[:-1], dtype=np.int8) > 0
    gaps = p.ends[k[inner]]
    data = p.data.copy()
    data[gaps] = 32
    take[gaps] = True
    length = np.bincount(doc[k], p.ends[k] - p.starts[k] + inner, rows).astype(np.int64)
    return data[take], np.concatenate([[0], np.cumsum(length)])


def _remove(window: int, minimizer: int, known: Repeats):
    def run(batches):
        for b in V.text_slices(batches):
            p = Paths(b.column("text"), window, minimizer)
            gone = repeated_words(p, known)
            data, offs = _kept_text(p, ~gone)
            total = np.concatenate([[0], np.cumsum(gone)])
            yield batch("doc_id n_words n_removed text", b.column("doc_id"), np.diff(p.first), total[p.first[1:]] - total[p.first[:-1]], V.binary_array(data, offs, pa.string()))

    return run


def compact(links: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths that continue a span: a link without a branch leads to them.

    ``links`` (a, b, n) count how often path b follows path a; ``paths`` (path, n) count occurrences. A link that occurs as often as both of its ends is
    the only way out of the one and the only way into the other.
    """
    na, nb = paths.select(F.col("path").alias("a"), F.col("n").alias("n_a")), paths.select(F.col("path").alias("b"), F.col("n").alias("n_b"))
    return links.join(na, "a").where("n = n_a").join(nb, "b").where("n = n_b").select(F.col("b").alias("path"))


def find_repeats(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> Repeats:
    """Repeated spans and windows of a table with ``text``."""
    spark, texts = docs.sparkSession, docs.where("text is not null").select("text")
    paths = texts.mapInArrow(_count_paths(window, minimizer), "key long, content long, n long")
    paths = materialize(paths.groupBy("content").agg(F.sum("n").alias("n"), F.first("key").alias("key")), "paths")
    again = paths.where("n > 1").select(F.col("content").alias("key"), "n")
    several = paths.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1").select("key")
    known = Repeats(store(again, "repeated-paths", {}), store(several, "minimizers", {}))
    seen = materialize(texts.mapInArrow(_windows_and_links(window, minimizer, known), "kind byte, a long, b long, n long, m long"), "path-windows")
    windows = seen.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("m").alias("m")).where("n > 1 and m > 0")
    windows = windows.groupBy(F.col("a").alias("key")).agg(F.max_by("b", F.struct("n", "b")).alias("value"))  # one for each first hash
    known.windows = store(windows, "windows", "i8")
    links = seen.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n"))
    known.follows = store(compact(links, again.select(F.col("key").alias("path"), "n")).select(F.col("path").alias("key")), "followers", {})
    release(spark, seen)
    release(spark, paths)
    spans = texts.mapInArrow(_count_spans(window, minimizer, known), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    known.spans = store(spans.select("key"), "spans", {})
    return known


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the kept words as text."""
    known = find_repeats(docs, window, minimizer)
    return docs.select("doc_id", "text").mapInArrow(_remove(window, minimizer, known), "doc_id long, n_words long, n_removed long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select r, s, array_to_string(w[s:s + 34], ' ') as t from (select r, w, unnest(generate_series(1, len(w) - 34)) as s from d)),
again as (select t from win group by t having count(*) > 1),
gone as (select distinct r, unnest(generate_series(s, s + 34)) as p from win semi join again using (t)),
words as (select r, unnest(w) as x, unnest(generate_series(1, len(w))) as p from d),
kept as (select r, string_agg(x, ' ' order by p) as t from words anti join gone using (r, p) group by r),
n as (select r, count(*) as n from gone group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join n using (r) left join kept using (r)
"""

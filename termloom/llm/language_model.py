"""LM scoring with a weighted backoff automaton.

Training. N-grams of the training documents are counted order by order; counts from ``min_count`` on are kept (1 unless told otherwise: every n-gram that was
seen; words always). An order counts only what continues a kept context and ends in a kept shorter n-gram. Tasks pass on sorted, summed and packed pairs
of state and word, dealt to buckets that hold about equally many tokens, so that neither a frequent word nor a large corpus makes a large task.
Probabilities are interpolated with absolute discounting: p(w|h) = (c(hw) - D) / c(h) + b(h) * p(w|h'), where b(h) is what discounting and unkept
n-grams leave over; D = n1 / (n1 + 2 n2) of each order. Unseen words are one further type that shares what words are discounted.

Automaton. States are contexts of up to ``order`` - 1 words. A kept n-gram is an arc from the state of its first words into the state of its last ones,
with its probability as weight; the failure arc of a state, of weight b(h), leads to the context without its first word. States and arcs are
numbers (64 bits) of sorted flat files in the shared folder (see ``_automaton``) that executors map; nothing but bucket counts passes through the driver.
Arcs hold counts, from which weights follow, so that an n-gram takes few bytes.

Scoring. A task fetches the arcs that its slice of texts can reach, in bulk, and then traverses the texts from left to right: each document carries its state from
token to token, takes failure arcs until an arc with the token leaves the state, and adds the log10 weights on the way. Documents are traversed side by side;
long ones are cut into stretches, each of which is entered ``order`` - 1 tokens earlier, after which its state is that of the whole text.

Tokens are runs of non-space characters, A-Z lower-cased, then one end per document, which also is the context of the first word.

Defined cases: null and empty texts are the end alone; rows with a null id are training rows; repeated rows count each time; without training rows every token is
unseen and the base score is that of a count of 0 with N = V = 0; other columns are not read. A very long text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.shared import fresh_dir, materialize

from . import _vec as V
from ._automaton import Arcs, Layout
from ._spark import batch, held_out, table
from ._tables import Table, open_fs, store

ORDER, MIN_COUNT = 3, 1
#: Keys that a task sorts and sums at a time, and tokens of a bucket, about.
FLUSH, BUCKET_TOKENS = 2 << 20, 4 << 20
#: Tokens that a lane of the traversal takes.
STRETCH = 512
END = np.uint64(0xE4D0F1E2D3C4B5A6)


@dataclass
class Model:
    order: int
    tokens: int = 0
    types: int = 0
    words: Table | None = None
    levels: list[Arcs] = field(default_factory=list)
    discounts: list[float] = field(default_factory=list)

    @property
    def unseen(self) -> float:
        p = self.discounts[0] * self.types / self.tokens if self.tokens else 1.0
        return p or 1 / (self.tokens + self.types + 1)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each row's words, then its end."""
    data, offs = V.buffers(texts)
    s, e, first = V.word_spans(data, offs)
    words = V.hash_spans(data, s, e, lower=True)
    n = len(first) - 1
    out = np.full(len(words) + n, END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[first[1:] + np.arange(n)] = False
    out[is_word] = words
    return out, first + np.arange(n + 1)


def reach(texts: pa.Array, words: Table, levels: list[Arcs]):
    """(first, numbers, states): by order, the number of the arc that ends at each token, and the state of that many words before it; -1 for none."""
    hashes, first = tokens_of(texts)
    starts = np.zeros(len(hashes), bool)
    starts[first[:-1]] = True
    numbers, states = [words.find(hashes)], []
    for k in range(len(levels) + 1):
        state = np.full(len(hashes), -1, np.int64)
        state[1:] = numbers[k][:-1]
        state[starts] = words.find(np.array([END]))[0] if k == 0 else -1
        states.append(state)
        if k < len(levels):
            number = np.full(len(hashes), -1, np.int64)
            has = np.flatnonzero((state >= 0) & (numbers[0] >= 0))
            number[has] = levels[k].find(state[has], numbers[0][has])
            numbers.append(number)
    return first, numbers, states


def _count_words(batches):
    """(key, n) of the words, summed in tasks."""
    held, size = [], 0

    def flush():
        k, n = np.unique(np.concatenate(held), return_counts=True)
        return batch("key n", k.view(np.int64), n)

    for b in V.text_slices(batches):
        held.append(tokens_of(b.column("text"))[0])
        size += len(held[-1])
        if size >= FLUSH:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _count(words: Table, levels: list[Arcs], layout: Layout):
    """Blocks of the next order's (state, word) pairs."""

    def run(batches):
        held, size = [], 0
        for b in V.text_slices(batches):
            _, numbers, states = reach(b.column("text"), words, levels)
            has = np.flatnonzero((states[-1] >= 0) & (numbers[-1] >= 0))
            held.append((states[-1][has], numbers[0][has]))
            size += len(has)
            if size >= FLUSH:
                yield layout.blocks(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield layout.blocks(*(np.concatenate(x) for x in zip(*held)))

    return run


def first_layout(model: Model, counts: DataFrame) -> Layout:
    """Ranges of words; a word that has as many tokens as a bucket has a range of its own, in several parts where it has more."""
    half = max(1, BUCKET_TOKENS // 2)
    edges = set(np.linspace(0, model.types, max(1, model.tokens // half) + 1, dtype=np.int64)[:-1].tolist())
    hot = counts.where(F.col("n") > half).select("key", "n").collect()  # fewer than tokens / half
    numbers = model.words.find(np.array([r.key for r in hot], np.int64).view(np.uint64)).tolist()
    edges |= {w for h in numbers for w in (h, h + 1) if w < model.types}
    lo = np.array(sorted(edges), np.int64)
    parts = np.ones(len(lo), np.int64)
    for h, r in zip(numbers, hot):
        parts[np.searchsorted(lo, h)] = max(1, min(model.types, r.n // BUCKET_TOKENS))
    return Layout(lo, parts, model.types, model.types)


def next_layout(level: Arcs, tokens: np.ndarray, types: int) -> Layout:
    """Ranges of a level's arcs: its buckets, those of many tokens in several parts."""
    has = np.flatnonzero(level.counts)
    return Layout(level.before[has], np.clip(tokens[has] // (2 * BUCKET_TOKENS), 1, max(1, types)), len(level), types)


def train(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> Model:
    """The automaton of docs (text)."""
    spark = docs.sparkSession
    texts = docs.select("text")
    model = Model(order)
    counts = materialize(texts.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "word-counts")
    one, two = (F.coalesce(F.sum((F.col("n") == j).cast("long")), F.lit(0)) for j in (1, 2))
    s = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types"), one.alias("ones"), two.alias("twos")).first()
    model.tokens, model.types = s.n, s.types
    model.words = store(counts, "words", {"n": "i8"})
    model.discounts.append(s.ones / (s.ones + 2 * s.twos) if s.ones else 0.0)
    if not model.tokens:
        return model
    layout = first_layout(model, counts)
    for k in range(2, order + 1):
        uri = fresh_dir(spark, f"arcs{k}")
        fs, path = open_fs(uri)
        fs.create_dir(path, recursive=True)
        blocks = texts.mapInArrow(_count(model.words, model.levels, layout), "bucket long, keys binary, counts binary")
        merged = blocks.repartition(len(layout), "bucket").sortWithinPartitions("bucket").mapInArrow(layout.merge(uri, min_count), "bucket long, kept long, tokens long, ones long, twos long")
        stats = merged.toPandas()  # one row a bucket
        kept, tokens = (np.bincount(stats["bucket"], stats[c], len(layout)).astype(np.int64) for c in ("kept", "tokens"))
        ones, twos = stats["ones"].sum(), stats["twos"].sum()
        model.levels.append(Arcs(uri, layout, kept, min_count))
        model.discounts.append(float(ones / (ones + 2 * twos)) if ones else 0.0)
        if not kept.any():
            break
        layout = next_layout(model.levels[-1], tokens, model.types)
    return model


@dataclass
class Reached:
    """The part of the automaton that a slice of texts can reach: by order, whether an arc leaves the state of the words before each token with it,
    the arcs' log10 weights, and the log10 weights of these states' failure arcs; and each token's count."""

    first: np.ndarray
    has: list[np.ndarray]
    weight: list[np.ndarray]
    fail: list[np.ndarray]
    count: np.ndarray


def fetch(texts: pa.Array, model: Model) -> Reached:
    first, numbers, states = reach(texts, model.words, model.levels)
    count = model.words.values(numbers[0], 0, "n")
    p = np.where(numbers[0] >= 0, (count - model.discounts[0]) / max(1, model.tokens), model.unseen)
    p = np.where(p > 0, p, model.unseen)
    out = Reached(first, [np.ones(len(p), bool)], [np.log10(p)], [np.zeros(len(p))], count)
    for k, level in enumerate(model.levels):
        state, arc, d = states[k], numbers[k + 1], model.discounts[k + 1]
        distinct, back = np.unique(state, return_inverse=True)
        real = np.flatnonzero(distinct >= 0)
        seen = np.ones(len(distinct), np.int64)
        seen[real] = model.words.values(distinct[real], 0, "n") if k == 0 else model.levels[k - 1].n(distinct[real])
        kinds, follow = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        kinds[real], follow[real] = level.leaving(distinct[real])
        follow = np.where(follow < 0, seen, follow)
        fail = np.where(kinds > 0, np.maximum(1 - (follow - d * kinds) / np.maximum(1, seen), 1e-12), 1.0)[back]
        has = arc >= 0
        p = np.where(has, np.maximum(level.n(arc) - d, 0) / np.maximum(1, seen)[back], 0) + fail * p
        out.has.append(has)
        out.weight.append(np.log10(p))
        out.fail.append(np.log10(fail))
    return out


def traverse(part: Reached, stretch: int | None = None) -> np.ndarray:
    """log10 probability of each row: a walk from left to right that carries each row's state (how many words of context it has)."""
    stretch, top = stretch or STRETCH, len(part.has) - 1
    rows = len(part.first) - 1
    size = np.diff(part.first)
    pieces = -(-size // stretch)
    row = np.repeat(np.arange(rows), pieces)
    begin = part.first[row] + stretch * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(begin + stretch, part.first[row + 1])
    at = np.maximum(begin - top, part.first[row])
    state = np.where(at == part.first[row], min(1, top), 0)  # a text's start is the context of its end mark
    order = np.argsort(at - end, kind="stable")  # longest first, so that those still under way come first
    row, begin, end, at, state = row[order], begin[order], end[order], at[order], state[order]
    length, total = end - at, np.zeros(len(row))
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t, "left"))
        here, now = at[:n] + t, state[:n].copy()
        gain = np.zeros(n)
        for k in range(top, 0, -1):
            fails = np.flatnonzero((now == k) & ~part.has[k][here])
            gain[fails] += part.fail[k][here[fails]]
            now[fails] = k - 1
        for k in range(top + 1):
            takes = np.flatnonzero(now == k)
            gain[takes] += part.weight[k][here[takes]]
        state[:n] = np.minimum(np.where(part.count[here] > 0, now + 1, 0), top)
        total[:n] += np.where(here >= begin[:n], gain, 0)
    return np.bincount(row, total, rows)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of docs (doc_id, text)."""

    def run(batches):
        for b in V.text_slices(batches):
            part = fetch(b.column("text"), model)
            base = np.log10((part.count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            at = part.first[:-1]
            yield batch("doc_id n_tokens n_known base_score score", b.column("doc_id"), np.diff(part.first), np.add.reduceat((part.count > 0).astype(np.int64), at), np.add.reduceat(base, at), traverse(part))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 10, 0)
    model = train(docs.where(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")

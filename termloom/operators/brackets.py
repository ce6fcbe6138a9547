"""Bracketings of compounds: all binary trees, their modifier-head pairs and the best tree by pair counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=64)
def trees(n: int, start: int = 0) -> tuple:
    """All binary trees over the positions start .. start + n - 1; a leaf is its position."""
    if n == 1:
        return (start,)
    return tuple((left, right) for k in range(1, n) for left in trees(k, start) for right in trees(n - k, start + k))


def head(tree) -> int:
    return tree if isinstance(tree, int) else head(tree[1])


def pairs(tree) -> list[tuple[int, int]]:
    """(modifier, head) positions, one for each inner node."""
    return [] if isinstance(tree, int) else [*pairs(tree[0]), *pairs(tree[1]), (head(tree[0]), head(tree[1]))]


def written(tree, words: list[str]) -> str:
    return words[tree] if isinstance(tree, int) else f"[{written(tree[0], words)} {written(tree[1], words)}]"


def best_tree(words: list[str], n: dict[str, int]) -> tuple[str, float]:
    """The first tree of the largest score, as it is written, and its score.

    A span's head is its last word, so its best tree is made of the best ones of its parts; products are of integers, without rounding.
    """
    size = len(words)
    score, cut = {(i, i + 1): 1 for i in range(size)}, {}
    for length in range(2, size + 1):
        for i in range(size - length + 1):
            j, best = i + length, None
            for k in range(i + 1, j):
                s = score[i, k] * score[k, j] * (n.get(f"{words[k - 1]} {words[j - 1]}", 0) + 1)
                if best is None or s > best:
                    best, cut[i, j] = s, k
            score[i, j] = best
    opened, closed, spans = [0] * size, [0] * size, [(0, size)]
    while spans:
        i, j = spans.pop()
        if j - i > 1:
            opened[i] += 1
            closed[j - 1] += 1
            spans += [(i, cut[i, j]), (cut[i, j], j)]
    try:
        total = float(score[0, size])
    except OverflowError:
        total = float("inf")
    return " ".join("[" * a + w + "]" * z for a, w, z in zip(opened, words, closed)), total


def all_pairs(phrases: DataFrame) -> DataFrame:
    """(term, modifier, head): every ordered pair of words of a phrase."""
    w = F.split("term", " ")
    at = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.transform(F.sequence(i + 1, F.size(w)), lambda j: F.struct(F.element_at(w, i).alias("modifier"), F.element_at(w, j).alias("head")))))
    return phrases.select("term").distinct().where(F.size(w) > 1).select("term", F.inline(at))


def bracket(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, tree, score): the tree with the largest product of (count + 1) over its pairs; the first one on ties.

    counts (modifier, head, n) join the phrases' pairs; each phrase then has its pairs in one row, and the best tree is found over its spans, whatever their number of words.
    """
    p = all_pairs(phrases).join(counts, ["modifier", "head"], "left").groupBy("term").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.concat_ws(" ", "modifier", "head"), F.coalesce("n", F.lit(0)))))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for term, m in zip(b["term"], b["m"]):
                rows.append((term, *best_tree(term.split(" "), dict(m))))
            yield pd.DataFrame(rows, columns=["term", "tree", "score"])

    return p.mapInPandas(run, "term string, tree string, score double")

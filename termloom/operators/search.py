"""Search tables: phrase, sentence and document rows with normalised columns, and the queries on them that are no plain filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import terms as T


def phrase_rows(occ: DataFrame, sections: tuple[str, ...] = (), years: tuple[int, int] | None = None) -> DataFrame:
    """The phrase table: occurrences of some sections and years with stemmed, separated and head columns, so that exact filters replace analyzers."""
    x = occ.where(F.col("section").isin(*sections)) if sections else occ
    x = x.where(F.col("year").between(*years)) if years else x
    words = F.split("term", " ")
    return x.withColumns({"canonical": T.canonical_phrase(F.col("term")), "sp": T.separated(F.col("term")), "head": F.element_at(words, -1), "plen": F.size(words)})


def sentence_rows(phrases: DataFrame) -> DataFrame:
    """The sentence table: heads and terms of each (doc, sent), in the order of their places."""
    in_order = F.array_sort(F.collect_list(F.struct("loc", "term", "head")))
    x = phrases.groupBy("doc", "sent").agg(in_order.alias("_r"))
    return x.select("doc", "sent", F.transform("_r", lambda r: r["head"]).alias("sheads"), F.transform("_r", lambda r: r["term"]).alias("sterms"))


def document_rows(phrases: DataFrame) -> DataFrame:
    """The document table: year, number of phrases and of distinct terms."""
    return phrases.groupBy("doc").agg(F.min("year").alias("year"), F.count("*").alias("phrases"), F.countDistinct("term").alias("terms"))


def write_index(phrases: DataFrame, path: str, new: bool = True) -> None:
    """(Re)create or extend the three tables of an index; phrases are partitioned by year, so that year filters prune files."""
    mode = "overwrite" if new else "append"
    phrases.write.mode(mode).partitionBy("year").parquet(f"{path}/np")
    sentence_rows(phrases).write.mode(mode).parquet(f"{path}/sent")
    document_rows(phrases).write.mode(mode).parquet(f"{path}/doc")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("np", "sent", "doc"))


def with_field(rows: DataFrame, field: str) -> DataFrame:
    """Rows in which a field exists."""
    return rows.where(F.col(field).isNotNull())


def documents_with(documents: DataFrame, phrases: DataFrame, condition: Column) -> DataFrame:
    """Documents that have a phrase for which a condition holds (a child query)."""
    return documents.join(phrases.where(condition).select("doc").distinct(), "doc", "left_semi")


def at_least(rows: DataFrame, field: str, value, least: int) -> DataFrame:
    """Rows with a value in a field whose count reaches a minimum."""
    return rows.where((F.col(field) == value) & (F.col("count") >= least))


def marked_matches(rows: DataFrame, field: str, word: str) -> DataFrame:
    """Rows whose field has the word, with the word between em marks."""
    hit = F.concat(F.lit(" "), F.col(field), F.lit(" "))
    return rows.where(hit.contains(f" {word} ")).withColumn("marked", F.trim(F.replace(hit, F.lit(f" {word} "), F.lit(f" <em>{word}</em> "))))


def personalised_ranks(edges: DataFrame, positive: DataFrame, negative: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, n, p, b, x, diff, ratio) of four runs: restarts at negative seeds, at positive ones, at both, and anywhere; differences as of score lists."""
    from termloom.plans.shared import materialize

    from .graph import page_rank

    edges, positive, negative = (materialize(x, "rank-input") for x in (edges, positive, negative))  # each of them is read by several runs
    runs = {"n": negative, "p": positive, "b": positive.union(negative), "x": None}
    out = None
    for name, seeds in runs.items():
        r = page_rank(edges, seeds, rounds=rounds).withColumnRenamed("rank", name)
        out = r if out is None else out.join(r, "node")
    return out.withColumn("diff", F.col("p") - F.col("n")).withColumn("ratio", F.col("p") / (F.col("n") + 1e-5))


def tree_of_matches(matches: DataFrame, most: int) -> DataFrame:
    """term, pattern, year, n, examples: the matches of each branch, at most so many by place (the report's cap), joined by bars, and how many there are."""
    first = F.slice(F.array_sort(F.collect_list("match")), 1, most)
    return matches.groupBy("term", "pattern", "year").agg(F.count("*").alias("n"), F.array_join(first, "|").alias("examples"))

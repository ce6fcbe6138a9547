"""Joins of features, labels and classifications, and the selections made from them. Tables are joined on their keys; the optimizer chooses how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled_instances(instances: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("y", "n")) -> DataFrame:
    """Instances (term, ...) with the label of their term, for labels (term, label) that are kept."""
    return instances.join(labels.where(F.col("label").isin(*keep)), "term")


def unlabelled_instances(instances: DataFrame, labels: DataFrame, use_all: bool = False) -> DataFrame:
    """Instances whose term has no label; all of them on request."""
    return instances if use_all else instances.join(labels.select("term"), "term", "left_anti")


def training_statistics(instances: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: instances and distinct terms, with a label and without."""
    has = F.col("label").isNotNull()
    x = instances.select("term").join(labels.select("term", "label"), "term", "left")
    return x.agg(
        F.count(F.when(has, 1)).alias("labelled_instances"), F.count(F.when(~has, 1)).alias("unlabelled_instances"),
        F.countDistinct(F.when(has, F.col("term"))).alias("labelled_types"), F.countDistinct(F.when(~has, F.col("term"))).alias("unlabelled_types"),
    )


def annotated_chunks(annotations: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the label of their chunk, annotations whose chunk has no row): a join on the chunk's id, and what it missed."""
    return rows.join(annotations, "chunk_id"), annotations.join(rows.select("chunk_id"), "chunk_id", "left_anti")


def by_category(rows: DataFrame, categories: DataFrame, wanted: tuple[str, ...], least: int = 1) -> DataFrame:
    """Rows (term, ...) with the predicted category of their term, for the categories wanted and terms of at least so many rows."""
    often = rows.groupBy("term").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("term")
    return rows.join(categories.where(F.col("category").isin(*wanted)), "term").join(often, "term", "left_semi")


def select_candidates(rows: DataFrame, negatives: DataFrame, classified: DataFrame, matches: DataFrame) -> DataFrame:
    """Candidate rows (chunk_id, term) that are no negative example and were classified, with their pattern matches (chunk_id, pattern), joined in order."""
    patterns = matches.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("pattern")), "|").alias("patterns"))
    return rows.join(negatives.select("term").distinct(), "term", "left_anti").join(classified.select("chunk_id").distinct(), "chunk_id", "left_semi").join(patterns, "chunk_id", "left")


def accepted_terms(gold: DataFrame, scores: DataFrame, occurrences: DataFrame, least: float = 0.9, years: int = 1) -> DataFrame:
    """Occurrences (term, year, ...) of gold positives and of terms that score enough, if they are seen in more years than given."""
    terms = gold.select("term").union(scores.where(F.col("score") >= least).select("term")).distinct()
    lasting = occurrences.join(terms, "term", "left_semi").groupBy("term").agg(F.countDistinct("year").alias("_y")).where(F.col("_y") > years)
    return occurrences.join(lasting.select("term"), "term", "left_semi")


def first_occurrence(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given, by one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def type_label(term: Column, label: Column, types: tuple[str, ...], when: str = "i", then: str = "t") -> Column:
    """A generic word that stands as a term, or ends one, gets a label of its own."""
    return F.when((label == when) & F.substring_index(term, " ", -1).isin(*types), then).otherwise(label)


def label_lists(rows: DataFrame, by: str, labels: tuple[str, ...]) -> DataFrame:
    """For each document the sorted terms of each label, joined by bars (rows: by, term, label, first occurrences)."""
    lists = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("label") == c, F.col("term")))), "|").alias(c) for c in labels]
    return rows.groupBy(by).agg(*lists)


def unlabelled_system_terms(system: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """System terms (term, score) from a threshold on that have no gold label."""
    return system.where(F.col("score") >= threshold).join(gold.select("term"), "term", "left_anti")


def first_hits(hits: DataFrame, contexts: DataFrame) -> DataFrame:
    """The first hit of a term in each sentence (term, doc, sentence, at), with the sentence's context (doc, sentence, context)."""
    return hits.groupBy("term", "doc", "sentence").agg(F.min("at").alias("at")).join(contexts, ["doc", "sentence"])


def first_n_of_section(rows: DataFrame, n: int, sections: tuple[str, ...]) -> DataFrame:
    """The first n rows of each document by place, of which those of the sections stay (the limit comes before the filter)."""
    order = Window.partitionBy("doc").orderBy("loc", "term", "section")
    return rows.withColumn("_k", F.row_number().over(order)).where((F.col("_k") <= n) & F.col("section").isin(*sections)).drop("_k")


def majority(labels: Column) -> Column:
    """Aggregate: the most frequent label, the smallest of equally frequent ones."""
    counts = F.collect_list(labels)
    distinct = F.array_sort(F.array_distinct(counts))
    times = F.transform(distinct, lambda x: F.size(F.filter(counts, lambda y: y == x)))
    return F.element_at(distinct, F.array_position(times, F.array_max(times)).cast("int"))


def model_weights(model, names: list[str]) -> list[tuple[str, float]]:
    """Feature weights of a fitted linear model, the largest first; equal ones by name."""
    return sorted(zip(names, (float(x) for x in model.coefficients)), key=lambda r: (-r[1], r[0]))


def seeded_order(key: Column, seed: str = "0") -> Column:
    """A reproducible random order: the digest of seed and key."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))

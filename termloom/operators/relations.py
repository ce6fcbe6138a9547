"""Concept pairs of sentences, gold relations, feature bags and dependency paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concept_pairs(concepts: DataFrame, kind: str = "problem") -> DataFrame:
    """Pairs within a sentence: each other concept with each problem, and unordered pairs of problems. Concepts are (doc, sent, no, type); a sentence bounds the pairs."""
    a = concepts.select("doc", "sent", F.col("no").alias("no1"), F.col("type").alias("type1"))
    b = concepts.where(F.col("type") == kind).select("doc", "sent", F.col("no").alias("no2"), F.col("type").alias("type2"))
    return a.join(b, ["doc", "sent"]).where((F.col("type1") != kind) | (F.col("no1") < F.col("no2")))


def label_pairs(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs with the gold relation (doc, sent, no1, no2, relation) that links them in either order; ``none`` without one."""
    key = lambda x: x.withColumn("_lo", F.least("no1", "no2")).withColumn("_hi", F.greatest("no1", "no2"))
    g = key(gold).groupBy("doc", "sent", "_lo", "_hi").agg(F.min("relation").alias("relation"))
    x = key(pairs).join(g, ["doc", "sent", "_lo", "_hi"], "left").drop("_lo", "_hi")
    return x.withColumn("relation", F.coalesce("relation", F.lit("none")))


def feature_index(rows: DataFrame) -> DataFrame:
    """(feature, n, ids): how many instances hold a feature, and which, sorted; rows (id, feature)."""
    return rows.groupBy("feature").agg(F.countDistinct("id").alias("n"), F.array_sort(F.collect_set("id")).alias("ids"))


def frequent_features(rows: DataFrame, least: int) -> DataFrame:
    """Rows (id, feature) whose feature at least so many instances hold."""
    often = rows.groupBy("feature").agg(F.countDistinct("id").alias("_n")).where(F.col("_n") >= least)
    return rows.join(often.select("feature"), "feature", "left_semi")


def training_lines(rows: DataFrame, label: Column) -> DataFrame:
    """id, line: ``id label feature feature ...`` with sorted features; what text-based trainers read."""
    x = rows.groupBy("id").agg(F.min(label).alias("label"), F.array_sort(F.collect_set("feature")).alias("f"))
    return x.select("id", F.concat_ws(" ", F.col("id").cast("string"), "label", F.array_join("f", " ")).alias("line"))


def sparse_lines(rows: DataFrame, label: Column, names: list[str]) -> DataFrame:
    """id, line: ``{place 1, place 1, ..., n label}``, the sparse form of a relation file; ``names`` are the features in order (a model's, so bounded)."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")) - 1
    x = rows.where(F.col("feature").isin(*names)).select("id", place.cast("int").alias("p"), label.alias("label"))
    x = x.groupBy("id").agg(F.min("label").alias("label"), F.array_sort(F.collect_set("p")).alias("p"))
    return x.select("id", F.concat(F.lit("{"), F.array_join(F.transform("p", lambda i: F.concat(i.cast("string"), F.lit(" 1"))), ", "), F.lit(f", {len(names)} "), "label", F.lit("}")).alias("line"))


def relation_words(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(relation, word, n): words of sentences by the relations in them; pairs (doc, sent, relation), words (doc, sent, word)."""
    return pairs.select("doc", "sent", "relation").distinct().join(words.distinct(), ["doc", "sent"]).groupBy("relation", "word").agg(F.count("*").alias("n"))


def compare_predictions(rows: DataFrame, feature: str, gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold class against prediction of each instance that holds a feature, and whether they agree."""
    own = rows.where(F.col("feature") == feature).select("id").distinct()
    x = own.join(gold, "id").join(predictions, "id")
    return x.select("id", "gold", "predicted", (F.col("gold") == F.col("predicted")).alias("agree"))


def ancestors(heads: Column, node: Column, depth: int) -> Column:
    """A token, its head, the head's head ... up to the root (head 0); heads count from 1, at most ``depth`` steps, which a sentence's length bounds."""
    step = lambda chain, _: F.when(F.get(heads, F.element_at(chain, -1) - 1) > 0, F.concat(chain, F.array(F.get(heads, F.element_at(chain, -1) - 1)))).otherwise(chain)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(node), step)


def dependency_path(heads: Column, a: Column, b: Column, depth: int = 40) -> Column:
    """Tokens on the way from a to b in a dependency tree: up to their lowest common head and down again; null in different trees."""

    def path(up: Column, down: Column, top: Column) -> Column:
        left = F.slice(up, F.lit(1), F.array_position(up, top).cast("int"))
        right = F.slice(down, F.lit(1), F.greatest(F.array_position(down, top).cast("int") - 1, F.lit(0)))
        return F.when(top.isNotNull(), F.concat(left, F.reverse(right)))

    # arrays of one element, so that the two chains and where they meet are found once a row, not wherever they are named
    ways = F.array(F.struct(ancestors(heads, a, depth).alias("up"), ancestors(heads, b, depth).alias("down")))
    met = F.transform(ways, lambda w: F.struct(w["up"].alias("up"), w["down"].alias("down"), F.get(F.array_intersect(w["up"], w["down"]), F.lit(0)).alias("top")))
    return F.get(F.transform(met, lambda w: path(w["up"], w["down"], w["top"])), F.lit(0))


def nearest_left(values: Column, tags: Column, at: Column, prefix: str) -> Column:
    """The nearest value left of a place (from 0) whose tag begins so."""
    before = F.arrays_zip(F.slice(values, F.lit(1), at).alias("v"), F.slice(tags, F.lit(1), at).alias("t"))
    hits = F.filter(before, lambda x: F.startswith(x["t"], F.lit(prefix)))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["v"])

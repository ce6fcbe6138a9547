"""Canonical forms by a lexicon (word, pos, lemma), with suffix rules for words that it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import terms as T


def verb_stem(word: Column) -> Column:
    """Compact suffix rules for English verbs."""
    undouble = lambda c: F.regexp_replace(c, r"([bdgmnprt])\1$", "$1")
    return (
        F.when(F.length(word) < 5, word)
        .when(word.rlike("ies$|ied$"), F.regexp_replace(word, "ie[sd]$", "y"))
        .when(word.rlike("ing$"), undouble(F.regexp_replace(word, "ing$", "")))
        .when(word.rlike("ed$"), undouble(F.regexp_replace(word, "ed$", "")))
        .when(word.rlike("s$") & ~word.rlike("ss$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def canonical_words(rows: DataFrame, word: str, pos: str, lexicon: DataFrame) -> DataFrame:
    """Rows with ``lemma``: the lexicon's for the word and part of speech (N or V), else by suffix rules."""
    known = lexicon.groupBy(F.col("word").alias("_w"), F.col("pos").alias("_p")).agg(F.min("lemma").alias("_l"))
    x = rows.join(known, (F.col(word) == F.col("_w")) & (F.col(pos) == F.col("_p")), "left")
    rule = F.when(F.col(pos) == "V", verb_stem(F.col(word))).otherwise(T.singular(F.col(word)))
    return x.withColumn("lemma", F.coalesce("_l", rule)).drop("_w", "_p", "_l")


def canonical_features(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows (feature, ...) with ``canonical``: the head of a verb or noun feature's value (its first word; joined by _ and |) in canonical form, others as they are."""
    name, value = F.substring_index("feature", "=", 1), F.regexp_replace("feature", "^[^=]*=", "")
    pos = F.when(F.startswith(name, F.lit("prev_V")), "V").when(F.startswith(name, F.lit("prev_N")) | (name == "last_word"), "N")
    x = rows.withColumns({"_name": name, "_pos": pos, "_head": F.regexp_extract(value, r"^([^_|]*)", 1), "_rest": F.regexp_replace(value, r"^[^_|]*", "")})
    x = canonical_words(x, "_head", "_pos", lexicon)
    return x.withColumn("canonical", F.when(F.col("_pos").isNull(), F.col("feature")).otherwise(F.concat("_name", F.lit("="), "lemma", "_rest"))).drop("_name", "_pos", "_head", "_rest", "lemma")


def canonical_phrases(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows (term, ...) with ``canonical``: the phrase with its last word in canonical form."""
    x = rows.withColumns({"_head": F.substring_index("term", " ", -1), "_pos": F.lit("N")})
    x = canonical_words(x, "_head", "_pos", lexicon)
    lead = F.left("term", F.length("term") - F.length("_head"))
    return x.withColumn("canonical", F.concat(lead, F.col("lemma"))).drop("_head", "_pos", "lemma")

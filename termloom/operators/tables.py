"""Tables that several steps share: terms by section and sub-phrase, evaluation sets and sweeps, change scores, and samples with their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import terms as T


def term_table(occ: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """(term, doc, year, counts by section of the term itself and as a part of a longer phrase): one row a term and document."""
    parts = occ.select("doc", "year", "section", F.col("term").alias("phrase"), F.explode(T.subphrases(F.split("term", " "))).alias("term"))
    whole = F.col("term") == F.col("phrase")
    counts = [F.count(F.when((F.col("section") == s) & c, 1)).alias(f"{name}_{s.lower()}") for name, c in (("full", whole), ("part", ~whole)) for s in sections]
    return parts.groupBy("term", "doc").agg(F.min("year").alias("year"), *counts)


def with_context(rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """Feature rows (doc, sent_no, ...) beside their sentence (doc, sent_no, text)."""
    return rows.join(sentences, ["doc", "sent_no"])


def evaluation_terms(gold: DataFrame, system: DataFrame, training: DataFrame, words: int = 0) -> DataFrame:
    """Terms with gold label and system score, without those of the training set; of a number of words, if one is given (-1: several)."""
    x = gold.join(system, "term").join(training.select("term"), "term", "left_anti")
    n = F.size(F.split("term", " "))
    return x if words == 0 else x.where(n > 1) if words < 0 else x.where(n == words)


def score_choice(scores: DataFrame, kind: str, least: int = 1) -> DataFrame:
    """(term, score) of summed scores (term, avg, min, max, n): minimum and maximum count only for terms of several instances, the average else."""
    s = F.col("avg") if kind == "avg" else F.when(F.col("n") > 1, F.col(kind)).otherwise(F.col("avg"))
    return scores.where(F.col("n") >= least).select("term", s.alias("score"))


def sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall and counts at each threshold for all terms, single words and longer ones, in one aggregation; pairs are (term, label, score)."""
    kinds = F.array(F.lit("all"), F.when(F.contains("term", F.lit(" ")), "multi").otherwise("single"))
    x = pairs.select("label", "score", F.explode(kinds).alias("filter"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    yes, found = F.col("label") == "y", F.col("score") >= F.col("threshold")
    x = x.groupBy("filter", "threshold").agg(F.count(F.when(yes & found, 1)).alias("tp"), F.count(F.when(~yes & found, 1)).alias("fp"), F.count(F.when(yes & ~found, 1)).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return x.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})


def category_scores(pairs: DataFrame, skip: tuple[str, ...] = ("x", "u")) -> DataFrame:
    """Precision, recall and F1 of each category of (gold, system) pairs; pairs with a skipped gold label don't count."""
    own = pairs.where(~F.col("gold").isin(*skip)).groupBy("gold", "system").agg(F.count("*").alias("n"))
    same = F.sum(F.when(F.col("gold") == F.col("system"), F.col("n")).otherwise(0))
    g = own.groupBy(F.col("gold").alias("category")).agg(same.alias("tp"), F.sum("n").alias("gold"))
    s = own.groupBy(F.col("system").alias("category")).agg(F.sum("n").alias("system"))
    x = g.join(s, "category", "left").withColumn("system", F.coalesce("system", F.lit(0)))
    p, r = F.when(F.col("system") > 0, F.col("tp") / F.col("system")).otherwise(0.0), F.col("tp") / F.col("gold")
    return x.select("category", "tp", "gold", "system", p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def change_score(now: Column, then: Column) -> Column:
    """(now - then) / (now + then), a little damped."""
    return (now - then) / (now + then + 1e-6)


def change_bin(x: Column) -> Column:
    """-2 .. 2: strong and slight falls, none, and rises."""
    return F.when(x <= -0.5, -2).when(x < -0.1, -1).when(x <= 0.1, 0).when(x < 0.5, 1).otherwise(2)


def capped_locations(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first locations of each key (a report's cap) with the number of all."""
    n = rows.groupBy(key).agg(F.count("*").alias("total"))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= most).drop("_k").join(n, key)


def growth_lists(series: DataFrame, first: str, last: str) -> DataFrame:
    """Series with flags: growing (last above twice the first), from zero, and from zero to two."""
    a, b = F.col(first), F.col(last)
    return series.withColumns({"growing": (a > 0) & (b > 2 * a), "from_zero": (a == 0) & (b > 0), "zero_to_two": (a == 0) & (b == 2)})


def mutual_information(joint: Column, a: Column, b: Column, n: Column) -> Column:
    """pmi, mi (weighted by the joint probability), normalised pmi and pmi weighted by the logarithm of the frequency; -1000 where undefined."""
    pmi = F.log2(joint * n / (a * b))
    none = (joint <= 0) | (a <= 0) | (b <= 0) | (n <= 0)
    pick = lambda c: F.when(none, -1000.0).otherwise(c)
    norm = F.when(joint < n, pmi / -F.log2(joint / n)).otherwise(-1000.0)
    return F.struct(pick(pmi).alias("pmi"), pick(joint / n * pmi).alias("mi"), pick(norm).alias("norm_pmi"), pick(pmi * F.log2(joint)).alias("fpmi"))


def capped_series(series: DataFrame, largest: float, value: str = "n") -> DataFrame:
    """The older usage score: ln(n + 1) / ln(largest), damped over the years, and at most 1 afterwards."""
    from .series import damped

    x = damped(series.select("term", "year", (F.log(F.col(value) + 1.0) / F.log(F.lit(float(largest)))).alias("usage")))
    return x.withColumn("damped", F.least(F.col("damped"), F.lit(1.0)))


def three_votes(trigrams: DataFrame, pairs: DataFrame) -> DataFrame:
    """L or R for three-word compounds by three votes: adjacent pairs, the first pair against first and last word, and pair shares; pairs are (term, df)."""
    w = F.split("term", " ")
    x = trigrams.select("term", F.concat_ws(" ", w[0], w[1]).alias("ab"), F.concat_ws(" ", w[1], w[2]).alias("bc"), F.concat_ws(" ", w[0], w[2]).alias("ac"))
    for c in ("ab", "bc", "ac"):
        x = x.join(pairs.select(F.col("term").alias(c), F.col("df").alias(f"n_{c}")), c, "left").withColumn(f"n_{c}", F.coalesce(f"n_{c}", F.lit(0)))
    side = lambda c: F.when(c, 1).otherwise(-1)
    votes = side(F.col("n_ab") >= F.col("n_bc")) + side(F.col("n_ab") >= F.col("n_ac")) + side(F.col("n_ab") * 2 >= F.col("n_bc") + F.col("n_ac"))
    return x.select("term", "n_ab", "n_bc", "n_ac", F.when(votes > 0, "L").otherwise("R").alias("label"))


def punctuated_tokens(text: Column) -> Column:
    """White-space tokens with a final , : ; . ? or ! as a token of its own."""
    return F.filter(F.split(F.regexp_replace(F.concat(text, F.lit(" ")), r"([,:;.?!])(?=\s)", " $1"), r"\s+"), lambda t: t != "")

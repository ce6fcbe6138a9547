"""Counts and statistics of terms, features and pairs.

Tables are long: ``occ`` rows are (doc, year, term[, feature]). Document frequencies count distinct documents; distinctness is reduced
before anything is joined, so that a shuffle carries each (document, term) once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import terms as T


def sum_scores(scores: DataFrame, term: str = "term", score: str = "score") -> DataFrame:
    """term, avg, n, min, max of instance scores; malformed (null) scores are dropped."""
    s = F.col(score)
    return scores.where(s.isNotNull()).groupBy(F.regexp_replace(term, r"\\/", "/").alias("term")).agg(F.avg(s).alias("avg_score"), F.count("*").alias("n"), F.min(s).alias("min_score"), F.max(s).alias("max_score"))


def corpus_size(occ: DataFrame) -> DataFrame:
    return occ.groupBy("year").agg(F.countDistinct("doc").alias("n_docs"))


def term_feature_stats(occ: DataFrame) -> DataFrame:
    """Per (year, term, feature): document frequency, probability, P(f|t), P(t|f), NPMI, with the marginal frequencies."""
    pairs = occ.select("year", "doc", "term", "feature").distinct()
    tf = pairs.groupBy("year", "term", "feature").agg(F.count("*").alias("df"))
    t = pairs.select("year", "doc", "term").distinct().groupBy("year", "term").agg(F.count("*").alias("df_term"))
    f = pairs.select("year", "doc", "feature").distinct().groupBy("year", "feature").agg(F.count("*").alias("df_feat"))
    x = tf.join(t, ["year", "term"]).join(f, ["year", "feature"]).join(corpus_size(occ), "year")
    d = F.col("df")
    return x.select(
        "year", "term", "feature", "df", "df_term", "df_feat",
        F.round(d / F.col("n_docs"), 6).alias("p"),
        F.round(d / F.col("df_term"), 6).alias("p_f_t"),
        F.round(d / F.col("df_feat"), 6).alias("p_t_f"),
        F.round(T.npmi(d, F.col("df_term"), F.col("df_feat"), F.col("n_docs")), 6).alias("npmi"),
    )


def pair_stats(occ: DataFrame, min_df: int = 2) -> DataFrame:
    """Co-occurring terms of a document, t1 < t2: pair and single document frequencies, NPMI and frequency-weighted NPMI.

    Terms below ``min_df`` are dropped before pairs are made, which bounds them per document.
    """
    dt = occ.select("year", "doc", "term").distinct()
    df = dt.groupBy("year", "term").agg(F.count("*").alias("df"))
    frequent = dt.join(df.where(F.col("df") >= min_df), ["year", "term"])
    a = frequent.select("year", "doc", F.col("term").alias("t1"), F.col("df").alias("df1"))
    b = frequent.select("year", "doc", F.col("term").alias("t2"), F.col("df").alias("df2"))
    pairs = a.join(b, ["year", "doc"]).where("t1 < t2").groupBy("year", "t1", "t2").agg(F.count("*").alias("pair_df"), F.first("df1").alias("df1"), F.first("df2").alias("df2"))
    x = pairs.join(corpus_size(occ), "year")
    npmi = T.npmi(F.col("pair_df"), F.col("df1"), F.col("df2"), F.col("n_docs"))
    return x.select("year", "t1", "t2", "pair_df", "df1", "df2", (F.round(npmi, 6) + 0.0).alias("npmi"), (F.round(npmi * F.log2("pair_df"), 6) + 0.0).alias("fpmi"))


def score_bins(scores: DataFrame) -> DataFrame:
    """Per (year, term): mean score, count and ten left-closed bins."""
    b = T.bin_left_closed(F.col("score"))
    bins = [F.count(F.when(b == k, 1)).alias(f"v{k}") for k in range(10)]
    return scores.groupBy("year", "term").agg(F.avg("score").alias("score"), F.count("*").alias("doc_count"), *bins)


def merge_bins(parts: DataFrame, least: int = 2) -> DataFrame:
    """Weighted means and summed bins over years; terms below ``least`` occurrences go."""
    total = F.sum("doc_count")
    return parts.groupBy("term").agg((F.sum(F.col("score") * F.col("doc_count")) / total).alias("score"), total.alias("doc_count"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(10)]).where(F.col("doc_count") >= least)


def inverted_index(occ: DataFrame, loc: str = "loc") -> DataFrame:
    """Per (doc, term): number of occurrences and their places, ascending, as one string."""
    return occ.groupBy("doc", "term").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(loc))), " ").alias("locs"))


def category_argmax(counts: DataFrame, key: str, category: str, weight: str, last_wins: bool) -> DataFrame:
    """The category of the largest weight per key; on ties the alphabetically last or first one."""
    best = F.max(F.struct(F.col(weight).alias("w"), category)) if last_wins else F.min(F.struct((-F.col(weight)).alias("w"), category))
    w = F.col("b.w") if last_wins else -F.col("b.w")
    return counts.groupBy(key).agg(best.alias("b")).select(key, F.col(f"b.{category}").alias(category), w.alias(weight))


def dispersion(occ: DataFrame, side: str) -> DataFrame:
    """Per (year, head or modifier): number of distinct longer terms, their occurrences and entropy.

    The head is a term's last word and the modifier its first, so a prefix or suffix search becomes an equi-aggregation.
    """
    words = F.split("term", " ")
    key = F.element_at(words, -1) if side == "head" else F.element_at(words, 1)
    counts = occ.where(F.size(words) > 1).groupBy("year", key.alias("word"), "term").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("year", "word"))
    return counts.withColumn("p", p).groupBy("year", "word").agg(F.count("*").alias("dispersion"), F.sum("c").alias("total"), F.round(T.entropy(F.col("p")), 6).alias("entropy"))


def section_counts(occ: DataFrame) -> DataFrame:
    """Per (year, term): documents with the term in each section and in any."""
    per_doc = occ.groupBy("year", "doc", "term", "section").agg(F.count("*").alias("c"))
    return per_doc.groupBy("year", "term").agg(F.countDistinct("doc").alias("docs"), *[F.countDistinct(F.when(F.col("section") == s, F.col("doc"))).alias(f"docs_{s.lower()}") for s in ("F", "O")])


def word_dispersion(phrases: DataFrame) -> DataFrame:
    """Per word: occurrences over phrases, and distinct phrases."""
    return phrases.select("term", F.explode(F.split("term", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("term").alias("phrases"))


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with their number from 1 in each group, by the order given. Rows are range-sorted and counted by partition, so that no group comes into one task."""
    from termloom.plans.shared import materialize

    x = materialize(rows.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = x.groupBy(*group, "_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a group and partition
    own = F.row_number().over(Window.partitionBy(*group, "_p").orderBy(*order))
    ranked = x.withColumn("_k", own)
    condition = None
    for c in [*group, "_p"]:
        one = ranked[c].eqNullSafe(before[c])
        condition = one if condition is None else condition & one
    return ranked.join(before, condition).select(*[ranked[c] for c in rows.columns], (F.col("_k") + F.col("_before")).alias(name))


def means_in_order(rows: DataFrame, key: str, scores: dict[str, Column]) -> DataFrame:
    """(key, n, means) of scores, summed in the order of the rows' place ``at``, so that the last digits of a sum, and what a limit decides by them, don't depend on partitions.

    Sums run along the sorted rows of a key; no key's rows are collected."""
    order = Window.partitionBy(key).orderBy("at")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = rows.select(key, "at", *[c.alias(a) for a, c in scores.items()])
    x = x.select(key, F.count("*").over(sofar).alias("n"), *[(F.sum(a).over(sofar) / F.nullif(F.count(a).over(sofar), F.lit(0))).alias(a) for a in scores], F.lead(F.lit(1)).over(order).isNull().alias("_last"))
    return x.where("_last").drop("_last")


def appearance_rank(rows: DataFrame, first: str) -> DataFrame:
    """Rows with ``early``: 1 for the first to appear, falling evenly to 1/n for the last."""
    n = F.broadcast(rows.agg(F.count("*").alias("_all")))  # one row
    return numbered(rows, [], [first], "_r").crossJoin(n).withColumn("early", (F.col("_all") - F.col("_r") + 1) / F.col("_all")).drop("_r", "_all")

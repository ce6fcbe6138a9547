"""Yearly series of terms: dense grids, levels, damping, growth, cohorts and change measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _by_term():
    return Window.partitionBy("term").orderBy("year")


def grid(values: DataFrame, first: int, last: int, value: str = "n") -> DataFrame:
    """Every term with every year of the range, 0 where there was nothing; each term explodes its own years, so nothing is crossed."""
    terms = values.select("term").distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return terms.join(values, ["term", "year"], "left").select("term", "year", F.coalesce(value, F.lit(0)).alias(value))


def size_adjusted(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Counts scaled by the largest year's size over the year's."""
    largest = sizes.agg(F.max("n_docs").alias("largest"))
    factor = sizes.crossJoin(F.broadcast(largest)).select("year", (F.col("largest") / F.col("n_docs")).alias("factor"))  # one row
    return counts.join(factor, "year").withColumn("adjusted", F.col("n") * F.col("factor"))


def frequency_level(adjusted: DataFrame) -> DataFrame:
    """0, 1 (from 10) or 2 (from 25), never falling."""
    level = F.when(F.col("adjusted") >= 25, 2).when(F.col("adjusted") >= 10, 1).otherwise(0)
    return adjusted.withColumn("level", F.max(level).over(_by_term().rowsBetween(Window.unboundedPreceding, 0)))


def usage(counts: DataFrame) -> DataFrame:
    """ln(n + 1) / ln(largest of the year + 1.0001)."""
    most = counts.groupBy("year").agg(F.max("n").alias("_most"))
    return counts.join(most, "year").withColumn("usage", F.log(F.col("n") + 1.0) / F.log(F.col("_most") + 1.0001)).drop("_most")


def damped(series: DataFrame, value: str = "usage") -> DataFrame:
    """A value below the previous output falls by a fifth of the gap only: a fold over the term's ordered years."""
    ordered = F.array_sort(F.collect_list(F.struct("year", value)))
    step = lambda acc, x: F.struct(
        F.when(acc["prev"].isNull() | (x[value] >= acc["prev"]), x[value]).otherwise(acc["prev"] - (acc["prev"] - x[value]) / 5).alias("prev"),
        F.concat(acc["out"], F.array(F.struct(x["year"].alias("year"), F.when(acc["prev"].isNull() | (x[value] >= acc["prev"]), x[value]).otherwise(acc["prev"] - (acc["prev"] - x[value]) / 5).alias("damped")))).alias("out"),
    )
    start = F.struct(F.lit(None).cast("double").alias("prev"), F.array().cast("array<struct<year:int,damped:double>>").alias("out"))
    folded = series.groupBy("term").agg(ordered.alias("s")).select("term", F.aggregate("s", start, step, lambda acc: acc["out"]).alias("out"))
    return folded.select("term", F.inline("out"))


def relative_frequency(counts: DataFrame) -> DataFrame:
    """ln(n + 1) / ln(largest of the year + 1); null in a year of zeros."""
    most = counts.groupBy("year").agg(F.max("n").alias("_most"))
    return counts.join(most, "year").withColumn("relative", F.when(F.col("_most") > 0, F.log(F.col("n") + 1.0) / F.log(F.col("_most") + 1.0))).drop("_most")


def change(values: DataFrame) -> DataFrame:
    """Against the previous year (missing 0): ratio (c + 1) / (l + 1) and signed log2(|c - l| + 1)."""
    last = values.select("term", (F.col("year") + 1).alias("year"), F.col("n").alias("last"))
    x = values.join(last, ["term", "year"], "left").withColumn("last", F.coalesce("last", F.lit(0)))
    d = F.col("n") - F.col("last")
    return x.select("term", "year", "n", "last", ((F.col("n") + 1) / (F.col("last") + 1)).alias("ratio"), (F.signum(d.cast("double")) * F.log2(F.abs(d) + 1.0)).alias("adjusted"))


def first_years(occ: DataFrame) -> DataFrame:
    """First year of each term; terms of the earliest year make a cohort but aren't new."""
    first = occ.groupBy("term").agg(F.min("year").alias("first_year"))
    start = first.agg(F.min("first_year").alias("start"))
    return first.crossJoin(F.broadcast(start)).select("term", "first_year", (F.col("first_year") > F.col("start")).alias("is_new"))  # one row


def cohorts(counts: DataFrame, near: int = 2, far: int = 5) -> DataFrame:
    """Bucket of each cohort term by its counts ``near`` and ``far`` years on: 0, 1, 2 each."""
    first = F.min("year").over(Window.partitionBy("term"))
    x = counts.withColumn("cohort", first).groupBy("term", "cohort").agg(*[F.max(F.when(F.col("year") == F.col("cohort") + k, F.col("n"))).alias(f"n{k}") for k in (near, far)])
    a, b = F.coalesce(f"n{near}", F.lit(0)), F.coalesce(f"n{far}", F.lit(0))
    return x.select("term", "cohort", F.when(a > 20, 2).when(a > 5, 1).otherwise(0).alias("near"), F.when(b > 50, 2).when(b > 10, 1).otherwise(0).alias("far"))


def growth_prominence(counts: DataFrame) -> DataFrame:
    """(c - p) / (p + 1), and prominence (1 - p/c)(1 - 1/c) where p < c, else 1e-6, 1e-8 in the first year."""
    p, c = F.lag("n").over(_by_term()), F.col("n")
    return counts.select("term", "year", "n", ((c - p) / (p + 1)).alias("growth"), F.when(p.isNull(), 1e-8).when(p < c, (1 - p / c) * (1 - 1 / c)).otherwise(1e-6).alias("prominence"))


def temporal_entropy(counts: DataFrame, years: int = 11) -> DataFrame:
    """1 + sum(p log2 p) / log2(years) over a term's years."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("term"))
    return counts.withColumn("p", p).groupBy("term").agg((1 + F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0)) / F.log2(F.lit(float(years)))).alias("te"))


def kl_over_years(counts: DataFrame, key: str = "feature") -> DataFrame:
    """KL of P(year | key) from P(year), and the signs of the differences by year."""
    actual = F.sum("n").over(Window.partitionBy(key, "year")) / F.sum("n").over(Window.partitionBy(key))
    totals = counts.groupBy("year").agg(F.sum("n").alias("t"))
    expected = totals.crossJoin(F.broadcast(totals.agg(F.sum("t").alias("all")))).select("year", (F.col("t") / F.col("all")).alias("q"))  # one row
    x = counts.withColumn("p", actual).select(key, "year", "p").distinct().join(expected, "year")
    sign = F.when(F.col("p") > F.col("q"), "+").when(F.col("p") < F.col("q"), "-").otherwise("0")
    return x.groupBy(key).agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", sign.alias("s")))), lambda r: r["s"]), "").alias("signs"))


def tipping_points(counts: DataFrame, always_before: int = 1982) -> DataFrame:
    """First year above 2 (immature), and first from 5 on that isn't the term's first year unless early enough (mature); else 9999."""
    first = F.min("year").over(Window.partitionBy("term"))
    x = counts.withColumn("first", first)
    eligible = (F.col("year") > F.col("first")) | (F.col("year") < always_before)
    return x.groupBy("term").agg(F.coalesce(F.min(F.when(F.col("n") > 2, F.col("year"))), F.lit(9999)).alias("immature"), F.coalesce(F.min(F.when((F.col("n") >= 5) & eligible, F.col("year"))), F.lit(9999)).alias("mature"))


def cumulative_new(pairs: DataFrame, key: str = "feature") -> DataFrame:
    """Per (key, year): distinct terms, those new for the key, and all so far."""
    first = pairs.groupBy(key, "term").agg(F.min("year").alias("year")).groupBy(key, "year").agg(F.count("*").alias("new"))
    seen = pairs.select(key, "term", "year").distinct().groupBy(key, "year").agg(F.count("*").alias("terms"))
    so_far = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy(key).orderBy("year"))
    return seen.join(first, [key, "year"], "left").select(key, "year", "terms", F.coalesce("new", F.lit(0)).alias("new"), so_far.alias("cumulative"))


def rising(series: DataFrame, first: int, last: int) -> DataFrame:
    """Terms whose last value is more than twice their first, with the pivoted pair."""
    x = series.groupBy("term").agg(*[F.max(F.when(F.col("year") == y, F.col("n"))).alias(a) for y, a in ((first, "a"), (last, "b"))])
    return x.select("term", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")).where("b > 2 * a")


def maturity(year: Column, immature: Column, mature: Column) -> Column:
    return F.when(year < immature, 0).when(year < mature, 1).otherwise(2)


def spread_by_feature(counts: DataFrame) -> DataFrame:
    """hm-difference of consecutive years: log2(c2/c1) * log2(|c2 - c1| + 1), where both years have a count."""
    prev = F.lag("n").over(_by_term())
    x = counts.withColumn("prev", prev).where("prev > 0 and n > 0")
    return x.select("term", "year", (F.log2(F.col("n") / F.col("prev")) * F.log2(F.abs(F.col("n") - F.col("prev")) + 1.0)).alias("hm_diff"))

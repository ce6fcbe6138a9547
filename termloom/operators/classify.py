"""Seeds, smoothed feature-category probabilities, naive Bayes, maximum entropy, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_categories(occ: DataFrame, seeds: DataFrame) -> DataFrame:
    """(term, category, pair_count, prob): how a term's seed features (feature, category) divide."""
    pairs = occ.join(seeds, "feature").groupBy("term", "category").agg(F.count("*").alias("pair_count"))
    return pairs.withColumn("prob", F.col("pair_count") / F.sum("pair_count").over(Window.partitionBy("term")))


def seed_terms(term_cats: DataFrame, min_prob: float, min_pairs: int) -> DataFrame:
    """Both bounds are inclusive."""
    return term_cats.where((F.col("prob") >= min_prob) & (F.col("pair_count") >= min_pairs))


def feature_categories(occ: DataFrame, seed_terms: DataFrame) -> DataFrame:
    """(feature, category, n): one count per term-feature row of a seed term."""
    return occ.select("term", "feature").join(seed_terms.select("term", "category"), "term").groupBy("feature", "category").agg(F.count("*").alias("n"))


def smoothed(fc: DataFrame, categories: tuple[str, ...], seeds: DataFrame) -> DataFrame:
    """Per (feature, category), unseen pairs included: P(c|f) = (n + 1) / (N_f + K), P(f|c) = (n + 1) / (N_c + F), and KL of P(c|f) from the seed priors."""
    k = len(categories)
    each = fc.select("feature").distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories])))
    x = each.join(fc, ["feature", "category"], "left").select("feature", "category", F.coalesce("n", F.lit(0)).alias("n"))
    nf, nc = F.sum("n").over(Window.partitionBy("feature")), F.sum("n").over(Window.partitionBy("category"))
    features = F.broadcast(fc.agg(F.countDistinct("feature").alias("features")))  # one row
    prior = seeds.groupBy("category").agg(F.count("*").alias("c"))
    prior = prior.select("category", (F.col("c") / F.sum("c").over(Window.partitionBy())).alias("prior"))  # a row for each category
    x = x.withColumn("nf", nf).withColumn("nc", nc).crossJoin(features).join(F.broadcast(prior), "category")
    pcf = (F.col("n") + 1) / (F.col("nf") + k)
    x = x.select("feature", "category", "n", pcf.alias("p_c_f"), ((F.col("n") + 1) / (F.col("nc") + F.col("features"))).alias("p_f_c"), "prior")
    return x.withColumn("kl", F.sum(F.col("p_c_f") * F.log(F.col("p_c_f") / F.col("prior"))).over(Window.partitionBy("feature")))


def naive_bayes(counts: DataFrame, model: DataFrame, cutoff: float, prior: str = "raw") -> DataFrame:
    """(term, category, score) of the best category: prior + sum of n * ln P(f|c) over features with KL above the cutoff; the alphabetically first wins ties.

    ``prior`` adds the plain prior ("raw", the established behaviour) or its logarithm ("log").
    """
    m = model.where(F.col("kl") > cutoff).select("feature", "category", F.log("p_f_c").alias("w"), "prior")
    x = counts.join(m, "feature").groupBy("term", "category").agg(F.sum(F.col("n") * F.col("w")).alias("s"), F.first("prior").alias("prior"))
    x = x.withColumn("score", F.col("s") + (F.col("prior") if prior == "raw" else F.log("prior")))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.round("score", 9)), "category"))
    return x.withColumn("r", rank).where("r = 1").select("term", "category", "score")


def maxent(train: DataFrame, test: DataFrame, variance: float = 1.0, min_df: int = 1) -> DataFrame:
    """(key, score) of test rows (key, feats) by logistic regression on binary features, fitted on train rows (feats, label 0/1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    n = max(1, train.count())
    steps = [CountVectorizer(inputCol="feats", outputCol="x", binary=True, minDF=min_df), LogisticRegression(featuresCol="x", labelCol="label", regParam=1 / (variance * n), standardization=False)]
    fitted = Pipeline(stages=steps).fit(train)
    return fitted.transform(test).select("key", vector_to_array("probability")[1].alias("score"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, -1 where undefined."""
    return F.when(b == 0, -1.0).otherwise(a / b)


def confusion(gold_and_score: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold (score strictly above it is y): tp, fp, fn, tn and precision, recall, F1, accuracy."""
    rows = gold_and_score.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    said, is_ = F.col("score") > F.col("threshold"), F.col("gold")
    x = rows.groupBy("threshold").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("tp", said & is_), ("fp", said & ~is_), ("fn", ~said & is_), ("tn", ~said & ~is_))])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    x = x.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when((F.col("precision") < 0) | (F.col("recall") < 0) | (F.col("precision") + F.col("recall") == 0), -1.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return x.withColumn("f1", f1).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def kappa(pairs: DataFrame) -> DataFrame:
    """One row: n, observed and chance agreement and Cohen's kappa of two label columns a and b."""
    joint = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = joint.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = joint.groupBy("a").agg(F.sum("n").alias("na")), joint.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, left.a == right.b).agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    x = total.crossJoin(chance).select("n", (F.col("same") / F.col("n")).alias("agreement"), (F.col("both") / (F.col("n") * F.col("n"))).alias("chance"))  # one row each
    return x.withColumn("kappa", F.when(F.col("chance") < 1, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))))

"""Classification and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog import query, table
from termloom.operators import classify as C

from .views import OCC, occurrences

SEEDS = (("type=ECONOMY", "a"), ("type=SMALL", "a"), ("type=LARGE", "t"), ("type=PROMO", "t"))
_SEED_SQL = "seeds(feature, category) as (values " + ", ".join(f"('{f}', '{c}')" for f, c in SEEDS) + ")"
_TC = f"{OCC}, {_SEED_SQL}, tc0 as (select part as term, category, count(*) as pair_count from occ join seeds using (feature) group by all), tc as (select *, pair_count / sum(pair_count) over (partition by term) as prob from tc0)"
_TCS = _TC + ", tcs as (select * from tc where prob >= 0.6 and pair_count >= 3)"
_FC = _TCS + ", fc as (select o.brand as feature, category, count(*) as n from occ o join tcs on o.part = tcs.term group by all)"
_PROB = (
    _FC
    + """, cats as (select distinct category from seeds), g as (select f.feature, c.category, coalesce(n, 0) as n from (select distinct feature from fc) f cross join cats c left join fc using (feature, category)),
 prior as (select category, count(*) / (select count(*) from tcs) as prior from tcs group by category),
 p as (select feature, category, n, (n + 1) / (sum(n) over (partition by feature) + 2) as p_c_f, (n + 1) / (sum(n) over (partition by category) + (select count(distinct feature) from fc)) as p_f_c, prior from g join prior using (category)),
 m as (select *, sum(p_c_f * ln(p_c_f / prior)) over (partition by feature) as kl from p)"""
)


def _occ(spark, d):
    return occurrences(spark, d).withColumn("term", F.col("part"))


def _seeds(spark):
    return spark.createDataFrame(list(SEEDS), "feature string, category string")


def _seed_terms(spark, d):
    return C.seed_terms(C.term_categories(_occ(spark, d), _seeds(spark)), 0.6, 3)


def _model(spark, d):
    brands = _occ(spark, d).withColumn("feature", F.col("brand"))
    seeds = _seed_terms(spark, d)
    return C.smoothed(C.feature_categories(brands, seeds), ("a", "t"), seeds)


@query("term_category", f"with {_TC} select term, category, pair_count, round(prob, 6) as prob from tc")
def term_category(spark, d):
    return C.term_categories(_occ(spark, d), _seeds(spark)).withColumn("prob", F.round("prob", 6)).select("term", "category", "pair_count", "prob")


@query("seeds", f"with {_TCS} select term, category, pair_count, round(prob, 6) as prob from tcs")
def seeds(spark, d):
    return _seed_terms(spark, d).withColumn("prob", F.round("prob", 6)).select("term", "category", "pair_count", "prob")


@query("feature_category", f"with {_FC} select feature, category, n from fc")
def feature_category(spark, d):
    return C.feature_categories(_occ(spark, d).withColumn("feature", F.col("brand")), _seed_terms(spark, d))


@query("fc_prob_kl", f"with {_PROB} select feature, category, n, round(p_c_f, 6) as p_c_f, round(p_f_c, 6) as p_f_c, round(kl, 6) + 0.0 as kl from m")
def fc_prob_kl(spark, d):
    return _model(spark, d).select("feature", "category", "n", F.round("p_c_f", 6).alias("p_c_f"), F.round("p_f_c", 6).alias("p_f_c"), (F.round("kl", 6) + 0.0).alias("kl"))


@query("nb_classify", f"""with {_PROB}, c as (select p_name as term, brand as feature, count(*) as n from occ join part on p_partkey = part group by all),
 s as (select term, category, sum(c.n * ln(p_f_c)) + max(prior) as score from c join m using (feature) where kl > 0 group by all)
select term, category, round(score, 6) as score from (select *, row_number() over (partition by term order by round(score, 9) desc, category) as r from s) where r = 1""")
def nb_classify(spark, d):
    counts = occurrences(spark, d).groupBy("term", F.col("brand").alias("feature")).agg(F.count("*").alias("n"))
    return C.naive_bayes(counts, _model(spark, d), 0.0).withColumn("score", F.round("score", 6))


_GOLD = "g as (select doc_id, quality = 1 as gold, (length(text) % 101) / 100 as score from labels join documents using (doc_id))"


def _gold(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("len"))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", (F.col("quality") == 1).alias("gold"), ((F.col("len") % 101) / 100).alias("score"))


@query("prf_sweep", f"""with {_GOLD}, x as (select t as threshold, count(case when score > t and gold then 1 end) as tp, count(case when score > t and not gold then 1 end) as fp, count(case when score <= t and gold then 1 end) as fn, count(case when score <= t and not gold then 1 end) as tn
 from g, (select unnest(generate_series(0, 9)) / 10 as t) group by t),
 y as (select *, case when tp + fp = 0 then -1 else tp / (tp + fp) end as p, case when tp + fn = 0 then -1 else tp / (tp + fn) end as r from x)
select threshold, tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, round(case when p < 0 or r < 0 or p + r = 0 then -1 else 2 * p * r / (p + r) end, 6) as f1, round(case when tp + fp + fn + tn = 0 then -1 else (tp + tn) / (tp + fp + fn + tn) end, 6) as accuracy from y""")
def prf_sweep(spark, d):
    x = C.confusion(_gold(spark, d), [t / 10 for t in range(10)])
    return x.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("kappa", """with p as (select quality as a, toxic as b from labels), j as (select a, b, count(*) as n from p group by all), l as (select a, sum(n) as na from j group by a), r as (select b, sum(n) as nb from j group by b),
 x as (select sum(n) as n, sum(case when a = b then n else 0 end) / sum(n) as agreement, (select sum(na * nb) from l join r on a = b) / (sum(n) * sum(n)) as chance from j)
select n::bigint as n, round(agreement, 6) as agreement, round(chance, 6) as chance, round((agreement - chance) / (1 - chance), 6) as kappa from x""")
def kappa(spark, d):
    x = C.kappa(table(spark, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")))
    return x.select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "chance", "kappa")])


@query("confusion_crosstab", "select quality, count(case when toxic = 0 then 1 end) as t0, count(case when toxic = 1 then 1 end) as t1 from labels group by quality")
def confusion_crosstab(spark, d):
    return table(spark, d, "labels").groupBy("quality").agg(F.count(F.when(F.col("toxic") == 0, 1)).alias("t0"), F.count(F.when(F.col("toxic") == 1, 1)).alias("t1"))


@query("label_share", "select lang, round(avg(quality), 6) as share, count(*) as n from labels join documents using (doc_id) group by lang")
def label_share(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return x.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("share"), F.count("*").alias("n"))


@query("maxent_scores")
def maxent_scores(spark, d):
    """Quality of documents from their distinct words, by logistic regression."""
    words = F.array_distinct(F.split(F.lower("text"), " "))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), words.alias("feats"))
    train = docs.join(table(spark, d, "labels"), F.col("key") == F.col("doc_id")).select("feats", F.col("quality").cast("double").alias("label"))
    return C.maxent(train, docs, min_df=3)

"""Concept pairs, feature bags and dependency paths: orders are notes, line status a sentence, returned lines problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog import query, table
from termloom.operators import relations as R

_C = """c as (select distinct l_orderkey as doc, l_linestatus as sent, l_partkey * 10 + l_linenumber as no, case when l_returnflag = 'R' then 'problem' else 'test' end as type from lineitem),
 p as (select a.doc, a.sent, a.no as no1, a.type as type1, b.no as no2, b.type as type2 from c a join c b on a.doc = b.doc and a.sent = b.sent and b.type = 'problem' where a.type <> 'problem' or a.no < b.no),
 g as (select doc, sent, no1 as x, no2 as y, 'rel' || ((no1 + no2) % 3) as relation from p where (no1 + no2) % 5 < 3)"""


def _concepts(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("doc"), F.col("l_linestatus").alias("sent"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("no"), F.when(F.col("l_returnflag") == "R", "problem").otherwise("test").alias("type")).distinct()


def _labelled(spark, d):
    p = R.concept_pairs(_concepts(spark, d))
    s = F.col("no1") + F.col("no2")
    gold = p.where(s % 5 < 3).select("doc", "sent", F.col("no2").alias("no1"), F.col("no1").alias("no2"), F.concat(F.lit("rel"), (s % 3).cast("string")).alias("relation"))
    return R.label_pairs(p, gold)


@query("concept_pairs", f"with {_C} select doc, sent, no1, type1, no2, type2 from p")
def concept_pairs(spark, d):
    return R.concept_pairs(_concepts(spark, d)).select("doc", "sent", "no1", "type1", "no2", "type2")


@query("labelled_pairs", f"with {_C} select p.doc, p.sent, no1, no2, coalesce(min(relation), 'none') as relation from p left join g on g.doc = p.doc and g.sent = p.sent and least(no1, no2) = least(x, y) and greatest(no1, no2) = greatest(x, y) group by p.doc, p.sent, no1, no2, type1, type2")
def labelled_pairs(spark, d):
    return _labelled(spark, d).select("doc", "sent", "no1", "no2", "relation")


@query("relation_words", f"""with {_C}, l as (select distinct doc, sent, case when (no1 + no2) % 5 < 3 then 'rel' || ((no1 + no2) % 3) else 'none' end as relation from p), w as (select distinct l_orderkey as doc, l_linestatus as sent, p_brand as word from lineitem join part on p_partkey = l_partkey)
select relation, word, count(*) as n from l join w using (doc, sent) group by all""")
def relation_words(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    w = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), F.col("l_linestatus").alias("sent"), F.col("p_brand").alias("word"))
    return R.relation_words(_labelled(spark, d), w)


def _bag(spark, d):
    p = table(spark, d, "part")
    feats = F.array(F.concat(F.lit("type="), "p_type"), F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("head="), F.element_at(F.split("p_name", " "), 2)))
    return p.select(F.col("p_partkey").alias("id"), F.explode(feats).alias("feature"), (F.col("p_size") > 25).cast("int").cast("string").alias("label"))


_BAG = "b as (select p_partkey as id, case when p_size > 25 then '1' else '0' end as label, unnest(['type=' || p_type, 'brand=' || p_brand, 'head=' || string_split(p_name, ' ')[2]]) as feature from part)"


@query("feature_index", f"with {_BAG} select feature, count(distinct id) as n, string_agg(distinct id::varchar, ' ' order by id::varchar) as ids from b group by feature")
def feature_index(spark, d):
    x = R.feature_index(_bag(spark, d).withColumn("id", F.col("id").cast("string")))
    return x.select("feature", "n", F.array_join("ids", " ").alias("ids"))


@query("frequent_binary_features", f"with {_BAG} select id, feature from b where feature in (select feature from b group by feature having count(distinct id) >= (select count(*) / 25 from part))")
def frequent_binary_features(spark, d):
    """Features that a twenty-fifth of the instances hold."""
    least = F.broadcast(table(spark, d, "part").agg((F.count("*") / 25).alias("least")))  # one row
    b = _bag(spark, d)
    often = b.groupBy("feature").agg(F.countDistinct("id").alias("n")).crossJoin(least).where("n >= least").select("feature")
    return b.join(often, "feature", "left_semi").select("id", "feature")


@query("training_lines", f"with {_BAG} select id, id || ' ' || min(label) || ' ' || string_agg(feature, ' ' order by feature) as line from b group by id")
def training_lines(spark, d):
    return R.training_lines(_bag(spark, d), F.col("label"))


_NAMES = ["type=ECONOMY", "type=SMALL", "head=anvil", "head=bolt", "brand=Brand#1"]


@query("sparse_lines", f"with {_BAG} select id, '{{' || string_agg((list_position({_NAMES}, feature) - 1) || ' 1', ', ' order by list_position({_NAMES}, feature)) || ', {len(_NAMES)} ' || min(label) || '}}' as line from b where list_contains({_NAMES}, feature) group by id")
def sparse_lines(spark, d):
    return R.sparse_lines(_bag(spark, d), F.col("label"), _NAMES)


@query("prediction_comparison", "select p_partkey as id, case when p_size > 25 then 1 else 0 end as gold, case when p_retailprice > 950 then 1 else 0 end as predicted, (p_size > 25) = (p_retailprice > 950) as agree from part where p_type = 'PROMO'")
def prediction_comparison(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    gold, predicted = p.select("id", (F.col("p_size") > 25).cast("int").alias("gold")), p.select("id", (F.col("p_retailprice") > 950).cast("int").alias("predicted"))
    return R.compare_predictions(_bag(spark, d), "type=PROMO", gold, predicted)


@query("dependency_paths", """with t as (select l_orderkey, l_linenumber, l_linenumber as a, l_suppkey % 7 + 1 as b from lineitem), c as (select *, list_filter([a, a // 2, a // 4], lambda x: x > 0) as ca, list_filter([b, b // 2, b // 4], lambda x: x > 0) as cb from t),
 l as (select *, list_filter(ca, lambda x: list_contains(cb, x))[1] as top from c)
select l_orderkey, a, b, array_to_string(list_concat(ca[1:list_position(ca, top)], list_reverse(cb[1:list_position(cb, top) - 1])), '>') as path from l""")
def dependency_paths(spark, d):
    """Paths in sentences of seven tokens in which token i hangs on token i / 2."""
    heads = F.array(*[F.lit(i // 2) for i in range(1, 8)])
    a, b = F.col("l_linenumber"), (F.col("l_suppkey") % 7 + 1).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", a.alias("a"), b.alias("b"), F.array_join(R.dependency_path(heads, a, b, 7), ">").alias("path"))


@query("nearest_governors", """with t as (select l_orderkey, l_linenumber, l_partkey, list_filter([1, 2, 3, 4, 5, 6, 7], lambda i: i < l_linenumber and (i * 3 + l_orderkey) % 4 = 0) as hits from lineitem) select l_orderkey, l_linenumber, l_partkey, 'w' || hits[-1] as verb from t""")
def nearest_governors(spark, d):
    """The nearest verb left of a token in a sentence of seven."""
    words = F.array(*[F.lit(f"w{i}") for i in range(1, 8)])
    tags = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when((i * 3 + F.col("l_orderkey")) % 4 == 0, "VB").otherwise("NN"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.nearest_left(words, tags, F.col("l_linenumber") - 1, "V").alias("verb"))

"""Further filters, cohorts, shares, summaries and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.catalog import query, table
from termloom.functions import terms as T
from termloom.operators import brackets as B
from termloom.operators import sampling as P
from termloom.operators import stats as S

from .time_series import _PARTS, _parts
from .views import OCC, occurrences, yearly_counts

_AT = "max(case when year = {y} then n end)"


def _at(y, default=0):
    return F.coalesce(F.max(F.when(F.col("year") == y, F.col("n"))), F.lit(default))


@query("cohort_range_filter", f"with {_PARTS}, x as (select term, coalesce({_AT.format(y=1996)}, 0) as a, coalesce({_AT.format(y=1999)}, 0) as b from po group by term) select term, a, b from x where a between 0 and 4 and b between 5 and 9")
def cohort_range_filter(spark, d):
    return _parts(spark, d).groupBy("term").agg(_at(1996).alias("a"), _at(1999).alias("b")).where("a between 0 and 4 and b between 5 and 9")


@query("absent_in_references", "select distinct l_partkey as part from lineitem where year(l_shipdate) = 2000 and l_returnflag = 'R' and l_partkey not in (select l_partkey from lineitem where year(l_shipdate) = 1996 and l_returnflag = 'R') and l_partkey not in (select l_partkey from lineitem where year(l_shipdate) = 1998 and l_returnflag = 'R')")
def absent_in_references(spark, d):
    o = occurrences(spark, d).where("flag = 'R'").select("part", "year")
    x = o.where("year = 2000").select("part").distinct()
    for y in (1996, 1998):
        x = x.join(o.where(F.col("year") == y).select("part"), "part", "left_anti")
    return x


@query("change_bins", f"""with {_PARTS}, x as (select term, coalesce({_AT.format(y=1996)}, 0) as r, coalesce({_AT.format(y=1998)}, 0) as p from po group by term), y as (select *, (p - r) / (p + r + 1e-6) as change from x)
select term, round(change, 6) + 0.0 as change, case when change > 0.3 then 2 when change > -0.3 then 1 else 0 end as bin from y""")
def change_bins(spark, d):
    x = _parts(spark, d).groupBy("term").agg(_at(1996).alias("r"), _at(1998).alias("p"))
    x = x.withColumn("change", (F.col("p") - F.col("r")) / (F.col("p") + F.col("r") + 1e-6))
    return x.select("term", (F.round("change", 6) + 0.0).alias("change"), F.when(F.col("change") > 0.3, 2).when(F.col("change") > -0.3, 1).otherwise(0).alias("bin"))


@query("total_prominence", f"""with {_PARTS}, x as (select term, year, n, n - lag(n) over w as d, sum(n) over w as total from po window w as (partition by term order by year))
select term, year, round(log2(d + 1) * (d + 1) / (total + 1), 6) as prominence from x where d > 0""")
def total_prominence(spark, d):
    w = Window.partitionBy("term").orderBy("year")
    x = _parts(spark, d).withColumn("d", F.col("n") - F.lag("n").over(w)).withColumn("total", F.sum("n").over(w)).where("d > 0")
    return x.select("term", "year", F.round(F.log2(F.col("d") + 1) * (F.col("d") + 1) / (F.col("total") + 1), 6).alias("prominence"))


@query("trend_of_top_terms", f"with {OCC}, c as (select term, year, count(distinct doc) as n from occ group by all), t as (select term, row_number() over (order by sum(n) desc, term) as rank from c group by term) select term, year, n, rank from c join t using (term) where rank <= 10")
def trend_of_top_terms(spark, d):
    c = yearly_counts(spark, d)
    top = c.groupBy("term").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "term").limit(10)  # a report
    top = top.select("term", F.row_number().over(Window.partitionBy().orderBy(F.desc("t"), "term")).alias("rank"))
    return c.join(F.broadcast(top), "term").select("term", "year", "n", "rank")


@query("feature_given_year", f"with {OCC}, c as (select brand as feature, year, count(*) as n from occ group by all) select feature, year, round(n / sum(n) over (partition by year), 6) as p_f_y, round(n / sum(n) over (partition by feature), 6) as p_y_f from c")
def feature_given_year(spark, d):
    c = occurrences(spark, d).groupBy(F.col("brand").alias("feature"), "year").agg(F.count("*").alias("n"))
    by = {k: c.groupBy(k).agg(F.sum("n").alias(f"n_{k}")) for k in ("year", "feature")}
    x = c.join(by["year"], "year").join(by["feature"], "feature")
    return x.select("feature", "year", F.round(F.col("n") / F.col("n_year"), 6).alias("p_f_y"), F.round(F.col("n") / F.col("n_feature"), 6).alias("p_y_f"))


@query("top_features_per_term", f"with {OCC}, c as (select term, brand, count(*) as n from occ group by all) select term, brand, n, rank from (select *, row_number() over (partition by term order by n desc, brand) as rank from c) where rank <= 3")
def top_features_per_term(spark, d):
    c = occurrences(spark, d).groupBy("term", "brand").agg(F.count("*").alias("n"))
    return P.top_k(c, ["term"], [F.desc("n"), "brand"], 3)


@query("series_classes", f"""with {OCC}, s as (select part, year, avg(score) as s from occ group by all), x as (select part, round(sum(s), 6) as total, stddev_pop(s) as spread, max(case when year = 1995 then s end) as first, max(case when year = 2001 then s end) as last from s group by part having count(*) = 7)
select part, total < 3 as low, total between 3.25 and 3.75 as medium, total > 4 as high, spread > 0.02 and round(last - first, 6) > 0.2 as rising from x""")
def series_classes(spark, d):
    """Classes of complete series; they may overlap."""
    s = occurrences(spark, d).groupBy("part", "year").agg(F.avg("score").alias("s"))
    x = s.groupBy("part").agg(F.count("*").alias("k"), F.round(F.sum("s"), 6).alias("total"), F.stddev_pop("s").alias("spread"), *[F.max(F.when(F.col("year") == y, F.col("s"))).alias(a) for y, a in ((1995, "first"), (2001, "last"))]).where("k = 7")
    return x.select("part", (F.col("total") < 3).alias("low"), F.col("total").between(3.25, 3.75).alias("medium"), (F.col("total") > 4).alias("high"), ((F.col("spread") > 0.02) & (F.round(F.col("last") - F.col("first"), 6) > 0.2)).alias("rising"))


@query("trend_predicate", f"with {OCC}, x as (select part, avg(case when year = 1996 then score end) as s1, avg(case when year = 2000 then score end) as s2 from occ group by part) select part, round(s1, 6) as s1, round(s2, 6) as s2 from x where s1 > 0 and s2 > 0.1 and s2 > 3 * s1")
def trend_predicate(spark, d):
    """Means are summed in the table's order; a threefold growth is decided by their last digits."""
    x = S.means_in_order(occurrences(spark, d, at=True), "part", {a: F.when(F.col("year") == y, F.col("score")) for y, a in ((1996, "s1"), (2000, "s2"))})
    return x.where(T.rising(F.col("s1"), F.col("s2"))).select("part", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"))


@query("years_by_category", "select cast(year(o_orderdate) as integer) as year, c_mktsegment as category, count(*) as n from orders join customer on o_custkey = c_custkey where year(o_orderdate) >= 1990 group by all")
def years_by_category(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).where("year >= 1990")
    return o.join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("category")), F.col("o_custkey") == F.col("c_custkey")).groupBy("year", "category").agg(F.count("*").alias("n"))


@query("nation_region_rollup", "select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def nation_region_rollup(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    x = table(spark, d, "customer").select("c_nationkey", "c_acctbal").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("first_domain", f"with {OCC} select doc, arg_min(brand, loc * 1000 + part / 100000) as domain from occ group by doc")
def first_domain(spark, d):
    """The category of a document's first row (line numbers may repeat; the smaller part comes first)."""
    return occurrences(spark, d).groupBy("doc").agg(F.min_by("brand", F.col("loc") * 1000 + F.col("part") / 100000).alias("domain"))


@query("singleton_sections", f"with {OCC} select doc, section, part from (select doc, section, part, row_number() over (partition by doc, section order by loc, part) as r from occ) where r = 1")
def singleton_sections(spark, d):
    return P.top_k(occurrences(spark, d).select("doc", "section", "part", "loc"), ["doc", "section"], ["loc", "part"], 1).select("doc", "section", "part")


@query("two_score_comparison", f"""with {OCC}, a as (select part, avg(score) as s from occ where year < 1998 group by part), b as (select part, avg(score) as s from occ where year >= 1998 group by part)
select count(*) as terms, round(avg(coalesce(a.s, 0) - coalesce(b.s, 0)), 6) + 0.0 as mean_difference from (select p_partkey as part from part) p left join a using (part) left join b using (part)""")
def two_score_comparison(spark, d):
    s = occurrences(spark, d).groupBy("part").agg(F.avg(F.when(F.col("year") < 1998, F.col("score"))).alias("a"), F.avg(F.when(F.col("year") >= 1998, F.col("score"))).alias("b"))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("part")).join(s, "part", "left")
    return x.agg(F.count("*").alias("terms"), (F.round(F.avg(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))), 6) + 0.0).alias("mean_difference"))


@query("overlap_share", "select round(count(case when toxic = 1 then 1 end) / count(*), 6) as share, count(*) as labelled from labels join documents using (doc_id) where quality = 1")
def overlap_share(spark, d):
    x = table(spark, d, "labels").where("quality = 1").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    return x.agg(F.round(F.count(F.when(F.col("toxic") == 1, 1)) / F.count("*"), 6).alias("share"), F.count("*").alias("labelled"))


@query("super_terms", f"with {OCC}, c as (select term, count(*) as n from occ group by term), x as (select term, n, unnest([string_split(term, ' ')[1], string_split(term, ' ')[-1]]) as word, unnest(['modifier', 'head']) as side from c) select word, side, count(*) as terms, count(case when n >= 2 then 1 end) as terms2, sum(n)::bigint as total from x group by all")
def super_terms(spark, d):
    w = F.split("term", " ")
    c = occurrences(spark, d).groupBy("term").agg(F.count("*").alias("n"))
    x = c.select("term", "n", F.inline(F.array(F.struct(F.element_at(w, 1).alias("word"), F.lit("modifier").alias("side")), F.struct(F.element_at(w, -1).alias("word"), F.lit("head").alias("side")))))
    return x.groupBy("word", "side").agg(F.count("*").alias("terms"), F.count(F.when(F.col("n") >= 2, 1)).alias("terms2"), F.sum("n").alias("total"))


@query("document_summaries", f"with {OCC} select doc, coalesce(string_agg(distinct case when flag = 'N' then term end, ';' order by case when flag = 'N' then term end), '') as n, coalesce(string_agg(distinct case when flag = 'A' then term end, ';' order by case when flag = 'A' then term end), '') as a, coalesce(string_agg(distinct case when flag = 'R' then term end, ';' order by case when flag = 'R' then term end), '') as r from occ group by doc")
def document_summaries(spark, d):
    terms = lambda f: F.array_join(F.array_sort(F.collect_set(F.when(F.col("flag") == f, F.col("term")))), ";")
    return occurrences(spark, d).groupBy("doc").agg(*[terms(f).alias(f.lower()) for f in "NAR"])


@query("head_modifier_pairs", "with p as (select distinct p_name as term, string_split(p_name, ' ') as w from part) select term, w[i] as modifier, w[j] as head from p, (select unnest(generate_series(1, 8)) as i), (select unnest(generate_series(2, 8)) as j) where i < j and j <= len(w)")
def head_modifier_pairs(spark, d):
    return B.all_pairs(table(spark, d, "part").select(F.col("p_name").alias("term")))


@query("compound_bracketing")
def compound_bracketing(spark, d):
    """Best trees of the benchmark's four-word sequences by its adjacent word pairs."""
    w = F.split(F.lower("text"), " ")
    b = table(spark, d, "benchmark").where(F.size(w) >= 4)
    grams = lambda n: b.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).alias("term"))
    two = F.split("term", " ")
    counts = grams(2).groupBy(two[0].alias("modifier"), two[1].alias("head")).agg(F.count("*").alias("n"))
    return B.bracket(grams(4), counts)


_SINGULAR = "case when regexp_matches(x, '(ss|us|is)$') or length(x) < 4 then x when regexp_matches(x, 'ies$') then regexp_replace(x, 'ies$', 'y') when regexp_matches(x, '(ch|sh|x|s|z)es$') then regexp_replace(x, 'es$', '') when regexp_matches(x, 's$') then regexp_replace(x, 's$', '') else x end"


@query("canonical_phrases", f"""with p as (select distinct p_type || ' ' || p_name || 's' as phrase from part) select phrase, array_to_string(list_transform(string_split(lower(phrase), ' '), lambda x: {_SINGULAR}), ' ') as canonical from p""")
def canonical_phrases(spark, d):
    x = table(spark, d, "part").select(F.concat("p_type", F.lit(" "), "p_name", F.lit("s")).alias("phrase")).distinct()
    return x.select("phrase", T.canonical_phrase(F.col("phrase")).alias("canonical"))


@query("shared_word_counts", "with p as (select distinct p_name as term from part) select a.term as t1, count(*) as sharing from p a join p b on a.term <> b.term and len(list_intersect(string_split(a.term, ' '), string_split(b.term, ' '))) > 0 group by a.term")
def shared_word_counts(spark, d):
    """Terms that share a word, through the words and not by comparing all terms."""
    p = table(spark, d, "part").select(F.col("p_name").alias("term")).distinct().select("term", F.explode(F.split("term", " ")).alias("word"))
    return p.withColumnRenamed("term", "t1").join(p, "word").where("t1 != term").select("t1", "term").distinct().groupBy("t1").agg(F.count("*").alias("sharing"))


@query("ascii_histogram", f"with {OCC}, c as (select brand, count(*) as n from occ group by brand) select brand, n, repeat('*', (n * 50 // (select max(n) from c))::int) as bar from c")
def ascii_histogram(spark, d):
    c = occurrences(spark, d).groupBy("brand").agg(F.count("*").alias("n"))
    x = c.crossJoin(F.broadcast(c.agg(F.max("n").alias("m"))))  # one row
    return x.select("brand", "n", F.expr("repeat('*', cast(n * 50 div m as int))").alias("bar"))


@query("annotation_batches", "select doc_id, (ceil(row_number() over (partition by lang order by doc_id) / 50.0))::int as batch, lang from documents")
def annotation_batches(spark, d):
    from termloom.operators.stats import numbered

    x = numbered(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], "n")
    return x.select("doc_id", F.ceil(F.col("n") / 50.0).cast("int").alias("batch"), "lang")

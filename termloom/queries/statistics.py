"""Aggregations and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog import query, table
from termloom.functions import terms as T
from termloom.operators import stats as S

from .views import COUNTS, OCC, occurrences, yearly_counts

_TFS = OCC + """, pairs as (select distinct year, doc, term, feature from occ), n as (select year, count(distinct doc) as n_docs from occ group by all),
 tf as (select year, term, feature, count(*) as df from pairs group by all),
 t as (select year, term, count(distinct doc) as df_term from pairs group by all), f as (select year, feature, count(distinct doc) as df_feat from pairs group by all)"""


@query("term_feature_npmi", f"""with {_TFS}
select year, term, feature, df, df_term, df_feat, round(df / n_docs, 6) as p, round(df / df_term, 6) as p_f_t, round(df / df_feat, 6) as p_t_f,
 round(case when df < n_docs then log2((df / n_docs) / ((df_term / n_docs) * (df_feat / n_docs))) / -log2(df / n_docs) end, 6) as npmi
from tf join t using (year, term) join f using (year, feature) join n using (year)""")
def term_feature_npmi(spark, d):
    return S.term_feature_stats(occurrences(spark, d))


@query("pair_npmi", f"""with {OCC}, dt as (select distinct year, doc, term from occ), n as (select year, count(distinct doc) as n_docs from occ group by all),
 df as (select year, term, count(*) as df from dt group by all),
 fr as (select dt.* from dt join df using (year, term) where df >= 2), p as (select a.year, a.term as t1, b.term as t2, count(*) as pair_df from fr a join fr b on a.year = b.year and a.doc = b.doc and a.term < b.term group by all),
 x as (select p.year, t1, t2, pair_df, d1.df as df1, d2.df as df2, case when pair_df < n_docs then log2((pair_df / n_docs) / ((d1.df / n_docs) * (d2.df / n_docs))) / -log2(pair_df / n_docs) end as m
  from p join df d1 on d1.year = p.year and d1.term = t1 join df d2 on d2.year = p.year and d2.term = t2 join n on n.year = p.year)
select year, t1, t2, pair_df, df1, df2, round(m, 6) + 0.0 as npmi, round(m * log2(pair_df), 6) + 0.0 as fpmi from x""")
def pair_npmi(spark, d):
    return S.pair_stats(occurrences(spark, d))


@query("sum_scores", f"""with {OCC} select term, round(avg(score), 6) as avg_score, count(*) as n, round(min(score), 6) as min_score, round(max(score), 6) as max_score from occ group by term""")
def sum_scores(spark, d):
    x = S.sum_scores(occurrences(spark, d))
    return x.select("term", *[F.round(c, 6).alias(c) if c != "n" else F.col(c) for c in ("avg_score", "n", "min_score", "max_score")])


_BINS = ", ".join(f"count(case when b = {k} then 1 end) as v{k}" for k in range(10))


@query("score_bins_by_year", f"""with {OCC}, s as (select *, case when score <= 1 then least(floor(score * 10), 9)::int end as b from occ)
select year, term, round(avg(score), 6) as score, count(*) as doc_count, {_BINS} from s group by year, term""")
def score_bins_by_year(spark, d):
    return S.score_bins(occurrences(spark, d)).withColumn("score", F.round("score", 6))


@query("bins_weighted_merge", f"""with {OCC}, s as (select *, case when score <= 1 then least(floor(score * 10), 9)::int end as b from occ),
 p as (select year, term, avg(score) as score, count(*) as doc_count, {_BINS} from s group by year, term)
select term, round(sum(score * doc_count) / sum(doc_count), 6) as score, sum(doc_count)::bigint as doc_count, {", ".join(f"sum(v{k})::bigint as v{k}" for k in range(10))} from p group by term having sum(doc_count) > 1""")
def bins_weighted_merge(spark, d):
    return S.merge_bins(S.score_bins(occurrences(spark, d))).withColumn("score", F.round("score", 6))


@query("normalized_bins", f"""with {OCC}, s as (select *, case when score <= 1 then least(floor(score * 10), 9)::int end as b from occ), p as (select year, term, count(*) as doc_count, {_BINS} from s group by all)
select year, term, {", ".join(f"round(v{k} / doc_count, 6) as s{k}" for k in range(10))} from p""")
def normalized_bins(spark, d):
    return S.score_bins(occurrences(spark, d)).select("year", "term", *[F.round(F.col(f"v{k}") / F.col("doc_count"), 6).alias(f"s{k}") for k in range(10)])


@query("inverted_index", f"""with {OCC} select doc, term, count(*) as n, string_agg(loc::varchar, ' ' order by loc) as locs from occ group by doc, term""")
def inverted_index(spark, d):
    return S.inverted_index(occurrences(spark, d))


@query("corpus_frequency", f"""with {OCC} select term, count(*) as corpus_freq, count(distinct doc) as doc_freq from occ group by term""")
def corpus_frequency(spark, d):
    return occurrences(spark, d).groupBy("term").agg(F.count("*").alias("corpus_freq"), F.countDistinct("doc").alias("doc_freq"))


@query("doc_features", f"""with {OCC} select year, doc, term, year::varchar || '|' || doc::varchar || '|' || replace(term, ' ', '_') as uid, string_agg(distinct feature, ' ' order by feature) as feats from occ group by year, doc, term""")
def doc_features(spark, d):
    x = occurrences(spark, d).groupBy("year", "doc", "term").agg(F.array_join(F.array_sort(F.collect_set("feature")), " ").alias("feats"))
    return x.select("year", "doc", "term", T.instance_key(F.col("doc"), F.col("year"), F.col("term")).alias("uid"), "feats")


@query("frequency_of_frequencies", f"""with {OCC}, c as (select part, count(*) as n from occ group by part) select n, count(*) as terms from c group by n""")
def frequency_of_frequencies(spark, d):
    return occurrences(spark, d).groupBy("part").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("terms"))


@query("threshold_counts", f"""with {OCC}, c as (select part, count(*) as n from occ group by part) select t, count(*) as terms from c, (select unnest([5, 10, 25, 50, 100]) as t) where n >= t group by t""")
def threshold_counts(spark, d):
    """A term lands under every threshold that it reaches; thresholds are a constant list within each row."""
    c = occurrences(spark, d).groupBy("part").agg(F.count("*").alias("n"))
    reached = F.filter(F.array(*[F.lit(t) for t in (5, 10, 25, 50, 100)]), lambda t: t <= F.col("n"))
    return c.select(F.explode(reached).alias("t")).groupBy("t").agg(F.count("*").alias("terms"))


@query("head_mod_dispersion", f"""with {OCC}, c as (select year, list_extract(string_split(term, ' '), -1) as word, term, count(*) as c from occ where len(string_split(term, ' ')) > 1 group by all),
 p as (select *, c / sum(c) over (partition by year, word) as p from c)
select year, word, count(*) as dispersion, sum(c)::bigint as total, round(-sum(case when p > 0 then p * log2(p) else 0 end), 6) as entropy from p group by year, word""")
def head_mod_dispersion(spark, d):
    return S.dispersion(occurrences(spark, d), "head")


@query("modifier_dispersion", f"""with {OCC}, c as (select year, string_split(term, ' ')[1] as word, term, count(*) as c from occ where len(string_split(term, ' ')) > 1 group by all),
 p as (select *, c / sum(c) over (partition by year, word) as p from c)
select year, word, count(*) as dispersion, sum(c)::bigint as total, round(-sum(case when p > 0 then p * log2(p) else 0 end), 6) as entropy from p group by year, word""")
def modifier_dispersion(spark, d):
    return S.dispersion(occurrences(spark, d), "modifier")


@query("mod_entropy", f"""with {OCC}, w as (select string_split(term, ' ')[-1] as head, string_split(term, ' ')[1] as modifier, count(*) as c from occ group by all), p as (select *, c / sum(c) over (partition by head) as p from w)
select head, count(*) as modifiers, round(-sum(p * log2(p)), 6) as entropy from p group by head""")
def mod_entropy(spark, d):
    from pyspark.sql import Window

    w = F.split("term", " ")
    c = occurrences(spark, d).groupBy(F.element_at(w, -1).alias("head"), F.element_at(w, 1).alias("modifier")).agg(F.count("*").alias("c"))
    c = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("head")))
    return c.groupBy("head").agg(F.count("*").alias("modifiers"), F.round(T.entropy(F.col("p")), 6).alias("entropy"))


@query("section_doc_counts", f"""with {OCC} select year, term, count(distinct doc) as docs, count(distinct case when section = 'F' then doc end) as docs_f, count(distinct case when section = 'O' then doc end) as docs_o from occ group by year, term""")
def section_doc_counts(spark, d):
    return S.section_counts(occurrences(spark, d))


@query("word_dispersion", "select word, count(*) as n, count(distinct p_name) as phrases from (select p_name, unnest(string_split(p_name, ' ')) as word from part) group by word")
def word_dispersion(spark, d):
    return S.word_dispersion(table(spark, d, "part").select(F.col("p_name").alias("term")))


@query("phrase_probability", """with w as (select p_partkey, unnest(string_split(p_name, ' ')) as word from part), p as (select word, count(*) / (select count(*) from w) as p from w group by word)
select p_name as term, round(sum(p), 6) as prob from (select distinct p_name, unnest(string_split(p_name, ' ')) as word from (select distinct p_name from part)) join p using (word) group by p_name""")
def phrase_probability(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    total = words.agg(F.count("*").alias("all"))
    p = words.groupBy("word").agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).select("word", (F.col("c") / F.col("all")).alias("p"))  # one row
    phrases = table(spark, d, "part").select(F.col("p_name").alias("term")).distinct().select("term", F.explode(F.array_distinct(F.split("term", " "))).alias("word"))
    return phrases.join(p, "word").groupBy("term").agg(F.round(F.sum("p"), 6).alias("prob"))


@query("subphrase_counts", """with b as (select item_id, string_split(text, ' ') as w from benchmark), g as (select array_to_string(w[i:i + n - 1], ' ') as sub, n, item_id from b, (select unnest(generate_series(1, 5)) as n), (select unnest(generate_series(1, 200)) as i) where i + n - 1 <= len(w))
select sub, n, count(*) as total, count(distinct item_id) as items from g group by sub, n""")
def subphrase_counts(spark, d):
    """Sub-phrases of up to five words."""
    w = F.split("text", " ")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size(w), F.lit(5))), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.struct(F.array_join(F.slice(w, i, n), " ").alias("sub"), n.alias("n")))))
    x = table(spark, d, "benchmark").select("item_id", F.inline(grams))
    return x.groupBy("sub", F.col("n").cast("long").alias("n")).agg(F.count("*").alias("total"), F.countDistinct("item_id").alias("items"))


@query("feature_value_counts", f"""with {OCC} select feature, count(*) as n, count(distinct term) as terms from occ group by feature having count(*) > 5""")
def feature_value_counts(spark, d):
    return occurrences(spark, d).groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms")).where("n > 5")


@query("feature_year_rollup", f"""with {OCC} select feature, year, count(*) as n from occ group by rollup (feature, year)""")
def feature_year_rollup(spark, d):
    return occurrences(spark, d).rollup("feature", "year").agg(F.count("*").alias("n"))


@query("usage_rollup", f"""with {OCC} select year, section, flag, count(*) as n, grouping(section)::bigint as g from occ group by grouping sets ((year, section, flag), (year, flag))""")
def usage_rollup(spark, d):
    occurrences(spark, d).createOrReplaceTempView("termloom_occ")
    return spark.sql("select year, section, flag, count(*) as n, cast(grouping(section) as bigint) as g from termloom_occ group by grouping sets ((year, section, flag), (year, flag))")


@query("weighted_maturity_rollup", f"""with {OCC}, c as (select year, section, case when flag = 'N' then 0 when flag = 'A' then 1 else 2 end as m, case when section = 'F' then 3 else 1 end as w, count(*) as n from occ group by all)
select year, section, round(coalesce(sum(m * w * n) / sum(w * n) / 2, 0), 6) as score from c group by rollup (year, section)""")
def weighted_maturity_rollup(spark, d):
    m = F.when(F.col("flag") == "N", 0).when(F.col("flag") == "A", 1).otherwise(2)
    c = occurrences(spark, d).groupBy("year", "section", m.alias("m"), F.when(F.col("section") == "F", 3).otherwise(1).alias("w")).agg(F.count("*").alias("n"))
    score = F.sum(F.col("m") * F.col("w") * F.col("n")) / F.sum(F.col("w") * F.col("n")) / 2
    return c.rollup("year", "section").agg(F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))


@query("score_histogram", f"""with {OCC}, s as (select doc, avg(score) as s from occ group by doc) select least(floor(s * 10), 9)::bigint as bin, count(*) as n from s group by 1""")
def score_histogram(spark, d):
    """Means are summed in the table's order."""
    s = S.means_in_order(occurrences(spark, d, at=True), "doc", {"s": F.col("score")})
    return s.groupBy(F.least(F.floor(F.col("s") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("category_pivot_argmax", f"""with {OCC}, c as (select term, flag, count(*) as n from occ group by all)
select term, max(case when flag = 'A' then n else 0 end)::bigint as a, max(case when flag = 'N' then n else 0 end)::bigint as n, max(case when flag = 'R' then n else 0 end)::bigint as r,
 arg_max(flag, n::double * 1000 + ascii(flag)) as best from c group by term""")
def category_pivot_argmax(spark, d):
    """The last category wins ties."""
    c = occurrences(spark, d).groupBy("term", "flag").agg(F.count("*").alias("n"))
    best = S.category_argmax(c, "term", "flag", "n", last_wins=True).select("term", F.col("flag").alias("best"))
    wide = c.groupBy("term").agg(*[F.coalesce(F.max(F.when(F.col("flag") == x, F.col("n"))), F.lit(0)).alias(x.lower()) for x in "ANR"])
    return wide.join(best, "term").select("term", "a", "n", "r", "best")


@query("abstract_pivot", f"""with {OCC} select term, {", ".join(f"count(distinct case when year = {y} and section = 'F' then doc end) as y{y}" for y in range(1995, 2002))} from occ group by term""")
def abstract_pivot(spark, d):
    return occurrences(spark, d).groupBy("term").agg(*[F.countDistinct(F.when((F.col("year") == y) & (F.col("section") == "F"), F.col("doc"))).alias(f"y{y}") for y in range(1995, 2002)])


@query("global_statistics", f"""with {OCC}, s as (select term, avg(score) as s, count(*) as n from occ group by term) select count(*) as terms, sum(n)::bigint as instances, max(n) as most, round(max(s), 6) as top, count(case when s > 0.5 then 1 end) as high, sum(case when s > 0.5 then n else 0 end)::bigint as high_instances from s""")
def global_statistics(spark, d):
    s = occurrences(spark, d).groupBy("term").agg(F.avg("score").alias("s"), F.count("*").alias("n"))
    return s.agg(F.count("*").alias("terms"), F.sum("n").alias("instances"), F.max("n").alias("most"), F.round(F.max("s"), 6).alias("top"), F.count(F.when(F.col("s") > 0.5, 1)).alias("high"), F.sum(F.when(F.col("s") > 0.5, F.col("n")).otherwise(0)).alias("high_instances"))


@query("order_statistics_of_features", f"""with {OCC}, f as (select term, brand, min(year) as y from occ group by all)
select a.brand as f1, b.brand as f2, count(case when a.y < b.y then 1 end) as before, count(case when a.y > b.y then 1 end) as after, count(case when a.y = b.y then 1 end) as same from f a join f b on a.term = b.term and a.brand < b.brand group by all""")
def order_statistics_of_features(spark, d):
    """Which of two features a term had first, for all pairs of features."""
    f = occurrences(spark, d).groupBy("term", "brand").agg(F.min("year").alias("y"))
    a, b = f.select("term", F.col("brand").alias("f1"), F.col("y").alias("y1")), f.select("term", F.col("brand").alias("f2"), F.col("y").alias("y2"))
    return a.join(b, "term").where("f1 < f2").groupBy("f1", "f2").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("before", F.expr("y1 < y2")), ("after", F.expr("y1 > y2")), ("same", F.expr("y1 = y2")))])


@query("mean_by_key", f"""with {OCC} select term, round(avg(score), 6) as mean_score, round(avg(loc), 6) as mean_loc, round(stddev_pop(score), 6) as spread from occ group by term""")
def mean_by_key(spark, d):
    return occurrences(spark, d).groupBy("term").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("loc"), 6).alias("mean_loc"), F.round(F.stddev_pop("score"), 6).alias("spread"))


@query("canonical_surface_forms", "select lower(c_mktsegment) as canonical, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as forms, count(*) as n from customer group by 1")
def canonical_surface_forms(spark, d):
    return table(spark, d, "customer").groupBy(F.lower("c_mktsegment").alias("canonical")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("forms"), F.count("*").alias("n"))


@query("tfidf_terms", f"""with {COUNTS}, n as (select year, count(distinct doc) as n_docs from occ group by all), tf as (select term, year, count(*) as tf from occ group by all)
select term, year, tf, n as df, round(tf * log2(floor(n_docs / (n + 1))), 6) as tfidf from counts join tf using (term, year) join n using (year)""")
def tfidf_terms(spark, d):
    occ = occurrences(spark, d)
    tf = occ.groupBy("term", "year").agg(F.count("*").alias("tf"))
    x = yearly_counts(spark, d).join(tf, ["term", "year"]).join(S.corpus_size(occ), "year")
    return x.select("term", "year", "tf", F.col("n").alias("df"), F.round(T.tfidf(F.col("tf"), F.col("n"), F.col("n_docs")), 6).alias("tfidf"))

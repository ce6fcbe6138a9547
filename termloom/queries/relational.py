"""Predicates, joins, set operations, top-k and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.catalog import query, table
from termloom.functions import terms as T
from termloom.operators import sampling as P
from termloom.operators import stats as S

from .views import COUNTS, OCC, SIZES, occurrences, year_sizes, yearly_counts

_TOKENS = "tok as (select distinct unnest(string_split(text, ' ')) as term from documents)"


def _tokens(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("term")).distinct()


_LETTERS = r"length(regexp_replace(term, '[^\p{L}]', '', 'g'))"
_BAD = rf"(trim(term) = '' or not regexp_matches(term, '^[\p{{L}}\p{{N}}]') or contains(term, '---') or contains(term, '___') or {_LETTERS} * 2 < length(term) or length(term) > 75"


@query("term_filters", rf"""with {_TOKENS} select term, {_BAD} or lower(term) in ('end', 'none', 'untitled')) as bad, {_BAD}) as bad_plain, contains(term, ' ') or contains(term, '---') or contains(term, '___') or length(term) > 75 as bad_joined,
 length(term) > 75 or {_LETTERS} < length(term) - {_LETTERS} as symbols, regexp_matches(term, '^[a-z ]{{2,}}$') as alphabetic, regexp_matches(term, '^[\x00-\x7f]*$') as is_ascii from tok""")
def term_filters(spark, d):
    t = F.col("term")
    return _tokens(spark, d).select("term", T.bad_term(t).alias("bad"), T.bad_term(t, ()).alias("bad_plain"), T.bad_joined_term(t).alias("bad_joined"), T.mostly_symbols(t).alias("symbols"), T.alphabetic(t).alias("alphabetic"), t.rlike(r"^[\x00-\x7f]*$").alias("is_ascii"))


_RIGHT = "case " + " ".join(f"when s > {k / 10} then {k}" for k in range(9, 0, -1)) + " else 0 end"


@query("bins", f"""with {OCC}, x as (select distinct score as s from occ union select distinct score * score from occ) select round(s, 9) as s, {_RIGHT} as right_closed, case when s <= 1 then least(floor(s * 10), 9)::int end as left_closed, least(floor(s * 20), 19)::int as twenty,
 case when s < 0.5 then 0 when s < 2 then 1 else 2 end as ternary, case when s between 0.6 and 1 then 'y' when s between 0 and 0.2 then 'n' end as label from x""")
def bins(spark, d):
    occ = occurrences(spark, d)
    x = occ.select(F.col("score").alias("s")).union(occ.select(F.col("score") * F.col("score"))).distinct()
    s = F.col("s")
    return x.select(F.round(s, 9).alias("s"), T.bin_right_closed(s).alias("right_closed"), T.bin_left_closed(s).alias("left_closed"), T.bin_twenty(s).alias("twenty"), T.ternary(s).alias("ternary"), T.label_by_range(s).alias("label"))


@query("phrase_forms", """select distinct p_name as term, '[ ' || replace(p_name, ' ', ' | ') || ' ]' as separated, '[ ' || replace(p_name, ' ', ' | ') || ' |' as left_form, '| ' || replace(p_name, ' ', ' | ') || ' ]' as right_form,
 len(string_split(p_name, ' '))::int as plen, string_split(p_name, ' ')[-1] as last_word, case when len(string_split(p_name, ' ')) > 1 then string_split(p_name, ' ')[1] end as first_word,
 case when length(p_name) >= 6 then right(p_name, 3) end as suffix3, 'name=' || replace(p_name, ' ', '_') as feature from part""")
def phrase_forms(spark, d):
    t = F.col("term")
    w = F.split(t, " ")
    return table(spark, d, "part").select(F.col("p_name").alias("term")).distinct().select(
        "term", T.separated(t).alias("separated"), T.boundary_pattern(t, "l").alias("left_form"), T.boundary_pattern(t, "r").alias("right_form"),
        F.size(w).alias("plen"), F.element_at(w, -1).alias("last_word"), F.when(F.size(w) > 1, F.element_at(w, 1)).alias("first_word"),
        F.when(F.length(t) >= 6, F.expr("right(term, 3)")).alias("suffix3"), T.feature("name", t).alias("feature"),
    )


@query("variant_pairs", """with t as (select distinct p_name as term, string_split(p_name, ' ')[1] as m from part) select a.term as t1, b.term as t2, starts_with(b.term, left(a.term, greatest(length(a.term) - 2, 0))) as is_variant from t a join t b on a.m = b.m and a.term <> b.term""")
def variant_pairs(spark, d):
    """Terms that share their first word, and whether one begins with the other without its last two characters."""
    t = table(spark, d, "part").select(F.col("p_name").alias("t1"), F.element_at(F.split("p_name", " "), 1).alias("m")).distinct()
    return t.join(t.withColumnRenamed("t1", "t2"), "m").where("t1 != t2").select("t1", "t2", T.variant(F.col("t1"), F.col("t2")).alias("is_variant"))


@query("singular_forms", """with w as (select distinct unnest(string_split(lower(text), ' ')) as word from benchmark)
select word, case when regexp_matches(word, '(ss|us|is)$') or length(word) < 4 then word when regexp_matches(word, 'ies$') then regexp_replace(word, 'ies$', 'y') when regexp_matches(word, '(ch|sh|x|s|z)es$') then regexp_replace(word, 'es$', '')
 when regexp_matches(word, 's$') then regexp_replace(word, 's$', '') else word end as singular from w""")
def singular_forms(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct().select("word", T.singular(F.col("word")).alias("singular"))


@query("combine_scores_full_outer", f"""with {OCC}, f as (select part, count(*) as freq from occ where year < 1998 group by part), t as (select part, avg(score) as tech from occ where section = 'F' and year > 1999 group by part), m as (select part, max(year)::int as mat from occ where flag = 'R' and year < 1997 group by part)
select coalesce(f.part, t.part, m.part) as term, coalesce(freq, -1) as freq, round(coalesce(tech, -1), 6) as tech, coalesce(mat, -1)::int as mat from f full join t using (part) full join m on m.part = coalesce(f.part, t.part)""")
def combine_scores_full_outer(spark, d):
    o = occurrences(spark, d)
    f = o.where("year < 1998").groupBy("part").agg(F.count("*").alias("freq"))
    t = o.where("section = 'F' and year > 1999").groupBy("part").agg(F.avg("score").alias("tech"))
    m = o.where("flag = 'R' and year < 1997").groupBy("part").agg(F.max("year").alias("mat"))
    x = f.join(t, "part", "full_outer").join(m, "part", "full_outer")
    return x.select(F.col("part").alias("term"), F.coalesce("freq", F.lit(-1)).alias("freq"), F.round(F.coalesce("tech", F.lit(-1.0)), 6).alias("tech"), F.coalesce("mat", F.lit(-1)).alias("mat"))


@query("domain_score", f"""with {OCC}, a as (select part, count(*) as f from occ where section = 'F' group by part), b as (select part, count(*) as f from occ where section = 'O' group by part)
select a.part as term, round(ln(a.f) - ln(coalesce(b.f, 1)) + ln((select sum(f) from a)) - ln((select sum(f) from b)), 6) as score from a left join b using (part)""")
def domain_score(spark, d):
    """ln f1 - ln f2 + ln N1 - ln N2; a missing frequency is 1."""
    c = occurrences(spark, d).groupBy("part").agg(F.count(F.when(F.col("section") == "F", 1)).alias("a"), F.count(F.when(F.col("section") == "O", 1)).alias("b"))
    n = F.broadcast(c.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2")))  # one row
    x = c.where("a > 0").crossJoin(n)
    return x.select(F.col("part").alias("term"), F.round(F.log("a") - F.log(F.greatest("b", F.lit(1))) + F.log("n1") - F.log("n2"), 6).alias("score"))


@query("diff_score", f"""with {COUNTS}, {SIZES}, a as (select * from counts where year = 1996), b as (select * from counts where year = 2000)
select a.term, round(ln(coalesce(b.n, 1)) - ln(a.n) + ln((select n_docs from sizes where year = 1996)) - ln((select n_docs from sizes where year = 2000)), 6) as score, coalesce(u.cat, 'u') as cat
from a left join b using (term) left join (select p_name as term, max(p_type) as cat from part where p_type like 'E%' group by 1) u on u.term = a.term""")
def diff_score(spark, d):
    c, s = yearly_counts(spark, d), year_sizes(spark, d)
    a, b = c.where("year = 1996").select("term", "n"), c.where("year = 2000").select("term", F.col("n").alias("m"))
    sizes = F.broadcast(s.agg(F.max(F.when(F.col("year") == 1996, F.col("n_docs"))).alias("n1"), F.max(F.when(F.col("year") == 2000, F.col("n_docs"))).alias("n2")))  # one row
    cat = table(spark, d, "part").where("p_type like 'E%'").groupBy(F.col("p_name").alias("term")).agg(F.max("p_type").alias("cat"))
    x = a.join(b, "term", "left").join(cat, "term", "left").crossJoin(sizes)
    return x.select("term", F.round(F.log(F.coalesce("m", F.lit(1))) - F.log("n") + F.log("n1") - F.log("n2"), 6).alias("score"), F.coalesce("cat", F.lit("u")).alias("cat"))


@query("cat_filter", f"""with {OCC}, c as (select part, count(*) as f, avg(score) as s from occ group by part) select part as term, f as freq, round(s, 6) as score from c where f between 20 and 40 and s >= 0.5""")
def cat_filter(spark, d):
    """Means are summed in the table's order, as by the SQL on one thread; at the limit their last digits decide."""
    c = S.means_in_order(occurrences(spark, d, at=True), "part", {"score": F.col("score")}).withColumnsRenamed({"part": "term", "n": "freq"})
    return c.where("freq between 20 and 40 and score >= 0.5").withColumn("score", F.round("score", 6))


@query("ngram_growth", f"with {COUNTS} select a.term, a.n as f1, b.n as f2, b.n - a.n as growth, round((b.n - a.n) / b.n, 6) as relative from counts a join counts b using (term) where a.year = 1996 and b.year = 1999")
def ngram_growth(spark, d):
    """Relative to the later year."""
    c = yearly_counts(spark, d)
    x = c.where("year = 1996").select("term", F.col("n").alias("f1")).join(c.where("year = 1999").select("term", F.col("n").alias("f2")), "term")
    return x.select("term", "f1", "f2", (F.col("f2") - F.col("f1")).alias("growth"), F.round((F.col("f2") - F.col("f1")) / F.col("f2"), 6).alias("relative"))


@query("cohort_feature_lift", f"""with {OCC}, y as (select part, min(year) as y from occ group by part), f as (select distinct part, doc, brand, y from occ join y using (part)),
 x as (select brand, count(distinct case when part % 3 = 0 then doc end) as a, count(distinct doc) as b from f group by brand)
select brand as feature, a, b, round((a / (select count(distinct doc) from f where part % 3 = 0)) / (b / (select count(distinct doc) from f)), 6) as lift from x""")
def cohort_feature_lift(spark, d):
    """P(feature | cohort) / P(feature); the cohort is a property of the term, here every third part, as the test tables have no cohorts of use."""
    f = occurrences(spark, d).select("doc", F.col("brand").alias("feature"), (F.col("part") % 3 == 0).alias("cohort"))
    member = F.when(F.col("cohort"), F.col("doc"))
    whole = F.broadcast(f.agg(F.countDistinct(member).alias("ca"), F.countDistinct("doc").alias("cb")))  # one row
    x = f.groupBy("feature").agg(F.countDistinct(member).alias("a"), F.countDistinct("doc").alias("b")).crossJoin(whole)
    return x.select("feature", "a", "b", F.round((F.col("a") / F.col("ca")) / (F.col("b") / F.col("cb")), 6).alias("lift"))


@query("score_differences", f"""with {OCC}, a as (select part, avg(score) as s from occ where flag = 'A' group by part), n as (select part, avg(score) as s from occ where flag = 'N' group by part), r as (select part, avg(score) as s from occ where flag = 'R' group by part)
select part as term, round(coalesce(a.s, 0) - coalesce(n.s, 0), 6) + 0.0 as diff, round(coalesce(a.s, 0) / (coalesce(n.s, 0) + 1e-5), 6) as ratio, round(coalesce(a.s, 0) * coalesce(r.s, 0), 6) as product from a full join n using (part) full join r using (part)""")
def score_differences(spark, d):
    """Three score lists side by side in one aggregation, missing 0: what two full outer joins give."""
    x = occurrences(spark, d).groupBy(F.col("part").alias("term")).agg(*[F.coalesce(F.avg(F.when(F.col("flag") == c, F.col("score"))), F.lit(0.0)).alias(c) for c in "ANR"])
    return x.select("term", (F.round(F.col("A") - F.col("N"), 6) + 0.0).alias("diff"), F.round(F.col("A") / (F.col("N") + 1e-5), 6).alias("ratio"), F.round(F.col("A") * F.col("R"), 6).alias("product"))


@query("range_join_years", f"""with {OCC} select p.name as period, count(*) as n from occ join (values ('early', 1995, 1997), ('middle', 1997, 1999), ('late', 1999, 2002)) p(name, a, b) on year >= a and year < b group by p.name""")
def range_join_years(spark, d):
    """Half-open periods from a small constant list."""
    periods = F.broadcast(spark.createDataFrame([("early", 1995, 1997), ("middle", 1997, 1999), ("late", 1999, 2002)], "period string, a int, b int"))
    return occurrences(spark, d).join(periods, (F.col("year") >= F.col("a")) & (F.col("year") < F.col("b"))).groupBy("period").agg(F.count("*").alias("n"))


@query("label_merge", """select doc_id, case when l.quality is null then 'u' when l.toxic = 1 and l.quality = 1 then 'conflict' when l.toxic = 1 then 'n' else 'y' end as label from documents d left join labels l using (doc_id)""")
def label_merge(spark, d):
    labels = table(spark, d, "labels")
    label = F.when(F.col("quality").isNull(), "u").when((F.col("toxic") == 1) & (F.col("quality") == 1), "conflict").when(F.col("toxic") == 1, "n").otherwise("y")
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", label.alias("label"))


@query("label_diff", "select doc_id, quality from labels where quality = 1 and doc_id not in (select doc_id from labels where toxic = 1)")
def label_diff(spark, d):
    labels = table(spark, d, "labels")
    return labels.where("quality = 1").join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality")


@query("docs_with_phrase", "select distinct o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem join part on l_partkey = p_partkey where p_name like '% anvil')")
def docs_with_phrase(spark, d):
    anvil = occurrences(spark, d).where(F.element_at(F.split("term", " "), -1) == "anvil").select(F.col("doc").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(anvil, "o_orderkey", "left_semi")


@query("set_intersect", f"with {OCC} select part from occ where year = 1996 and flag = 'R' intersect select part from occ where year = 2000 and flag = 'R'")
def set_intersect(spark, d):
    o = occurrences(spark, d).where("flag = 'R'")
    return o.where("year = 1996").select("part").intersect(o.where("year = 2000").select("part"))


@query("set_difference", f"with {OCC} select part from occ where year = 1996 and flag = 'R' except select part from occ where year = 2000 and flag = 'R'")
def set_difference(spark, d):
    o = occurrences(spark, d).where("flag = 'R'")
    return o.where("year = 1996").select("part").subtract(o.where("year = 2000").select("part"))


@query("union_dedup", f"with {OCC} select part from occ where year = 1996 union select part from occ where year = 2000")
def union_dedup(spark, d):
    o = occurrences(spark, d)
    return o.where("year = 1996").select("part").unionByName(o.where("year = 2000").select("part")).distinct()


@query("bag_intersect", f"with {OCC} select doc, part from occ where year = 1996 and part in (select part from occ where year = 2000 and flag = 'R')")
def bag_intersect(spark, d):
    o = occurrences(spark, d)
    return o.where("year = 1996").select("doc", "part").join(o.where("year = 2000 and flag = 'R'").select("part"), "part", "left_semi").select("doc", "part")


@query("membership_markers", f"with {OCC}, a as (select distinct part from occ where year = 1996), b as (select distinct part from occ where year = 2000) select part, case when a.p is not null and b.p is not null then '=' when b.p is null then '-' else '+' end as mark from (select part, part as p from a) a full join (select part, part as p from b) b using (part)")
def membership_markers(spark, d):
    x = occurrences(spark, d).where("year in (1996, 2000)").groupBy("part").agg(F.max((F.col("year") == 1996)).alias("a"), F.max(F.col("year") == 2000).alias("b"))
    return x.select("part", F.when(F.col("a") & F.col("b"), "=").when(F.col("a"), "-").otherwise("+").alias("mark"))


@query("topk_chunks_per_doc", f"with {OCC} select doc, loc, term, rank from (select doc, loc, term, row_number() over (partition by doc order by loc, term) as rank from occ where section = 'F') where rank <= 3")
def topk_chunks_per_doc(spark, d):
    return P.top_k(occurrences(spark, d).where("section = 'F'").select("doc", "loc", "term"), ["doc"], ["loc", "term"], 3)


@query("argmax_label", f"with {OCC}, c as (select doc, flag, count(*) as n from occ group by all) select doc, flag, n from (select *, row_number() over (partition by doc order by n desc, flag) as r from c) where r = 1")
def argmax_label(spark, d):
    c = occurrences(spark, d).groupBy("doc", "flag").agg(F.count("*").alias("n"))
    return P.top_k(c, ["doc"], [F.desc("n"), "flag"], 1).drop("rank")


@query("capped_sample", f"with {OCC} select doc, loc, term from (select doc, loc, term, row_number() over (partition by term order by md5(doc::varchar || '|' || loc::varchar), doc, loc) as r from occ) where r <= 20")
def capped_sample(spark, d):
    return P.capped_sample(occurrences(spark, d).select("doc", "loc", "term"), ["term"], ["doc", "loc"], 20)


@query("round_robin_sample", f"with {OCC}, s as (select distinct part, brand from occ) select brand, part, turn from (select *, row_number() over (partition by brand order by part) as turn from s) order by turn, brand limit 100")
def round_robin_sample(spark, d):
    return P.round_robin(occurrences(spark, d).select("brand", "part").distinct(), "brand", ["part"], 100)


@query("train_test_split", f"with {OCC}, s as (select distinct part, brand from occ) select brand, part, row_number() over (partition by brand order by md5(part::varchar), part) <= ceil(count(*) over (partition by brand) * 0.7) as is_train from s")
def train_test_split(spark, d):
    s = occurrences(spark, d).select("brand", "part").distinct()
    return P.train_test(s, "brand", [P.hash_order(F.col("part")), "part"], 0.7)


@query("cumulative_terms", f"with {OCC}, c as (select part, count(distinct doc) as n from occ group by part) select part, n, sum(n) over (order by n desc, part rows unbounded preceding)::bigint as running from c")
def cumulative_terms(spark, d):
    """A running total over a whole order: partial sums by range of n first, then within each, so that no task holds all rows."""
    c = occurrences(spark, d).groupBy("part").agg(F.countDistinct("doc").alias("n"))
    by_n = c.groupBy("n").agg(F.sum("n").alias("t"))
    before = by_n.select("n", (F.sum("t").over(Window.partitionBy().orderBy(F.desc("n"))) - F.col("t")).alias("before"))  # distinct counts only
    x = c.join(before, "n")
    return x.select("part", "n", (F.col("before") + F.sum("n").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))).alias("running"))


@query("offset_limit", "select doc_id, lang from documents order by doc_id limit 50 offset 100")
def offset_limit(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").offset(100).limit(50)


@query("dense_usage_distribution", f"with {OCC}, s as (select doc, avg(score) as s from occ group by doc) select case when s = 0 then -1 else {_RIGHT} end as bin, count(*) as n from s group by 1")
def dense_usage_distribution(spark, d):
    """Eleven bins: zero apart, the rest right-closed; means are summed in the table's order."""
    s = S.means_in_order(occurrences(spark, d, at=True), "doc", {"s": F.col("score")})
    return s.groupBy(F.when(F.col("s") == 0, -1).otherwise(T.bin_right_closed(F.col("s"))).alias("bin")).agg(F.count("*").alias("n"))

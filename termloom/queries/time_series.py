"""Series over years."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog import query
from termloom.operators import series as E

from .views import COUNTS, OCC, SIZES, occurrences, year_sizes, yearly_counts

_YEARS = (1995, 2001)
_GRID = "grid as (select t.term, y.year, coalesce(n, 0) as n from (select distinct term from counts) t cross join (select unnest(generate_series(1995, 2001))::int as year) y left join counts c on c.term = t.term and c.year = y.year)"


def _grid(spark, d):
    return E.grid(yearly_counts(spark, d), *_YEARS)


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query("dense_grid", f"with {COUNTS}, {_GRID} select term, year, n from grid")
def dense_grid(spark, d):
    return _grid(spark, d)


@query("time_series_pivot", f"with {COUNTS}, {_GRID} select term, {', '.join(f'max(case when year = {y} then n end)::bigint as y{y}' for y in range(1995, 2002))} from grid group by term")
def time_series_pivot(spark, d):
    return _grid(spark, d).groupBy("term").pivot("year", list(range(1995, 2002))).agg(F.max("n")).toDF("term", *[f"y{y}" for y in range(1995, 2002)])


@query("time_series_unpivot", f"with {COUNTS}, {_GRID} select term, 'y' || year as name, n from grid")
def time_series_unpivot(spark, d):
    wide = time_series_pivot(spark, d)
    return wide.unpivot("term", [c for c in wide.columns if c != "term"], "name", "n")


@query("size_adjusted_counts", f"with {COUNTS}, {SIZES} select term, year, n, round(n * ((select max(n_docs) from sizes) / n_docs), 6) as adjusted from counts join sizes using (year)")
def size_adjusted_counts(spark, d):
    return _rounded(E.size_adjusted(yearly_counts(spark, d), year_sizes(spark, d)).select("term", "year", "n", "adjusted"), "adjusted")


@query("frequency_level_series", f"""with {COUNTS}, {SIZES}, {_GRID}, a as (select term, year, n, n * ((select max(n_docs) from sizes) / n_docs) as adj from grid join sizes using (year))
select term, year, max(case when adj >= 25 then 2 when adj >= 10 then 1 else 0 end) over (partition by term order by year rows unbounded preceding) as level from a""")
def frequency_level_series(spark, d):
    return E.frequency_level(E.size_adjusted(_grid(spark, d), year_sizes(spark, d))).select("term", "year", "level")


_USAGE = f"{COUNTS}, {_GRID}, usage as (select term, year, n, ln(n + 1.0) / ln(max(n) over (partition by year) + 1.0001) as usage from grid)"


@query("usage_rates", f"with {_USAGE} select term, year, n, round(usage, 6) as usage from usage")
def usage_rates(spark, d):
    return _rounded(E.usage(_grid(spark, d)), "usage")


@query("damped_usage_series", f"""with recursive {_USAGE}, f as (select term, year, usage as damped from usage where year = 1995
 union all select u.term, u.year, case when u.usage >= f.damped then u.usage else f.damped - (f.damped - u.usage) / 5 end from f join usage u on u.term = f.term and u.year = f.year + 1)
select term, year, round(damped, 6) as damped from f""")
def damped_usage_series(spark, d):
    return _rounded(E.damped(E.usage(_grid(spark, d))), "damped")


@query("relative_frequency", f"with {COUNTS}, {_GRID} select term, year, n, round(ln(n + 1.0) / ln(max(n) over (partition by year) + 1.0), 6) as relative from grid")
def relative_frequency(spark, d):
    return _rounded(E.relative_frequency(_grid(spark, d)), "relative")


@query("yoy_diff", f"""with {COUNTS}, x as (select c.term, c.year, c.n, coalesce(l.n, 0) as last from counts c left join counts l on l.term = c.term and l.year = c.year - 1)
select term, year, n, last, round((n + 1) / (last + 1), 6) as ratio, round(sign(n - last) * log2(abs(n - last) + 1.0), 6) as adjusted from x""")
def yoy_diff(spark, d):
    return _rounded(E.change(yearly_counts(spark, d)), "ratio", "adjusted")


@query("category_change", f"""with {OCC}, c as (select term, year, flag, count(*) as n from occ group by all), b as (select term, year, arg_max(flag, n::double * 1000 + ascii(flag)) as cat from c group by all)
select b.term, b.year, b.cat, l.cat as last_cat, coalesce(l.cat <> b.cat, false) as changed from b left join b l on l.term = b.term and l.year = b.year - 1""")
def category_change(spark, d):
    c = occurrences(spark, d).groupBy("term", "year", "flag").agg(F.count("*").alias("n"))
    b = c.groupBy("term", "year").agg(F.max(F.struct("n", "flag")).alias("b")).select("term", "year", F.col("b.flag").alias("cat"))
    last = b.select("term", (F.col("year") + 1).alias("year"), F.col("cat").alias("last_cat"))
    return b.join(last, ["term", "year"], "left").select("term", "year", "cat", "last_cat", F.coalesce(F.col("cat") != F.col("last_cat"), F.lit(False)).alias("changed"))


_PARTS = "po as (select l_partkey as term, cast(year(l_shipdate) as integer) as year, count(distinct l_orderkey) as n from lineitem group by all)"


def _parts(spark, d):
    return occurrences(spark, d).groupBy(F.col("part").alias("term"), "year").agg(F.countDistinct("doc").alias("n"))


@query("first_year", f"with {_PARTS}, f as (select term, min(year) as first_year from po group by term) select term, first_year, first_year > (select min(first_year) from f) as is_new from f")
def first_year(spark, d):
    return E.first_years(_parts(spark, d))


@query("new_terms", f"with {_PARTS}, f as (select term, min(year) as y from po group by term) select y as year, count(*) as new_terms from f where y > (select min(y) from f) group by y")
def new_terms(spark, d):
    return E.first_years(_parts(spark, d)).where("is_new").groupBy(F.col("first_year").alias("year")).agg(F.count("*").alias("new_terms"))


@query("cohorts", f"""with {_PARTS}, c as (select *, min(year) over (partition by term) as cohort from po), x as (select term, cohort, coalesce(max(case when year = cohort + 2 then n end), 0) as a, coalesce(max(case when year = cohort + 5 then n end), 0) as b from c group by all)
select term, cohort, case when a > 20 then 2 when a > 5 then 1 else 0 end as near, case when b > 50 then 2 when b > 10 then 1 else 0 end as far from x""")
def cohorts(spark, d):
    return E.cohorts(_parts(spark, d))


@query("growth_prominence", f"""with {COUNTS}, x as (select *, lag(n) over (partition by term order by year) as p from counts)
select term, year, n, round((n - p) / (p + 1), 6) as growth, round(case when p is null then 1e-8 when p < n then (1 - p / n) * (1 - 1 / n) else 1e-6 end, 6) as prominence from x""")
def growth_prominence(spark, d):
    return _rounded(E.growth_prominence(yearly_counts(spark, d)), "growth", "prominence")


@query("temporal_entropy", f"with {COUNTS}, p as (select term, n / sum(n) over (partition by term) as p from counts) select term, round(1 + sum(p * log2(p)) / log2(11.0), 6) as te from p group by term")
def temporal_entropy(spark, d):
    return _rounded(E.temporal_entropy(yearly_counts(spark, d)), "te")


@query("feature_year_kl", f"""with {OCC}, c as (select feature, year, count(*) as n from occ group by all), t as (select year, sum(n) as t from c group by year),
 x as (select feature, year, n / sum(n) over (partition by feature) as p, t / (select sum(t) from t) as q from c join t using (year))
select feature, round(sum(p * ln(p / q)), 6) as kl, string_agg(case when p > q then '+' when p < q then '-' else '0' end, '' order by year) as signs from x group by feature""")
def feature_year_kl(spark, d):
    c = occurrences(spark, d).groupBy("feature", "year").agg(F.count("*").alias("n"))
    return _rounded(E.kl_over_years(c), "kl")


@query("tipping_points", f"""with {_PARTS}, x as (select *, min(year) over (partition by term) as first from po)
select term, coalesce(min(case when n > 2 then year end), 9999) as immature, coalesce(min(case when n >= 5 and (year > first or year < 1982) then year end), 9999) as mature from x group by term""")
def tipping_points(spark, d):
    return E.tipping_points(_parts(spark, d))


@query("feature_cumulative_new", f"""with {OCC}, f as (select brand as feature, part as term, min(year) as year from occ group by all), nw as (select feature, year, count(*) as new from f group by all),
 s as (select brand as feature, year, count(distinct part) as terms from occ group by all)
select s.feature, s.year, terms, coalesce(new, 0) as new, sum(coalesce(new, 0)) over (partition by s.feature order by s.year)::bigint as cumulative from s left join nw using (feature, year)""")
def feature_cumulative_new(spark, d):
    pairs = occurrences(spark, d).select(F.col("brand").alias("feature"), F.col("part").alias("term"), "year")
    return E.cumulative_new(pairs)


@query("rising_terms", f"with {_PARTS}, x as (select term, coalesce(max(case when year = 1996 then n end), 0) as a, coalesce(max(case when year = 2000 then n end), 0) as b from po group by term) select term, a, b from x where b > 2 * a")
def rising_terms(spark, d):
    return E.rising(_parts(spark, d), 1996, 2000)


@query("head_mod_diff", f"""with {OCC}, c as (select string_split(term, ' ')[-1] as term, year, count(distinct term) as n from occ group by 1, 2), x as (select *, lag(n) over (partition by term order by year) as p from c)
select term, year, round(log2(n / p) * log2(abs(n - p) + 1.0), 6) as hm_diff from x where p > 0 and n > 0""")
def head_mod_diff(spark, d):
    c = occurrences(spark, d).groupBy(F.element_at(F.split("term", " "), -1).alias("term"), "year", F.col("term").alias("full")).count().groupBy("term", "year").agg(F.count("*").alias("n"))
    return _rounded(E.spread_by_feature(c), "hm_diff")


@query("year_share_histogram", f"with {COUNTS}, {_GRID} select term, year, round(n / sum(n) over (partition by term), 6) as share from grid")
def year_share_histogram(spark, d):
    from pyspark.sql import Window

    return _grid(spark, d).select("term", "year", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("term")), 6).alias("share"))


@query("running_ratio", f"""with {OCC}, c as (select term, year, count(distinct case when section = 'F' then doc end) as a, count(distinct doc) as n from occ group by all)
select term, year, round(a / n, 6) as ratio, round(sum(a) over w / sum(n) over w, 6) as cumulative from c window w as (partition by term order by year)""")
def running_ratio(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("term").orderBy("year")
    c = occurrences(spark, d).groupBy("term", "year").agg(F.countDistinct(F.when(F.col("section") == "F", F.col("doc"))).alias("a"), F.countDistinct("doc").alias("n"))
    return c.select("term", "year", F.round(F.col("a") / F.col("n"), 6).alias("ratio"), F.round(F.sum("a").over(w) / F.sum("n").over(w), 6).alias("cumulative"))


@query("maturity_lookup", f"""with {_PARTS}, x as (select *, min(year) over (partition by term) as first from po), t as (select term, coalesce(min(case when n > 2 then year end), 9999) as a, coalesce(min(case when n >= 5 and (year > first or year < 1982) then year end), 9999) as b from x group by term)
select term, year, case when year < a then 0 when year < b then 1 else 2 end as maturity from po join t using (term)""")
def maturity_lookup(spark, d):
    p = _parts(spark, d)
    return p.join(E.tipping_points(p), "term").select("term", "year", E.maturity(F.col("year"), F.col("immature"), F.col("mature")).alias("maturity"))

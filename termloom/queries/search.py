"""Search tables, personalised ranks, context patterns and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog import query, table
from termloom.operators import search as S
from termloom.operators import text as X

from .views import OCC, occurrences


def _index(spark, d):
    return S.phrase_rows(occurrences(spark, d).select("doc", "year", "term", "section", "loc", "flag").distinct().withColumn("sent", F.col("flag")), ("F",), (1995, 1999))


_NP = f"{OCC}, np as (select distinct doc, year, term, section, loc, flag as sent, string_split(term, ' ')[-1] as head, string_split(term, ' ')[1] as m from occ where section = 'F' and year between 1995 and 1999)"


@query("index_phrases", f"with {_NP} select doc, year, term, sent, loc, '[ ' || replace(term, ' ', ' | ') || ' ]' as sp, head, 2 as plen from np")
def index_phrases(spark, d):
    return _index(spark, d).select("doc", "year", "term", "sent", "loc", "sp", "head", "plen")


@query("index_sentences", f"with {_NP} select doc, sent, string_agg(head, '|' order by loc, term) as sheads, string_agg(term, '|' order by loc, term) as sterms from np group by all")
def index_sentences(spark, d):
    x = S.sentence_rows(_index(spark, d))
    return x.select("doc", "sent", F.array_join("sheads", "|").alias("sheads"), F.array_join("sterms", "|").alias("sterms"))


@query("index_documents", f"with {_NP} select doc, min(year) as year, count(*) as phrases, count(distinct term) as terms from np group by doc")
def index_documents(spark, d):
    return S.document_rows(_index(spark, d))


@query("documents_with_child", f"with {_NP}, docs as (select doc, min(year) as year, count(*) as phrases from np group by doc) select * from docs where doc in (select doc from np where head = 'anvil' and sent = 'R')")
def documents_with_child(spark, d):
    np = _index(spark, d)
    return S.documents_with(S.document_rows(np), np, (F.col("head") == "anvil") & (F.col("sent") == "R")).select("doc", "year", "phrases")


@query("rows_with_field", "select p_type, count(*) as n from (select p_type, case when p_size % 4 > 0 then p_brand end as f from part) where f is not null group by p_type")
def rows_with_field(spark, d):
    x = table(spark, d, "part").select("p_type", F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("f"))
    return S.with_field(x, "f").groupBy("p_type").agg(F.count("*").alias("n"))


@query("phrases_of_length", f"with {OCC} select term, count(*) as n, count(distinct doc) as df from occ where len(string_split(term, ' ')) = 2 group by term")
def phrases_of_length(spark, d):
    return S.phrase_rows(occurrences(spark, d)).where("plen = 2").groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("df"))


@query("counted_search", f"with {OCC} select term, brand, count(*) as count from occ where brand = 'Brand#3' group by all having count(*) >= 10")
def counted_search(spark, d):
    x = occurrences(spark, d).groupBy("term", "brand").agg(F.count("*").alias("count"))
    return S.at_least(x, "brand", "Brand#3", 10)


@query("marked_matches", "select conv_id, turn, trim(replace(' ' || text || ' ', ' de ', ' <em>de</em> '), ' ') as marked from conversations where contains(' ' || text || ' ', ' de ')")
def marked_matches(spark, d):
    return S.marked_matches(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "de").select("conv_id", "turn", "marked")


def _run(name, seeds):
    r = f"{name}0 as (select node, h as rank from home_{name})"
    steps = ", ".join(
        f"{name}{k} as (select h.node, 0.15 * h + 0.85 * coalesce(m, 0) as rank from home_{name} h left join (select b as node, sum(rank * p) as m from steps join {name}{k - 1} on a = node group by b) using (node))" for k in range(1, 4)
    )
    return f"home_{name} as (select node, case when {seeds} then 1.0 / sum(case when {seeds} then 1 else 0 end) over () else 0 end as h from nodes), {r}, {steps}"


@query("personalised_ranks", f"""with {OCC}, e as (select term as a, brand as b, count(*)::double as w from occ group by all), bo as (select a, b, w from e union all select b, a, w from e), steps as (select a, b, w / sum(w) over (partition by a) as p from bo),
 nodes as (select distinct a as node from steps), {_run('n', "node like 'red %'")}, {_run('p', "node like 'small %'")}, {_run('b', "(node like 'small %' or node like 'red %')")}, {_run('x', 'true')}
select node, round(n3.rank, 9) as n, round(p3.rank, 9) as p, round(b3.rank, 9) as b, round(x3.rank, 9) as x, round(p3.rank - n3.rank, 9) + 0.0 as diff, round(p3.rank / (n3.rank + 1e-5), 6) as ratio from n3 join p3 using (node) join b3 using (node) join x3 using (node)""")
def personalised_ranks(spark, d):
    o = occurrences(spark, d)
    edges = o.groupBy(F.col("term").alias("a"), F.col("brand").alias("b")).agg(F.count("*").cast("double").alias("w"))
    terms = o.select(F.col("term").alias("node")).distinct()
    r = S.personalised_ranks(edges, terms.where("node like 'small %'"), terms.where("node like 'red %'"), 3)
    return r.select("node", *[F.round(c, 9).alias(c) for c in ("n", "p", "b", "x")], (F.round("diff", 9) + 0.0).alias("diff"), F.round("ratio", 6).alias("ratio"))


_CONTEXTS = {"lead": ("l", "^(the|la|die)$"), "follow": ("r", "^(of|de|und)$"), "mark": ("r", "[.!?]$")}


@query("context_patterns", r"""with t as (select conv_id, turn, string_split(text, ' ') as w from conversations), p as (select * from t where len(w) >= 5)
select conv_id, turn, pattern from p, (select unnest(['lead', 'follow', 'mark']) as pattern) where
 (pattern = 'lead' and len(list_filter(w[1:3], lambda x: regexp_matches(x, '^(the|la|die)$'))) > 0) or (pattern = 'follow' and len(list_filter(w[5:7], lambda x: regexp_matches(x, '^(of|de|und)$'))) > 0)
 or (pattern = 'mark' and len(list_filter(w[5:7], lambda x: regexp_matches(x, '[.!?]$'))) > 0)""")
def context_patterns(spark, d):
    """Patterns on the three words left or right of the fourth word of each turn."""
    x = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w")).where(F.size("w") >= 5)
    return X.context_matches(x, F.slice("w", 1, 3), F.slice("w", 5, 3), _CONTEXTS).select("conv_id", "turn", "pattern")


@query("match_tree", f"with {OCC}, m as (select term, brand as pattern, year, doc || ':' || loc as match, row_number() over (partition by term, brand, year order by doc || ':' || loc) as i from occ) select term, pattern, year, count(*) as n, string_agg(match, '|' order by match) filter (i <= 3) as examples from m group by all")
def match_tree(spark, d):
    o = occurrences(spark, d).select("term", F.col("brand").alias("pattern"), "year", F.concat_ws(":", F.col("doc").cast("string"), F.col("loc").cast("string")).alias("match"))
    return S.tree_of_matches(o, 3)


@query("grouped_contexts", "with t as (select conv_id, turn, role, text, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as g from conversations) select conv_id, g::int as g, count(*) filter (role <> 'user') as contexts, coalesce(sum(length(text)) filter (role <> 'user'), 0)::bigint as size from t where g > 0 group by all")
def grouped_contexts(spark, d):
    """Term lines and the context lines under each, told apart by a running number within a file."""
    x = X.running_groups(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user").where("g > 0")
    other = F.col("role") != "user"
    return x.groupBy("conv_id", "g").agg(F.count(F.when(other, 1)).alias("contexts"), F.coalesce(F.sum(F.when(other, F.length("text"))), F.lit(0)).alias("size"))

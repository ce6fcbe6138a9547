"""Texts: chunks, windows, lookup, search, graph and relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.catalog import query, table
from termloom.operators import graph as G
from termloom.operators import text as X

from .views import COUNTS, OCC, occurrences

_STOP = ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS)


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.split("text", r"\s+").alias("tokens"))


@query("function_word_chunks", rf"""with t as (select doc_id as doc, regexp_split_to_array(lower(regexp_replace(text, '([.,;:!?|()"])', ' \1 ', 'g')), '\s+') as w from documents),
 c as (select doc, unnest(string_split(array_to_string(list_transform(w, lambda x: case when x in ({_STOP}) or not regexp_matches(x, '[\p{{L}}\p{{N}}]') then chr(10) else x end), ' '), chr(10))) as chunk from t)
select doc, trim(chunk) as chunk, count(*) as n from c where trim(chunk) <> '' group by all""")
def function_word_chunks(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("doc"), F.explode(X.chunk_by_function_words(F.col("text"))).alias("chunk")).groupBy("doc", "chunk").agg(F.count("*").alias("n"))


@query("sentence_counts", r"""select doc_id as doc, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::int as sentences from documents""")
def sentence_counts(spark, d):
    """Sentences of each text; white space behind the last end mark is no sentence, null and empty texts have none."""
    kept = F.filter(X.sentences(F.coalesce("text", F.lit(""))), lambda s: s != "")
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.size(kept).alias("sentences"))


@query("context_window", r"""with t as (select doc_id as doc, regexp_split_to_array(text, '\s+') as w from documents), p as (select doc, w, unnest(generate_series(1, len(w))) as i from t),
 h as (select doc, w, i, w[i] as target from p where w[i] in ('trash', 'idiot', 'nicht', 'que'))
select target, w[j] as neighbour, count(*) as tf, count(distinct doc) as df from (select *, unnest(generate_series(greatest(i - 3, 1), least(i + 3, len(w)))) as j from h) where j <> i group by all""")
def context_window(spark, d):
    targets = spark.createDataFrame([("trash",), ("idiot",), ("nicht",), ("que",)], "target string")
    return X.context_window(_docs(spark, d), F.broadcast(targets), 3)


@query("cooccurrence_tfidf", r"""with t as (select doc_id as doc, regexp_split_to_array(text, '\s+') as w from documents), n as (select count(*) as n from t), f as (select doc, word, count(*) as tf from (select doc, unnest(w) as word from t) group by all), df as (select word, count(*) as df from f group by word)
select doc, word, tf, df, round(tf * log2(floor(n / (df + 1))), 6) as tfidf from f join df using (word), n where n / (df + 1) >= 1""")
def cooccurrence_tfidf(spark, d):
    from termloom.functions import terms as T

    # one shuffle, by the word: counts of a document's words, and of a word's documents, are both made in the word's partition
    words = _docs(spark, d).select("doc", F.explode("tokens").alias("word")).where("word is not null").repartition("word")
    f = words.groupBy("doc", "word").agg(F.count("*").alias("tf")).withColumn("df", F.count("*").over(Window.partitionBy("word")))
    n = F.broadcast(table(spark, d, "documents").agg(F.count("*").alias("n")))  # one row
    x = f.crossJoin(n).where("n / (df + 1) >= 1")
    return x.select("doc", "word", "tf", "df", F.round(T.tfidf(F.col("tf"), F.col("df"), F.col("n")), 6).alias("tfidf"))


@query("dictionary_lookup_longest", r"""with b as (select regexp_split_to_array(text, '\s+') as w from benchmark), g as (select distinct array_to_string(w[i:i + n - 1], ' ') as term from (select w, n, unnest(generate_series(1, len(w) - n + 1)) as i from b, (select unnest(generate_series(2, 10)) as n))),
 t as (select doc_id as doc, regexp_split_to_array(text, '\s+') as w from documents), f as (select distinct array_to_string(string_split(term, ' ')[1:2], ' ') as two from g), c as (select doc, i, w[i:i + 9] as v, array_to_string(w[i:i + 1], ' ') as two from (select doc, w, unnest(generate_series(1, len(w) - 1)) as i from t)),
 p as (select doc, i - 1 as s, i - 1 + n as e, array_to_string(v[1:n], ' ') as term from (select doc, i, v from c semi join f using (two)), (select unnest(generate_series(2, 10)) as n) where n <= len(v)),
 h as (select doc, list([{'s': s, 'e': e, 't': term}] order by s - e, -e) as h from p semi join g using (term) group by doc),
 k as (select doc, unnest(list_reduce(h, lambda a, x: case when len(list_filter(a, lambda k: k.s < x[1].e and x[1].s < k.e)) > 0 then a else list_concat(a, x) end)) as k from h)
select doc, k.s::int as start, k.e::int as end, k.t as term from k""")
def dictionary_lookup_longest(spark, d):
    """Sequences of two to ten words of the benchmark in the documents, longest first."""
    from termloom.functions import terms as T

    grams = table(spark, d, "benchmark").select(F.explode(T.subphrases(F.split("text", r"\s+"))).alias("term")).where(F.size(F.split("term", " ")).between(2, 10))
    return X.dictionary_lookup(_docs(spark, d), grams, longest=10)


_PATTERNS = {"economy or small, first brand": {"type": ["ECONOMY", "SMALL"], "brand": ["Brand#1"]}, "promo": {"type": ["PROMO"]}}


@query("pattern_matches", """select p_partkey, case when k = 1 then 'economy or small, first brand' else 'promo' end as pattern from part, (select unnest([1, 2]) as k)
where (k = 1 and p_type in ('ECONOMY', 'SMALL') and p_brand = 'Brand#1') or (k = 2 and p_type = 'PROMO')""")
def pattern_matches(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand").alias("feats"))
    return X.feature_matches(rows, _PATTERNS).select("p_partkey", "pattern")


@query("match_summary", "select p_name as term, count(*) as n from part where p_type = 'PROMO' or (p_type in ('ECONOMY', 'SMALL') and p_brand = 'Brand#1') group by p_name")
def match_summary(spark, d):
    rows = table(spark, d, "part").select("p_name", F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand").alias("feats"))
    return X.feature_matches(rows, _PATTERNS).groupBy(F.col("p_name").alias("term")).agg(F.count("*").alias("n"))


@query("feature_row_scan", "select p_partkey::varchar as chunk_id, (1990 + p_size)::int as year, p_name as term, p_type as type, p_brand as brand from part")
def feature_row_scan(spark, d):
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), (F.col("p_size") + 1990).cast("string"), "p_name", F.concat(F.lit("type="), "p_type"), F.concat(F.lit("brand="), "p_brand"))
    x = table(spark, d, "part").select(X.parse_feature_row(line).alias("r"))
    return x.select("r.chunk_id", "r.year", "r.term", F.col("r.feats")["type"].alias("type"), F.col("r.feats")["brand"].alias("brand"))


@query("chunker_phrases")
def chunker_phrases(spark, d):
    docs = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), "text")
    return X.phrase_occurrences(docs).select("doc", "sentence", "start", "end", "term")


@query("context_features")
def context_features(spark, d):
    docs = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), "text")
    x = X.phrase_occurrences(docs).select("term", F.explode("feats").alias("name", "value"))
    return x.groupBy("name", "value").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"))


@query("tokens_with_offsets")
def tokens_with_offsets(spark, d):
    return X.token_rows(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


def _edges(spark, d):
    o = occurrences(spark, d)
    return o.groupBy(F.col("term").alias("a"), F.col("brand").alias("b")).agg(F.count("*").cast("double").alias("w"))


_ROUND = """r{k} as (select h.node, 0.15 * h + 0.85 * coalesce(m, 0) as rank from home h left join (select b as node, sum(rank * p) as m from steps join r{j} on a = node group by b) using (node))"""


@query("pagerank_terms", f"""with {OCC}, e as (select term as a, brand as b, count(*)::double as w from occ group by all), bo as (select a, b, w from e union all select b, a, w from e),
 steps as (select a, b, w / sum(w) over (partition by a) as p from bo), home as (select distinct a as node, 1.0 / (select count(distinct a) from steps) as h from steps), r0 as (select node, h as rank from home), """ + ", ".join(_ROUND.format(k=k, j=k - 1) for k in range(1, 11)) + " select node, round(rank, 9) as rank from r10")
def pagerank_terms(spark, d):
    return G.page_rank(_edges(spark, d)).select("node", F.round("rank", 9).alias("rank"))


@query("role_relations", f"""with {OCC}, r as (select distinct doc, term, case flag when 'N' then 'i' when 'A' then 'ct' else 'ca' end as role from occ)
select a.doc, a.role || '-' || b.role as relation, a.term as t1, b.term as t2 from r a join r b using (doc) where (a.role = 'i' and b.role in ('ca', 'ct')) or (a.role = 'ca' and b.role = 'ca' and a.term < b.term)""")
def role_relations(spark, d):
    role = F.when(F.col("flag") == "N", "i").when(F.col("flag") == "A", "ct").otherwise("ca")
    return G.role_relations(occurrences(spark, d).select("doc", "term", role.alias("role")))


@query("role_pivot", f"""with {OCC} select term, count(case when flag = 'N' then 1 end) as i, count(case when flag = 'A' then 1 end) as ct, count(case when flag = 'R' then 1 end) as ca, round(count(case when flag = 'N' then 1 end) / (count(*) + 1e-8), 6) as share from occ group by term""")
def role_pivot(spark, d):
    n = {a: F.count(F.when(F.col("flag") == f, 1)) for a, f in (("i", "N"), ("ct", "A"), ("ca", "R"))}
    return occurrences(spark, d).groupBy("term").agg(*[c.alias(a) for a, c in n.items()], F.round(n["i"] / (F.count("*") + 1e-8), 6).alias("share"))


_GRAMS = "b as (select item_id, string_split(lower(text), ' ') as w from benchmark), g2 as (select term, count(distinct item_id) as df from (select item_id, array_to_string(w[i:i + 1], ' ') as term from b, (select unnest(generate_series(1, 200)) as i) where i + 1 <= len(w)) group by term), g3 as (select term, count(distinct item_id) as df from (select item_id, array_to_string(w[i:i + 2], ' ') as term from b, (select unnest(generate_series(1, 200)) as i) where i + 2 <= len(w)) group by term)"


def _grams(spark, d, n):
    w = F.split(F.lower("text"), " ")
    x = table(spark, d, "benchmark").where(F.size(w) >= n).select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).alias("term"))
    return x.groupBy("term").agg(F.countDistinct("item_id").alias("df"))


@query("trigram_bracketing", f"""with {_GRAMS}, t as (select term, df as df3, string_split(term, ' ') as w from g3), x as (select t.term, df3, coalesce(ab.df, 0) as df_ab, coalesce(bc.df, 0) as df_bc, coalesce(ac.df, 0) as df_ac from t
 left join g2 ab on ab.term = w[1] || ' ' || w[2] left join g2 bc on bc.term = w[2] || ' ' || w[3] left join g2 ac on ac.term = w[1] || ' ' || w[3])
select *, case when df_ab > df_bc then 'L' when df_ab < df_bc then 'R' else 'U' end as label, case when df3 > df_ab and df3 > df_bc then 'T' else '' end as top from x""")
def trigram_bracketing(spark, d):
    return G.bracket_trigrams(_grams(spark, d, 3), _grams(spark, d, 2))


@query("phrase_hierarchy", """with p as (select distinct p_name as term from part union select distinct string_split(p_name, ' ')[-1] from part) select p.term, list_extract(string_split(p.term, ' '), -1) as parent from p where contains(p.term, ' ')""")
def phrase_hierarchy(spark, d):
    part = table(spark, d, "part")
    return G.hierarchy(part.select(F.col("p_name").alias("term")).union(part.select(F.element_at(F.split("p_name", " "), -1))))


@query("collocations", f"with {OCC} select term, count(distinct o.doc) as docs from occ o where term <> 'blue anvil' and (doc, section) in (select (doc, section) from occ where term = 'blue anvil') group by term")
def collocations(spark, d):
    return G.collocations(occurrences(spark, d).select("doc", F.col("section").alias("sent"), "term"), "blue anvil")


@query("phrase_search", f"with {OCC} select doc, year, term from occ where contains(' ' || term || ' ', ' anvil ') and flag = 'R'")
def phrase_search(spark, d):
    return G.phrase_search(occurrences(spark, d), {"term": "anvil"}, {"flag": "R"}, ["doc", "year", "term"])


@query("phrase_frequencies", f"with {OCC} select year, count(*) as corpus_freq, count(distinct doc) as doc_freq from occ where contains(' ' || term || ' ', ' anvil ') group by year")
def phrase_frequencies(spark, d):
    return G.phrase_search(occurrences(spark, d), {"term": "anvil"}).groupBy("year").agg(F.count("*").alias("corpus_freq"), F.countDistinct("doc").alias("doc_freq"))


@query("first_location", f"with {OCC} select doc, coalesce(min(case when term like '% anvil' then loc end), -1) as loc, count(case when term like '% anvil' then 1 end) as tf from occ group by doc")
def first_location(spark, d):
    hit = F.element_at(F.split("term", " "), -1) == "anvil"
    return occurrences(spark, d).groupBy("doc").agg(F.coalesce(F.min(F.when(hit, F.col("loc"))), F.lit(-1)).alias("loc"), F.count(F.when(hit, 1)).alias("tf"))


@query("colloc_json", f"""with {OCC} select doc, section, '{{"terms":[' || string_agg('"' || term || '"', ',' order by loc, term) || ']}}' as row from occ group by doc, section""")
def colloc_json(spark, d):
    x = occurrences(spark, d).groupBy("doc", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("loc", "term"))), lambda r: r["term"]).alias("terms"))
    return x.select("doc", "section", F.to_json(F.struct("terms")).alias("row"))


@query("event_daily_series", "select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by all")
def event_daily_series(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("co_mention_counts", f"with {COUNTS}, d as (select distinct doc, term from occ) select term, count(*) as docs, sum(k)::bigint as co_terms from (select term, doc, count(*) over (partition by doc) - 1 as k from d) group by term")
def co_mention_counts(spark, d):
    from pyspark.sql import Window

    x = occurrences(spark, d).select("doc", "term").distinct().withColumn("k", F.count("*").over(Window.partitionBy("doc")) - 1)
    return x.groupBy("term").agg(F.count("*").alias("docs"), F.sum("k").alias("co_terms"))

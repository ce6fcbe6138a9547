"""Term tables, canonical forms, tagged phrases, lookups and exports over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog import query, table
from termloom.functions import forms as S
from termloom.functions import terms as T
from termloom.operators import canon as C
from termloom.operators import text as X
from termloom.plans.corpus import archive_index
from termloom.sources import reports as H
from termloom.sources import repository as R

from .views import OCC, occurrences, placed


@query("terms_by_sql", f"with {OCC}, t as (select term, count(*) as frequency, avg(score) as technology_score from occ group by term) select term, frequency from t where technology_score > 0.5")
def terms_by_sql(spark, d):
    """What a user asks of the terms table in SQL."""
    t = occurrences(spark, d).groupBy("term").agg(F.count("*").alias("frequency"), F.avg("score").alias("technology_score"))
    return R.ask("select term, frequency from {terms} where technology_score > 0.5", terms=t)


@query("terms_of_year", f"with {OCC} select doc, term, count(*) as n from occ where year = 1996 group by all")
def terms_of_year(spark, d):
    return R.of_years(occurrences(spark, d), 1996).groupBy("doc", "term").agg(F.count("*").alias("n"))


@query("section_term_lists", f"with {OCC} select doc, string_agg(term, chr(9) order by loc, term) as terms from occ where section = 'F' group by doc")
def section_term_lists(spark, d):
    return R.ordered_terms(occurrences(spark, d), ("F",))


@query("pending_files", "select o_orderkey::varchar as source, year(o_orderdate)::int as year from orders where o_orderkey not in (select l_orderkey from lineitem)")
def pending_files(spark, d):
    """Listed files that haven't been processed."""
    files = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("source"), F.year("o_orderdate").alias("year"))
    return R.pending(files, table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source")))


@query("id_statistics", "select case o_orderkey % 4 when 1 then 'D' when 2 then 'PP' else '' end as prefix, case when o_orderkey % 3 = 0 then '' else 'B' || (o_orderkey % 3) end as kind, count(*) as n from orders group by all")
def id_statistics(spark, d):
    """Prefixes and kind codes of an index of numbers."""
    k = F.col("o_orderkey")
    lead = F.element_at(F.array(F.lit("US"), F.lit("D"), F.lit("PP"), F.lit("US20")), (k % 4 + 1).cast("int"))
    name = F.concat(lead, F.lpad(k.cast("string"), 7, "0"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("B"), (k % 3).cast("string"))), F.lit(".xml"))
    p = table(spark, d, "orders").select(S.patent_parts(name).alias("p"))
    return p.groupBy("p.prefix", "p.kind").agg(F.count("*").alias("n"))


@query("archive_index", "select l_orderkey as archive, count(*) as n, arg_min(l_partkey, l_linenumber * 1000000 + l_partkey) as first, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) as last from lineitem group by l_orderkey")
def archive_items(spark, d):
    place = F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")
    return archive_index(placed(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_partkey").alias("item"), place.alias("place"), "at"))


_LEXICON = [("small", "V", "smallen"), ("hot", "V", "heat"), ("gears", "N", "gear"), ("rods", "N", "rodlet"), ("reds", "N", "red")]
_LEX = "lex as (select * from (values " + ", ".join(str(r) for r in _LEXICON) + ") v(word, pos, lemma))"
_SING = "case when regexp_matches(h, '(ss|us|is)$') or length(h) < 4 then h when regexp_matches(h, 'ies$') then regexp_replace(h, 'ies$', 'y') when regexp_matches(h, '(ch|sh|x|s|z)es$') then regexp_replace(h, 'es$', '') when regexp_matches(h, 's$') then regexp_replace(h, 's$', '') else h end"


@query("canonical_features", f"""with {_LEX}, f as (select distinct string_split(p_name, ' ')[1] as m, string_split(p_name, ' ')[2] as w, p_size % 4 as k from part), x as (select *, case k when 0 then m || 'ing' when 1 then w || 's' when 2 then w || 's' else m end as h from f)
select distinct case k when 0 then 'prev_V=' || h || '_of' when 1 then 'prev_Npr=' || h || '_for' when 2 then 'last_word=' || h else 'prev_J=' || h end as feature,
 case k when 0 then 'prev_V=' || coalesce(lemma, case when m[-1] = m[-2] and m[-1] in ('b', 'd', 'g', 'm', 'n', 'p', 'r', 't') then left(m, length(m) - 1) else m end) || '_of' when 1 then 'prev_Npr=' || coalesce(lemma, {_SING}) || '_for' when 2 then 'last_word=' || coalesce(lemma, {_SING}) else 'prev_J=' || h end as canonical
from x left join lex on lex.word = h and lex.pos = case when k = 0 then 'V' when k < 3 then 'N' end""")
def canonical_features(spark, d):
    m, w = (F.element_at(F.split("p_name", " "), k) for k in (1, 2))
    feature = F.element_at(F.array(F.concat(F.lit("prev_V="), m, F.lit("ing_of")), F.concat(F.lit("prev_Npr="), w, F.lit("s_for")), F.concat(F.lit("last_word="), w, F.lit("s")), F.concat(F.lit("prev_J="), m)), (F.col("p_size") % 4 + 1).cast("int"))
    rows = table(spark, d, "part").select(feature.alias("feature")).distinct()
    return C.canonical_features(rows, spark.createDataFrame(_LEXICON, "word string, pos string, lemma string")).select("feature", "canonical")


@query("lexicon_phrases", f"""with {_LEX}, p as (select distinct p_name || 's' as term, string_split(p_name, ' ')[1] as m, string_split(p_name, ' ')[2] || 's' as h from part) select term, m || ' ' || coalesce(lemma, {_SING}) as canonical from p left join lex on word = h and pos = 'N'""")
def lexicon_phrases(spark, d):
    rows = table(spark, d, "part").select(F.concat("p_name", F.lit("s")).alias("term")).distinct()
    return C.canonical_phrases(rows, spark.createDataFrame(_LEXICON, "word string, pos string, lemma string")).select("term", "canonical")


def _sentences(spark, d):
    w = F.split("term", " ")
    token = lambda t, g: F.struct(t.alias("tok"), F.lit(g).alias("tag"))
    tokens = F.array(token(F.lit("The"), "DT"), token(w[0], "JJ"), token(w[1], "NN"), token(F.lit("is"), "VBZ"), token(F.lit("used"), "VBN"), token(F.lit("."), "."))
    x = occurrences(spark, d).select("doc", "year", "loc", "term").distinct()
    section = F.when(F.col("loc") == 1, "TITLE").otherwise("ABSTRACT")
    return x.select(F.col("doc").cast("string").alias("doc"), "year", section.alias("section"), F.col("loc").alias("sent_no"), F.when(F.col("loc") <= 2, 0).otherwise(1).alias("sent_in_section"), tokens.alias("tokens"))


@query("tagged_phrases", f"""with {OCC}, s as (select distinct doc, year, loc, term from occ) select doc || '_' || loc || '_0' as chunk_id, year, term, 'the' as prev, 'is' as next, case when loc = 1 then 'TITLE' else 'ABSTRACT' end || case when loc <= 2 then '_sent1' else '_later' end as section_loc, string_split(term, ' ')[2] as last_word from s""")
def tagged_phrases(spark, d):
    """Feature rows of tagged sentences: the whole document driver."""
    f = F.col("feats")
    return X.tagged_phrases(_sentences(spark, d)).select("chunk_id", "year", "term", f["prev_n1"].alias("prev"), f["next_n1"].alias("next"), f["section_loc"].alias("section_loc"), f["last_word"].alias("last_word"))


@query("term_verbs", f"with {OCC} select term, brand as verb, count(*) as n from occ where flag <> 'N' group by all")
def term_verbs(spark, d):
    """Terms with the verbs of their prev_V features (prev_VNP has the same beginning)."""
    o = occurrences(spark, d).select("term", F.array(F.concat(F.when(F.col("flag") == "A", "prev_V=").when(F.col("flag") == "R", "prev_VNP=").otherwise("next_V="), "brand"), "feature").alias("feats"))
    verbs = F.filter("feats", lambda f: F.startswith(f, F.lit("prev_V")))
    return o.select("term", F.explode(F.transform(verbs, lambda f: F.regexp_replace(f, "^[^=]*=", ""))).alias("verb")).groupBy("term", "verb").agg(F.count("*").alias("n"))


@query("section_lookup", r"with t as (select conv_id * 1000 + turn as doc, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) as term from conversations where role = 'user') select doc, term, count(*) as n from t where term in ('de', 'la', 'des', 'der', 'the') group by all")
def section_lookup(spark, d):
    """Dictionary words in some sections alone, at word boundaries."""
    docs = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    return X.trie_lookup(docs, ["de", "la", "des", "der", "the"])


@query("terms_by_initial", "select left(term, 1) as initial, count(*) as n from (select distinct p_name as term from part) group by 1")
def terms_by_initial(spark, d):
    """A dictionary's parts by first letter."""
    return table(spark, d, "part").select(F.col("p_name").alias("term")).distinct().groupBy(F.left("term", F.lit(1)).alias("initial")).agg(F.count("*").alias("n"))


@query("phrase_patterns", "select distinct p_name as term, pattern, part1, part2 from (select p_name, 'colour' as pattern, regexp_extract(p_name, '^(red|blue)', 0) as part1, regexp_extract(p_name, '(bolt|gear)$', 0) as part2 from part where regexp_matches(p_name, '^(red|blue)') and regexp_matches(p_name, '(bolt|gear)$') union all select p_name, 'size', regexp_extract(p_name, 'small|large', 0), null from part where regexp_matches(p_name, 'small|large'))")
def phrase_patterns(spark, d):
    """Patterns all of whose expressions a phrase fits, with what fitted."""
    rows = table(spark, d, "part").select(F.col("p_name").alias("term")).distinct()
    x = rows.select("term", F.explode(X.phrase_patterns(F.col("term"), {"colour": ["^(red|blue)", "(bolt|gear)$"], "size": ["small|large"]})).alias("m"))
    return x.select("term", "m.pattern", F.get("m.parts", F.lit(0)).alias("part1"), F.get("m.parts", F.lit(1)).alias("part2"))


@query("phrase_legality", r"""with w as (select distinct unnest(string_split(text, ' ')) as t from conversations) select t, not regexp_matches(t, '^\p{L}') or length(t) > 12 or regexp_matches(t, '[\[\]{}<>|=%$#@*\\]') or lower(t) in ('de', 'la', 'the') as illegal,
 len(string_split(t, '=')) = 2 as feature, regexp_replace(regexp_replace(t, '^CN', ''), '[A-Z]$', '') as short_id, false as chinese from w where t <> ''""")
def phrase_legality(spark, d):
    t = F.col("t")
    w = table(spark, d, "conversations").select(F.explode(F.split("text", " ")).alias("t")).where("t != ''").distinct()
    return w.select("t", T.illegal_phrase(t, ("de", "la", "the"), 12).alias("illegal"), T.legal_feature(t).alias("feature"), T.short_patent_id(t).alias("short_id"), T.chinese(t).alias("chinese"))


@query("kept_features", "with p as (select distinct p_type, p_brand, p_name from part) select p_type, p_brand, p_name, 'type=' || p_type || '|brand=' || p_brand as kept, list_has_any(string_split(p_name, ' '), string_split('small ' || lower(p_type) || ' gear', ' ')) as shares from p")
def kept_features(spark, d):
    p = table(spark, d, "part").select("p_type", "p_brand", "p_name").distinct()
    feats = F.array(F.concat(F.lit("type="), "p_type"), F.concat(F.lit("name="), "p_name"), F.concat(F.lit("brand="), "p_brand"))
    return p.select("p_type", "p_brand", "p_name", F.array_join(T.keep_features(feats, ("type", "brand")), "|").alias("kept"), T.share_word(F.col("p_name"), F.concat(F.lit("small "), F.lower("p_type"), F.lit(" gear"))).alias("shares"))


@query("chinese_terms", "select term, round(max(score), 4) as best from (select case when l_partkey % 3 = 0 then '技术' || (l_partkey % 50) when l_partkey % 3 = 1 then '技' || (l_partkey % 50) || 'abc' else '方法系统' end as term, l_discount * 10 as score from lineitem) where score > 0.5 and length(regexp_replace(term, '[^一-龥]', '', 'g')) * 2 > length(term) group by term")
def chinese_terms(spark, d):
    """Distinct Chinese terms with a score above .5."""
    k = F.col("l_partkey")
    term = F.when(k % 3 == 0, F.concat(F.lit("技术"), (k % 50).cast("string"))).when(k % 3 == 1, F.concat(F.lit("技"), (k % 50).cast("string"), F.lit("abc"))).otherwise("方法系统")
    x = table(spark, d, "lineitem").select(term.alias("term"), (F.col("l_discount") * 10).alias("score"))
    return x.where((F.col("score") > 0.5) & T.chinese(F.col("term"))).groupBy("term").agg(F.round(F.max("score"), 4).alias("best"))


@query("html_rows", "select p_partkey, '<tr><td>' || p_partkey || '</td><td>' || replace(replace(replace(p_name || ' <' || p_brand || '> & ' || p_type, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>' as html from part")
def html_rows(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" <"), "p_brand", F.lit("> & "), "p_type").alias("what"))
    return H.html_rows(x, ["p_partkey", "what"]).select("p_partkey", "html")


@query("fact_lines", "select l_orderkey as doc, 'TECHNOLOGY term=\"' || p_name || '\" START=' || l_linenumber || ' END=' || (l_linenumber + length(p_name)) as line from lineitem join part on p_partkey = l_partkey")
def fact_lines(spark, d):
    o = occurrences(spark, d).select("doc", "term", F.col("loc").alias("start"), (F.col("loc") + F.length("term")).alias("end"))
    return H.fact_lines(o, "TECHNOLOGY")


@query("plot_points", f"with {OCC}, y as (select year, avg(score) as s from occ group by year) select year::double as year, printf('(%.2f,%.2f)', year::double, round(s, 2)) as point from y")
def plot_points(spark, d):
    y = occurrences(spark, d).groupBy(F.col("year").cast("double").alias("year")).agg(F.round(F.avg("score"), 2).alias("s"))
    return H.plot_points(y, "year", "s").select("year", "point")


@query("open_annotation_terms", "select distinct p_name as term from part where p_name not in (select p_name from part where p_size = 7)")
def open_annotation_terms(spark, d):
    """Terms that a labelling task still has to ask for."""
    p = table(spark, d, "part").select(F.col("p_name").alias("term"), "p_size")
    labels = p.select("term", F.when(F.col("p_size") == 7, "y").when(F.col("p_size") == 8, "bad").alias("label")).where("label is not null")
    return H.TASKS["technology"].open_terms(p.select("term").distinct(), labels)


@query("first_category", "with c as (select p_name as term, p_type as best, count(*) as n from part group by all), r as (select *, row_number() over (partition by term order by n desc, best) as i from c) select term, best, n from r where i = 1")
def first_category(spark, d):
    """The most frequent category of a term, the first one on ties."""
    from termloom.operators.stats import category_argmax

    c = table(spark, d, "part").groupBy(F.col("p_name").alias("term"), F.col("p_type").alias("best")).agg(F.count("*").alias("n"))
    return category_argmax(c, "term", "best", "n", False)

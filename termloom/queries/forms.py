"""Scalar forms: ids, tags, dates, splits and formats over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog import query, table
from termloom.functions import forms as S

from .views import OCC, occurrences

_W = "string_split(p_name, ' ')"


@query("tag_strings", f"""with t as (select distinct p_name as term, {_W}[1] || '_JJ ' || {_W}[2] || '_NN' as tagged from part)
select term, array_to_string(list_transform(list_filter(string_split(tagged, ' '), lambda x: split_part(x, '_', 2) like 'N%'), lambda x: lower(split_part(x, '_', 1))), ' ') as nouns, 'JN' as acronym, null::varchar as illegal from t""")
def tag_strings(spark, d):
    w = F.split("p_name", " ")
    t = table(spark, d, "part").select(F.col("p_name").alias("term"), F.concat(w[0], F.lit("_JJ "), w[1], F.lit("_NN")).alias("tagged")).distinct()
    tags = F.array_join(F.transform(F.split("tagged", " "), lambda x: F.substring_index(x, "_", -1)), " ")
    return t.select("term", F.array_join(S.words_with_tag(F.col("tagged")), " ").alias("nouns"), S.tag_acronym(tags, ("J", "N")).alias("acronym"), S.tag_acronym(tags, ("N",)).alias("illegal"))


@query("patent_id_forms", """with t as (select o_orderkey as k, case o_orderkey % 4 when 0 then '' when 1 then 'D' when 2 then 'PP' else '20' end || lpad(o_orderkey::varchar, 7, '0') as number, case when o_orderkey % 3 = 0 then '' else 'B' || (o_orderkey % 3) end as kind from orders)
select k, number as id, regexp_extract(number, '^([A-Z]*)', 1) as prefix, kind, regexp_replace(number, '^[A-Z]*', '') as digits,
 case when k % 4 = 3 then left(number, 4) || '/' || substr(number, 5, length(number) - 6) when k % 4 = 2 then left(number, 2) || '/' || substr(number, 3, length(number) - 4)
  when k % 4 = 1 then left(number, 1) || '/' || substr(number, 2, length(number) - 3) else left(number, 2) || '/' || substr(number, 3, length(number) - 4) end as path from t""")
def patent_id_forms(spark, d):
    k = F.col("o_orderkey")
    lead = F.element_at(F.array(F.lit(""), F.lit("D"), F.lit("PP"), F.lit("20")), (k % 4 + 1).cast("int"))
    number = F.concat(lead, F.lpad(k.cast("string"), 7, "0"))
    kind = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("B"), (k % 3).cast("string")))
    t = table(spark, d, "orders").select(k.alias("k"), number.alias("number"), F.concat(F.lit("US"), number, kind, F.lit(".xml")).alias("name"))
    p = S.patent_parts(F.col("name"))
    return t.select("k", S.patent_id(F.concat(F.lit("a/b/"), F.col("name"))).alias("id"), p["prefix"].alias("prefix"), p["kind"].alias("kind"), p["number"].alias("digits"), S.patent_path(F.col("number")).alias("path"))


@query("class_domains", """with p as (select p_partkey, left(p_type, 1) || '-' || p_size || '-' || left(p_brand, 1) as c from part), m as (select * from (values ('E11', 'early'), ('S28B', 'late'), ('P7', 'promo'), ('M5B', 'medium')) v(k, dom))
select p_partkey, case when a.dom is not null then a.k else replace(c, '-', '') end as key, coalesce(a.dom, b.dom) as domain from p left join m a on a.k = string_split(c, '-')[1] || string_split(c, '-')[2] left join m b on b.k = replace(c, '-', '')""")
def class_domains(spark, d):
    known = F.create_map(*[F.lit(x) for x in ("E11", "early", "S28B", "late", "P7", "promo", "M5B", "medium")])
    c = F.concat_ws("-", F.left("p_type", F.lit(1)), F.col("p_size").cast("string"), F.left("p_brand", F.lit(1)))
    return table(spark, d, "part").select("p_partkey", S.domain_of_class(c, known).alias("r")).select("p_partkey", "r.key", "r.domain")


@query("section_features", """select distinct doc, case when loc = 1 then 'TITLE' else 'ABSTRACT' end as section, case when loc = 1 then 'TITLE' else 'ABSTRACT' end || case when loc <= 2 then '_sent1' else '_later' end as location
from (select l_orderkey as doc, l_linenumber as loc from lineitem)""")
def section_features(spark, d):
    """The location feature of a sentence, and the section read back from it."""
    name = F.when(F.col("l_linenumber") == 1, "TITLE").otherwise("ABSTRACT")
    at = F.when(F.col("l_linenumber") <= 2, 0).otherwise(F.col("l_linenumber") - 2)
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), S.section_location(name, at).alias("location")).distinct()
    return x.select("doc", S.section_of(F.concat(F.lit("prev_V=use section_loc="), "location", F.lit(" plen=2"))).alias("section"), "location")


@query("substring_offsets", "select doc_id, len(regexp_extract_all(lower(coalesce(text, '')), 'th'))::int as n, (instr(lower(text), 'th') - 1)::int as first from documents where contains(lower(text), 'th')")
def substring_offsets(spark, d):
    x = table(spark, d, "documents").select("doc_id", S.offsets_of(F.lower("text"), "th").alias("at")).where(F.size("at") > 0)
    return x.select("doc_id", F.size("at").alias("n"), F.get("at", F.lit(0)).alias("first"))


@query("formatted_scores", f"""with {OCC}, x as (select part, sum(round(score * 10)::int) / count(*) / 10 + 0.00012 as s, count(*) as n, count(case when flag = 'R' then 1 end) as r from occ group by part)
select part as term, case when n % 7 = 0 then 'None' else printf('%.2f', s) end as score, case when n % 5 = 0 then '-1' else printf('%.4f', s) end as lookup, printf('%.2f', r / n + 0.00012) as share from x""")
def formatted_scores(spark, d):
    """Means of whole tenths, so that their digits don't depend on the order of summing, a little off the borders of rounding."""
    x = occurrences(spark, d).groupBy(F.col("part").alias("term")).agg(F.sum(F.round(F.col("score") * 10).cast("int")).alias("t"), F.count("*").alias("n"), F.count(F.when(F.col("flag") == "R", 1)).alias("r"))
    s = F.col("t") / F.col("n") / 10 + 0.00012
    return x.select("term", S.two_decimals(F.when(F.col("n") % 7 != 0, s)).alias("score"), S.lookup_score(F.when(F.col("n") % 5 == 0, -1.0).otherwise(s)).alias("lookup"), S.ratio(F.col("r") / F.col("n") + 0.00012, F.lit(1)).alias("share"))


@query("text_after_word", "select conv_id, turn, split_part(text, ' de ', 2) as after, split_part(text, ' de ', 1) as before from conversations where contains(text, ' de ')")
def text_after_word(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", S.after_word(F.col("text"), "de").alias("r")).where("r is not null")
    return x.select("conv_id", "turn", "r.after", "r.before")


@query("counted_lines", "select n || chr(9) || p_name as line from (select p_name, count(*) as n from part group by 1)")
def counted_lines(spark, d):
    x = table(spark, d, "part").groupBy("p_name").count()
    return x.select(S.counted_line(F.format_string("%7d %s", "count", "p_name")).alias("line"))


@query("text_fragments", r"""with f as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.?!;:,\t])', '\1' || chr(1), 'g'), '\x01|[\r\n]{2,}'), lambda x: trim(x, ' ')), lambda x: x <> '') as f from documents where text is not null)
select doc_id, len(f)::int as n, md5(array_to_string(f, '|')) as digest from f""")
def text_fragments(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", S.fragments(F.col("text")).alias("f"))
    return x.select("doc_id", F.size("f").alias("n"), F.md5(F.array_join("f", "|")).alias("digest"))


@query("line_checks", r"""select doc_id, length(line) <= 200 as short, length(line) = strlen(line) as is_ascii, md5(regexp_replace(line, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) as clean
from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)""")
def line_checks(spark, d):
    """Too long lines, ASCII lines and lines without control characters."""
    x = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return x.select("doc_id", (F.length("line") <= 200).alias("short"), S.all_ascii(F.col("line")).alias("is_ascii"), F.md5(S.without_controls(F.col("line"))).alias("clean"))


@query("numeric_dates", "select o_orderkey, strftime(o_orderdate, '%m-%d-%Y') as long_form, strftime(o_orderdate, '%m-%d-%Y') as short_form, strftime(o_orderdate, '%Y-%m-%d') as other from orders")
def numeric_dates(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", S.numeric_date(F.date_format(day, "MMMM d, yyyy")).alias("long_form"), S.numeric_date(F.date_format(day, "MMM d , yyyy")).alias("short_form"), S.numeric_date(F.date_format(day, "yyyy-MM-dd")).alias("other")
    )


_FRAMES = "case " + " ".join("when list_has_any(w, [" + ", ".join(f"'{w}'" for w in words) + f"]) then '{name}'" for name, words in S.TIME_FRAMES) + " else 'U' end"


@query("time_frames", f"""select k, {_FRAMES} as frame from (select c_custkey as k, ['the', case c_custkey % 9 when 0 then 'family' when 1 then 'current' when 2 then 'history' when 3 then 'discharge' when 4 then 'instructions' when 5 then 'allergies' when 6 then 'exam' when 7 then 'prior' else 'none' end,
 case when c_custkey % 5 = 0 then 'mother' else 'of' end] as w from customer)""")
def time_frames(spark, d):
    k = F.col("c_custkey")
    word = F.element_at(F.array(*[F.lit(w) for w in "family current history discharge instructions allergies exam prior none".split()]), (k % 9 + 1).cast("int"))
    return table(spark, d, "customer").select(k.alias("k"), S.time_frame(F.array(F.lit("the"), word, F.when(k % 5 == 0, "mother").otherwise("of"))).alias("frame"))


_AFFIXES = ("lat", "gi", "dge", "nvi", "ol")


@query("shared_words", f"""with t as (select distinct p_name as term, string_split(p_name, ' ') as w from part), p as (select a.term as t1, b.term as t2, a.w as w1, b.w as w2 from t a join t b on a.w[2][1] = b.w[2][1] and a.term < b.term)
select t1, t2, array_to_string(list_sort(list_distinct(list_intersect(list_filter(w1, lambda x: length(x) > 3), list_filter(w2, lambda x: length(x) > 3)))), ' ') as terms,
 array_to_string(list_sort(list_distinct(list_intersect(list_transform(list_filter(w1, lambda x: length(x) > 2), lambda x: left(x, 2)), list_transform(list_filter(w2, lambda x: length(x) > 2), lambda x: left(x, 2))))), ' ') as stems,
 array_to_string(list_sort(list_filter({list(_AFFIXES)}, lambda a: len(list_filter(w1, lambda x: length(x) - length(a) > 2 and contains(x, a))) > 0)), ' ') as affixes from p""")
def shared_words(spark, d):
    """Terms whose heads begin alike: shared words, shared stems, and affixes of the first."""
    t = table(spark, d, "part").select(F.col("p_name").alias("t1"), F.split("p_name", " ").alias("w1")).distinct().withColumn("k", F.left(F.col("w1")[1], F.lit(1)))
    p = t.join(t.withColumnsRenamed({"t1": "t2", "w1": "w2"}), "k").where("t1 < t2")
    a, b = F.col("w1"), F.col("w2")
    return p.select("t1", "t2", F.array_join(S.shared_terms(a, b, 3), " ").alias("terms"), F.array_join(S.shared_stems(a, b, 2), " ").alias("stems"), F.array_join(S.affixes_in(a, _AFFIXES), " ").alias("affixes"))


@query("score_of_label", "select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then 2 else 4 end as place, round(l_discount, 4) as score from lineitem")
def score_of_label(spark, d):
    """The score of label y where labels and scores alternate in any order."""
    y, n = F.concat(F.lit("y "), F.format_string("%.4f", "l_discount")), F.concat(F.lit("n "), F.format_string("%.4f", 1 - F.col("l_discount")))
    row = F.when(F.col("l_linenumber") % 2 == 0, F.concat(y, F.lit(" "), n)).otherwise(F.concat(n, F.lit(" "), y))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.value_of_label(row, "y").alias("r")).select("l_orderkey", "l_linenumber", "r.place", "r.score")


@query("highlighted_phrases", r"""with t as (select conv_id, turn, regexp_split_to_array(text, ' ') as w from conversations where len(regexp_split_to_array(text, ' ')) >= 4)
select conv_id, turn, replace(replace(replace(array_to_string(w[1:1], ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' <np> ' || replace(replace(replace(array_to_string(w[2:3], ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' </np> ' ||
 replace(replace(replace(array_to_string(w[4:], ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as sentence from t""")
def highlighted_phrases(spark, d):
    """The second and third word of each turn marked as a phrase."""
    x = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w")).where(F.size("w") >= 4)
    return x.select("conv_id", "turn", S.highlighted(F.col("w"), F.lit(1), F.lit(3)).alias("sentence"))


@query("first_keywords", "select doc_id, nullif(regexp_extract(lower(text), '(disgusting|pathetic|trash|idiot|clown)', 1), '') as kind from documents where regexp_matches(lower(text), 'disgusting|pathetic|trash|idiot|clown')")
def first_keywords(spark, d):
    x = table(spark, d, "documents").select("doc_id", S.first_keyword(F.col("text"), ("trash", "idiot", "clown", "pathetic", "disgusting")).alias("kind"))
    return x.where("kind is not null")


@query("description_rest", r"""with t as (select page_id, html as t, nullif(instr(html, '</title>'), 0) + 7 as title, nullif(instr(html, '</style>'), 0) + 7 as style, nullif(instr(html, '</body>'), 0) - 1 as stop from pages)
select page_id, md5(trim(substr(t, coalesce(title, style, 0) + 1, greatest(stop - coalesce(title, style, 0), 0)), ' ')) as digest from t where stop is not null""")
def description_rest(spark, d):
    """What is left of a body behind the first of its leading parts."""
    end = lambda tag: F.nullif(F.instr("html", tag), F.lit(0)) + len(tag) - 1
    x = table(spark, d, "pages").select("page_id", S.rest_of_description(F.col("html"), [end("</title>"), end("</style>")], F.lit(0), F.nullif(F.instr("html", "</body>"), F.lit(0)) - 1).alias("t"))
    return x.where("t is not null").select("page_id", F.md5("t").alias("digest"))


@query("dates_in_markup", r"""select o_orderkey, strftime(o_orderdate, '%Y%m%d')::int as application, case when o_orderkey % 3 > 0 then strftime(o_orderdate + interval 400 day, '%Y%m%d')::int end as publication from orders""")
def dates_in_markup(spark, d):
    """Application and publication dates from XML text."""
    from termloom.sources.readers import dates_of

    form = lambda c: F.date_format(c, "yyyyMMdd")
    day = F.col("o_orderdate")
    xml = F.concat(F.lit("<doc><application-reference><date>"), form(day), F.lit("</date></application-reference>"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit('<publication-reference lang="en">\n <date>'), form(F.date_add(day, 400)), F.lit("</date></publication-reference>"))).otherwise(""), F.lit("</doc>"))
    return dates_of(table(spark, d, "orders").select("o_orderkey", xml.alias("text")))

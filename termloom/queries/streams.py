"""Windows over events (the same code runs on streams), the catalog and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.catalog import query, table
from termloom.plans.lineage import append_new
from termloom.streaming import incremental as I


@query("event_hour_windows", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by all")
def event_hour_windows(spark, d):
    x = I.windowed_counts(table(spark, d, "events").select("ts", "event_type"))
    return x.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("event_sessions", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as k from e)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k""")
def event_sessions(spark, d):
    x = I.sessions(table(spark, d, "events").select("ts", "user_id"))
    return x.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("append_new_documents", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def append_new_documents(spark, d):
    return append_new(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "source"), "doc_id")


@query("json_properties", "select event_type, count(*) as n, count(props) as with_props from events group by event_type")
def json_properties(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"))


@query("html_titles", "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<p>'))::int as paragraphs from pages")
def html_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("paragraphs"))


@query("conversation_turns", "select conv_id, count(*) as turns, count(case when role = 'user' then 1 end) as user_turns, sum(length(text))::bigint as chars from conversations group by conv_id")
def conversation_turns(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count(F.when(F.col("role") == "user", 1)).alias("user_turns"), F.sum(F.length("text")).alias("chars"))

"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A window is ``width`` consecutive words
of an item; an item of fewer words is one window. All words of a window have to occur, so its necessary prefix is a
single token: the one that is rarest in the documents. Document words join windows on that token only; the token's offset
in the window gives the start, bounded by the document's length, and then the whole window is compared.

The windows are broadcast if their measured size is below ``broadcast_bytes``; then scanning, joining and verifying is one
stage without a shuffle of text. Beyond that, words are shuffled to the windows' prefix tokens and candidates are verified against
their documents by a second join, both with adaptive splitting of skewed partitions.

What is found is written to the shared folder, so that texts are scanned for it once.

Defined cases: null and empty texts have no words and are never hit; items without words are never found; items with the same
windows are all counted; repeated rows (same id and text) get the same result each; rows that share an id but not the text are
kept apart; null ids are ids like any other. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.shared import materialize

from ._spark import LOWER, UPPER, ascii_lower, row_key, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """The words, with an empty string before or after them where the text begins or ends with a separator."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def word_count(words: Column) -> Column:
    return F.size(words) - (F.element_at(words, 1) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """(window, item_id): each distinct window text of each item."""
    w = items.select("item_id", F.filter(words_of(F.col("text")), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.concat_ws(" ", F.slice("w", F.col("s"), width)).alias("window")).distinct()


def prefixes(windows: DataFrame, docs_words: DataFrame, small: bool) -> DataFrame:
    """(word, off, n, window): the rarest word of each distinct window, by the number of its occurrences in the documents."""
    hint = F.broadcast if small else (lambda x: x)
    distinct = windows.select("window").distinct().withColumn("w", F.split("window", " "))
    tokens = distinct.select("window", F.size("w").alias("n"), F.posexplode("w").alias("off", "word"))
    vocabulary = tokens.select("word").distinct()
    counts = docs_words.select(F.explode("_w").alias("word")).join(hint(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    ranked = tokens.join(counts, "word")  # a window with a word that no document has can't occur
    whole = ranked.groupBy("window", "n").agg(F.count("*").alias("found"), F.min(F.struct("df", "word", "off")).alias("first"))
    return whole.where("found = n").select("window", "n", F.col("first.word").alias("word"), F.col("first.off").alias("off"))


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(hits, windows): hits hold row key, start, n and window; windows hold window and item_id."""
    windows = windows_of(items, width)
    measured = windows.agg(F.sum(F.length("window") + 64)).first()[0] or 0
    small = measured * 3 <= broadcast_bytes
    source = docs.where("text is not null").select(*row_key(F.col("doc_id"), F.col("text")), words_of(F.col("text")).alias("_w"))
    prefix = prefixes(windows, docs.where("text is not null").select(words_of(F.col("text")).alias("_w")), small)
    start = F.col("_pos") - F.col("off")
    same = (start >= 0) & (start + F.col("n") <= F.size("_w")) & (F.concat_ws(" ", F.slice("_w", start + 1, F.col("n"))) == F.col("window"))
    if small:
        found = source.select("__id", "__text", "_w", F.posexplode("_w").alias("_pos", "word")).join(F.broadcast(prefix), "word").where(same)
    else:
        candidates = source.select("__id", "__text", F.posexplode("_w").alias("_pos", "word")).join(prefix, "word").where(start >= 0).distinct()
        texts = source.dropDuplicates(["__id", "__text"]).withColumnsRenamed({"__id": "__id2", "__text": "__text2"})
        found = candidates.join(texts, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__text") == F.col("__text2"))).where(same)
    return found.select("__id", "__text", start.alias("start"), "n", "window"), windows


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, windows = matches(docs, items, width, broadcast_bytes)
    found = materialize(found.distinct(), "hits")
    covered = found.groupBy("__id", "__text", "start").agg(F.max("n").alias("n")).select("__id", "__text", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy("__id", "__text").agg(F.count("*").alias("n_hit"))
    ids = found.select("__id", "__text", "window").distinct().join(windows, "window").select("__id", "__text", F.col("item_id").cast("string").alias("item")).distinct()
    ids = ids.groupBy("__id", "__text").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items"))
    hits = covered.join(ids, covered["__id"].eqNullSafe(ids["__id"]) & (covered["__text"] == ids["__text"])).select(covered["__id"].alias("__i"), covered["__text"].alias("__t"), "n_hit", "n_items", "items")
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), word_count(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(hits, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("__id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that no window of an item occurs in, with their columns."""
    found, _ = matches(docs, items, width)
    hit = found.select(F.col("__id").alias("__i"), F.col("__text").alias("__t")).distinct()
    key, text = row_key(F.col("doc_id"), F.col("text"))
    return docs.select("*", key, text).join(hit, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t")), "left_anti").select(*[docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (select distinct item_id, array_to_string(w[s:s + 9], ' ') as t, least(len(w), 10) as n from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as s from b where len(w) > 0)),
sizes as (select distinct n from win),
g as (select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as t from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from d, sizes)),
m as (select doc_id, s, g.n, item_id from g join win using (t)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from m) group by 1),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from m) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join i using (doc_id)
"""

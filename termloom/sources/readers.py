"""Readers and writers of the formats that term mining works on; all lazy, all distributed.

Every reader takes a path (or several) that Spark can list; ``.gz`` files are read as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.terms import year_of_path
from termloom.operators.text import parse_feature_row

SECTIONS = ("TITLE", "DATE", "ABSTRACT", "SUMMARY", "TECHNICAL_FIELD", "BACKGROUND_ART", "DESC_REST", "FIRST_CLAIM", "OTHER_CLAIMS")


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """year, source, target of tab-separated lines; comments and blanks go, one column means no year, a leading slash of the target goes."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    p = F.split("value", "\t")
    one = F.size(p) == 1
    target = F.when(F.size(p) > 2, F.regexp_replace(F.get(p, F.lit(2)), "^/", ""))
    return lines.select(F.when(~one, F.get(p, F.lit(0))).alias("year"), F.when(one, F.get(p, F.lit(0))).otherwise(F.get(p, F.lit(1))).alias("source"), target.alias("target"))


def feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, doc_id, year, term, feats of phrase-feature files."""
    x = spark.read.text(path).where("value != ''").select(parse_feature_row(F.col("value")).alias("r")).select("r.*")
    return x.select("chunk_id", F.regexp_replace("chunk_id", r"_\d+$", "").alias("doc_id"), "year", "term", "feats")


def write_feature_rows(rows: DataFrame, path: str, compress: bool = True) -> None:
    """Feature rows with sorted features, one file a partition."""
    feats = F.array_sort(F.transform(F.map_entries("feats"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    line = F.concat_ws("\t", "chunk_id", F.col("year").cast("string"), "term", F.array_join(feats, "\t"))
    rows.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc, year, text of whole text files; the year is the parent directory, 9999 if that is none."""
    x = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    return x.select(F.regexp_extract("file", r"([^/]+?)(?:\.\w+)*$", 1).alias("doc"), year_of_path(F.col("file")).alias("year"), F.col("value").alias("text"))


def sections(docs: DataFrame) -> DataFrame:
    """doc, year, section, ord, text of documents (doc, year, text) with ``FH_<NAME>:`` header lines, closed by ``END``."""
    body = F.regexp_replace("text", r"(?m)^END\s*$", "")
    parts = F.split(body, r"(?m)^FH_")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    x = docs.select("doc", "year", F.posexplode(parts).alias("ord", "part"))
    return x.select("doc", "year", F.regexp_extract("part", r"^(\w+):", 1).alias("section"), "ord", F.regexp_replace("part", r"^\w+:\s*|\s+$", "").alias("text"))


def write_sections(rows: DataFrame, path: str) -> None:
    """The sectioned text of each document, in the fixed order of sections."""
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), "ord", F.concat(F.lit("FH_"), "section", F.lit(":\n"), "text").alias("t"))))
    text = F.concat(F.array_join(F.transform(lines, lambda r: r["t"]), "\n"), F.lit("\nEND"))
    rows.groupBy("year", "doc").agg(text.alias("text")).write.mode("overwrite").partitionBy("year").json(path)


def tagged_sentences(docs: DataFrame) -> DataFrame:
    """doc, year, section, sent_no, sent_in_section, tokens array<struct<tok,tag>> of documents with ``FH_`` headers and token_TAG lines."""
    s = sections(docs).select("doc", "year", "section", "ord", F.posexplode(F.filter(F.split("text", r"\n"), lambda x: F.trim(x) != "")).alias("sent_in_section", "line"))
    number = F.row_number().over(Window.partitionBy("doc", "year").orderBy("ord", "sent_in_section")) - 1
    token = lambda x: F.struct(F.regexp_extract(x, r"^(.*)_[^_]*$", 1).alias("tok"), F.regexp_extract(x, r"_([^_]*)$", 1).alias("tag"))
    return s.select("doc", "year", "section", number.alias("sent_no"), "sent_in_section", F.transform(F.split(F.trim("line"), r"\s+"), token).alias("tokens"))


def labels(spark: SparkSession, path: str, keep: tuple[str, ...] = ("y", "n")) -> DataFrame:
    """term, label of label files; comments go; of several labels of a term the first that is read stays."""
    x = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("at", F.monotonically_increasing_id())
    p = F.split("value", "\t")
    x = x.select(F.get(p, F.lit(1)).alias("term"), F.trim(F.get(p, F.lit(0))).alias("label"), "at").where(F.col("label").isin(*keep) & F.col("term").isNotNull())
    return x.groupBy("term").agg(F.min_by("label", "at").alias("label"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """doc, class, type, start, end of stand-off lines of key="value" and bare TYPE START END fields."""
    x = spark.read.text(path).withColumn("file", F.input_file_name())
    get = lambda key, pattern: F.nullif(F.regexp_extract("value", key + "=?\"?(" + pattern + ")\"?", 1), F.lit(""))
    return x.select(F.regexp_extract("file", r"([^/]+?)\.\w+$", 1).alias("doc"), F.nullif(F.regexp_extract("value", r"^(\w+)", 1), F.lit("")).alias("class"), get("TYPE", r"\w+").alias("type"), get("START", r"\d+").cast("int").alias("start"), get("END", r"\d+").cast("int").alias("end"))


def section_tree(spans: DataFrame) -> DataFrame:
    """doc, start, end, parent_start, parent_end: the smallest span of the same document around each span."""
    a, b = spans.select("doc", "start", "end").distinct(), spans.select("doc", F.col("start").alias("ps"), F.col("end").alias("pe")).distinct()
    inside = a.join(b, "doc").where("ps <= start and pe >= end and (ps < start or pe > end)")
    parent = inside.groupBy("doc", "start", "end").agg(F.min_by(F.struct("ps", "pe"), F.struct(F.col("pe") - F.col("ps"), "ps")).alias("p"))
    return a.join(parent, ["doc", "start", "end"], "left").select("doc", "start", "end", F.col("p.ps").alias("parent_start"), F.col("p.pe").alias("parent_end"))


def _between(text: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))


def clean_inline_tags(text: Column) -> Column:
    """Trademark signs go; tags glued to words get a blank."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, "™", ""), r"(?<=\w)(<\w)", " $1"), r"(</\w+>)(?=\w)", "$1 ")


def web_of_science(spark: SparkSession, path: str) -> DataFrame:
    """date, title, abstract and subjects of records closed by ``</REC>``."""
    x = spark.read.option("lineSep", "</REC>").text(path).where(F.col("value").contains("<REC"))
    t = clean_inline_tags(F.col("value"))
    title = F.coalesce(_between(t, "item_title"), F.nullif(F.trim(F.regexp_extract(t, r"(?s)<title[^>]*type=\"item\"[^>]*>(.*?)</title>", 1)), F.lit("")), _between(t, "title"))
    year = F.coalesce(F.nullif(F.regexp_extract(t, r"pubyear=\"(\d{4})\"", 1), F.lit("")), F.substring(_between(t, "bib_date"), 1, 4))
    return x.select(year.cast("int").alias("year"), title.alias("title"), _between(t, "abstract").alias("abstract"), F.expr("regexp_extract_all(value, '<subject[^>]*>([^<]*)</subject>', 1)").alias("subjects"))


def cnki(spark: SparkSession, path: str) -> DataFrame:
    """doc, year (first four digits of the file name), title, abstract, body."""
    x = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return x.select("file", F.nullif(F.regexp_extract("file", r"(\d{4})", 1), F.lit("")).cast("int").alias("year"), *[_between(F.col("value"), t).alias(t) for t in ("title", "abstract", "body")])


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """title, year (the earliest publication date), abstract and body of article files."""
    x = spark.read.text(path, wholetext=True)
    years = F.transform(F.expr(r"regexp_extract_all(value, '(?s)<pub-date.*?<year>(\\d{4})</year>', 1)"), lambda y: y.cast("int"))
    strip = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    v = F.col("value")
    return x.select(strip(_between(v, "article-title")).alias("title"), F.array_min(years).alias("year"), strip(_between(v, "abstract")).alias("abstract"), strip(_between(v, "body")).alias("body"))


def route_by_subject(records: DataFrame, domains: DataFrame) -> DataFrame:
    """Each record with the first domain (by ``ord``) that one of its subjects belongs to; domains are (domain, subject, ord)."""
    x = records.withColumn("rid", F.xxhash64(F.to_json(F.struct(*records.columns))))
    hit = x.select("rid", F.explode("subjects").alias("subject")).join(domains, "subject").groupBy("rid").agg(F.min_by("domain", "ord").alias("domain"))
    return x.join(hit, "rid").drop("rid")


def technologies(spark: SparkSession, years: str, ids: str) -> DataFrame:
    """term, id, available and mature years from the two ontology tables."""
    y = spark.read.csv(years, sep="\t", schema="term string, years string")
    i = spark.read.csv(ids, sep="\t", schema="term string, id string")
    p = F.split("years", " ")
    return y.select("term", F.get(p, F.lit(0)).cast("int").alias("available"), F.get(p, F.lit(1)).cast("int").alias("mature")).join(i, "term")


def dates_of(docs: DataFrame) -> DataFrame:
    """The columns but ``text``, with the application and publication dates (yyyymmdd as int) of XML texts; null where there is none."""
    date = lambda tag: F.nullif(F.regexp_extract("text", rf"(?s)<{tag}(?:\s[^>]*)?>.*?<date>(\d{{8}})</date>", 1), F.lit("")).cast("int")
    return docs.select(*[c for c in docs.columns if c != "text"], date("application-reference").alias("application"), date("publication-reference").alias("publication"))

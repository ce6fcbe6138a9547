"""Stores of documents and terms: a repository with an id index, resumable ingest, term tables, and copies by year. All are folders of Parquet that any number of tasks write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import forms as S


class Repository:
    """Documents (id, path, year, content) and one index for each processing step; a document is added once, whoever adds it again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, kind: str = "patents") -> Repository:
        """An empty repository of a kind."""
        self.spark.createDataFrame([(kind,)], "kind string").write.mode("overwrite").parquet(self._table("kind"))
        self.spark.createDataFrame([], "id string, path string, year int, content binary").write.mode("overwrite").partitionBy("year").parquet(self._table("documents"))
        self.spark.createDataFrame([], "id string, path string, step string").write.mode("overwrite").partitionBy("step").parquet(self._table("steps"))
        return self

    def documents(self) -> DataFrame:
        return self.spark.read.schema("id string, path string, content binary, year int").parquet(self._table("documents"))

    def add(self, rows: DataFrame) -> int:
        """Add rows (id, path, year, content) whose id isn't there yet, one of each; returns how many."""
        new = rows.dropDuplicates(["id"]).join(self.documents().select("id"), "id", "left_anti")
        before = self.documents().count()
        new.select("id", "path", "year", "content").write.mode("append").partitionBy("year").parquet(self._table("documents"))
        return self.documents().count() - before

    def processed(self, rows: DataFrame, step: str) -> None:
        """Record where a step left its output (id, path)."""
        rows.select("id", "path", F.lit(step).alias("step")).write.mode("append").partitionBy("step").parquet(self._table("steps"))

    def paths(self, ids: DataFrame, step: str = "source") -> DataFrame:
        """id and path of ids, as stored or after a step; unknown ids have none."""
        own = self.documents().select("id", "path") if step == "source" else self.spark.read.schema("id string, path string, step string").parquet(self._table("steps")).where(F.col("step") == step).select("id", "path")
        return ids.select("id").distinct().join(own, "id", "left")


def patent_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows for a repository from files below a folder, plain or gzipped: id and path follow from the file's name, the year from its directory."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    year = F.coalesce(F.nullif(F.regexp_extract("path", r"/(\d{4})/[^/]*$", 1), F.lit("")).cast("int"), F.lit(9999))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.gz$", "")
    ident = F.coalesce(S.patent_id(name), name)
    return x.select(ident.alias("id"), F.concat_ws("/", S.patent_path(ident), name).alias("path"), year.alias("year"), "content")


def pending(files: DataFrame, processed: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of a file list (source, ...) that aren't processed yet; a limit is the caller's batch."""
    x = files.join(processed.select("source").distinct(), "source", "left_anti")
    return x.orderBy("source").limit(limit) if limit is not None else x


def ingest(spark: SparkSession, files: DataFrame, target: str, done: str) -> tuple[DataFrame, DataFrame]:
    """Copy the files (source, year) that aren't recorded in ``done`` into ``target`` by year, and record them; returns what was copied and the sources that don't exist."""
    try:
        processed = spark.read.schema("source string").parquet(done)
        processed.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        processed = spark.createDataFrame([], "source string")
    todo = pending(files, processed)
    folders = [r.f for r in todo.select(F.regexp_replace("source", r"/[^/]*$", "").alias("f")).distinct().collect()]  # one row a folder
    if not folders:
        return todo, todo.select("source")
    there = spark.read.format("binaryFile").load(folders).select(F.regexp_replace("path", r"^file:/+", "/").alias("source"), "content")
    got = todo.join(there, "source")
    got.select("source", "year", "content").write.mode("append").partitionBy("year").parquet(target)
    copied = spark.read.parquet(target).select("source").join(todo.select("source"), "source", "left_semi")
    copied.write.mode("append").parquet(done)
    return copied, todo.select("source").join(copied, "source", "left_anti")


def of_years(rows: DataFrame, year: int = 0) -> DataFrame:
    """Rows of a year; 0 means all."""
    return rows.where(F.col("year") == year) if year else rows


def load_terms(rows: DataFrame, path: str, year: int = 0) -> None:
    """Append rows (year, doc, term, ...) to a term table, one partition a year."""
    of_years(rows, year).write.mode("append").partitionBy("year").parquet(path)


def export_terms(rows: DataFrame, path: str, year: int = 0) -> None:
    """The same rows as tab-separated text for bulk loads elsewhere."""
    of_years(rows, year).write.mode("overwrite").csv(path, sep="\t")


def copy_years(rows: DataFrame, path: str, language: str, years: list[int]) -> None:
    """Documents of some years into a tree of language and year."""
    rows.where(F.col("year").isin(*years)).withColumn("language", F.lit(language)).write.mode("append").partitionBy("language", "year").parquet(path)


def ask(sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over tables named in braces; whatever the SQL says is planned like any query."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(sql, **tables)


def ordered_terms(rows: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """doc and the tab-joined terms of some sections, in the order of their places."""
    in_order = F.array_sort(F.collect_list(F.struct("loc", "term")))
    return rows.where(F.col("section").isin(*sections)).groupBy("doc").agg(F.array_join(F.transform(in_order, lambda r: r["term"]), "\t").alias("terms"))


def patent(spark: SparkSession, path: str) -> DataFrame:
    """file, title, abstract, description and claims (array) of patent XML files."""
    from .readers import _between

    x = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(S.without_controls(c), r"<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    claims = F.expr(r"regexp_extract_all(value, '(?s)<claim[ >](.*?)</claim>', 1)")
    v = F.col("value")
    title = F.coalesce(_between(v, "invention-title"), _between(v, "title"))
    return x.select("file", plain(title).alias("title"), plain(_between(v, "abstract")).alias("abstract"), plain(_between(v, "description")).alias("description"), F.transform(claims, lambda c: plain(F.regexp_replace(c, r"^[^>]*>", ""))).alias("claims"))


def by_kind(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Documents of a source: patents (ln), web of science (wos), cnki or pubmed (pm)."""
    from . import readers as R

    known = {"ln": patent, "wos": R.web_of_science, "cnki": R.cnki, "pm": R.pubmed}
    if kind not in known:
        raise ValueError(f"no such source: {kind}")
    return known[kind](spark, path)


def concept_files(spark: SparkSession, path: str) -> DataFrame:
    """doc, line, start, end, text, type of concept files (``c="..." l:w l:w||t="..."``), one concept a line."""
    x = spark.read.text(path).withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.\w+$", 1))
    get = lambda k: F.regexp_extract("value", r'^c="(.*)" (\d+):(\d+) \d+:(\d+)\|\|t="([^"]*)"', k)
    return x.where(get(5) != "").select("doc", get(2).cast("int").alias("line"), get(3).cast("int").alias("start"), get(4).cast("int").alias("end"), get(1).alias("text"), get(5).alias("type"))


def relation_files(spark: SparkSession, path: str) -> DataFrame:
    """doc, line, start1, start2, relation of relation files (``c="..." l:w l:w||r="..."||c="..." l:w l:w``)."""
    x = spark.read.text(path).withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.\w+$", 1))
    get = lambda k: F.regexp_extract("value", r'^c=".*" (\d+):(\d+) \d+:\d+\|\|r="([^"]*)"\|\|c=".*" \d+:(\d+) \d+:\d+', k)
    return x.where(get(3) != "").select("doc", get(1).cast("int").alias("line"), get(2).cast("int").alias("start1"), get(4).cast("int").alias("start2"), get(3).alias("relation"))

"""A corpus's settings, its steps as functions from tables to tables, and the history of what was processed."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """What a run needs to know: language, kind of source, years, sections and thresholds. Values come from ``key = value`` lines or the caller."""

    corpus: str = ""
    language: str = "en"
    source: str = "ln"
    first_year: int = 0
    last_year: int = 9999
    sections: tuple[str, ...] = ("TITLE", "ABSTRACT")
    chunk_rules: str = "en"
    min_df: int = 2
    extra: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, lines: list[str]) -> Settings:
        known = {f: type(getattr(cls(), f)) for f in cls.__dataclass_fields__ if f != "extra"}
        values: dict = {}
        extra: dict = {}
        for line in lines:
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            key, _, value = (x.strip() for x in line.partition("="))
            if key not in known:
                extra[key] = value
            else:
                values[key] = tuple(value.split()) if known[key] is tuple else known[key](value)
        return replace(cls(), **values, extra=extra)

    def years(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("year").between(self.first_year, self.last_year))


class Corpus:
    """Steps of a corpus: each reads the table that another wrote, once; a step already there isn't run again."""

    STEPS: dict[str, tuple[str | None, Callable[[DataFrame, Settings], DataFrame]]] = {}

    def __init__(self, spark: SparkSession, root: str, settings: Settings):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def populate(self, docs: DataFrame) -> DataFrame:
        """Take documents (doc, year, text with section headers), as far as the settings' years go."""
        return self._write("documents", self.settings.years(docs))

    def run(self, step: str) -> DataFrame:
        """Run a step, and those that it needs, unless they are there."""
        if self._there(step):
            return self.table(step)
        needs, f = self.STEPS[step]
        return self._write(step, f(self.run(needs) if needs in self.STEPS else self.table(needs), self.settings))

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        start = time.time()
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        out = self.table(name)
        self.spark.createDataFrame([(name, time.time() - start, out.count())], "step string, seconds double, n long").write.mode("append").parquet(f"{self.root}/history")
        return out

    def datasets(self) -> list[str]:
        return [s for s in ("documents", *self.STEPS) if self._there(s)]

    def processing_time(self) -> DataFrame:
        """step, n and seconds a row of all runs."""
        return self.table("history").groupBy("step").agg(F.sum("n").alias("n"), (F.sum("seconds") / F.greatest(F.sum("n"), F.lit(1))).alias("seconds_each"))


def _sections(docs: DataFrame, s: Settings) -> DataFrame:
    from termloom.sources.readers import sections

    return sections(docs)


def _tagged(docs: DataFrame, s: Settings) -> DataFrame:
    from termloom.sources.readers import tagged_sentences

    return tagged_sentences(docs)


def _phrases(sentences: DataFrame, s: Settings) -> DataFrame:
    from termloom.operators.text import tagged_phrases

    return tagged_phrases(sentences, s.language, sections=s.sections)


Corpus.STEPS = {"sections": ("documents", _sections), "sentences": ("documents", _tagged), "phrases": ("sentences", _phrases)}


def check_counts(available: DataFrame, processed: DataFrame, limit: int) -> None:
    """A step that is to process so many more files needs them to be there."""
    have, done = available.count(), processed.count()
    if have < done + limit:
        raise ValueError(f"{limit} more files are wanted, but {have - done} are left")


def archive_index(rows: DataFrame) -> DataFrame:
    """archive, n, first and last item of archives by their place; rows (archive, item, place, at). Of items of one place the first by ``at`` counts, at both ends."""
    first = lambda place: F.min_by("item", F.when(place.isNotNull(), F.struct(place, "at")))
    return rows.groupBy("archive").agg(F.count("*").alias("n"), first(F.col("place")).alias("first"), first(-F.col("place")).alias("last"))


def profiled(df: DataFrame) -> dict:
    """Seconds of a full run into no sink, and the formatted plan."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return {"seconds": time.time() - start, "plan": plan}

"""Catalog of data sets: stages with options, versions found by lineage, incremental appends and provenance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    stage: str
    options: tuple[tuple[str, str], ...] = ()

    def __str__(self) -> str:
        return " ".join([self.stage, *(f"{k}={v}" for k, v in self.options)])


def read_pipeline(text: str) -> list[Step]:
    """One step a line: stage, then name=value options; # begins a comment."""
    out = []
    for line in text.splitlines():
        words = line.partition("#")[0].split()
        if words:
            out.append(Step(words[0], tuple(tuple(w.split("=", 1)) for w in words[1:] if "=" in w)))
    return out


@dataclass
class DataSet:
    stage: str
    version: int
    lineage: list[Step]
    processed: int = 0
    history: list[str] = field(default_factory=list)


@dataclass
class Catalog:
    """The data sets of a corpus. An input is the one whose lineage is the beginning of the wanted pipeline; an output is found or made."""

    sets: list[DataSet] = field(default_factory=list)

    def find(self, stage: str, pipeline: list[Step]) -> DataSet | None:
        found = [d for d in self.sets if d.stage == stage and d.lineage == pipeline[: len(d.lineage)]]
        if len(found) > 1:
            raise ValueError(f"{len(found)} data sets of stage {stage} fit")
        return found[0] if found else None

    def output(self, stage: str, pipeline: list[Step]) -> DataSet:
        at = next(i for i, s in enumerate(pipeline) if s.stage == stage)
        lineage = pipeline[: at + 1]
        same = [d for d in self.sets if d.stage == stage]
        for d in same:
            if d.lineage == lineage:
                return d
        self.sets.append(DataSet(stage, 1 + max([0, *(d.version for d in same)]), lineage))
        return self.sets[-1]

    def record(self, data: DataSet, n: int, note: str = "") -> None:
        data.processed += n
        data.history.append(f"{n} {note}".strip())

    def ready(self, source: DataSet, target: DataSet, limit: int) -> bool:
        """Whether the source has the files that the target's next ``limit`` need."""
        return source.processed >= target.processed + limit


def append_new(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What of ``new`` isn't there yet, one row a key: the rows to append."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def missing_files(listed: DataFrame, present: DataFrame, key: str = "source") -> DataFrame:
    return listed.select(key).join(present.select(key), key, "left_anti")


def view(existing: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """A named subset of a repository by a list of ids."""
    out = existing.join(ids.select(key), key, "left_semi")
    out.createOrReplaceTempView(name)
    return out


def provenance(lines: DataFrame) -> DataFrame:
    """key, value of ``key = value`` lines (value)."""
    p = F.split("value", r"\s*=\s*", 2)
    return lines.where(F.col("value").contains("=")).select(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value"))

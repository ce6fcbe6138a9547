"""The test tables in the terms of the domain: orders are documents, part names terms, part attributes features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.catalog import table

OCC = """occ as (select l_orderkey as doc, cast(year(l_shipdate) as integer) as year, p_name as term, 'type=' || replace(p_type, ' ', '_') as feature,
  p_brand as brand, l_linestatus as section, l_linenumber as loc, l_discount * 10 as score, l_returnflag as flag, l_partkey as part
  from lineitem join part on l_partkey = p_partkey)"""
COUNTS = OCC + ", counts as (select term, year, count(distinct doc) as n from occ group by all)"
SIZES = "sizes as (select year, count(distinct doc) as n_docs from occ group by all)"


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the place ``at`` of each row in it: file, and row of the file."""
    t = table(spark, sf_dir, name)
    return t.select(*t.columns, F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))


def occurrences(spark: SparkSession, sf_dir: str, at: bool = False) -> DataFrame:
    """Line items with their parts; ``at``: with the line item's place in its table."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    line = (placed if at else table)(spark, sf_dir, "lineitem").select(*["at"] * at, "l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_linestatus", "l_returnflag", "l_shipdate")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("doc"),
        F.year("l_shipdate").alias("year"),
        F.col("p_name").alias("term"),
        F.concat(F.lit("type="), F.regexp_replace("p_type", " ", "_")).alias("feature"),
        F.col("p_brand").alias("brand"),
        F.col("l_linestatus").alias("section"),
        F.col("l_linenumber").alias("loc"),
        (F.col("l_discount") * 10).alias("score"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_partkey").alias("part"),
        *["at"] * at,
    )


def yearly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(spark, sf_dir).groupBy("term", "year").agg(F.countDistinct("doc").alias("n"))


def year_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(spark, sf_dir).groupBy("year").agg(F.countDistinct("doc").alias("n_docs"))

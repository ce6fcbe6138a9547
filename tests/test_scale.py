"""Steps whose cost or result changes with the size of the tables."""

import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from termloom import catalog
from termloom.functions import forms
from termloom.operators import search


def test_offsets_of_long_texts_take_one_search(spark):
    long = "ü" * 400_000 + "thth" + "é" * 400_000
    rows = spark.createDataFrame([(1, long), (2, "aaa"), (3, None), (4, ""), (5, "ththx th")], "k int, text string")
    start = time.time()
    got = {r.k: list(r.at) for r in rows.select("k", forms.offsets_of(F.col("text"), "th").alias("at")).collect()}
    assert got == {1: [400_000, 400_002], 2: [], 3: [], 4: [], 5: [0, 2, 6]} and time.time() - start < 30
    twice = rows.where("k = 2").select(forms.offsets_of(F.col("text"), "aa").alias("at")).first()
    assert list(twice["at"]) == [0, 1]


def test_seven_digits_hold_no_year(spark):
    rows = spark.createDataFrame([("1900012",), ("2099999",), ("201900012",), ("20050123456",), ("0012345",), ("PP0012345",)], "n string")
    assert [r.p for r in rows.select(forms.patent_path(F.col("n")).alias("p")).collect()] == ["19/000", "20/999", "2019/000", "2005/01234", "00/123", "PP/00123"]


def _star(spark, path, lines, parts):
    """Line items (order, part, line, discount, flag, year) in their order, one file, and parts (key, name); the rest of the columns is made up."""
    line = pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_returnflag", "year"]).assign(l_suppkey=0, l_linestatus="F")
    line["l_shipdate"] = pd.to_datetime(line.pop("year").astype(str) + "-06-01").astype("datetime64[us]")
    line.astype({"l_linenumber": "int32"}).to_parquet(f"{path}/lineitem.parquet", row_group_size=2000)
    pd.DataFrame(parts, columns=["p_partkey", "p_name"]).assign(p_brand="Brand#1", p_type="SMALL").to_parquet(f"{path}/part.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return lambda name: (sorted(map(tuple, catalog.queries()[name](spark, str(path)).collect())), sorted(con.execute(catalog.oracle_sql()[name]).fetchall()))


def test_parts_from_a_million_on_reach_into_the_next_line(spark, tmp_path):
    both = _star(spark, tmp_path, [(1, 1_500_001, 1, 0.1, "A", 1996), (1, 400_000, 2, 0.1, "N", 1996)], [(1_500_001, "red bolt"), (400_000, "red bolt")])
    got, want = both("adjusted_evaluation")
    assert got == want == [("A", "t", 1)]


def test_items_of_one_place_go_by_their_order_in_the_table(spark, tmp_path):
    one, two = (1, 1_300_000, 1, 0.0, "A", 1996), (1, 300_000, 2, 0.0, "A", 1996)
    both = _star(spark, tmp_path, [one, two, *[(2, *x[1:]) for x in (two, one)]], [(0, "red bolt")])
    got, want = both("archive_index")
    assert got == want == [(1, 2, 1_300_000, 1_300_000), (2, 2, 300_000, 300_000)]


def _spread(spark, path):
    """Line items of 400 parts in several row groups, where means of parts (and of documents) lie on the limits of queries but for their last digits."""
    r, lines = random.Random(5), []
    for p in range(400):
        half = [r.randrange(11) for _ in range(12)]
        tenths = [*half, *[10 - x for x in half]] if p % 2 else [1, 2, 3] * 4 + [5, 7] * 6
        years = [1998] * 24 if p % 2 else [1996] * 12 + [2000] * 12
        lines += [(r.randrange(2000), p, 1, t / 100, "A", y) for t, y in zip(tenths, years)]
    r.shuffle(lines)
    return _star(spark, path, lines, [(p, "red bolt") for p in range(400)])


@pytest.mark.parametrize("name", ["cat_filter", "dense_usage_distribution", "score_histogram", "trend_predicate"])
def test_means_do_not_depend_on_partitions(spark, tmp_path, name):
    """The SQL on one thread sums in the table's order; so does the query, however many tasks read the table."""
    both = _spread(spark, tmp_path)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        got, want = both(name)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == want and want


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_of_a_term_need_no_sub_phrases(spark, sf):
    assert "Generate" not in _plan(catalog.queries()["documents_of_term_year"](spark, sf))


def test_ways_to_the_root_are_found_once_a_row(spark, sf):
    assert _plan(catalog.queries()["dependency_paths"](spark, sf)).count("aggregate(") == 2


def test_edges_of_four_runs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    edges = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0)], "a string, b string, w double").mapInPandas(count, "a string, b string, w double")
    seed = lambda x: spark.createDataFrame([(x,)], "node string")
    assert search.personalised_ranks(edges, seed("a"), seed("b"), 1).count() == 3 and made.value == 2


def test_document_frequencies_need_no_second_pass(spark, sf):
    plan = _plan(catalog.queries()["cooccurrence_tfidf"](spark, sf))
    assert plan.count("Generate explode") == 1 and plan.count("Join") == 1  # with the number of documents

import gzip

from pyspark.sql import functions as F

from termloom.sources import readers as R
from termloom.streaming import incremental as I


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(text)
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def test_file_list(spark, tmp_path):
    p = write(tmp_path / "l.txt", "# comment\n1997\ta/b.xml\t/1997/b.xml\n\n1998\tc.xml\nonly.xml\n")
    assert sorted((tuple(r) for r in R.file_list(spark, p).collect()), key=str) == sorted([("1997", "a/b.xml", "1997/b.xml"), ("1998", "c.xml", None), (None, "only.xml", None)], key=str)


def test_feature_rows_round_trip(spark, tmp_path):
    p = write(tmp_path / "f.gz", "US1_12\t1997\tdata base\tprev_V=use=x\tlast_word=base\tjunk\n")
    rows = R.feature_rows(spark, p)
    r = rows.first()
    assert (r.doc_id, r.year, r.term, r.feats) == ("US1", 1997, "data base", {"prev_V": "use=x", "last_word": "base"})
    R.write_feature_rows(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "US1_12\t1997\tdata base\tlast_word=base\tprev_V=use=x"


def test_sections_and_tagged_sentences(spark, tmp_path):
    write(tmp_path / "d/1997/US9.tag", "FH_TITLE:\na_DT b_c_NN\nFH_ABSTRACT:\nd_NN\ne_VB f_NN\nEND\n")
    docs = R.documents(spark, str(tmp_path / "d"))
    s = R.sections(docs).orderBy("ord").collect()
    assert [(x.doc, x.year, x.section, x.text) for x in s] == [("US9", 1997, "TITLE", "a_DT b_c_NN"), ("US9", 1997, "ABSTRACT", "d_NN\ne_VB f_NN")]
    t = R.tagged_sentences(docs).orderBy("sent_no").collect()
    assert [(x.section, x.sent_no, x.sent_in_section) for x in t] == [("TITLE", 0, 0), ("ABSTRACT", 1, 0), ("ABSTRACT", 2, 1)]
    assert tuple(t[0].tokens[1]) == ("b_c", "NN")
    R.write_sections(R.sections(docs), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).first().text == "FH_TITLE:\na_DT b_c_NN\nFH_ABSTRACT:\nd_NN\ne_VB f_NN\nEND"


def test_labels_annotations_tree(spark, tmp_path):
    p = write(tmp_path / "a.lab", "# head\ny\tdata base\nn\tdata base\n?\tx\nn\tfoo\n")
    assert {r.term: r.label for r in R.labels(spark, p).collect()} == {"data base": "y", "foo": "n"}
    p = write(tmp_path / "x.fact", 'STRUCTURE TYPE="TITLE" START=0 END=10\nSTRUCTURE TYPE="TEXT" START=20 END=90\nSTRUCTURE TYPE="P" START=30 END=40\nbad line\n')
    a = R.annotations(spark, p).where("type is not null")
    assert sorted(tuple(r)[1:] for r in a.collect()) == [("STRUCTURE", "P", 30, 40), ("STRUCTURE", "TEXT", 20, 90), ("STRUCTURE", "TITLE", 0, 10)]
    tree = {(r.start, r.end): (r.parent_start, r.parent_end) for r in R.section_tree(a).collect()}
    assert tree == {(0, 10): (None, None), (20, 90): (None, None), (30, 40): (20, 90)}


def test_xml_sources(spark, tmp_path):
    p = write(tmp_path / "w.xml.gz", '<REC><pub_info pubyear="2003"/><title type="item">Big<i>data</i></title><subject>Physics</subject><subject>Optics</subject><abstract>An abs</abstract></REC>\n<REC><item_title>T2</item_title><bib_date>1999 MAY</bib_date></REC>\n')
    w = R.web_of_science(spark, p).orderBy("year").collect()
    assert [(x.year, x.title.replace(" ", ""), x.abstract, x.subjects) for x in w] == [(1999, "T2", None, []), (2003, "Big<i>data</i>", "An abs", ["Physics", "Optics"])]
    domains = spark.createDataFrame([("phys", "Physics", 1), ("opt", "Optics", 0)], "domain string, subject string, ord int")
    assert [r.domain for r in R.route_by_subject(R.web_of_science(spark, p), domains).collect()] == ["opt"]
    c = R.cnki(spark, write(tmp_path / "ab2001x.xml", "<title>题目</title><abstract>摘要</abstract>")).first()
    assert (c.year, c.title, c.abstract, c.body) == (2001, "题目", "摘要", None)
    m = R.pubmed(spark, write(tmp_path / "p.nxml", "<article><article-title>A <i>b</i></article-title><pub-date><year>2005</year></pub-date><pub-date a='x'><year>2004</year></pub-date><abstract><p>One</p><p>Two</p></abstract></article>")).first()
    assert (m.title, m.year, m.abstract, m.body) == ("A b", 2004, "One Two", None)


def test_technologies(spark, tmp_path):
    a, b = write(tmp_path / "y.tab", "data base\t1997 2001\n"), write(tmp_path / "i.tab", "data base\tt1\nother\tt2\n")
    assert [tuple(r) for r in R.technologies(spark, a, b).collect()] == [("data base", 1997, 2001, "t1")]


def test_streams(spark, tmp_path):
    rows = spark.range(1000).select(F.lit(2000).cast("int").alias("year"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("term"), (F.col("id") % 11 / 10).alias("score"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    I.bins_sink(stream, f"{tmp_path}/bins", f"{tmp_path}/ck").awaitTermination()
    got = {r.term: r for r in I.merged_bins(spark, f"{tmp_path}/bins").collect()}
    want = {r.term: r for r in rows.groupBy("term").agg(F.avg("score").alias("s"), F.count("*").alias("n")).collect()}
    assert all(abs(got[t].score - want[t].s) < 1e-9 and got[t].doc_count == want[t].n for t in want)
    events = spark.createDataFrame([("2024-01-01 00:05:00", "a", 1), ("2024-01-01 00:50:00", "a", 1), ("2024-01-01 01:05:00", "b", 1)], "ts string, event_type string, user_id long").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.event_type, r.n) for r in I.windowed_counts(events).collect()) == [("a", 2), ("b", 1)]
    assert sorted(r.n for r in I.sessions(events).collect()) == [1, 2]


def test_sections_of_any_number(spark):
    from termloom.sources import readers

    text = "".join(f"FH_S{k}:\nline {k}\n" for k in range(1500)) + "END\n"
    docs = spark.createDataFrame([("d", 2000, text), ("none", 2000, ""), ("null", 2000, None)], "doc string, year int, text string")
    rows = readers.sections(docs).orderBy("ord").collect()
    assert [(r.doc, r.section, r.ord, r.text) for r in rows] == [("d", f"S{k}", k, f"line {k}") for k in range(1500)]

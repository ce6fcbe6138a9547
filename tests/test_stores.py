"""Repository, ingest, corpus steps, exports and readers of concept files."""

import gzip

import pytest
from pyspark.sql import functions as F

from termloom.plans.corpus import Corpus, Settings, check_counts, profiled
from termloom.sources import reports as H
from termloom.sources import repository as R


def test_repository(spark, tmp_path):
    src = tmp_path / "src" / "1999"
    src.mkdir(parents=True)
    (src / "US12345B2.xml").write_text("<a/>")
    with gzip.open(src / "US20010001234A1.xml.gz", "wt") as f:
        f.write("<b/>")
    repo = R.Repository(spark, f"{tmp_path}/repo").create()
    docs = R.patent_documents(spark, f"{tmp_path}/src")
    assert repo.add(docs) == 2 and repo.add(docs) == 0
    rows = {r.id: (r.path, r.year) for r in repo.documents().collect()}
    assert rows == {"12345": ("12/3/US12345B2.xml", 1999), "20010001234": ("2001/00012/US20010001234A1.xml", 1999)}
    ids = spark.createDataFrame([("12345",), ("9",)], "id string")
    assert {r.id: r.path for r in repo.paths(ids).collect()} == {"12345": "12/3/US12345B2.xml", "9": None}
    repo.processed(spark.createDataFrame([("12345", "txt/1")], "id string, path string"), "txt")
    assert {r.id: r.path for r in repo.paths(ids, "txt").collect()} == {"12345": "txt/1", "9": None}


def test_ingest_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / "in" / f"{n}.xml").write_text(n)
    files = lambda names: spark.createDataFrame([(f"{tmp_path}/in/{n}.xml", 2000) for n in names], "source string, year int")
    copied, missing = R.ingest(spark, files("ab"), f"{tmp_path}/out", f"{tmp_path}/done")
    assert (copied.count(), missing.count()) == (2, 0)
    (tmp_path / "in" / "c.xml").write_text("c")
    _, missing = R.ingest(spark, files("abcd"), f"{tmp_path}/out", f"{tmp_path}/done")
    assert [r.source[-5:] for r in missing.collect()] == ["d.xml"] and spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_term_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1999, "d", "pump"), (2000, "e", "gear")], "year int, doc string, term string")
    R.load_terms(rows, f"{tmp_path}/t")
    R.load_terms(rows, f"{tmp_path}/t", 2000)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    R.export_terms(rows, f"{tmp_path}/csv", 1999)
    assert [r.value for r in spark.read.text(f"{tmp_path}/csv").collect()] == ["1999\td\tpump"]
    R.copy_years(rows, f"{tmp_path}/tree", "en", [1999])
    assert (tmp_path / "tree" / "language=en" / "year=1999").is_dir()


def test_patents_and_kinds(spark, tmp_path):
    (tmp_path / "p.xml").write_text("<p><invention-title>A pump</invention-title><abstract><p>Moves\x0b water.</p></abstract><claims><claim num='1'>One</claim><claim num='2'>Two</claim></claims></p>")
    row = R.by_kind(spark, "ln", f"{tmp_path}/p.xml").first()
    assert (row.title, row.abstract, row.description, row.claims) == ("A pump", "Moves water.", None, ["One", "Two"])
    with pytest.raises(ValueError):
        R.by_kind(spark, "none", str(tmp_path))


def test_concepts_and_relations(spark, tmp_path):
    (tmp_path / "n1.con").write_text('c="chest pain" 3:1 3:2||t="problem"\nnonsense\n')
    (tmp_path / "n1.rel").write_text('c="aspirin" 3:0 3:0||r="TrAP"||c="chest pain" 3:1 3:2\n')
    assert tuple(R.concept_files(spark, f"{tmp_path}/*.con").first()) == ("n1", 3, 1, 2, "chest pain", "problem")
    assert tuple(R.relation_files(spark, f"{tmp_path}/*.rel").first()) == ("n1", 3, 0, 1, "TrAP")


def test_corpus(spark, tmp_path):
    s = Settings.parse(["language = en", "first_year = 1990  # from here", "sections = TITLE", "taste = odd", ""])
    assert (s.first_year, s.sections, s.extra) == (1990, ("TITLE",), {"taste": "odd"})
    text = "FH_TITLE:\nThe_DT fast_JJ pump_NN is_VBZ here_RB\nFH_ABSTRACT:\nA_DT gear_NN turns_VBZ\nEND"
    docs = spark.createDataFrame([("d1", 1999, text), ("d2", 1980, text)], "doc string, year int, text string")
    c = Corpus(spark, f"{tmp_path}/c", s)
    c.populate(docs)
    rows = c.run("phrases").collect()
    assert [(r.chunk_id, r.term, r.feats["section_loc"]) for r in rows] == [("d1_0_0", "fast pump", "TITLE_sent1")]
    assert c.datasets() == ["documents", "sentences", "phrases"] and c.run("phrases").count() == 1
    assert {r.step: r.n for r in c.processing_time().collect()} == {"documents": 1, "sentences": 2, "phrases": 1}
    check_counts(docs, docs.limit(1), 1)
    with pytest.raises(ValueError):
        check_counts(docs, docs, 1)
    assert "Scan" in profiled(c.table("documents"))["plan"]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a<b", 1), (None, 2)], "t string, n int")
    H.write_html(rows, ["t", "n"], f"{tmp_path}/h")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/h").collect()) == ["<tr><td></td><td>2</td></tr>", "<tr><td>a&lt;b</td><td>1</td></tr>"]
    assert "<title>T</title>" in H.html_document("T", ["x"], "p{}")
    assert r"\addplot coordinates {(0.10,0.20)};" in H.latex_plot({"c": ["(0.10,0.20)"]}, ("p", "r"))


def test_index_tables(spark, tmp_path):
    from termloom.operators import search as S

    occ = spark.createDataFrame([("d", 1999, "fast pumps", "T", 1, "s"), ("d", 1999, "gear", "T", 2, "s"), ("e", 2000, "gear", "A", 1, "s")], "doc string, year int, term string, section string, loc int, sent string")
    S.write_index(S.phrase_rows(occ), f"{tmp_path}/i")
    np, sent, doc = S.read_index(spark, f"{tmp_path}/i")
    assert {r.canonical for r in np.collect()} == {"fast pump", "gear"} and sent.where("doc = 'd'").first().sheads == ["pumps", "gear"] and doc.count() == 2
    S.write_index(S.phrase_rows(occ, ("A",)), f"{tmp_path}/i", new=False)
    assert S.read_index(spark, f"{tmp_path}/i")[0].count() == 4
    S.write_index(S.phrase_rows(occ, years=(2000, 2000)), f"{tmp_path}/i")
    assert S.read_index(spark, f"{tmp_path}/i")[0].count() == 1


def test_model_weights(spark):
    from types import SimpleNamespace

    from termloom.operators.labelling import model_weights

    assert model_weights(SimpleNamespace(coefficients=[0.1, 2.0, -1.0]), ["a", "b", "c"]) == [("b", 2.0), ("a", 0.1), ("c", -1.0)]


def test_shared_folder_has_to_be_named_on_a_cluster(spark, monkeypatch):
    from termloom.plans import shared

    fake = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})(), "sparkContext": type("X", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://h:7077"})()})()
    with pytest.raises(ValueError):
        shared.shared_dir(fake)

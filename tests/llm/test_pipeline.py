import hashlib

import corpus_pipeline
from test_near_dedup import brute
from termloom.llm import bpe, decontaminate, secrets_scan, toxicity
from tokenizers import Tokenizer


def test_stages_against_brute_force(spark, sf):
    """Each stage is followed by its plain counterpart on the stage's own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    names = docs.columns
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        after.append(docs)
    assert all(d.columns == names for d in after[:-1])
    start = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.query(spark, sf).collect()}
    kept = [{r.doc_id: r for r in d.collect()} for d in after]
    assert kept[0].keys() == {d for d, p in scores.items() if p == 0} and start.count() == len(scores)
    components = brute([(d, r.text) for d, r in kept[0].items()], 80)
    assert kept[1].keys() == {d for d, _, _, keep in components if keep}
    found = decontaminate.decontaminate(after[1], spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert kept[2].keys() == {r.doc_id for r in found.collect() if not r.contaminated}
    net = secrets_scan.default_network()
    import pyarrow as pa

    for d, r in kept[2].items():
        text = secrets_scan.redact(r.text, secrets_scan.scan(pa.array([r.text]), net)[0])
        assert kept[3][d].text == text and kept[3].keys() == kept[2].keys()
        assert kept[3][d].n_chars == (len(text) if text != r.text else r.n_chars)
    library = Tokenizer.from_file(bpe.production_path())
    for d, r in list(kept[3].items())[:40]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert kept[4][d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert kept[4][d].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None, "q"), (2, "", "en", "s", 0, "q"), (None, "some text", "en", "s", 9, "q"), (3, "w " * 50_000, "en", "s", 100_000, "q"), (3, "w " * 50_000, "en", "s", 100_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa

from termloom.llm import substring_dedup as S


def brute(docs, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def got(spark, docs, k, m):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in S.remove_repeats(df, k, m).collect()), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß", "x"]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randrange(30, 90))] for _ in range(6)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            if rnd.random() < 0.4:
                p = list(rnd.choice(passages))
                if rnd.random() < 0.5:
                    p[rnd.randrange(len(p))] = "changed"
                a = rnd.randrange(20)
                parts += p[a : len(p) - rnd.randrange(20)]
            else:
                parts += [rnd.choice(vocab) for _ in range(rnd.randrange(50))]
        docs.append((d, rnd.choice([" ", "\n", " \t"]).join(parts)))
    docs += [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "a " * 200), (105, "a b " * 90), docs[3], (None, docs[4][1])]
    assert got(spark, docs, 35, 16) == brute(docs, 35)
    assert got(spark, docs, 6, 3) == brute(docs, 6)


def test_many_copies_and_shifts(spark):
    rnd = random.Random(4)
    text = " ".join(f"t{rnd.randrange(50)}" for _ in range(400))
    docs = [(i, text[i * 3 :]) for i in range(12)]
    assert got(spark, docs, 12, 5) == brute(docs, 12)


def test_small_slices_and_flushes(monkeypatch):
    """What tasks pass on sums up to the same, however small their slices and flushes are."""
    rnd = random.Random(7)
    texts = [" ".join(f"t{rnd.randrange(9)}" for _ in range(rnd.randrange(90))) for _ in range(50)] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]

    def sums():
        out = Counter()
        for b in S._count_paths(12, 5)(iter(batches)):
            for k, c, n in zip(*(b.column(x).to_pylist() for x in ("key", "content", "n"))):
                out[k, c] += n
        return out

    whole = sums()
    monkeypatch.setattr(S, "FLUSH", 20)
    monkeypatch.setattr(S.V.text_slices, "__defaults__", ("text", 300))
    assert sums() == whole and sum(whole.values()) > len(whole)


def test_compaction(spark, monkeypatch):
    """An unbranched repeat is one span; a branch begins another; without compaction every path is a span of its own."""
    rnd = random.Random(8)
    new = lambda n: [f"u{rnd.randrange(10**9)}" for _ in range(n)]
    long, tail = new(400), new(100)
    docs = [new(20) + long + tail + new(30), new(7) + long + tail + new(5), new(11) + long + new(60)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")

    def spans(d):
        p = S.Paths(pa.array([" ".join(docs[d])]), 35, 16)
        start, end, *_ = S.spans_of(p, known)
        return sorted(zip(start.tolist(), end.tolist()))

    known = S.find_repeats(df)
    assert len(spans(2)) == 1 and len(spans(0)) == len(spans(1)) == 2
    (a, b), (c, d) = spans(0)
    assert 20 <= a <= 20 + 20 and b - c == 34 and 520 - 20 <= d <= 520
    compacted = len(known.spans)
    monkeypatch.setattr(S, "compact", lambda links, paths: links.limit(0).selectExpr("b as path"))
    known = S.find_repeats(df)
    assert len(known.spans) > 5 * compacted


def test_very_long_text_and_other_columns(spark):
    rnd = random.Random(9)
    text = " ".join(f"v{rnd.randrange(10**6)}" for _ in range(40_000))
    part = " ".join(text.split()[9_000:12_000])
    docs = [(1, text), (2, f"x y {part} z")]
    df = spark.createDataFrame([(d, t, "k", 5) for d, t in docs], "doc_id long, text string, content string, n long")
    rows = sorted(tuple(r) for r in S.remove_repeats(df).collect())
    assert rows == brute(docs, 35) and rows[0][2] == 3_000


def test_empty(spark):
    assert got(spark, [], 35, 16) == []


def test_query_hashes_kept_text(spark, sf):
    row = S.query(spark, sf).orderBy("doc_id").first()
    assert len(row.kept_sha256) == 64 and row.n_removed <= row.n_words
    text = S.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).orderBy("doc_id").first().text
    assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()

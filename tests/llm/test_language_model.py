import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from termloom.llm import language_model as L


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Brute:
    """The same model with dictionaries."""

    def __init__(self, texts, order, least):
        grams = [Counter() for _ in range(order)]
        for t in map(tokens, texts):
            seq = [None, *t]
            grams[0].update((w,) for w in t)
            for k in range(2, order + 1):
                for i in range(len(seq) - k + 1):
                    g = tuple(seq[i : i + k])
                    grams[k - 1][g] += 1
        self.kept, self.d = [], []
        for k, c in enumerate(grams):
            if k:
                c = Counter({g: n for g, n in c.items() if g[:-1] in self.kept[k - 1] and g[1:] in self.kept[k - 1]})
            ones, twos = (sum(1 for n in c.values() if n == j) for j in (1, 2))
            self.d.append(ones / (ones + 2 * twos) if ones else 0.0)
            self.kept.append({g: n for g, n in c.items() if n >= (least if k else 1)})
        self.n, self.v = sum(grams[0].values()), len(grams[0])
        self.under = defaultdict(lambda: [0, 0])
        for c in self.kept[1:]:
            for g, n in c.items():
                self.under[g[:-1]][0] += n
                self.under[g[:-1]][1] += 1

    def p(self, h, w):
        if not h:
            if (w,) in self.kept[0]:
                return (self.kept[0][w,] - self.d[0]) / self.n
            return self.d[0] * self.v / self.n
        k = len(h)
        if h not in self.kept[k - 1]:
            return self.p(h[1:], w)
        seen, (n, kinds) = self.kept[k - 1][h], self.under[h]
        back = max(1e-12, 1 - (n - self.d[k] * kinds) / seen) if kinds else 1.0
        got = self.kept[k].get((*h, w))
        return ((got - self.d[k]) / seen if got else 0) + back * self.p(h[1:], w)

    def score(self, text, order):
        seq, total = [None, *tokens(text)], 0.0
        for i in range(1, len(seq)):
            total += math.log10(self.p(tuple(seq[max(0, i - order + 1) : i]), seq[i]))
        return total


@pytest.mark.parametrize("order,least", [(2, 2), (3, 2), (4, 2), (2, 1), (3, 1), (4, 1)])
def test_against_dictionaries(spark, order, least):
    rnd = random.Random(order)
    texts = [" ".join(rnd.choice("a b c d É the The x1 x2 x3".split() + [f"r{rnd.randrange(200)}"]) for _ in range(rnd.randrange(40))) for _ in range(60)]
    texts += [None, "", " \n", texts[3], "a b " * 300]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = L.train(train, order, least)
    own = Brute(texts, order, least)
    assert (model.tokens, model.types) == (own.n, own.v)
    asked = [*texts[:20], "zzz yyy a b c", None, "a b c d zzz a b"]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.score(docs, model).collect()}
    for i, t in enumerate(asked):
        assert got[i].n_tokens == len(tokens(t))
        assert got[i].score == pytest.approx(own.score(t, order), rel=1e-9)
        c = [own.kept[0].get((w,), 0) for w in tokens(t)]
        assert got[i].n_known == sum(x > 0 for x in c)
        assert got[i].base_score == pytest.approx(sum(math.log10((x + 0.1) / (own.n + 0.1 * (own.v + 1))) for x in c))
    # all next tokens of a context, the unseen one included, sum to one
    for h in [(), (None,), ("a",), ("a", "b"), ("zzz",)]:
        if len(h) < order:
            assert sum(own.p(h, w) for (w,) in own.kept[0]) + own.p(h, "never seen") == pytest.approx(1)


def test_no_training_rows(spark):
    model = L.train(spark.createDataFrame([], "text string"))
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in L.score(docs, model).collect()), key=str)
    assert [r[1:4] for r in rows] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert L.score(docs.limit(0), model).collect() == []


def test_query(spark, sf):
    rows = L.query(spark, sf).toPandas()
    assert rows.held_out.any() and (~rows.held_out).any()
    own = rows[rows.held_out]
    assert own.score.sum() > own.base_score.sum() and np.isfinite(rows.score).all()


def test_query_keeps_ngrams_seen_once(spark, tmp_path):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice([f"w{rnd.randrange(12)}", f"r{rnd.randrange(200)}"]) for _ in range(rnd.randrange(1, 30))) for _ in range(80)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.query(spark, str(tmp_path)).collect()
    own = Brute([texts[r.doc_id] for r in got if not r.held_out], 3, 1)
    assert len(got) == len(texts) and any(r.held_out for r in got)
    for r in got:
        assert r.score == pytest.approx(own.score(texts[r.doc_id], 3), rel=1e-9)


def test_small_buckets_flushes_and_stretches(spark, monkeypatch):
    """Hot words in several parts, many buckets, and long texts in stretches give the same scores."""
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["the", "the", f"w{rnd.randrange(30)}", f"r{rnd.randrange(300)}"]) for _ in range(rnd.randrange(1, 400))) for _ in range(40)]
    own = Brute(texts, 3, 1)
    monkeypatch.setattr(L, "BUCKET_TOKENS", 300)
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    model = L.train(train, 3)
    assert model.levels[0].layout.parts.max() > 1 and len(model.levels[0].layout) > 10
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, held_out string, score double")
    for r in L.score(docs, model).collect():
        assert r.score == pytest.approx(own.score(texts[r.doc_id], 3), rel=1e-9)
    import pyarrow as pa

    part = L.fetch(pa.array(texts + ["never seen the w1 the", None]), model)
    for stretch in (1, 2, 7):
        assert np.allclose(L.traverse(part, stretch), L.traverse(part))


def test_very_long_text(spark):
    rnd = random.Random(12)
    text = " ".join(rnd.choice(["A", "b", f"x{rnd.randrange(50)}"]) for _ in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.score(docs, L.train(docs)).collect()}
    own = Brute([text, "a b"], 3, 1)
    assert got[1].n_tokens == 60_001 and got[1].score == pytest.approx(own.score(text, 3), rel=1e-9)


def test_files_that_cannot_be_mapped(spark, tmp_path, monkeypatch):
    """Without maps, files are read whole and the last used ones are kept, up to a number of bytes."""
    from termloom.llm import _tables as T

    for i in range(6):
        np.arange(1000, dtype=np.int64).tofile(tmp_path / f"{i}.key")
    monkeypatch.setattr(T, "_local", lambda uri: None)
    monkeypatch.setattr(T, "HELD_BYTES", 20_000)
    files = T.Files(f"file://{tmp_path}")
    for i in [0, 1, 2, 3, 4, 5, 0, 5]:
        assert files.read(f"{i}.key", np.int64)[7] == 7
    assert len(files._held) <= 3 and files._bytes <= 24_000

import math
import random

import pytest
from pyspark.sql import functions as F

from termloom.functions import terms as T
from termloom.operators import classify, graph, sampling, series, stats, text
from termloom.plans import lineage
from termloom.plans.shared import materialize, shared_dir


def test_damped_series_follows_the_previous_output(spark):
    df = spark.createDataFrame([("t", y, v) for y, v in enumerate([1.0, 0.5, 0.2, 2.0, 0.0])], "term string, year int, usage double")
    got = [r.damped for r in series.damped(df).orderBy("year").collect()]
    want, prev = [], None
    for v in [1.0, 0.5, 0.2, 2.0, 0.0]:
        prev = v if prev is None or v >= prev else prev - (prev - v) / 5
        want.append(prev)
    assert got == pytest.approx(want)


def test_usage_rates_are_in_proportion_to_logarithms(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 0)], "term string, year int, n int")
    u = {r.term: r.usage for r in series.usage(df).collect()}
    assert u["c"] == 0 and u["b"] / u["a"] == pytest.approx(math.log2(3))


def test_kl_and_npmi(spark):
    row = spark.range(1).select(T.kl(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25))).alias("kl"), T.npmi(F.lit(10), F.lit(10), F.lit(10), F.lit(10)).alias("n")).first()
    assert row.kl == pytest.approx(0.5 * math.log(2)) and row.n is None


def test_sum_scores_drops_malformed_and_normalises_slashes(spark):
    df = spark.createDataFrame([("a\\/b", 1.0), ("a/b", 3.0), ("a/b", None)], "term string, score double")
    assert [tuple(r) for r in stats.sum_scores(df).collect()] == [("a/b", 2.0, 2, 1.0, 3.0)]


def greedy(tokens, terms, longest):
    hits = [(s, e) for s in range(len(tokens)) for e in range(s + 1, min(len(tokens), s + longest) + 1) if " ".join(tokens[s:e]) in terms]
    kept = []
    for s, e in sorted(hits, key=lambda h: (h[0] - h[1], -h[1])):
        if all(e <= a or b <= s for a, b in kept):
            kept.append((s, e))
    return sorted(kept)


def test_dictionary_lookup_against_brute_force(spark):
    r = random.Random(1)
    docs = [(d, [r.choice("abcde") for _ in range(r.randrange(30))]) for d in range(30)]
    terms = {"a b", "b c d", "c", "d e a b", "e e"}
    df, dic = spark.createDataFrame(docs, "doc long, tokens array<string>"), spark.createDataFrame([(t,) for t in terms], "term string")
    got = {}
    for x in text.dictionary_lookup(df, dic).collect():
        got.setdefault(x.doc, []).append((x.start, x.end))
    assert {d: sorted(v) for d, v in got.items()} == {d: g for d, t in docs if (g := greedy(t, terms, 10))}


def test_chunker_rolls_back_to_the_last_legal_end():
    chart = text.parse_chart("the_DT large_JJ data_NN based_VBN on_IN a_DT new_JJ index_NN")
    assert text.chunk_chart(chart, text.SCHEMAS["en"]) == [(1, 3), (6, 8)]
    open_end = text.parse_chart("a_DT system_NN based_VBN")
    assert text.chunk_chart(open_end, text.SCHEMAS["en"]) == [(1, 3)]
    of = text.parse_chart("the_DT state_NN of_IN the_DT art_NN")
    assert text.chunk_chart(of, text.SCHEMAS["en_w_of"]) == [(1, 2), (4, 5)]


def test_phrase_features():
    chart = text.parse_chart("we_PRP really_RB improve_VB speed_NN of_IN fast_JJ search_NN engines_NNS today_NN")
    f = text.phrase_features(chart, 6, 8)
    assert f["prev_J"] == "fast" and f["prev_Npr"] == "speed_of" and f["prev_VNP"] == "improve_speed_of" and f["last_word"] == "engines" and f["suffix3"] == "nes"
    assert "prev_V" not in f and text.phrase_features(chart, 3, 4)["prev_V"] == "improve"
    assert f["next_n3"] == "today_^_^"


def test_tokenizer_offsets():
    s = "Don't use Fig. 3 (e.g. this), please: it's U.S. data."
    toks = text.tokenize(s)
    assert all(s[a:b] == t for a, b, t in toks)
    words = [t for _, _, t in toks]
    assert words[:2] == ["Do", "n't"] and "Fig." in words and "e.g." in words and "U.S." in words and words[-1] == "." and "'s" in words


def test_page_rank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 1.0)], "a string, b string, w double")
    assert sum(r["rank"] for r in graph.page_rank(edges, rounds=6, every=2).collect()) == pytest.approx(1)
    seeded = {r.node: r["rank"] for r in graph.page_rank(edges, spark.createDataFrame([("y",)], "node string"), rounds=6).collect()}
    assert seeded["y"] > seeded["a"]


def test_kappa_and_undefined_ratios(spark):
    df = spark.createDataFrame([("y", "y")] * 4 + [("n", "n")] * 3 + [("y", "n")] * 3, "a string, b string")
    k = classify.kappa(df).first()
    assert k.agreement == pytest.approx(0.7) and k.kappa == pytest.approx((0.7 - 0.46) / 0.54)
    gold = spark.createDataFrame([(True, 0.2)], "gold boolean, score double")
    assert classify.confusion(gold, [0.5]).first().precision == -1


def test_samples_are_repeatable(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
    one, two = (sorted(tuple(r) for r in sampling.capped_sample(df.repartition(n), ["k"], ["id"], 5).collect()) for n in (1, 7))
    assert one == two and len(one) == 15


def test_lineage():
    pipe = lineage.read_pipeline("# stages\nxml2txt\ntxt2tag tagger=x\ntag2chk rules=en v=2\n")
    assert [str(s) for s in pipe] == ["xml2txt", "txt2tag tagger=x", "tag2chk rules=en v=2"]
    c = lineage.Catalog()
    a = c.output("txt2tag", pipe)
    assert c.output("txt2tag", pipe) is a and c.find("txt2tag", pipe) is a and c.find("xml2txt", pipe) is None
    other = lineage.read_pipeline("xml2txt\ntxt2tag tagger=y\n")
    assert c.output("txt2tag", other).version == 2
    c.record(a, 10)
    assert c.ready(a, c.output("tag2chk", pipe), 10) and not c.ready(a, c.output("tag2chk", pipe), 11)


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(5), "x")
    assert df.count() == 5 and all(shared_dir(spark).split("://")[-1] in f for f in df.inputFiles())


def test_bracketings(spark):
    from termloom.operators import brackets as B

    assert [len(B.trees(n)) for n in range(1, 6)] == [1, 1, 2, 5, 14]
    left = ((0, 1), 2)
    assert B.pairs(left) == [(0, 1), (1, 2)] and B.written(left, ["a", "b", "c"]) == "[[a b] c]"
    counts = spark.createDataFrame([("b", "c", 5)], "modifier string, head string, n long")
    got = B.bracket(spark.createDataFrame([("a b c",), ("x y",)], "term string"), counts)
    assert {r.term: r.tree for r in got.collect()} == {"a b c": "[a [b c]]", "x y": "[x y]"}


def test_bracketings_of_any_length(spark):
    import random

    from termloom.operators import brackets as B

    rnd = random.Random(3)
    for size in (2, 3, 5, 7, 8):
        words = [rnd.choice("abcd") for _ in range(size)]
        n = {f"{x} {y}": rnd.randrange(4) for x in "abcd" for y in "abcd"}
        best = None
        for t in B.trees(size):
            s = 1
            for i, j in B.pairs(t):
                s *= n[f"{words[i]} {words[j]}"] + 1
            if best is None or s > best[1]:
                best = (B.written(t, words), s)
        assert B.best_tree(words, n) == best
    counts = spark.createDataFrame([("a", "b", 5)], "modifier string, head string, n long")
    long = " ".join(f"w{k}" for k in range(30))
    got = {r.term: r for r in B.bracket(spark.createDataFrame([(long,), ("c d e f g h a b",)], "term string"), counts).collect()}
    assert got[long].score == 1.0 and got[long].tree.count("[") == 29 and got["c d e f g h a b"].score == 6.0

"""Chunk rules, features of three languages, taggers, lookups and sentence ends against small examples and brute force."""

import random
import sys

import pytest

from termloom.operators import text as X


def chart(line):
    return X.parse_chart(line)


def phrases(line, rules):
    c = chart(line)
    return [" ".join(t for t, _ in c[a:b]) for a, b in X.chunk_chart(c, X.rule_sets(frozenset({"such"}))[rules])]


def test_rule_sets():
    line = "The_DT such_JJ fast_JJ figure_NN engine_NN of_IN cars_NNS is_VBZ running_VBG programs_NNS ._."
    assert phrases(line, "en") == ["fast figure engine", "cars", "programs"]  # a barred word doesn't begin a phrase, but may go on with one
    assert phrases("the_DT figure_NN shows_VBZ", "en") == []
    assert "engine of cars" in phrases("The_DT engine_NN of_IN cars_NNS is_VBZ", "en_with_of")
    assert phrases("is_VBZ running_VBG programs_NNS here_RB", "en_with_verbs") == ["running programs"]
    assert phrases("die_ART alte_ADJA Pumpe_NN von_APPR Wasser_NN ist_VAFIN", "de") == ["alte Pumpe von Wasser"]
    assert phrases("die_ART Pumpe_NN mit_APPR Wasser_NN ist_VAFIN", "de") == ["Pumpe", "Wasser"]
    assert phrases("新_JJ 系统_NN 的_DEG 方法_NN 是_VC", "cn") == ["新 系统 的 方法"]


def test_rule_files():
    rules = X.parse_rules(["start_pat\tNN - fig", "", "cont_pat\tNN", "cont_pat\tIN + of", "end_pat\tNN"])
    c = chart("fig_NN pump_NN of_IN water_NN at_IN rest_NN ._.")
    assert [(a, b) for a, b in X.chunk_chart(c, rules)] == [(1, 4), (5, 6)]
    with pytest.raises(ValueError):
        X.parse_rules(["middle_pat\tNN"])


def test_german_features():
    c = chart("Dann_ADV zeigt_VVFIN er_PPER die_ART alte_ADJA Pumpe_NN von_APPR Wasser_NN in_IN Ruhe_NN")
    f = X.german_features(c, 4, 8)
    assert (f["prev_V"], f["chunk_lead_J"], f["initial_J"], f["von_head"], f["following_prep"], f["last_word"]) == ("zeigt", "alte", "alte", "pumpe", "in", "wasser")
    f = X.german_features(chart("es_PPER war_VAINF die_ART Kraft_NN der_ART alten_ADJA Pumpe_NN"), 6, 7)
    assert (f["prev_N"], f["prev_J"]) == ("kraft", "alten") and "prev_V" not in f


def test_chinese_features():
    c = chart("本_DT 使用_VV 三_CD 种_M 新_JJ 快_VA 系统_NN")
    f = X.chinese_features(c, 4, 7)
    assert (f["prev_V"], f["first_Adj"], f["prev_J"], f["prev_CD_M"]) == ("使用", "新", "快", "种_三")


def test_heads():
    c = chart("pump_NN of_IN cold_JJ water_NN")
    assert (X.head_index(c, 0, 4), X.prepositional_head(c, 0, 4), X.head_index(c, 2, 4), X.prepositional_head(c, 2, 4)) == (0, 3, 3, -1)


def test_sentence_ends():
    t = "He said ( no . ) Then fig. The end . And more".split()
    assert X.sentence_ends(t, frozenset({"The"})) == [(0, 6), (6, 8), (8, 11)]


def test_external_tagger():
    tag = X.external_tagger([sys.executable, "-u", "-c", "import sys\nfor l in sys.stdin: print(' '.join(w + '_NN' for w in l.split()), flush=True)"])
    assert tag("a b\nc") == "a_NN b_NN c_NN" and tag("d") == "d_NN"


def test_dictionary_lookup_against_brute_force(spark):
    r = random.Random(3)
    words = "a b c d e".split()
    terms = {" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(25)}
    docs = [(i, [r.choice(words) for _ in range(r.randrange(0, 40))]) for i in range(30)]
    want = []
    for doc, toks in docs:
        hits = sorted((-(e - s), -e, s, e, " ".join(toks[s:e])) for s in range(len(toks)) for e in range(s + 1, min(len(toks), s + 4) + 1) if " ".join(toks[s:e]) in terms)
        kept = []
        for _, _, s, e, t in hits:
            if all(e <= a or b <= s for a, b, _ in kept):
                kept.append((s, e, t))
        want += [(doc, s, e, t) for s, e, t in kept]
    df = spark.createDataFrame(docs, "doc long, tokens array<string>")
    got = X.dictionary_lookup(df, spark.createDataFrame([(t,) for t in sorted(terms)], "term string"), 4)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_trie_lookup(spark):
    df = spark.createDataFrame([(1, "fast pump, fast pumps; a fast pump"), (2, None), (3, "超快系统方法")], "doc long, text string")
    got = {tuple(r) for r in X.trie_lookup(df, ["fast", "fast pump", "系统"]).collect()}
    assert got == {(1, "fast pump", 2), (1, "fast", 1)}
    assert {tuple(r) for r in X.trie_lookup(df, ["系统", "系统方法"], boundaries=False).collect()} == {(3, "系统方法", 1)}


def test_chinese_pieces_and_parens(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("甲乙\n丙。丁　戊。" + "长" * 600 + "。",)], "t string")
    row = df.select(X.chinese_pieces(F.col("t")).alias("p"), X.fixed_parens(F.lit("(_NN a_NN ）_VV")).alias("q")).first()
    assert row.p == ["甲乙丙。", "丁戊。"] and row.q == "(_PU a_NN ）_PU"


def test_category_ties(spark):
    from termloom.operators.stats import category_argmax

    c = spark.createDataFrame([("t", "a", 3), ("t", "b", 3), ("t", "c", 1)], "k string, c string, n long")
    assert category_argmax(c, "k", "c", "n", False).first().c == "a" and category_argmax(c, "k", "c", "n", True).first().c == "b"


def test_numbered(spark):
    from termloom.operators.stats import numbered

    rows = [(g, i) for g in ("x", "y", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(5)
    assert all(r.n == r.i + 1 for r in numbered(df, ["g"], ["i"], "n").collect())

import itertools
import random

import numpy as np
import pyarrow as pa

from termloom.llm import toxicity as X


def brute_segments(x):
    """Ruzzo and Tompa by definition: take the best segment, then work on both sides."""
    best = None
    for a, b in itertools.combinations(range(len(x) + 1), 2):
        s = sum(x[a:b])
        if s > 1e-12 and (best is None or s > best[2] + 1e-12 or (abs(s - best[2]) <= 1e-12 and b - a < best[1] - best[0])):
            best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return brute_segments(x[:a]) + [(a, b, round(s, 9))] + [(p + b, q + b, t) for p, q, t in brute_segments(x[b:])]


def test_segments():
    r = random.Random(1)
    for _ in range(200):
        n = r.randrange(1, 14)
        x = [r.choice([-0.5, -0.5, 1.1, 2.3, 0.7]) for _ in range(n)]
        at = np.array([i for i, v in enumerate(x) if v > 0], int)
        got = X.segments(np.array([x[i] for i in at]), at, -0.5)
        assert [(a, b, round(s, 9)) for a, b, s in got] == brute_segments(x)


def corpus(n, seed):
    r = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        t = [r.choice(plain) for _ in range(r.randrange(20, 200))]
        bad = r.random() < 0.2
        if bad:
            for _ in range(r.randrange(2, 6)):
                t.insert(r.randrange(len(t)), r.choice(["Nasty,", "vile", "AWFUL!"]))
        rows.append((i, " ".join(t), int(bad)))
    return rows


def test_learns_and_calibrates(spark):
    rows = corpus(600, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:400]], "doc_id long, toxic int")
    model = X.train(docs, labels)
    assert len(model.words) == 3
    got = {r.doc_id: r["__score"] for r in X.score(docs, model, ["doc_id"]).collect()}
    held = rows[400:]
    assert all((got[i] >= X.CUT) == bool(y) for i, _, y in held)
    stat, found = X.passages(pa.array(["w1 nasty vile w2 " + "w3 " * 400 + "awful nasty", None, ""]), model)
    assert len(found[0]) == 2 and found[0][0][:2] == (1, 3) and stat[1] == stat[2] == 0


def test_copies_weigh_as_one(spark):
    """A clean-worded text that was labelled toxic and copied often doesn't make its words toxic."""
    rows = corpus(300, 3) + [(1000 + i, "the quick brown fox jumps over the lazy dog", 1) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert len(X.train(docs, labels).words) == 3


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "x", "b"), (2, "", "c"), (2, "y " * 60_000, "d")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.train(docs, none)
    assert {r["__score"] for r in X.score(docs, model).collect()} == {0.5}
    assert X.score(docs.limit(0), model).collect() == []
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert X.score(docs, X.train(docs, labels)).count() == 4
    assert np.allclose(X.isotonic(np.array([1.0, 0, 2]), np.array([1.0, 1, 2])), [0.5, 0.5, 1.0])


def test_segments_in_linear_time():
    """Isolated hits with rising starts, which made the plain scan quadratic: eight times as many take about eight times as long."""
    import time

    def seconds(n):
        at = np.arange(n) * 3
        start = time.perf_counter()
        got = X.segments(np.full(n, 0.5), at, -1.0)
        assert len(got) == n
        return time.perf_counter() - start

    seconds(20_000)
    assert seconds(400_000) < 40 * max(seconds(50_000), 0.02)


def test_tail_constant():
    """Segments whose tail is K * n * exp(-x) give back ln K."""
    bins = np.arange(0, 20)
    words, k = 1e6, 0.02
    reach = words * k * np.exp(-bins * X._TAIL_BIN)
    n = reach - np.append(reach[1:], 0)
    assert abs(X.tail_constant(np.append(bins, -1), np.append(n, words)) - np.log(k)) < 0.3
    assert X.tail_constant(np.array([-1]), np.array([5.0])) == 0.0


def test_score_against_brute_force(spark):
    """Word scores, lambda and the statistic of every document by plain Python."""
    import math
    import re
    from collections import Counter

    rows = corpus(240, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = X.train(docs, labels)
    words = [re.findall("[a-z0-9]+", t.lower()) for _, t, _ in rows]
    t, c = Counter(), Counter()
    for (_, text, y), w in zip(rows, words):
        keys = X._group_keys(*X._hashes(pa.array([text])))
        if not X._side(keys)[0]:
            (t if y else c).update(set(w))
    share = sum(t.values()) / (sum(t.values()) + sum(c.values()))

    def score(w):
        x, y = t[w] + X.PRIOR * share, c[w] + X.PRIOR * (1 - share)
        return math.log(x / y) - math.log(share / (1 - share)) - X.Z * math.sqrt(1 / x + 1 / y)

    stat, _ = X.passages(pa.array([text for _, text, _ in rows]), model)
    for got, w in zip(stat, words):
        e = [model.lam * s - model.log_k - math.log(len(w)) for _, _, s in brute_best([score(x) for x in w])]
        assert abs(got - sum(x for x in e if x > X.SIGNIFICANT)) < 1e-6


def brute_best(x):
    """:func:`brute_segments` with prefix sums and recursion on both sides."""
    out, todo = [], [(0, len(x))]
    before = np.concatenate([[0.0], np.cumsum(x)])
    while todo:
        a, b = todo.pop()
        if a >= b:
            continue
        low, best = a, (0.0, 0, 0)
        for j in range(a + 1, b + 1):
            if before[j] - before[low] > best[0] + 1e-12:
                best = (before[j] - before[low], low, j)
            if before[j] <= before[low]:
                low = j
        if best[0] > 0:
            s, p, q = best
            out.append((p, q, s))
            todo += [(a, p), (q, b)]
    return out


def test_few_wrong_labels_do_not_fix_the_tail(spark):
    """Toxic rows labelled clean hold more long toxic segments than the tail needs; the rows of one toxic word are found all the same."""
    r = random.Random(8)
    rows = []
    for i in range(9000):
        t = [f"w{r.randrange(300)}" for _ in range(r.randrange(20, 60))]
        kind = r.choice(["", "", "", "", "", "", "", "", "run", "one"])
        bad = r.sample(["nasty", "vile", "awful"], {"": 0, "run": 3, "one": 1}[kind])
        at = r.randrange(len(t))
        rows.append((i, " ".join(t[:at] + bad + t[at:]), kind, int(kind != "" and r.random() > 0.14)))
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, *_, y in rows], "doc_id long, toxic int")
    got = {x.doc_id: x["__score"] for x in X.score(docs, X.train(docs, labels), ["doc_id"]).collect()}
    for kind, least in (("run", 0.98), ("one", 0.98), ("", 0.0)):
        caught = np.mean([got[i] >= X.CUT for i, _, k, _ in rows if k == kind])
        assert caught >= least if kind else caught <= 0.02

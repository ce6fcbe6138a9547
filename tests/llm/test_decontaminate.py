import hashlib
import random
import re

import pytest

from termloom.llm import decontaminate as D


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - width + 1)) if w else []:
            wins.setdefault(tuple(w[s : s + width]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                got = wins.get(tuple(w[s : s + n]))
                if got:
                    ids |= got
                    hit |= set(range(s, s + n))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_against_brute_force(spark, limit):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(60)] + ["É", "é", "Über", "x1"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(3, items[3][1]), (50, items[4][1]), (51, None), (52, " .. "), (9, "W1, w2; (w3)")]
    docs = []
    for d in range(40):
        t = [r.choice(vocab) for _ in range(r.randrange(80))]
        if r.random() < 0.6:
            p = words(r.choice(items)[1])
            a = r.randrange(len(t) + 1)
            t[a:a] = p[r.randrange(2) :] if p else []
        docs.append((d, r.choice([" ", ", ", "\n- "]).join(t) + r.choice(["", ".", " "])))
    docs += [(100, None), (101, ""), (102, "..."), docs[5], (6, docs[7][1]), (None, docs[8][1]), (103, "w1 w2 w3"), (104, "w5 " * 20_000)]
    a = spark.createDataFrame([(*x, "z", "q") for x in docs], "doc_id long, text string, window string, n string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(a, b, broadcast_bytes=limit)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(docs, items)
    kept = D.clean_documents(a, b)
    assert kept.columns == a.columns
    clean = [x for x, y in zip(sorted(docs, key=str), [None] * len(docs))]
    want = sorted((d for d, t in docs if not brute([(d, t)], items)[0][5]), key=str)
    assert sorted((x.doc_id for x in kept.collect()), key=str) == want and clean


def test_empty(spark):
    a = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [x.n_hit for x in D.decontaminate(a, none).collect()] == [0]
    assert D.decontaminate(a.limit(0), none).collect() == []
    assert D.clean_documents(a, none).count() == 1


def test_main_path_is_native(spark, sf):
    plan = D.query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

import random
import re


from termloom.llm import near_dedup as N


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    par = list(range(len(docs)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                par[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(docs):
        comp.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(comp[find(i)]), d == min(comp[find(i)])) for i, (d, _) in enumerate(docs))


def got(spark, docs, percent=85):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(tuple(r) for r in N.near_duplicates(df, percent).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_against_brute_force(spark):
    rnd = random.Random(5)
    docs = []
    for k in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([60, 150, 400]))]
        for v in range(rnd.choice([1, 3, 9])):
            own = [w if rnd.random() > rnd.choice([0.0, 0.005, 0.02, 0.06]) else f"x{rnd.randrange(9999)}" for w in base]
            docs.append((len(docs) * 3 + 1, " ".join(own)))
    docs += [(900, None), (901, ""), (902, " \n\t "), (903, "One two"), (904, "one TWO"), (905, "one two three four five six"), (906, "É é"), (907, "é é")]
    rnd.shuffle(docs)
    assert got(spark, docs) == brute(docs)
    assert got(spark, docs, N.PERCENT) == brute(docs, 80)


def test_blocks_and_chain(spark, monkeypatch):
    """Many unlinked look-alikes in the same buckets, and links that only lead through others."""
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for v in range(60):
        own = list(base)
        for p in rnd.sample(range(300), 12):
            own[p] = f"v{v}p{p}"
        docs.append((v, " ".join(own)))
    chain = list(base[:200])
    for v in range(8):
        chain = list(chain)
        chain[v * 20 : v * 20 + 2] = [f"c{v}", f"d{v}"]
        docs.append((100 + v, " ".join(chain)))
    monkeypatch.setattr(N, "BLOCK", 16)
    assert got(spark, docs) == brute(docs)


def test_boilerplate_family(spark, monkeypatch):
    """Texts around one boilerplate that meet in the same buckets and aren't alike enough, but for some pairs, are told apart by their rare shingles."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for v in range(70):
        own = list(base)
        for p in range(5, 200, 12):
            own[p] = f"v{v}p{p}"
        docs.append((v, " ".join(own)))
    for v in range(0, 70, 9):
        w = docs[v][1].split()
        w[100] = f"changed{v}"
        docs.append((200 + v, " ".join(w)))
    monkeypatch.setattr(N, "BLOCK", 8)
    assert got(spark, docs, 80) == brute(docs, 80)


def test_prefixes_share_a_shingle():
    """Any two sets of the similarity share a shingle of their prefixes, and the prefix is the rarest part."""
    import numpy as np

    rnd = random.Random(9)
    for _ in range(200):
        a = set(rnd.sample(range(1, 400), rnd.randrange(5, 60)))
        b = (a - set(rnd.sample(sorted(a), rnd.randrange(0, 1 + len(a) // 8)))) | set(rnd.sample(range(400, 500), rnd.randrange(0, 1 + len(a) // 8)))
        h = np.array(sorted(a) + sorted(b), np.uint64)
        at = np.array([0, len(a), len(a) + len(b)])
        often = np.array([(x * 7919) % 31 + (2 if x in a and x in b else 1) for x in h.tolist()])
        often = np.array([dict(zip(h.tolist(), often.tolist()))[x] for x in h.tolist()])
        row, place = N.prefix_of(h, at, often, 80)
        if 100 * len(a & b) >= 80 * len(a | b):
            assert set(h[place[row == 0]].tolist()) & set(h[place[row == 1]].tolist())


def test_very_long_text_against_brute_force(spark):
    rnd = random.Random(10)
    long = [f"l{rnd.randrange(5000)}" for _ in range(50_000)]
    near = list(long)
    for p in rnd.sample(range(50_000), 800):
        near[p] = "other"
    docs = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:30_000]))]
    assert got(spark, docs, 80) == brute(docs, 80)


def test_empty_table_and_stage(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).collect() == []
    rows = [(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (3, None, "z"), (None, "q", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = sorted(map(str, N.stage(spark, df, "").collect()))
    assert out == sorted(["Row(doc_id=1, text='a b c d e f', node='y')", "Row(doc_id=3, text=None, node='z')", "Row(doc_id=None, text='q', node='n')"])


def test_batch_thresholds_keep_similar_pairs():
    from math import comb

    miss = sum(comb(80, s) * 0.85**s * 0.15 ** (80 - s) for s in range(N.thresholds(85)[-1]))
    assert miss < 1e-4
    assert N.thresholds(85) == tuple(sorted(N.thresholds(85)))


def test_family_of_many_common_shingles(spark, monkeypatch):
    """Texts of paragraphs from one set, so that no shingle of a text is rare: every pair counts, and of their many links those that join are kept."""
    rnd = random.Random(11)
    parts = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(24)]
    docs = [(v, " ".join(p for p in parts if rnd.random() < 0.9)) for v in range(160)]
    docs += [(1000 + v, t + f" own{v} " + " ".join(f"x{v}y{i}" for i in range(rnd.randrange(90)))) for v, t in docs[:40]]
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N._families, "ROWS", 32)
    want = brute(docs, 80)
    assert got(spark, docs, 80) == want
    assert len({c for _, _, c, _ in want}) > 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert N.links(df, 80)[3].count() < 6 * len(docs)


def test_similar_sets_of_two_blocks(monkeypatch):
    """The matrix of similar sets against Python's sets, with shingles in products of several parts and in lists."""
    import numpy as np

    rnd = random.Random(12)
    sides = []
    for _ in "ab":
        sets = [set(rnd.sample(range(1, 60), rnd.randrange(20, 50))) | {1000 + rnd.randrange(200) for _ in range(rnd.randrange(4))} for _ in range(40)]
        sets[3:6] = [set(range(1, 40)), set(range(1, 49)), set(range(1, 51))]
        sides.append(sets)
    blocks = [(np.array([x for s in sets for x in sorted(s)], np.uint64), np.cumsum([0, *map(len, sets)])) for sets in sides]
    want = [[100 * len(x & y) >= 80 * len(x | y) for y in sides[1]] for x in sides[0]]
    for listed, columns, pairs in ((0, 7, 50), (40, 16, 50), (10_000, 16, 50)):
        for k, v in (("LISTED", listed), ("COLUMNS", columns), ("PAIRS", pairs)):
            monkeypatch.setattr(N._families, k, v)
        assert N._families.similar(*blocks[0], *blocks[1], 80).tolist() == want

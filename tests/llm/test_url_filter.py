import pytest

from termloom.llm import url_filter as U


def test_rules_and_parts(spark):
    urls = [
        ("http://www.Example.COM/en/7?x=/en/", "www.example.com", "/en/7", "example.com/en/7", "allow"),
        ("https://a.com/en/1#t", "a.com", "/en/1", "com/en/", "block"),
        ("https://com/en/", "com", "/en/", "com/en/", "block"),
        ("x://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("x://b.example.net/de/88", "b.example.net", "/de/88", "example.net/de/8", "block"),
        ("x://b.example.net/de/7", "b.example.net", "/de/7", "net/de/", "allow"),
        ("x://a.org?/es/", "a.org", "", None, "allow"),
        ("x://a.org/es", "a.org", "/es", None, "allow"),
        ("x://y://z.org/es/", "y:", "//z.org/es/", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", "v") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "url string, bad boolean")
    rows = U.filter_urls(pages, none).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in rows] == [u for u in urls for _ in range(2)]
    assert U.filter_urls(pages.limit(0), none).collect() == []


def test_reputation(spark):
    """A bad host is blocked; a new host of the same domain inherits; few outcomes aren't enough; one host may hold most rows."""
    bad = [("http://spam.bad.info/x", True)] * 300 + [("http://more.bad.info/x", True)] * 40
    good = [(f"http://h{i % 9}.fine.info/", False) for i in range(400)] + [("http://one.other.info/", True)]
    outcomes = spark.createDataFrame(bad + good, "url string, bad boolean")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://spam.bad.info/y", "http://new.bad.info/", "http://h1.fine.info/z", "http://one.other.info/q"] + ["http://spam.bad.info/y"] * 500)], "page_id long, url string")
    got = {r.page_id: r for r in U.filter_urls(pages, outcomes).collect()}
    assert len(got) == 504
    assert [got[i].verdict for i in range(4)] == ["block", got[1].verdict, "allow", "allow"]
    assert got[0].bad_bound > got[1].bad_bound > got[2].bad_bound
    assert got[3].bad_bound < U.LIMIT


@pytest.mark.parametrize("host,suffix,domain", [("a.b.co.uk", "co.uk", "b.co.uk"), ("x.y.example.com", "com", "example.com"), ("com", "com", "com"), ("", "", "")])
def test_suffixes(spark, host, suffix, domain):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.lit(host).alias("_h")).withColumn("_s", U.suffix_of(F.col("_h"))).withColumn("_d", U.domain_of(F.col("_h"), F.col("_s"))).first()
    assert (row._s, row._d) == (suffix, domain)


def test_reputation_against_brute_force(spark):
    """Every bound by plain Python: counts, strengths by moments, means from suffix to host."""
    import math
    import random
    from collections import defaultdict

    r = random.Random(4)
    hosts = [f"{a}.{b}.{c}" for a in "xyz" for b in ("one", "two", "three") for c in ("info", "co.uk", "dev")] + ["co.uk", "info"]
    outcomes = [(f"http://{(h := r.choice(hosts))}/p", r.random() < (0.8 if "one" in h else 0.1)) for _ in range(600)] + [(None, True)] * 40 + [("http://x.one.info/", None)]
    own = lambda h: (lambda s: (s, h if h == s else h[: -len(s) - 1].split(".")[-1] + "." + s))("co.uk" if h.endswith("co.uk") else h.split(".")[-1])
    count = {k: defaultdict(lambda: [0, 0]) for k in "hds"}
    for u, bad in outcomes:
        if u and bad is not None:
            h = u.split("/")[2]
            s, d = own(h)
            for k, key in (("h", h), ("d", (d, s)), ("s", s)):
                count[k][key][0] += 1
                count[k][key][1] += bad

    def strength(c):
        n, b, k = sum(x for x, _ in c.values()), sum(y for _, y in c.values()), len(c)
        p, left = b / n, n - sum(x * x for x, _ in c.values()) / n
        v = (sum(y * y / x for x, y in c.values()) - n * p * p - (k - 1) * p * (1 - p)) / left if k > 1 and left > 0 else 0
        return max(U.WEAKEST, min(10000.0, p * (1 - p) / v - 1)) if v > 0 else 10000.0

    kh, kd, ks = (strength(count[k]) for k in "hds")
    n, b = sum(x for x, _ in count["h"].values()), sum(y for _, y in count["h"].values())
    m0 = (b + 1) / (n + 2)

    def bound(h):
        s, d = own(h)
        at = lambda k, key, a, prior: (count[k][key][1] + a * prior) / (count[k][key][0] + a) if key in count[k] else prior
        ms = at("s", s, ks, m0)
        md = at("d", (d, s), kd, ms)
        m = at("h", h, kh, md)
        a = count["h"][h][0] + kh if h in count["h"] else kh
        return m - U.Z * math.sqrt(m * (1 - m) / (a + 1))

    asked = hosts + ["new.one.info", "a.b.newone.dev", "other.org", "co.uk"]
    pages = spark.createDataFrame([(i, f"http://{h}/q") for i, h in enumerate(asked)] + [(None, "http://info/" + "long" * 50_000), (90, None), (91, "nothing")], "page_id long, url string")
    rows = U.filter_urls(pages, spark.createDataFrame(outcomes, "url string, bad boolean")).collect()
    assert len(rows) == len(asked) + 3
    for row in rows:
        want = bound(row.host) if row.host else m0 - U.Z * math.sqrt(m0 * (1 - m0) / (kh + 1))
        assert abs(row.bad_bound - want) < 1e-9 and row.verdict == ("block" if want > U.LIMIT else "allow")

import numpy as np
import pytest

from termloom.llm import ann_search as A


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            s = sorted((-float((q * v).sum()), j) for j, v in ok if j != i)
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def got(spark, rows, k=20, every=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = {}
    for r in sorted(A.search(df, k, every).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def vectors(n, dim, seed, groups=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    if groups:
        x = r.standard_normal((groups, dim))[r.integers(0, groups, n)] + 0.3 * x
    return [[float(np.float32(v)) for v in row] for row in x * r.uniform(0.3, 2, (n, 1))]


@pytest.mark.parametrize("groups", [0, 30])
def test_recall(spark, groups, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 700)
    rows = list(enumerate(vectors(2000, 24, 1, groups)))
    want, have = brute(rows, 20, 20), got(spark, rows)
    assert want.keys() == have.keys()
    recall = np.mean([len({j for j, _ in want[q]} & {j for j, _ in have[q]}) / 20 for q in want])
    assert recall >= 0.9
    score = {(q, j): s for q in want for j, s in brute([r for r in rows if r[0] == q or r[0] % 7 == 0], 2000, 20).get(q, [])}
    for q in list(have)[:5]:
        for j, s in have[q]:
            assert s == pytest.approx(score.get((q, j), s))


def test_ties_nulls_and_few(spark):
    one = [1.0, 0.0, 0.5]
    rows = [(i, one) for i in range(60, 0, -1)] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 0.0]), (160, [float("nan"), 1.0, 1.0]), (180, [1.0, 2.0]), (None, one)]
    have = got(spark, rows)
    assert have.keys() == {20, 40, 60}
    for q, found in have.items():
        assert [j for j, _ in found] == [j for j in range(1, 22) if j != q][:20]
    few = got(spark, [(20, one), (1, [1.0, 1.0, 1.0]), (2, [-1.0, 0.0, 0.0])])
    assert [j for j, _ in few[20]] == [1, 2]
    assert got(spark, [(20, one)]) == {} and got(spark, []) == {}


def test_query(spark, sf):
    rows = A.query(spark, sf).collect()
    assert {r["rank"] for r in rows} == set(range(1, 21))


def test_known_neighbours_bound_further_blocks():
    """The closed form is the greatest depth at which the target's probability is reached."""
    r = np.random.default_rng(3)
    score, norm = r.uniform(-0.9, 0.999, 200), np.ones(200)
    d = A.enough(score, norm, 1.0)
    assert (A.met(score, norm, 1.0, d) >= A.TARGET - 1e-12).all()
    deeper = d < A.BITS
    assert (A.met(score, norm, 1.0, d + 1)[deeper] < A.TARGET).all() and (A.enough(np.array([1.0]), np.array([1.0]), 1.0) == A.BITS).all()


def test_other_columns(spark):
    rows = [(i, v, "x", 1.0) for i, v in enumerate(vectors(60, 8, 2))] + [(None, [1.0] * 8, "n", 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string, score double")
    got_rows = A.search(df, 5, 20).collect()
    assert {r.query_id for r in got_rows} == {0, 20, 40} and all(r.vec_id is not None for r in got_rows)

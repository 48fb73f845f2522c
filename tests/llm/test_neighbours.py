import numpy as np
import pytest

from pagemill.llm import neighbours as N


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 8)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(400 + i, x[0]) for i in range(60)]  # ties
    rows += [(0, x[0]), (500, None), (501, [0.0] * 8), (502, [float("nan"), *[1.0] * 7]), (503, [None, *[1.0] * 7]), (None, x[1]), (504, [1.0, 2.0]), (505, [float("inf"), *[1.0] * 7])]
    return rows


def test_against_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    rows = N.usable(df, "vec_id", "embedding")
    got = N.nearest(rows.filter("id % 20 = 0"), rows, 7, 4, 32).toPandas()
    good = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.asarray(v, np.float32).astype(float)
    for q in [i for i in good if i % 20 == 0]:
        cand = sorted((-float(sum(a * b for a, b in zip(good[q], good[j], strict=True))), j) for j in good if j != q and len(good[j]) == len(good[q]))[:7]
        g = got[got.query_id == q].sort_values("rank")
        assert g.vec_id.tolist() == [j for _, j in cand]
        np.testing.assert_allclose(g.score, [-s for s, _ in cand], rtol=1e-12)


def test_bounds_hold():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(50, 64)) * 10.0 ** r.integers(-6, 6, (50, 1)), r.standard_cauchy(size=(80, 64))
    (qa, sa, na), (qb, sb, nb) = N.quantised(a), N.quantised(b)
    approx = (qa.astype(float) @ qb.astype(float).T) * sa[:, None] * sb
    bound = 0.5 * (sa[:, None] * nb + na[:, None] * sb) + 16 * sa[:, None] * sb
    assert (np.abs(approx - a @ b.T) <= bound * (1 + 1e-9)).all()


def test_empty(spark):
    rows = N.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert N.nearest(rows, rows).count() == 0


def test_each_query_vector_of_one_id_has_its_own_list(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 5.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    usable = N.usable(rows, "vec_id", "embedding")
    got = N.nearest(usable.filter("id = 0"), usable, 2).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 3.0), (1, 2, 5.0), (2, 3, 1.0), (2, 3, 1.0)]

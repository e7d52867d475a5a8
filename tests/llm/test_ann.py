import numpy as np

from sabermill.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_recall_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SMALL", 400)
    monkeypatch.setattr(ann, "QUERIES", 30)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1200, 16)).astype(np.float32)
    x[100:160] = x[100]  # a hot vector
    x *= rng.uniform(0.5, 2, (1200, 1)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(2000, None, 0), (2020, [], 0), (2040, [0.0] * 16, 0), (2060, [None] + [1.0] * 15, 0), (2080, [float("nan")] * 16, 0), (2100, [float("inf")] * 16, 0), (2120, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    base = spark.createDataFrame(rows + bad, SCHEMA)
    got = ann.nearest(base, base.where("vec_id % 20 = 0"), k=20).collect()
    full = x.astype(np.float64)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 1200, 20))
    hit = 0
    for q, own in by.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and all(r.vec_id != q for r in own)
        score = (full * full[q]).sum(axis=1)
        assert np.allclose([r.score for r in own], score[[r.vec_id for r in own]], rtol=1e-12)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        score[q] = -np.inf
        hit += len({r.vec_id for r in own} & set(np.lexsort((np.arange(1200), -score))[:20].tolist()))
    assert hit / (20 * len(by)) >= 0.9
    assert ann.nearest(base.where("false"), base, k=3).count() == 0


def test_few_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.1], 0)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few, few.where("vec_id = 0"), k=20).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_repeated_rows_and_extreme_values(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (0, [3.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.1], 0), (20, [0.5, 0.1], 0), (20, [0.5, 0.1], 0)]
    base = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(base, base.where("vec_id % 20 = 0"), k=20).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    for size in (1e200, 1e-200, 1.7e308):
        rows = [(0, [size, 0.0]), (1, [size / 2, size / 2]), (2, [-size, size]), (3, [1.0, 1.0])]
        far = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = ann.nearest(far, far.where("vec_id = 0"), k=3).orderBy("rank").collect()
        with np.errstate(over="ignore"):
            want = {i: float(np.float64(size) * np.float64(v[0]) + 0.0 * v[1]) for i, v in rows[1:]}
        assert [r.vec_id for r in got] == sorted(want, key=lambda i: (-want[i], i)) and all(r.score == want[r.vec_id] for r in got)

import numpy as np
import pytest

from sabermill.operators.neighbors import comps_within


@pytest.mark.parametrize(("least", "most"), [(3, 20), (3, 6), (5, 200)])
def test_comps_within_match_brute_force(spark, least, most):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(rng.normal(size=(41, 3)) * rng.uniform(0.2, 2, (41, 1)))]
    rows += [(100, "c", [0.0] * 3), (200, "d", [0.0] * 3), (201, "d", [1.0] * 3)]
    want, beyond = set(), 0
    for pos in "abcd":
        own = [(i, np.array(v)) for i, p, v in rows if p == pos]
        near = {i: sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in own if j != i) for i, v in own}
        if not any(near.values()):
            continue
        radius = np.quantile([max(d for d, _ in x[:least]) for x in near.values()], 0.5)
        for i, x in near.items():
            kept = [y for k, y in enumerate(x) if k < least or y[0] <= radius][:most]
            beyond += len(kept) > least
            want |= {(i, j, round(d, 6)) for d, j in kept}
    got = {(r.player, r.comp, r.dist) for r in comps_within(spark.createDataFrame(rows, "id long, pos string, v array<double>"), "id", "pos", "v", least, most).collect()}
    assert got == want and beyond > 5


def test_comps_match_brute_force(spark, monkeypatch):
    from sabermill.operators import neighbors
    from sabermill.operators.neighbors import comps

    monkeypatch.setattr(neighbors, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], (rng.integers(0, 3, 3) / 7).tolist()) for i in range(90)]  # many ties
    rows += [(200 + i, "a", v) for i, v in enumerate([None, [0.0, None, 1.0], [1.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0]])]
    rows += [(300, "c", [1.0]), (301, None, [1.0]), (302, "d", [0.0]), (303, "d", [2.0000005])]

    def apart(v, w):
        if v is None or w is None or len(v) != len(w) or None in v or None in w:
            return (2, 0.0)
        x = sum((p - q) * (p - q) for p, q in zip(v, w)) ** 0.5
        return (1, 0.0) if x != x else (0, round(x, 6))

    for k in (1, 5):
        want = {(i, j, d if d[0] != 0 else (0, round(d[1], 5))) for i, p, v in rows for d, j in sorted((apart(v, w), j) for j, o, w in rows if p and o == p and j != i)[:k]}
        df = spark.createDataFrame(rows, "id long, pos string, v array<double>")
        out = comps(df, "id", "pos", "v", k)
        got = {(r.player, r.comp, (2, 0.0) if r.dist is None else (1, 0.0) if r.dist != r.dist else (0, round(r.dist, 5))) for r in out.collect()}
        assert got == want
    assert [r.dist for r in out.where("player = 302").collect()] == [2.000001]
    # no row for each pair of players: that is what took the time
    assert "Join Inner" not in out._jdf.queryExecution().optimizedPlan().toString().split("CoGroup")[0]
    assert "CoGroup" in out._jdf.queryExecution().optimizedPlan().toString()

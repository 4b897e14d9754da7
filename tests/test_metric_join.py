"""Pairs within a distance by pivots, against the tiles and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import metric_join
from sigloom.operators.pairs import PairJob
from sigloom.plans.compare import ComparePlan, SignaturePlan

_SIGS = "id long, sig array<double>"


def _vectors(spark, n=300, d=6, seed=0, ids=0):
    """Clusters of near vectors, copies, a cluster that holds a third of all, and vectors of other lengths."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(42).normal(size=(20, d))
    rows = []
    for i in range(n):
        centre = centres[0 if i % 3 == 0 else i % 20]
        v = centre + (0 if i % 15 == 0 else rng.normal(size=d) * 0.02)
        rows.append((ids + i, v.round(4).tolist() if i % 50 else v.round(4).tolist()[:3]))
    rows += [(ids + 9_000, None), (ids + 9_001, []), (ids + 9_002, [1.0, None]), (ids + 9_003, [float("nan")] * d), (ids + 9_004, [7.0]), (ids + 9_005, [7.0])]
    return spark.createDataFrame(rows, _SIGS)


def _found(df):
    rows = df.collect()
    assert len({(r["id_a"], r["id_b"]) for r in rows}) == len(rows)
    return {(r["id_a"], r["id_b"]): round(r["dist"], 8) for r in rows}


@pytest.mark.parametrize("method,theta,limit", [("manhattan", None, 0.15), ("manhattan", None, 0.0), ("PaSiT", 0.02, 0.6), ("hamming", None, 0.5), ("sateucl", 0.02, 0.7)])
def test_within_equals_the_tiles(spark, method, theta, limit, monkeypatch):
    sigs = _vectors(spark)
    extra = {} if theta is None else {"theta": theta}
    # hamming tiles take a missing value for equal; here such a row has no distance
    want = {p: d for p, d in _found(PairJob(sigs, method, high=limit, **extra).pairs()).items() if 9_003 not in p}
    assert want and _found(metric_join.within(sigs, method, limit, theta)) == want
    monkeypatch.setattr(metric_join, "ROWS_PER_PIVOT", 10)
    assert _found(metric_join.within(sigs, method, limit, theta, rows_per_slice=15)) == want


def test_true_euclid_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 3))
    want = {(i, j): round(float(np.linalg.norm(m[i] - m[j])), 8) for i in range(200) for j in range(i + 1, 200) if np.linalg.norm(m[i] - m[j]) <= 0.4}
    sigs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], _SIGS)
    assert _found(metric_join.within(sigs, "euclid", 0.4, rows_per_slice=20)) == want


def test_queries_meet_all_rows(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "ROWS_PER_PIVOT", 15)
    refs, asked = _vectors(spark), _vectors(spark, 80, seed=5, ids=100)
    want = _found(PairJob(refs, "manhattan", queries=asked, high=0.2).pairs())
    assert want and _found(metric_join.within(refs, "manhattan", 0.2, queries=asked, rows_per_slice=30)) == want


def test_what_is_compared_grows_with_what_is_near(spark):
    work = {}
    for n in (1_000, 4_000):
        rng = np.random.default_rng(n)
        centres = rng.uniform(0, 100, size=(n // 10, 8))
        rows = [(i, (centres[i // 10] + rng.normal(size=8) * 0.01).tolist()) for i in range(n)]
        got = metric_join.within(spark.createDataFrame(rows, _SIGS), "manhattan", 1.0, audit=True).agg(F.sum("compared"), F.sum("near"), F.max("rows")).first()
        assert got[1] == n // 10 * 45 and got[2] <= 2 * metric_join.ROWS
        work[n] = got[0]
        assert got[0] < 0.05 * n * n / 2
    assert work[4_000] < 8 * work[1_000]  # sixteen times as many pairs


def test_copies_of_a_third_are_split(spark):
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [float(i), -float(i)]) for i in range(900)]
    sigs = spark.createDataFrame(rows, _SIGS)
    tiles = metric_join.within(sigs, "manhattan", 0.5, rows_per_slice=40, audit=True).collect()
    assert sum(r["near"] for r in tiles) == 300 * 299 // 2 and max(r["rows"] for r in tiles) < 200
    assert metric_join.within(sigs.limit(0), "manhattan", 0.5).count() == 0
    with pytest.raises(ValueError):
        metric_join.within(sigs, "pearson", 0.5)


def test_a_plan_with_a_limit_uses_the_pivots(spark):
    sigs = _vectors(spark, 120).withColumn("ord", 20_000 - F.col("id"))
    plan = ComparePlan(method="PaSiT", theta=0.02, below=0.5, include_self=True, signature=SignaturePlan("freq", 2))
    for p in (plan, plan.with_(include_self=False, above=0.1)):
        got, want = p.pairs(sigs), p.job(p.prepare(sigs)).pairs()
        assert got.columns == want.columns

        def rounded(df):
            return sorted(str(r) for r in df.withColumn("dist", F.round("dist", 8)).collect())
        assert rounded(got) == rounded(want)


def test_rows_that_would_visit_every_cell_form_a_grid(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "ROWS_PER_PIVOT", 20)
    n, limit = 1_600, 0.95
    rng = np.random.default_rng(11)
    m = rng.normal(size=(n, 48))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[1::4] = m[::4] + rng.normal(size=(n // 4, 48)) * 0.01
    sigs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], _SIGS)
    far = np.sqrt(np.square(m[:, None, :] - m[None, :, :]).sum(axis=2))
    want = {(i, j): round(float(far[i, j]), 8) for i, j in zip(*np.nonzero(np.triu(far <= limit, 1)))}
    assert len(want) >= n // 4 and _found(metric_join.within(sigs, "euclid", limit)) == want
    tiles = metric_join.within(sigs, "euclid", limit, audit=True).agg(F.sum("rows"), F.sum("near")).first()
    assert tiles[0] <= 16 * n and tiles[1] == len(want)  # eighty cells: each row visited forty of them, and two ranges in each
    asked = sigs.where("id % 50 = 0").withColumn("id", F.col("id") + n)
    between = {(i, j + n): round(float(far[i, j]), 8) for i, j in zip(*np.nonzero(far <= limit)) if j % 50 == 0}
    assert _found(metric_join.within(sigs, "euclid", limit, queries=asked)) == between


@pytest.mark.parametrize("method, theta", [("euclid", None), ("satman", 0.1), ("sateucl", 0.1)])
def test_bounds_rule_out_most_pairs_and_none_within_the_limit(method, theta):
    rng = np.random.default_rng(8)
    metric = metric_join.metric_of(method, theta=theta)
    plain = rng.normal(scale=0.125, size=(200, 40))
    near = np.concatenate([plain[:50] + rng.normal(scale=0.03, size=(50, 40)), plain])
    for a, b in ((plain, near), (plain * 300, near * 300), (plain + 1e6, near + 1e6), (np.rint(plain * 8) / 10, np.rint(near * 8) / 10), (plain * 0, near * 0)):
        dist = metric.between(a, b)
        for limit in np.quantile(dist, [0.0, 0.01, 0.3]).tolist() + [0.6]:
            can = metric.bound(a, b, limit * (1 + 1e-9) + 1e-12)(slice(20, 170))
            assert can.shape == (150, 250) and can[dist[20:170] <= limit].all()
    far = metric.between(plain, near)
    can = metric.bound(plain, near, np.quantile(far, 0.01))(slice(None))
    assert can.mean() < 0.4


def test_bounds_leave_odd_values_to_the_distance():
    rows = np.random.default_rng(9).normal(size=(20, 6))
    rows[3, 3] = np.inf
    assert metric_join.metric_of("satman", theta=0.1).bound(rows, rows, 0.5) is None
    rows[3, 3] = 1e200
    assert all(metric_join.metric_of(m, theta=0.1).bound(rows, rows, 0.5) is None for m in ("satman", "sateucl", "euclid"))
    assert metric_join.metric_of("manhattan").bound(rows, rows, 0.5) is None


@pytest.mark.parametrize("method, theta, limit", [("euclid", None, 1.0), ("satman", 0.1, 0.7)])
def test_a_grid_does_not_compare_what_bounds_rule_out(spark, monkeypatch, method, theta, limit):
    rng = np.random.default_rng(10)
    rows = rng.normal(scale=0.125, size=(300, 64))
    rows[150:200] = rows[:50] + rng.normal(scale=0.05, size=(50, 64))
    sigs = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], _SIGS)
    metric = metric_join.metric_of(method, theta=theta)
    dist = metric.between(rows, rows)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if dist[i, j] <= limit}
    found = metric_join.within(sigs, method, limit, theta=theta).collect()
    assert len(found) == len(want) and {(r["id_a"], r["id_b"]) for r in found} == want and want
    monkeypatch.setattr(metric_join.Metric, "block", None)
    side = type("Side", (), {"away": np.zeros(300), "guest": np.zeros(300, bool), "next": np.zeros(300, bool), "matrix": rows, "probes": metric.between(rows, rows[:3])})
    looked = {(int(i), int(j)) for a, b in metric_join._candidates(side, side, True, metric, limit, False) for i, j in zip(a, b)}
    assert want <= looked and len(looked) < 0.3 * 300 * 299 / 2

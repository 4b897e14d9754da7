"""Close pairs through an index of hashes, and joins on hot keys."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.operators import dealing, sketch_join
from sigloom.operators.pairs import PairJob
from sigloom.plans.compare import ComparePlan, SignaturePlan

SIZE, K = 40, 7.0


def _sketches(spark, n=260, seed=0, ids=0):
    """Families of related sets; hash 5 is in a third of all, some sketches are short, empty or missing."""
    rng, rows = np.random.default_rng(seed), []
    pool = np.unique(np.random.default_rng(99).integers(10, 1 << 40, 6000))
    for i in range(n):
        family = np.random.default_rng(i % 30).choice(pool, 60, replace=False)
        own = np.unique(np.concatenate([family[rng.random(60) < 0.93], rng.choice(pool, 15)]))
        if i % 3 == 0:
            own = np.unique(np.append(own, 5))
        own = own[:SIZE] if i % 5 else own[:int(rng.integers(1, SIZE))]
        rows.append((ids + i, None if i == 7 else [] if i == 8 else [int(x) for x in own]))
    return spark.createDataFrame(rows, "id long, sig array<long>")


def _found(df):
    rows = df.collect()
    assert len({(r["id_a"], r["id_b"]) for r in rows}) == len(rows)
    return {(r["id_a"], r["id_b"]): round(r["dist"], 9) for r in rows}


@pytest.mark.parametrize("limit", [0.05, 0.4])
def test_neighbours_equal_the_tiles(spark, limit, monkeypatch):
    sigs = _sketches(spark)
    want = _found(PairJob(sigs, "approxANI", theta=K, sketch_size=SIZE, high=limit).pairs())
    assert want
    assert _found(sketch_join.neighbours(sigs, limit, K, SIZE)) == want
    monkeypatch.setattr(sketch_join, "SLICE", 7)
    monkeypatch.setattr(dealing, "PER_TASK", 20)
    assert _found(sketch_join.neighbours(sigs, limit, K, SIZE)) == want


def test_neighbours_of_queries_equal_the_tiles(spark, monkeypatch):
    monkeypatch.setattr(sketch_join, "SLICE", 11)
    refs, asked = _sketches(spark), _sketches(spark, 60, 1, 100)
    want = _found(PairJob(refs, "approxANI", queries=asked, theta=K, sketch_size=SIZE, high=0.2).pairs())
    assert want and _found(sketch_join.neighbours(refs, 0.2, K, SIZE, asked)) == want


def test_neighbours_make_no_tiles_and_no_cross_product(spark):
    plan = sketch_join.neighbours(_sketches(spark), 0.1, K, SIZE)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert sketch_join.neighbours(_sketches(spark).limit(0), 0.1, K, SIZE).count() == 0
    with pytest.raises(ValueError):
        sketch_join.neighbours(_sketches(spark), 1.0)


def test_a_hash_of_a_third_of_all_sketches_is_spread(spark, monkeypatch):
    monkeypatch.setattr(sketch_join, "SLICE", 20)
    rows = [(i, [1, 100 + i] if i % 3 == 0 else [1_000_000 + i]) for i in range(600)]
    sigs = spark.createDataFrame(rows, "id long, sig array<long>").where("id >= 0")
    met = sketch_join._met_within(sketch_join._held(sigs, "id"))
    assert met.count() == 200 * 199 // 2
    # all pairs arise from one hash, so they lie in as many tasks as its slices allow
    sizes = [r[0] for r in met.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 4 and max(sizes) < 0.4 * sum(sizes)


@pytest.mark.parametrize("limit", [0.05, 0.4])
def test_common_hashes_are_counted_in_tiles(spark, limit, monkeypatch):
    refs, asked = _sketches(spark), _sketches(spark, 60, 1, 100)
    pairs, found = (_found(sketch_join.neighbours(refs, limit, K, SIZE, q)) for q in (None, asked))
    monkeypatch.setattr(sketch_join, "MEETINGS", 0)
    # hash 1 to 9 in every sketch: an index would make nine rows per pair
    rows = [(i, [*range(1, 10), 100 + i // 3]) for i in range(300)]
    common = spark.createDataFrame(rows, "id long, sig array<long>")
    monkeypatch.setattr(sketch_join, "_met_within", None)
    assert _found(sketch_join.neighbours(common, 0.05, K, SIZE)) == _found(PairJob(common, "approxANI", theta=K, sketch_size=SIZE, high=0.05).pairs())
    monkeypatch.setattr(sketch_join, "_EMIT_PAIRS", 50)
    monkeypatch.setattr(sketch_join, "slice_count", lambda *_: 3)
    monkeypatch.setattr(sketch_join, "_meetings", lambda *_: 1 << 40)
    assert _found(sketch_join.neighbours(refs, limit, K, SIZE)) == pairs and pairs
    assert _found(sketch_join.neighbours(refs, limit, K, SIZE, asked)) == found and found


@pytest.mark.parametrize("how", ["inner", "left"])
def test_dealt_join_equals_a_join(spark, how):
    large = spark.createDataFrame([(None if i % 11 == 10 else 0 if i % 3 else i, i) for i in range(900)], "k long, v long")
    small = spark.createDataFrame([(i, f"x{i}") for i in range(0, 900, 2)] + [(0, "again")], "k long, name string")
    got = dealing.dealt_join(large, small, ["k"], ["v"], how, per_task=50)
    assert sorted(map(str, got.select("k", "v", "name").collect())) == sorted(map(str, large.join(small, "k", how).select("k", "v", "name").collect()))


def test_a_plan_with_a_limit_uses_the_index(spark):
    lineage = F.array(F.lit("root"), (F.col("id") % 2).cast("string"), *[F.lit(None).cast("string")] * 6)
    sigs = _sketches(spark, 90).withColumn("ord", 1000 - F.col("id")).withColumn("lineage", lineage)
    plan = ComparePlan(method="approxANI", theta=K, below=0.3, above=0.01, include_self=True, signature=SignaturePlan("minhash", 21, sketch_size=SIZE))
    for p in (plan, plan.with_(include_self=False, only=None)):
        got, want = p.pairs(sigs), p.job(p.prepare(sigs)).pairs()
        assert got.columns == want.columns

        def rounded(df):
            return sorted(str(r) for r in df.withColumn("dist", F.round("dist", 9)).collect())
        assert rounded(got) == rounded(want)


def _tile(n, seed, side=None, size=SIZE):
    """Sketches of few words of uneven frequency as one side of a tile."""
    rng = np.random.default_rng(seed)
    share = 1 / (1 + np.arange(400)) ** 0.7
    sigs = [np.sort(rng.choice(400, rng.integers(1, size + 1), replace=False, p=share / share.sum())).tolist() for _ in range(n)]
    side = 2 if side is None else side
    return pa.table({"id": pa.array(np.arange(n) + 1_000 * side), "sig": pa.array(sigs, pa.list_(pa.int64())), "_side": pa.array([side] * n)})


@pytest.mark.parametrize("common", [1e-9, 1 / 64, 2.0])
def test_a_tile_counts_by_matrices_and_by_meetings_alike(monkeypatch, common):
    monkeypatch.setattr(sketch_join, "_COMMON", common)
    for name, value in (("_BLOCK_ROWS", 7), ("_BLOCK_COLUMNS", 11), ("_MET", 13), ("_EMIT_PAIRS", 50)):
        monkeypatch.setattr(sketch_join, name, value)
    least, names = 0.2, ["id_a", "id_b", "shared", "every"]
    for table in (_tile(60, 1), pa.concat_tables([_tile(40, 2, 0), _tile(50, 3, 1)])):
        rows = list(zip(table["id"].to_pylist(), table["_side"].to_pylist(), table["sig"].to_pylist()))
        want = set()
        for x, (a, side_a, sig_a) in enumerate(rows):
            for b, side_b, sig_b in rows[x + 1:]:
                if side_a == side_b != 2:
                    continue
                cut = min([s[-1] for s in (sig_a, sig_b) if len(s) >= SIZE], default=1 << 62)
                shared = len(set(sig_a) & set(sig_b))
                every = sum(h <= cut for h in sig_a) + sum(h <= cut for h in sig_b) - shared
                if shared and shared >= least * every:
                    want.add((min(a, b), max(a, b), shared, every))
        batches = sketch_join._emit_close(least, SIZE, True, names)(iter(table.combine_chunks().to_batches()))
        found = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        assert len(found) == len(set(found)) and set(found) == want and want


def test_common_hashes_get_columns():
    """Most meetings of a tile lie in few hashes; they are not looked at one by one."""
    looked = []
    side = sketch_join._Sketches(_tile(300, 4), 0.2, SIZE)
    original = sketch_join._look
    sketch_join._look = lambda *args: (looked.append(int((args[3] - args[2]).sum())), original(*args))
    try:
        list(sketch_join._shared(side, side, True))
    finally:
        sketch_join._look = original
    counts = np.bincount(side.hashes)
    assert sum(looked) < (counts.astype(float) ** 2).sum() / 10

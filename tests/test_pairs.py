import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.functions import kernels, vectors as V
from sigloom.model import RELATION_LABELS
from sigloom.operators import pairs, profiles, reports, taxonomy as T
from sigloom.operators.pairs import PairJob, slice_count

A, B = [1.0, 1.01, 0.9, 1.2], [1.0, 1.0, 0.95, 1.3]


@pytest.fixture(scope="module")
def random_sigs(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(150, 7)).round(3)
    return m, spark.createDataFrame([(i, i % 4, [float(x) for x in row]) for i, row in enumerate(m)], "id long, grp long, sig array<double>")


def pairs_of(job):
    return {(r["id_a"], r["id_b"]): r["dist"] for r in job.pairs().collect()}


@pytest.mark.parametrize("method, theta, value", [
    ("manhattan", None, 0.16), ("euclid", None, 0.0126), ("PaSiT", 0.02, 0.625), ("hamming", None, 0.75), ("sateucl", 0.02, 0.75), ("corr", None, 0.016891)])
def test_distances_by_hand(spark, method, theta, value):
    sigs = spark.createDataFrame([(1, A), (2, B)], "id long, sig array<double>")
    got = PairJob(sigs, method, theta=theta).pairs().first()["dist"]
    assert got == pytest.approx(value, abs=1e-6)
    row = spark.createDataFrame([(A, B)], "a array<double>, b array<double>")
    column = {"manhattan": V.manhattan("a", "b"), "euclid": V.euclid_sq("a", "b"), "PaSiT": V.saturated_manhattan("a", "b"),
              "hamming": V.saturated_manhattan("a", "b", 0), "sateucl": V.saturated_euclid("a", "b"), "corr": V.pearson_distance("a", "b")}[method]
    assert row.select(column).first()[0] == pytest.approx(got, abs=1e-9)


@pytest.mark.parametrize("rows_per_tile", [8, 64, 1024])
def test_every_pair_once_whatever_the_tile_size(random_sigs, rows_per_tile):
    m, sigs = random_sigs
    got = pairs_of(PairJob(sigs, "manhattan", rows_per_tile=rows_per_tile))
    assert len(got) == 150 * 149 // 2
    for (a, b), d in got.items():
        assert a < b and d == pytest.approx(np.abs(m[a] - m[b]).sum())


def test_one_dominating_group_is_spread(spark):
    rows = [(i, 0 if i % 3 else i, [float(i), 1.0]) for i in range(120)]
    sigs = spark.createDataFrame(rows, "id long, grp long, sig array<double>")
    sums = {r["id"]: r["dist_sum"] for r in PairJob(sigs, "manhattan", within="grp", rows_per_tile=16).row_sums().collect()}
    big = [i for i, g, _ in rows if g == 0]
    assert sums[big[5]] == sum(abs(big[5] - j) for j in big)


def test_search_is_refs_by_queries(random_sigs):
    m, sigs = random_sigs
    refs, queries = sigs.where("id < 100"), sigs.where("id >= 100")
    got = pairs_of(PairJob(refs, "euclid", queries=queries, rows_per_tile=32))
    assert len(got) == 100 * 50
    assert got[7, 120] == pytest.approx(np.square(m[7] - m[120]).sum())


def test_nearest_and_medoid(random_sigs):
    m, sigs = random_sigs
    d = np.abs(m[:, None] - m[None]).sum(-1)
    off = d + np.diag([np.inf] * len(m))
    got = {r["id"]: r["nearest_id"] for r in PairJob(sigs, "manhattan", rows_per_tile=32).nearest().collect()}
    assert got == {i: int(off[i].argmin()) for i in range(len(m))}
    for r in profiles.medoids(sigs, "grp").collect():
        members = np.arange(r["grp"], len(m), 4)
        assert r["id"] == members[d[np.ix_(members, members)].sum(1).argmin()]


def test_incomparable_and_undefined_pairs(spark):
    sigs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, None), (5, [1.0, 1.0]), (6, [3.0, 9.0])], "id long, sig array<double>")
    got = pairs_of(PairJob(sigs, "corr"))
    assert got[1, 2] is None and got[1, 3] is None and got[3, 4] is None
    assert (1, 5) not in got and got[1, 6] == pytest.approx(0.0)  # a constant vector has no correlation
    assert set(pairs_of(PairJob(sigs, "corr", high=1.0))) == {(1, 6)}
    printed = {(r["File1"], r["File2"]): r["Distance"] for r in reports.pair_list(PairJob(sigs, "corr").pairs()).collect()}
    assert printed["1", "2"] == "-1.000000"


def test_relation_by_hand(spark):
    def rel(a, b):
        full = lambda x: None if x is None else [None] + x + [None] * (8 - len(x))
        df = spark.createDataFrame([(full(a), full(b))], "a array<string>, b array<string>")
        return df.select(T.relation("a", "b")).first()[0]
    assert rel(["p1", "c1", "o1"], ["p1", "c1", "o2"]) == 2
    assert rel(["p1", None, "o1"], ["p1", "c9", "o1"]) == 3
    assert rel(["p1"], ["p2"]) == 0 and rel(None, ["p1"]) == -1
    assert RELATION_LABELS[2] == "Same_Class"


def test_relation_in_tiles_equals_the_expression(spark):
    rng = np.random.default_rng(2)
    pick = lambda r: [None if rng.random() < 0.2 else f"{r}{rng.integers(2)}" for r in "kpcofgsti"]
    rows = [(i, None if i % 11 == 0 else pick(i)) for i in range(60)]
    sigs = spark.createDataFrame(rows, "id long, lineage array<string>")
    tiles = {(r["id_a"], r["id_b"]): r["relation"] for r in PairJob(sigs, rows_per_tile=16).pairs().collect()}
    a, b = sigs.select(F.col("id").alias("i"), F.col("lineage").alias("x")), sigs.select(F.col("id").alias("j"), F.col("lineage").alias("y"))
    plain = {(r["i"], r["j"]): r["r"] for r in a.join(b, F.col("i") < F.col("j")).select("i", "j", T.relation("x", "y").alias("r")).collect()}
    assert tiles == plain


def test_histogram_counts_all_pairs(random_sigs):
    _, sigs = random_sigs
    hist = PairJob(sigs, "manhattan", rows_per_tile=32).histogram(0.5)
    assert hist.agg(F.sum("weight")).first()[0] == 150 * 149 // 2
    wide = reports.histogram_table(hist, 0.5).orderBy("bin").collect()
    assert [r["bin"] for r in wide] == list(range(len(wide))) and wide[3]["centre"] == 1.75


def test_matrix_is_symmetric_with_its_diagonal(spark):
    sigs = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id long, sig array<double>")
    labels = spark.createDataFrame([(i, i, f"g{i}") for i in range(5)], "id long, ord long, name string")
    lines = [r["line"] for r in reports.matrix_lines(PairJob(sigs, "manhattan", include_self=True, high=3.0).pairs(), labels).orderBy("ord").collect()]
    assert lines[0] == "g0,0.000000,1.000000,2.000000,3.000000,NaN" and lines[4].startswith("g4,NaN,3.000000")


def test_plan_shape(random_sigs):
    _, sigs = random_sigs
    plan = PairJob(sigs, "PaSiT").pairs()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_slice_count_bounds_a_tile():
    assert slice_count(10 ** 6, 1024, 8) == math.ceil(10 ** 6 / 1024)
    assert slice_count(10, 1024, 8) == 1


def test_windows_are_compared_on_their_own(spark, contigs):
    from sigloom.plans.compare import ComparePlan, SignaturePlan

    df = contigs({1: ["ACGT" * 10], 2: ["ACGT" * 5 + "TTTTT" * 4], 3: ["ACG"]})
    plan = ComparePlan(method="manhattan", include_self=False, signature=SignaturePlan("freq", 2, window=20, window_step=20))
    got = {(r["id_a"], r["id_b"]): r["dist"] for r in plan.pairs(plan.signature.build(df)).collect()}
    assert set(got) == {(a, b) for a in ("1:0.0", "1:0.1", "2:0.0", "2:0.1") for b in ("1:0.0", "1:0.1", "2:0.0", "2:0.1") if a < b}
    assert got["1:0.0", "1:0.1"] == 0 == got["1:0.0", "2:0.0"] and got["1:0.0", "2:0.1"] > 1


@pytest.mark.parametrize("rows_per_tile", [4, 100])
def test_topk_search_is_that_of_all_pairs(spark, rows_per_tile):
    rng = np.random.default_rng(8)
    refs, asked = rng.integers(0, 3, (30, 4)).astype(float), rng.integers(0, 3, (9, 4)).astype(float)
    frame = lambda m, start: spark.createDataFrame([(start + i, x.tolist()) for i, x in enumerate(m)], "id long, sig array<double>")
    got = PairJob(frame(refs, 0), "manhattan", queries=frame(asked, 100), rows_per_tile=rows_per_tile, n_rows=30, n_queries=9).search_topk(4).collect()
    dist = np.abs(asked[:, None] - refs[None]).sum(-1)
    expected = {(100 + q, r + 1, int(i), dist[q, i]) for q in range(9) for r, i in enumerate(sorted(range(30), key=lambda i: (dist[q, i], i))[:4])}
    assert {tuple(r) for r in got} == expected


def test_weights_with_a_dominating_group(spark):
    lineages = [["k__W", "p__A"] if i % 3 == 0 else None if i % 3 == 1 else ["k__W", f"p__{i}"] for i in range(90)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lineages)], "id long, lineage array<string>")
    got = {r["id"]: r["weight"] for r in T.genome_weights(df, "phylum").collect()}
    assert got == {i: pytest.approx(1 / 30) if i % 3 == 0 else 1.0 for i in range(90)}


def test_a_tile_holds_a_bounded_number_of_pairs(monkeypatch):
    from sigloom.operators import pairs as module

    class Side:
        n = 300
        lengths, missing, values, lineage, group = np.full(300, 2), np.zeros(300, bool), np.arange(600.0), None, None
        starts, order = np.arange(300) * 2, np.arange(300)
        matrix = module._Rows.matrix

    monkeypatch.setattr(module, "_BLOCK_PAIRS", 3_000, raising=False)
    spec = dict(method="manhattan", theta=None, scale="none", common_format=False, sketch_size=None, length_tail=False, include_self=False, lineage=False,
                low=None, high=None, only=None, drop_incomparable=False)
    blocks = list(module._compare(Side(), Side(), True, spec))
    assert max(len(i) for i, *_ in blocks) <= 3_000
    assert {(a, b): x for i, j, _, d in blocks for a, b, x in zip(i.tolist(), j.tolist(), d.tolist())} == {(a, b): 4.0 * (b - a) for a in range(300) for b in range(a + 1, 300)}


def test_matrix_cells_travel_as_runs(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(reports, "_RUN_CELLS", 1_000)
    cells = [(i % 7, i, None if i == 5 else i / 2) for i in range(2_500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*cells[at:at + 250])], names=["row", "_c", "value"]) for at in range(0, 2_500, 250)]
    runs = [r for b in reports._packer(["row", "_c", "value"])(iter(batches)) for r in b.to_pylist()]
    assert len(runs) == 3 * 7 and sorted((r["row"], c, v) for r in runs for c, v in zip(r["_c"], r["value"]) if v is not None) == sorted(x for x in cells if x[2] is not None)
    sigs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, sig array<double>")
    pairs = PairJob(sigs, "manhattan", include_self=True).pairs()
    plan = reports.matrix_cells(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1  # every pair is compared once for both of its cells
    assert {(r["row"], r["col"]): r["value"] for r in reports.matrix_cells(pairs).collect()} == {(i, j): float(abs(i - j)) for i in range(40) for j in range(40)}
    labels = spark.createDataFrame([(i, 29 - i, f"n{i}") for i in range(30)], "id long, ord long, name string")
    lines = {r["ord"]: r["line"] for r in reports.matrix_lines(pairs.where("id_a <> 3 or id_b <> 4"), labels).collect()}
    want = lambda i, j: "NaN" if {i, j} == {3, 4} else f"{abs(i - j):.6f}"
    assert lines == {29 - i: ",".join([f"n{i}", *(want(i, j) for j in range(29, -1, -1))]) for i in range(30)}


def test_nearest_sorts_only_ties(monkeypatch):
    rng = np.random.default_rng(5)
    me, you = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(90), indexing="ij"))
    dist, order, sizes = rng.integers(0, 40, len(me)) / 4, rng.permutation(90), []
    want = [min(range(i * 90, i * 90 + 90), key=lambda p: (dist[p], order[you[p]])) for i in range(60)]
    sort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    assert pairs._nearest_of(me, you, dist, order).tolist() == want
    assert sizes[0] < len(me) // 10
    dist[::7] = np.nan
    found = pairs._nearest_of(me, you, dist, order)
    assert (dist[found] == np.nanmin(dist.reshape(60, 90), axis=1)).all()


def test_six_decimals_and_rounding_are_those_of_the_formatter(spark):
    from pyspark.sql import functions as F
    from sigloom.plans.queries_vectors import rounded
    rng = np.random.default_rng(6)
    values = [*rng.random(2_000), *(rng.integers(0, 10**7, 2_000) / 2e6), *(-rng.random(50)), 0.0, -0.0, 5e-7, 1e-9, -1e-9, 999.9999999, 123456.7, 1e300, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "dist double")
    both = rounded(df.select("dist", F.round("dist", 6).alias("r"), F.format_string("%.6f", "dist").alias("f"), reports.six_decimals("dist").alias("s")))
    assert both.where("not (dist <=> r) or cast(dist as string) <> cast(r as string) or f <> s").collect() == []
    plan = rounded(df)._jdf.queryExecution().executedPlan().toString()
    assert "rint" in plan.lower()
    assert rounded(spark.range(3), "id").schema["id"].dataType.simpleString() == "bigint"


def _tile_of_pairs(matrix, method, **more):
    """What one tile of all rows sends, from rows in no order."""
    import pyarrow as pa

    spec = dict(id="id", order="id", method=method, theta=0.1, scale="none", common_format=False, sketch_size=None, length_tail=False, include_self=False, lineage=False,
                low=None, high=None, only=None, drop_incomparable=False, weighted=False, within=None, oriented=True, rectangle=False, carry_order=False, names=["id_a", "id_b", "dist"], **more)
    ids = np.random.default_rng(3).permutation(len(matrix))
    rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(matrix[ids])), pa.array(np.full(len(ids), 2))], names=["id", "sig", "_side"])
    return pa.Table.from_batches(list(pairs._emit_pairs(spec)(iter([rows]))))


@pytest.mark.parametrize("method, most", [("exceed", 1.1), ("spearman", 2.3), ("pearson", 7.0)])
def test_pairs_are_written_small(method, most):
    import pyarrow as pa
    import pyarrow.parquet as pq

    m = np.random.default_rng(9).normal(size=(1_400, 64)) / 8
    found = _tile_of_pairs(m, method)
    a, b, dist = (found[c].to_numpy() for c in found.column_names)
    assert (a < b).all() and len(set(zip(a.tolist(), b.tolist()))) == len(a) == 1_400 * 1_399 // 2
    if method == "pearson":
        assert dist == pytest.approx((1 - np.corrcoef(m)[a, b]) / 2, abs=1e-9)
    sink = pa.BufferOutputStream()
    with pq.ParquetWriter(sink, found.schema, compression="snappy") as out:
        out.write_table(found.set_column(2, "dist", pa.array(np.rint(dist * 1e6) / 1e6)))
    assert sink.getvalue().size / len(a) < most


def test_pairs_to_be_sorted_are_not_laid_out_first(monkeypatch):
    monkeypatch.setattr(pairs, "_laid_out", lambda dist: 1 / 0)
    m = np.random.default_rng(1).integers(0, 9, (50, 3)).astype(float)
    got = {(r["id_a"], r["id_b"]): r["dist"] for r in _tile_of_pairs(m, "manhattan", laid_out=False).to_pylist()}
    assert got == {(i, j): np.abs(m[i] - m[j]).sum() for i in range(50) for j in range(i + 1, 50)}


def test_a_tile_holds_few_pairs_to_lay_them_out(monkeypatch):
    monkeypatch.setattr(pairs, "_BLOCK_PAIRS", 2_000)
    monkeypatch.setattr(pairs, "_LAID_PAIRS", 10_000)
    monkeypatch.setattr(pairs, "_BATCH_PAIRS", 3_000)
    monkeypatch.setattr(pairs, "_FEW_VALUES", 10)
    held, laid_out = [], pairs._laid_out
    monkeypatch.setattr(pairs, "_laid_out", lambda dist: held.append(len(dist)) or laid_out(dist))
    m = np.random.default_rng(4).integers(0, 60, (400, 3)).astype(float)
    m[7] = np.nan
    found = _tile_of_pairs(m, "manhattan")
    assert max(held) < 12_000 and max(c.num_rows for c in found.to_batches()) <= 3_000
    got = {(r["id_a"], r["id_b"]): r["dist"] for r in found.to_pylist()}
    assert got == {(i, j): np.abs(m[i] - m[j]).sum() for i in range(400) for j in range(i + 1, 400) if 7 not in (i, j)}


def test_sketches_are_indexed_once_for_all_blocks(monkeypatch):
    from sigloom.functions import kernels

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 30)))[:12].astype(float) for _ in range(90)]
    sets[4], sets[5] = sets[4][:0], sets[6]
    top = lambda x: x[-1] if len(x) >= 12 else math.inf

    def alike(x, y):
        cut = min(top(x), top(y))
        shared, every = len(set(x) & set(y)), (x <= cut).sum() + (y <= cut).sum()
        return shared / (every - shared) if every else math.nan

    want = np.array([[alike(x, y) for y in sets] for x in sets])
    whole, keep = kernels.Sketches(sets), np.arange(90) % 3 > 0
    np.testing.assert_array_equal(kernels.sketch_resemblance(whole, whole, 12), want)
    np.testing.assert_array_equal(kernels.sketch_resemblance(sets, whole[keep], 12), want[:, keep])
    np.testing.assert_array_equal(kernels.sketch_resemblance(whole[keep], whole[~keep], 12), want[np.ix_(keep, ~keep)])
    sizes, indexed = [], kernels.Sketches.__init__
    monkeypatch.setattr(kernels.Sketches, "__init__", lambda self, lists: indexed(self, lists) or sizes.append(len(self)))
    monkeypatch.setattr(pairs, "_BLOCK_PAIRS", 900)
    got = _tile_of_pairs(np.array(sets, dtype=object), "approxANI")
    assert sizes.count(90) == 1 and len(got) == 90 * 89 // 2 - np.isnan(np.triu(want, 1)).sum()


def test_small_whole_numbers_are_summed_as_integers(monkeypatch):
    rng = np.random.default_rng(3)
    counts = rng.poisson(9, (90, 50)).astype(float) - 4
    cases = [(kernels.manhattan, {}), (kernels.euclid_sq, {"scale": "inverse_dims"}), (kernels.hamming, {}), (kernels.element_hamming, {"scale": "mean"}),
             (kernels.saturated_manhattan, {"theta": 3.0}), (kernels.manhattan, {"scale": "mean"})]
    wide = counts * 900  # sums of squares need more than 32 bits
    tiny, huge = counts.copy(), counts.copy()
    tiny[0, 0], huge[0, 0] = 1e-20, 1e18
    gaps = counts.copy()
    gaps[3, 3], gaps[4, 4] = np.nan, np.inf
    for rows, whole in ((counts, True), (wide, None), (counts + 0.5, False), (tiny, False), (huge, False), (gaps, False)):
        for method, extra in cases:
            used = []
            with monkeypatch.context() as m, np.errstate(invalid="ignore"):
                plain = kernels._accumulate_whole
                m.setattr(kernels, "_accumulate_whole", lambda *args: (used.append(1), plain(*args))[1])
                found = method(rows[:40], rows[40:], **extra)
                m.setattr(kernels, "_whole_numbers", lambda *args: None)
                np.testing.assert_array_equal(found, method(rows[:40], rows[40:], **extra))
            assert whole is None or bool(used) == whole


def test_a_histogram_makes_no_index_of_its_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.poisson(6, 12)], None if i == 4 else ["World", f"p{i % 2}", None if i % 7 == 0 else f"c{i % 3}"], 1 / (1 + i % 4)) for i in range(50)]
    table = pa.table({"id": pa.array([r[0] for r in rows]), "sig": pa.array([r[1] for r in rows]), "lineage": pa.array([r[2] for r in rows]), "weight": pa.array([r[3] for r in rows]),
                      "_side": pa.array([pairs._SIDE_BOTH] * len(rows))})
    job = PairJob(spark.createDataFrame(rows, "id long, sig array<double>, lineage array<string>, weight double"), "manhattan")
    spec = {**job.spec, "weighted": True, "round_bins": False, "bin_width": 0.7, "names": ["bin", "relation", "weight"]}
    want = {}
    left = pairs._Rows(table, spec)
    for i, j, relation, dist in pairs._compare(left, left, True, spec):
        for a, b, r, d in zip(i, j, relation, dist):
            key = (int(d // 0.7), int(r))
            want[key] = want.get(key, 0) + rows[a][3] * rows[b][3]
    for few in (1 << 20, 0):
        monkeypatch.setattr(pairs, "_FEW_KEYS", few)
        with monkeypatch.context() as m:
            m.setattr(pairs, "_compare", None)
            found = {(x["bin"], x["relation"]): x["weight"] for batch in pairs._emit_histogram(spec)(iter(table.to_batches())) for x in batch.to_pylist()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import alignment
from sigloom.functions.stats import regularised_beta
from sigloom.operators import cluster, genes, marks
from sigloom.operators.pairs import PairJob

N = 18


@pytest.fixture(scope="module")
def points(spark):
    p = np.random.default_rng(5).normal(size=(N, 3))
    d = np.sqrt(np.square(p[:, None] - p[None]).sum(-1))
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(N) for j in range(i + 1, N)], "id_a long, id_b long, dist double")
    return d, pairs, spark.createDataFrame([(i, f"L{i}") for i in range(N)], "id long, name string")


def brute(d, linkage):
    """Merge one pair at a time; an infinite distance is a missing one."""
    d = (d ** 2 if linkage == "ward" else d).copy()
    np.fill_diagonal(d, np.inf)
    live, out = {i: (i, 1, i) for i in range(len(d))}, []
    for step in range(len(d) - 1):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        h = d[i, j]
        if not np.isfinite(h):
            break
        left, right = sorted((live[i], live[j]), key=lambda t: t[2])
        out.append((step, left[0], right[0], pytest.approx(h), left[1] + right[1]))
        for o in set(live) - {i, j}:
            wi, wj, wo = live[i][1], live[j][1], live[o][1]
            d[i, o] = d[o, i] = min(d[i, o], d[j, o]) if linkage == "single" else ((wi + wo) * d[i, o] + (wj + wo) * d[j, o] - wo * h) / (wi + wj + wo)
        d[j], d[:, j] = np.inf, np.inf
        live[i] = (len(d) + step, live[i][1] + live.pop(j)[1], left[2])
    return out


def rows(merges):
    return sorted(tuple(r) for r in merges.select("step", "left", "right", "height", "size").collect())


@pytest.mark.parametrize("block", [256, 3])
def test_single_linkage(points, block):
    d, pairs, leaves = points
    assert rows(cluster.single_linkage(pairs, leaves, block_edges=block)) == brute(d, "single")


def test_ward_linkage(points):
    d, pairs, leaves = points
    assert rows(cluster.ward_linkage(pairs, leaves)) == brute(d, "ward")


def brute_ratios(d):
    """``step, clusters, within, between, f`` of the merges, one after the other on the whole matrix."""
    live, within, out = {i: [i] for i in range(len(d))}, 0.0, []
    sq = d ** 2

    def between(x, y):
        x, y = live[x], live[y]
        inner = lambda g: sum(sq[i, j] for i in g for j in g if i < j)
        across = sum(sq[i, j] for i in x for j in y)
        return 2 / (len(x) + len(y)) * (across - len(y) / len(x) * inner(x) - len(x) / len(y) * inner(y)) if np.isfinite(across) else np.inf

    for step, left, right, height, size in brute(d, "ward"):
        if not np.isfinite(height.expected):
            break
        live[len(d) + step] = live.pop(left) + live.pop(right)
        within += size * height.expected
        every = [v for v in (between(x, y) for x in live for y in live if x < y) if np.isfinite(v)]
        f = pytest.approx(within / sum(every)) if every else None
        out.append((step, len(live), pytest.approx(within), pytest.approx(sum(every)), f))
    return out


@pytest.mark.parametrize("block", [256, 4])
@pytest.mark.parametrize("missing", [False, True])
def test_variance_ratio_of_ward_merges(points, holes, block, missing):
    d, pairs = holes if missing else points[:2]
    leaves = points[2]
    ratios = cluster.ward_f_statistic(pairs, leaves, cluster.ward_linkage(pairs, leaves), block)
    expected = brute_ratios(d)
    assert sorted(tuple(r) for r in ratios.select("step", "clusters", "within", "between", "f").collect()) == expected
    limit = expected[len(expected) // 2][4].expected
    wanted = min([r[1] for r in expected if r[4] is not None and r[4].expected < limit], default=N)
    assert cluster.ward_cluster_count(ratios, leaves, limit).first()[0] in (wanted, wanted - 1)
    assert cluster.ward_cluster_count(ratios, leaves, 0.0).first()[0] == N


def test_variance_ratio_without_merges(spark, points):
    leaves = points[2]
    none = spark.createDataFrame([], "id_a long, id_b long, dist double")
    ratios = cluster.ward_f_statistic(none, leaves, cluster.ward_linkage(none, leaves))
    assert ratios.count() == 0 and cluster.ward_cluster_count(ratios, leaves).first()[0] == N


@pytest.fixture(scope="module")
def holes(spark, points):
    """Two groups without any distance between them, a leaf without distances, and pairs that are missing or NULL."""
    d = points[0].copy()
    d[:8, 8:] = d[8:, :8] = np.inf
    d[17, :] = d[:, 17] = np.inf
    d[2, 5] = d[5, 2] = d[9, 12] = d[12, 9] = np.inf
    rows = [(i, j, float(d[i, j]) if np.isfinite(d[i, j]) else None) for i in range(N) for j in range(i + 1, N) if np.isfinite(d[i, j]) or (i + j) % 2]
    return d, spark.createDataFrame(rows, "id_a long, id_b long, dist double")


@pytest.mark.parametrize("linkage", ["single", "ward"])
def test_missing_distances_keep_clusters_apart(points, holes, linkage):
    _, _, leaves = points
    d, pairs = holes
    expected = [r for r in brute(d, linkage) if np.isfinite(r[3].expected)]
    merge = cluster.single_linkage if linkage == "single" else cluster.ward_linkage
    assert rows(merge(pairs, leaves)) == expected


def test_forest_leaves_have_places_of_their_own(points, holes):
    _, _, leaves = points
    merges = cluster.single_linkage(holes[1], leaves, block_edges=4)
    order = {r["id"]: r["pos"] for r in cluster.leaf_order(merges, leaves, N).collect()}
    assert sorted(order.values()) == list(range(N))
    for r in merges.where(F.col("size") == 2).collect():
        assert abs(order[r["left"]] - order[r["right"]]) == 1


@pytest.mark.parametrize("rows_per_tile", [5, 100])
def test_forest_of_tiles_has_the_same_tree(spark, points, rows_per_tile):
    p = np.random.default_rng(3).integers(0, 4, size=(40, 3)).astype(float)
    sigs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "id long, sig array<double>")
    job = lambda: PairJob(sigs, "manhattan", rows_per_tile=rows_per_tile, n_rows=40)
    tree = lambda df: sorted(tuple(r) for r in cluster.minimum_spanning_tree(df).collect())
    assert tree(job().forest()) == tree(job().pairs()) and job().forest().count() < 40 * 40 // 2 + 1


def test_newick_reads_back(points):
    d, pairs, leaves = points
    merges = cluster.single_linkage(pairs, leaves)
    tokens = cluster.newick_tokens(merges, leaves, N).orderBy("pos", "phase", "key").collect()
    text = "".join(t["token"] for t in tokens)
    assert text.endswith(";") and text.count("(") == text.count(")") == text.count(",") == N - 1
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        assert depth >= 0
    order = {r["id"]: r["pos"] for r in cluster.leaf_order(merges, leaves, N).collect()}
    assert sorted(order.values()) == list(range(N))
    for r in merges.where(F.col("size") == 2).collect():
        assert abs(order[r["left"]] - order[r["right"]]) == 1


def test_breakpoint_is_the_smallest_error(spark):
    f = sorted([0.1, 0.2, 0.25, 0.4, 0.5, 2.0, 3.9, 6.0, 8.5])
    n = len(f)
    def error(b):
        left = sum((f[i] - f[b] / b * i) ** 2 for i in range(b))
        return left + sum((f[i] - (f[b] + (f[-1] - f[b]) / (n - b) * (i - b))) ** 2 for i in range(b, n))
    found = cluster.best_breakpoint(spark.createDataFrame([(x,) for x in f], "v double")).first()
    best = min(range(1, n), key=error)
    assert found["rank"] == best and found["mse"] == pytest.approx(error(best))


def test_alignment_against_exhaustive_search():
    def brute_cost(a, b):
        @functools.lru_cache(None)
        def go(i, j, last):
            if i == len(a) and j == len(b):
                return 0, 0, 0
            options = []
            if i < len(a) and j < len(b):
                same = a[i] == b[j]
                options.append((0 if same else 2, -int(same), go(i + 1, j + 1, "m")))
            if i < len(a):
                options.append((1 if last in ("", "a") else 3, 0, go(i + 1, j, "a")))
            if j < len(b):
                options.append((1 if last in ("", "b") else 3, 0, go(i, j + 1, "b")))
            return min((c + r[0], s + r[1], 1 + r[2]) for c, s, r in options)
        return go(0, 0, "")
    rng = random.Random(3)
    words = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 8))) for _ in range(160)]
    a, b = words[::2], words[1::2]
    cost, identities, length, _ = alignment.align_many([alignment.encode(x) for x in a], [alignment.encode(x) for x in b])
    assert [(int(c), -int(i), int(n)) for c, i, n in zip(cost, identities, length)] == [brute_cost(x, y) for x, y in zip(a, b)]


def test_planted_gene_is_found_on_the_reverse_strand(spark, contigs):
    rng = random.Random(8)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    gene = base(120)
    changed = gene[:40] + ("A" if gene[40] != "A" else "C") + gene[41:]
    reverse = changed[::-1].translate(str.maketrans("ACGT", "TGCA"))
    found = genes.find_genes(contigs({1: [base(300), base(250) + reverse + base(90)], 2: [base(500)], 3: [base(33) + gene + base(300)]}),
                             spark.createDataFrame([(7, gene)], "gene_id long, gene string"))
    got = {r["genome_id"]: r for r in found.collect()}
    assert set(got) == {1, 3}
    assert got[1]["strand"] == "-" and got[1]["ord"] == 1 and got[1]["identities"] == 119 and got[1]["seq"] == changed
    assert got[3]["strand"] == "+" and got[3]["score"] == 1.0 and got[3]["end"] == 153
    pairs = PairJob(genes.gene_signature(found, spark.createDataFrame([(7, gene)], "gene_id long, gene string")), "alignseqs").pairs().collect()
    assert pairs[0]["dist"] == pytest.approx(1 / 120)
    two = spark.createDataFrame([(7, gene), (8, base(50))], "gene_id long, gene string")
    joined = genes.gene_pair_distances(found.select("genome_id", "gene_id", "seq"), two).collect()
    assert [(r["id_a"], r["id_b"]) for r in joined] == [(1, 3)] and joined[0]["dist"] == pytest.approx(1 - 119 / 121)


def test_marks_do_not_depend_on_the_chunk(spark):
    rng = random.Random(1)
    flags = [rng.random() < 0.4 for _ in range(200)]
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(flags)], "k long, pos long, mark boolean")
    read = lambda out: [r["mark"] for r in out.orderBy("pos").collect()]
    for chunk in (7, 1000):
        assert read(marks.dilate(df, ["k"], "pos", "mark", 2, chunk)) == [any(flags[max(0, i - 2):i + 3]) for i in range(200)]
        assert read(marks.erode(df, ["k"], "pos", "mark", 2, chunk)) == [all(flags[max(0, i - 2):i + 3]) for i in range(200)]
    runs = lambda chunk: sorted(tuple(r) for r in marks.runs(df, ["k"], "pos", "mark", chunk).select("begin", "length", "mark").collect())
    assert runs(7) == runs(1000) == runs(3) and sum(r[1] for r in runs(7)) == 200
    assert read(marks.bridge_gaps(df, ["k"], "pos", "mark", 3, 7)) == read(marks.bridge_gaps(df, ["k"], "pos", "mark", 3, 1000))


def test_incomplete_beta_closed_forms():
    x = np.array([0.0, 0.1, 0.5, 0.9, 1.0])
    assert regularised_beta(x, 1, 1) == pytest.approx(x)
    assert regularised_beta(x, 2, 3) == pytest.approx(6 * x ** 2 - 8 * x ** 3 + 3 * x ** 4)


def test_one_long_sequence_is_joined_over_two_sizes_of_chunks(spark):
    flags = [i % 50 < 30 or i > 300 for i in range(700)]
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(flags)], "k long, pos long, mark boolean")
    expected, at = [], 0
    while at < len(flags):
        end = at
        while end < len(flags) and flags[end] == flags[at]:
            end += 1
        expected.append((at, end - at, flags[at]))
        at = end
    for chunk in (4, 10, 64):
        assert sorted(tuple(r) for r in marks.runs(df, ["k"], "pos", "mark", chunk).select("begin", "length", "mark").collect()) == expected


def test_short_and_repetitive_genes_are_found(spark, contigs):
    rng = random.Random(4)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    panel = {1: base(8), 2: base(11), 3: "AC" * 20, 4: base(3)}
    genomes = {g: [base(60) + gene + base(70)] for g, gene in panel.items()}
    found = genes.find_genes(contigs(genomes), spark.createDataFrame(list(panel.items()), "gene_id long, gene string")).collect()
    whole = {(r["genome_id"], r["gene_id"]) for r in found if r["score"] == 1.0}
    assert {(g, g) for g in panel} <= whole


def test_too_long_pairs_are_refused():
    with pytest.raises(ValueError, match="cannot align"):
        alignment.align_block([np.zeros(1 << 18, np.uint8)], [np.zeros(1 << 18, np.uint8)], False)


def test_genes_are_found_across_the_borders_of_pieces(spark, contigs, monkeypatch):
    rng = random.Random(21)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    gene = base(60)
    cut = genes.in_pieces
    monkeypatch.setattr(genes, "PIECE", 128)
    monkeypatch.setattr(genes, "in_pieces", lambda frame, k, seq_col="seq": cut(frame, k, seq_col, 128))
    places = {1: 100, 2: 0, 3: 127, 4: 640 - 60, 5: 256}
    genomes = {g: [base(at) + gene + base(640 - 60 - at)] for g, at in places.items()}
    found = genes.find_genes(contigs(genomes), spark.createDataFrame([(1, gene)], "gene_id long, gene string")).collect()
    assert {(r["genome_id"], r["end"], r["seq"], r["score"]) for r in found} == {(g, at + 60, gene, 1.0) for g, at in places.items()}


def test_ward_rounds_leave_no_distances_behind(spark, monkeypatch):
    import os

    written = []

    def kept(df):
        written.append(cut_lineage(df))
        return written[-1]

    from sigloom.session import cut_lineage
    monkeypatch.setattr(cluster, "cut_lineage", kept)
    rng = np.random.default_rng(8)
    points = rng.normal(size=(40, 3))
    rows = [(i, j, float(np.linalg.norm(points[i] - points[j]))) for i in range(40) for j in range(i + 1, 40)]
    merges = cluster.ward_linkage(spark.createDataFrame(rows, "id_a long, id_b long, dist double"), spark.range(40))
    assert merges.count() == 39
    distances = [t for t in written if t.columns == ["a", "b", "d"]]
    assert len(distances) > 3 and sum(os.path.exists(t._sigloom_path.removeprefix("file:")) for t in distances) <= 1


def test_ward_rounds_from_signatures_write_few_distances(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 5)) * 4
    sigs = [[float(x) for x in centres[i % 12] + rng.normal(size=5)] for i in range(150)]
    sigs[20], sigs[31], sigs[90] = sigs[19], sigs[30], sigs[30]  # copies
    sigs[5], sigs[6], sigs[77], sigs[78] = None, [], [0.5, 1.0, 2.0], [0.25, 1.0, 2.5]  # leaves without a distance to the others
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sigs)], "id long, sig array<double>")
    job, leaves = PairJob(frame, "manhattan", rows_per_tile=60, n_rows=150), spark.range(150)
    want = {r["step"]: tuple(r) for r in cluster.ward_linkage(job.pairs(), leaves).collect()}
    written = []
    monkeypatch.setattr(cluster, "_TABLE_PAIRS", 500)
    monkeypatch.setattr(cluster, "_TILE_LEAVES", 20)
    monkeypatch.setattr(cluster, "slice_count", lambda *_: 3)
    over = cluster._over_clusters
    monkeypatch.setattr(cluster, "_over_clusters", lambda members, method, nearest: (written.append(None if nearest else over(members, method, nearest).count()), over(members, method, nearest))[1])
    found = {r["step"]: tuple(r) for r in cluster.ward_linkage(job, leaves).collect()}
    assert len(written) > 2 and written[-1] <= 500
    assert found.keys() == want.keys() and len(found) == 146
    for step, (_, left, right, height, size) in want.items():
        assert found[step][1:3] == (left, right) and found[step][4] == size and abs(found[step][3] - height) <= 1e-9 * max(1, height)
    monkeypatch.setattr(cluster, "_LARGE_CLUSTER", 1)  # then the distances of the second round are written
    assert {s: x[1:3] for s, x in ((r["step"], tuple(r)) for r in cluster.ward_linkage(job, leaves).collect())} == {s: x[1:3] for s, x in want.items()}
    assert written[-1] > 500


def test_only_plain_comparisons_go_without_a_table(spark):
    frame = spark.createDataFrame([(i, [float(i * i), 1.0]) for i in range(6)], "id long, sig array<double>")
    assert PairJob(frame, "manhattan").plain_method() == "manhattan"
    assert PairJob(frame, "manhattan", high=9.0).plain_method() is None and PairJob(frame, "PaSiT", theta=0.5).plain_method() is None
    leaves = spark.range(6)
    for job in (PairJob(frame, "manhattan"), PairJob(frame, "manhattan", high=9.0)):
        assert sorted(map(tuple, cluster.ward_linkage(job, leaves).collect())) == sorted(map(tuple, cluster.ward_linkage(job.pairs(), leaves).collect()))

"""Whitening, conversation trie and log-bilinear scores against plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import lbl, prefix_trie, whitening


# ---------------------------------------------------------------------------------------------------------------- whitening
def _reference(vectors, wanted=8):
    x = np.floor(1024 * np.array(vectors, dtype="f8")).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    keep = [i for i in np.argsort(-values)[:wanted] if values[i] > 1e-9 * values.max()]
    return n, ((n * x - sums) ** 2).sum(axis=1), centred @ axes[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


def _whitened(df, wanted=8):
    rows = defaultdict(dict)
    for r in df.collect():
        rows[r["vec_id"]][r["component"]] = r
    return rows


@pytest.mark.parametrize("n,d", [(200, 12), (40, 3), (5, 20)])
def test_whitening_equals_an_eigensolver(spark, n, d):
    vectors = np.random.default_rng(n).normal(size=(n, d)) * np.linspace(1, 3, d)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(7)
    got = _whitened(whitening.whiten(table))
    size, deviation, whitened, explained = _reference(vectors)
    assert set(got) == set(range(n))
    for k in range(len(explained)):
        ours = np.array([got[i][k + 1]["whitened"] for i in range(n)])
        assert min(np.abs(ours - whitened[:, k]).max(), np.abs(ours + whitened[:, k]).max()) < 1e-8
        assert abs(got[0][k + 1]["explained"] / explained[k] - 1) < 1e-10
    assert all(len(r) == len(explained) for r in got.values())
    assert all(got[i][1]["deviation"] == deviation[i] and got[i][1]["n"] == size for i in range(n)) and got[0][1]["identity_error"] < 1e-9


def test_vectors_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 0.5], [0.25, -1.0], [0.0, 2.0], [0.0, 2.0]]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(9, None, 1), (10, [1.0, None], 1), (11, [nan, 1.0], 1), (12, [inf, 1.0], 1), (13, [], 1), (14, [1.0], 1), (None, [3.0, 3.0], 1), (0, good[0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").toDF("vec_id", "embedding", "Vec_Id")
    got = whitening.whiten(table).collect()
    assert Counter(r["vec_id"] for r in got) == {0: 4, 1: 2, 2: 2, 3: 2, None: 2} and {r["n"] for r in got} == {6}
    _, deviation, _, _ = _reference(good + [[3.0, 3.0], good[0]])
    assert {r["deviation"] for r in got if r["vec_id"] == 1} == {deviation[1]}


@pytest.mark.parametrize("rows", [[], [(1, [2.0, 3.0])] * 3, [(1, None)]])
def test_tables_without_variance_have_no_component(spark, rows):
    df = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.count() == 0


@pytest.mark.parametrize("values", [[5.0] * 3 + [1.0] * 10 + [0.5], [9, 8, 7, 6, 5, 4, 3, 2, 2, 2, 2, 1], [4.0], [1.0] * 30, [3.0, 0.0, 0.0], np.geomspace(1e6, 1e-3, 25)])
def test_intervals_hold_what_inertia_counts(values):
    d = len(values)
    turn, _ = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    matrix = turn @ np.diag(np.array(values, "f8")) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found = whitening.intervals(matrix, 8)
    assert sum(c for *_, c in found) >= min(8, sum(v > 0 for v in values))
    want = sorted(values, reverse=True)
    for low, high, count in found:
        got, axes = whitening.feast(matrix, low, high, count)
        assert np.allclose(got, want[:count], rtol=1e-10, atol=1e-10 * max(values)) and np.allclose(axes.T @ axes, np.eye(count), atol=1e-9)
        want = want[count:]


def test_deviation_that_fits_no_long_is_refused(spark):
    table = spark.createDataFrame([(1, [1e12]), (2, [-1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|too large|too big|int"):
        whitening.whiten(table).collect()


# ---------------------------------------------------------------------------------------------------------------- prefix trie
def _brute_trie(rows, rebuild=True):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    conv = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    whole = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = tuple(conv.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    members, children, leaves, saved, out = defaultdict(list), defaultdict(int), {}, {}, []
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = sum(saved[k] for k in below[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if whole[c] == p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


_TURNS = "conv_id long, turn long, role string, text string"


def _conversations(seed, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-120, n):
        kind = rng.integers(4)
        length = int(rng.integers(1, 9)) if kind else 3
        for t in range(length):
            text = "same" if kind == 0 or (kind == 1 and t < 2) else f"text {rng.integers(3)} é"
            rows.append((c, None if t == 0 and kind == 2 else t, ["user", None, "assistant"][t % 3], None if kind == 3 and t == 1 else text))
    rows += [rows[0], rows[0], (None, 1, "user", "lost"), (7_000, 1, "", ""), (7_001, 1, None, None)]
    rows += [(100_000 + i, t, "user", f"line {t}") for i in range(2) for t in range(600)]
    return rows


@pytest.mark.parametrize("block,fan_in", [(100_000, 16), (40, 2), (5, 3)])
def test_trie_equals_brute_force_whatever_the_shards(spark, monkeypatch, block, fan_in):
    monkeypatch.setattr(prefix_trie, "FAN_IN", fan_in)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "TASK", 300 if block < 100 else 400_000)
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = _conversations(block)
    table = spark.createDataFrame(rows, _TURNS).withColumn("Depth", F.lit(1)).repartition(5)
    got = prefix_trie.conversation_trie(table, rebuild=True)
    assert Counter(tuple(r) for r in got.collect()) == _brute_trie(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], _TURNS), rebuild=True).count() == 0
    one = [(105, 0, "user", "x" * 300_000)]  # the group's first conversation is missing
    for rebuild in (True, False):
        got = prefix_trie.conversation_trie(spark.createDataFrame(one, _TURNS), rebuild=rebuild)
        assert Counter(tuple(r) for r in got.collect()) == _brute_trie(one, rebuild)


def test_a_third_of_all_conversations_are_one(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 200)
    monkeypatch.setattr(prefix_trie, "TASK", 500)
    monkeypatch.setattr(prefix_trie, "PIECE", 256)
    rows = [(c, t, "user", f"text {t}") for c in range(1_000) for t in range(3)] + [(c, 0, "user", f"own {c}") for c in range(1_000, 1_500)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, _TURNS).repartition(4))
    assert Counter(tuple(r) for r in got.collect()) == _brute_trie(rows, rebuild=False)


def test_search_tree_is_balanced_and_in_order():
    words = sorted({tuple(np.random.default_rng(i).integers(1, 50, 1 + i % 5).tolist()) for i in range(500)})
    tree = prefix_trie.SearchTree()
    for i in prefix_trie.median_order(len(words)):
        tree.insert(list(words[i]), i)
    prefixes, path = [], []
    for depth, key, end in tree.walk():
        path[depth - 1:] = [key]
        prefixes.append(tuple(path))
        assert (end >= 0) == (tuple(path) in set(words)) and (end < 0 or words[end] == tuple(path))
    assert prefixes == sorted({w[:d] for w in words for d in range(1, len(w) + 1)})


# ---------------------------------------------------------------------------------------------------------------- log-bilinear model
def _texts(n=300):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        mine = ["alpha beta gamma delta", "Rot Blau Grün gelb"][i % 2].split()
        rows.append((i, " ".join(rng.choice(mine, 30).tolist() + [f"w{i}", f"v{i % 40}"])))
    return rows + [(1_000, None), (1_001, ""), (1_002, " \t\n"), (None, "alpha beta"), (None, None), (1_003, "word " * 60_000), (5, rows[5][1])]


SMALL = lbl.Shape(outputs=6, dim=4, noise=8, batch=64, lookup=200)


def _by_hand(rows, model):
    """Scores word by word, from the model's vocabulary and tables."""
    counts = Counter()
    for i, text in rows:
        if i is None or lbl.fold_of(i) != 2:
            counts.update(lbl.tokens(text))
    total, distinct, v = sum(counts.values()), len(counts), model.vocab
    code = dict(zip(v.words, v.codes.tolist()))
    out = []
    for i, text in rows:
        words = lbl.tokens(text)
        codes = [v.class_total.size] * 2 + [code.get(w, v.tail) for w in words]
        score = 0.0
        for a, b, c, word in zip(codes, codes[1:], codes[2:], words):
            scores = [float(model.first[b, k]) + float(model.second[a, k]) for k in range(v.class_total.size)]
            score += (scores[c] - math.log(sum(map(math.exp, scores)))) / math.log(10)
            if c >= v.own:
                n = counts[word]
                share = n / v.class_total[c] if c < v.tail else (n or v.class_words[c] + 1) / (v.class_total[c] + v.class_words[c] + 1)
                score += math.log10(share)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        out.append((i, i is not None and lbl.fold_of(i) == 2, len(words), sum(counts[w] > 0 for w in words), total, round(base, 4), score))
    return out


def test_scores_equal_those_by_hand(spark):
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Row", F.lit(1)).repartition(6)
    model, _, _ = lbl.fitted(docs, SMALL)
    got = sorted((tuple(r) for r in lbl.score(docs, SMALL).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = sorted(_by_hand(rows, model), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [(*r[:5], round(r[5], 4)) for r in got] == [r[:6] for r in want]
    assert all(abs(a[6] - b[6]) <= 2e-3 * max(1.0, abs(b[6])) for a, b in zip(got, want))  # two fits in parallel, four-byte tables


def test_probabilities_add_up_and_the_model_beats_the_base(spark):
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, counts, _ = lbl.fitted(docs, SMALL)
    v = model.vocab
    code = dict(zip(v.words, v.codes.tolist()))
    events = [(code.get(bytes(r["word"]), v.tail), r["n"]) for r in counts.collect()] + [(v.tail, 0)]
    codes, n = np.array([c for c, _ in events]), np.array([n for _, n in events])
    for before, last in ((0, 0), (len(model.first) - 1, 3), (v.tail, v.tail)):
        assert abs((10 ** (model.log10(before, last, codes) + v.within(codes, n))).sum() - 1) < 1e-4
    held = [r for r in lbl.score(docs, SMALL).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("rows", [[], [(2, "one two")], [(None, None)]])
def test_scores_of_tiny_tables(spark, rows):
    got = lbl.score(spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    assert len(got) == len(rows) and all(r["score"] <= 1e-6 and r["base_score"] <= 0 for r in got)


def test_without_training_texts_everything_is_one_event(spark):
    held = next(i for i in range(100) if lbl.fold_of(i) == 2)
    row = lbl.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string"), SMALL).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, 0.0) and abs(row["score"]) < 1e-6

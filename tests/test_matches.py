"""Maximal matches and chains against brute force."""

import itertools

import numpy as np
import pytest

from sigloom.operators import dealing, matches


def _brute(queries, refs, least):
    out = set()
    for (i, a), (j, b) in itertools.product(queries, refs):
        for p in range(len(a)):
            for q in range(len(b)):
                if p and q and a[p - 1] == b[q - 1] and a[p - 1] in "ACGT":
                    continue
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and a[p + n] in "ACGT":
                    n += 1
                if n >= least:
                    out.add((i, j, p, q, n))
    return out


def _texts(seed, n, size):
    rng = np.random.default_rng(seed)
    core = "".join(rng.choice(list("ACGT"), 60))
    rows = [(i, "".join(rng.choice(list("ACGTN"), rng.integers(0, size), p=[.24, .24, .24, .24, .04])) + core[: rng.integers(0, 60)] + "A" * int(rng.integers(0, 20))) for i in range(n)]
    return [*rows, (n, core), (n + 1, ""), (n + 2, "N" * 30), (n + 3, core[5:30] + "T" + core[31:])]


@pytest.mark.parametrize("least,chunk", [(4, None), (6, 8), (9, 3)])
def test_maximal_matches_equal_brute_force(spark, least, chunk, monkeypatch):
    monkeypatch.setattr(dealing, "PER_TASK", 50)
    queries, refs = _texts(1, 8, 90), _texts(2, 6, 70) + [(50, _texts(1, 8, 90)[-4][1] + "G")]
    got = matches.maximal_matches(spark.createDataFrame(queries, "id long, seq string"), spark.createDataFrame(refs, "id long, seq string"), least, chunk)
    rows = [tuple(r) for r in got.select("query", "ref", "query_pos", "ref_pos", "length").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _brute(queries, refs, least)


def test_matches_over_chunks_pieces_and_word_length(spark, monkeypatch):
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("ACGT"), 5_000))
    other = long[100:2_000] + "A" + long[2_001 if long[2_000] != "A" else 2_000:4_900]
    from sigloom.operators import kmers
    monkeypatch.setattr(kmers, "PIECE", 512)
    monkeypatch.setattr(kmers.in_pieces, "__defaults__", ("seq", 512))
    got = matches.maximal_matches(spark.createDataFrame([(1, long)], "id long, seq string"), spark.createDataFrame([(2, other)], "id long, seq string"), 100, chunk=64)
    rows = [tuple(r)[2:] for r in got.collect()]
    assert sum(n for *_, n in rows) >= 4_700 and all(long[p:p + n] == other[q:q + n] for p, q, n in rows)
    assert all(p == 0 or q == 0 or long[p - 1] != other[q - 1] for p, q, n in rows)


def test_heaviest_chain_equals_all_chains():
    rng = np.random.default_rng(7)
    for _ in range(200):
        m = rng.integers(1, 8)
        q, r, n = rng.integers(0, 30, m), rng.integers(0, 30, m), rng.integers(1, 9, m)
        best = 0
        for size in range(1, m + 1):
            for some in itertools.permutations(range(m), size):
                total, ok = int(n[some[0]]), True
                for a, b in zip(some, some[1:]):
                    shared = max(0, q[a] + n[a] - q[b], r[a] + n[a] - r[b])
                    ok &= bool(q[a] < q[b] and r[a] < r[b] and shared < n[b])
                    total += int(n[b] - shared)
                best = max(best, total if ok else 0)
        assert matches.heaviest_chain(q, r, n)[0] == best


def test_rough_alignment(spark):
    rng = np.random.default_rng(9)
    a = "".join(rng.choice(list("ACGT"), 400))
    swap = {"A": "C", "C": "G", "G": "T", "T": "A"}
    b = "GG" + "".join(swap[c] if i in (100, 200) else c for i, c in enumerate(a) if not 300 <= i < 305)
    got = matches.rough_alignment(spark.createDataFrame([(1, a), (2, "A" * 50)], "id long, seq string"), spark.createDataFrame([(7, b)], "id long, seq string"), 20).collect()
    assert len(got) == 1 and got[0]["mismatches"] == 2 and 390 <= got[0]["matches"] <= 395 and got[0]["aligned"] == 400
    assert got[0]["dist"] == pytest.approx(1 - got[0]["matches"] / 400)

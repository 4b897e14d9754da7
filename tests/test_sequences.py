import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import alignment, hashing, sequences as Q
from sigloom.operators import kmers, signatures as S, sketch
from sigloom.operators.pairs import PairJob


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def count(seqs, k, both=True):
    found = Counter(s[i:i + k] for s in seqs for i in range(len(s) - k + 1) if "N" not in s[i:i + k])
    if both:
        found = found + Counter({rc(w): n for w, n in found.items()}) if not found else Counter(
            {w: found.get(w, 0) + found.get(rc(w), 0) for w in set(found) | {rc(w) for w in found}})
    return dict(found)


def counted(df, k):
    return {r["w"]: r["n"] for r in df.select(kmers.kmer_text("code", k).alias("w"), "n").collect()}


def test_counts_by_hand(contigs):
    one = contigs({1: ["ACGTNACG"]})
    assert counted(kmers.kmer_counts(one, 2, double_strand=False), 2) == {"AC": 2, "CG": 2, "GT": 1}
    assert counted(kmers.kmer_counts(one, 2), 2) == {"AC": 3, "GT": 3, "CG": 4}


@pytest.mark.parametrize("k", [1, 3, 7, 15, 21])
def test_counts_against_plain_python(contigs, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTN" if i % 3 else "ACGT") for _ in range(n)) for i, n in enumerate((0, 1, k, 50, 300))]
    assert counted(kmers.kmer_counts(contigs({1: seqs}), k), k) == count(seqs, k)


def test_long_contig_is_cut_into_segments_without_loss(contigs, monkeypatch):
    monkeypatch.setattr(kmers, "_SEGMENT", 16)
    raw, offsets = np.frombuffer(b"ACGTACGGTTACNACGTTGCAACGATTACAGATTACA", np.uint8), np.array([0, 20, 37])
    text = raw.tobytes().decode()
    found = sorted((int(r), int(p), int(c)) for row, pos, code in kmers.rolling_codes(raw, offsets, 5) for r, p, c in zip(row, pos, code))
    code = lambda w: int(w.translate(str.maketrans("ACGT", "0123")), 4)
    wanted = sorted((r, i, code(text[a + i:a + i + 5])) for r, (a, b) in enumerate(((0, 20), (20, 37))) for i in range(b - a - 4) if "N" not in text[a + i:a + i + 5])
    assert found == wanted


def test_genome_without_kmers_keeps_a_zero_vector(contigs):
    sigs = {r["id"]: r["sig"] for r in S.counts_signature(contigs({1: ["NNNN", "A"], 2: ["ACG"]}), 2).collect()}
    assert sum(sigs[1]) == 0 and len(sigs[1]) == 16 and sum(sigs[2]) == 4


def test_karlin_by_hand(contigs):
    sig = S.karlin_signature(contigs({1: ["ACGTTGCA"]}), 2).first()["sig"]
    at = lambda w: sig[int(w.translate(str.maketrans("ACGT", "0123")), 4)]
    for word, value in {"AA": 1.555556, "AC": 2.333333, "CG": 1.75, "TG": 2.333333, "GG": 0.054688}.items():
        assert at(word) == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("k", [3, 5])
def test_karlin_against_the_definition(contigs, k):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(200))
    n = count([seq], k)
    total = sum(n.values())
    words = ["".join(w) for w in itertools.product("ACGT", repeat=k)]
    sig = S.karlin_signature(contigs({1: [seq]}), k).first()["sig"]
    for i in rng.sample(range(4 ** k), 20):
        w, value = words[i], 0.0
        value = (n.get(w, 0) or 1 / 4 ** k) / total
        for size in range(1, k):
            for kept in itertools.combinations(range(k), size):
                share = sum(c for v, c in n.items() if all(v[p] == w[p] for p in kept))
                share = (share or 1 / size) / total
                value = value * share if size % 2 == k % 2 else value / share
        assert sig[i] == pytest.approx(value, rel=1e-9)


def test_markov_by_hand(contigs):
    sig = S.markov_signature(contigs({1: ["ACGTACGGTTAC"]}), 3).first()["sig"]
    assert sig[0b000110] == pytest.approx(-0.559017, abs=1e-6)


def test_hash_known_values(spark):
    code = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    codes = np.array([code(x) for x in ("A" * 21, "ACGTACGTACGTACGTACGTA", "T" * 21)])
    known = [129989395977297, 269842306527480, 279570891760300]
    assert hashing.packed_kmer_hash(codes, 21).tolist() == known
    row = spark.sql("select unhex('000000000000') a, unhex('1B1B1B1B1B00') b, unhex('FFFFFFFFFFC0') c").select(*[hashing.byte_hash(x) for x in "abc"]).first()
    assert list(row) == known


def test_sketch_keeps_the_smallest_hashes(contigs):
    rng = random.Random(4)
    seqs = {g: ["".join(rng.choice("ACGT") for _ in range(400))] for g in (1, 2)} | {3: ["AC"]}
    got = {r["id"]: r["sig"] for r in sketch.minhash_signature(contigs(seqs), 9, 20, 3).collect()}
    for g in (1, 2):
        words = {min(w, rc(w)) for w in count(seqs[g], 9, both=False)}
        hashes = hashing.packed_kmer_hash(np.array([int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in words]), 9)
        assert got[g] == sorted(set(h for h in hashes.tolist() if h % 3 == 0))[:20]
    assert got[3] == []


def test_sketch_distance_of_a_genome_with_itself_is_zero(spark):
    sigs = spark.createDataFrame([(1, [2, 4, 6]), (2, [2, 4, 6]), (3, [1, 3]), (4, [])], "id long, sig array<long>")
    got = {(r["id_a"], r["id_b"]): r["dist"] for r in PairJob(sigs, "approxANI", theta=21.0, sketch_size=3).pairs().collect()}
    assert got[1, 2] == pytest.approx(0.0) and got[1, 3] == 1.0 and got[1, 4] == 1.0 and len(got) == 6


def test_windows_by_hand(contigs):
    rows = kmers.windows(contigs({1: ["ACGTACGGTTAC", "ACG"]}), 5, 3).orderBy("window").collect()
    assert [(r["name"], r["start"], r["seq"]) for r in rows] == [("c0.0", 0, "ACGTA"), ("c0.1", 3, "TACGG"), ("c0.2", 6, "GGTTA")]


def test_sequence_expressions(spark):
    df = spark.createDataFrame([("ACGTACGGTTAC", "ANGT")], "s string, t string")
    row = df.select(
        Q.translate_codons("s"), Q.find_from("s", "GGN"), Q.find_from("s", "TAC", 4), Q.find_from("s", "AAAA"), Q.find_from("t", "ACG"),
        Q.pack_two_bit("s"), Q.reverse_complement("t"), Q.nucleotide_identity("s", F.lit("ACGA")), Q.decode(F.lit("acguR-")), Q.is_valid(F.lit("ACGR"))).first()
    assert list(row) == ["TYGY", 6, 9, 12, 0, "1B1AF1", "ACNT", 0.75, "ACGTNN", False]


def test_long_contigs_are_cut_without_losing_a_word(spark, contigs, monkeypatch):
    from sigloom.operators import genes, kmers as K, sketch

    rng = random.Random(12)
    long = "".join(rng.choice("ACGTN" if i % 97 == 0 else "ACGT") for i in range(1000))
    df = contigs({1: [long, "ACGT"], 2: ["", long[:40]]})
    whole = lambda: (sorted(map(tuple, K.kmer_counts(df, 5).collect())), sorted(map(tuple, sketch.kept_hashes(df, 7, 50, 2).collect())),
                     sorted(map(tuple, genes.seeds(df.select("genome_id", "seq"), 9).collect())))
    expected = whole()
    cut = K.in_pieces
    for piece in (64, 100, 999):
        for module in (K, sketch, genes):
            monkeypatch.setattr(module, "in_pieces", lambda frame, k, seq_col="seq", piece=piece: cut(frame, k, seq_col, piece))
        assert whole() == expected


def test_short_alignments_share_small_tables():
    rng = np.random.default_rng(4)
    genes = [rng.integers(0, 4, 40).astype(np.uint8) for _ in range(4_000)]
    regions = [np.concatenate((g[:20], rng.integers(0, 4, 40).astype(np.uint8), g[20:])) for g in genes]
    for free in (True, False):
        tracemalloc.start()
        alignment.align_many(genes, regions, free)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12 << 20
    few, wide = alignment.align_many(genes[:30], regions[:30], True), [np.concatenate((r, np.full(3_000, 4, np.uint8))) for r in regions[:30]]
    assert (few == alignment.align_many(genes[:30], wide, True)).all()  # 32 and 64 bits a cell

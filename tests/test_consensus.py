import random
from collections import defaultdict

import pytest

from sigloom.operators import consensus


def brute(targets, extensions, places):
    """Votes of every base, one by one."""
    votes = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for name, (seq, quality) in targets.items():
        for i, base in enumerate(seq or ""):
            votes[name, i][base][0] += quality[i] if quality else 30
    for query, ref, offset in places:
        seq, quality = extensions[query]
        for i, base in enumerate(seq):
            q = quality[i] if quality else 30
            votes[ref, offset + i][base][0] += q
            votes[ref, offset + i][base][1] += q
    out = {}
    for name in targets:
        spots = sorted(pos for ref, pos in votes if ref == name)
        new = []
        for pos in spots:
            ballot = votes[name, pos]
            base = min(ballot, key=lambda b: (-ballot[b][0], -ballot[b][1], b))
            new.append((base, max(0, min(96, 2 * ballot[base][0] - sum(v[0] for v in ballot.values())))))
        if spots:
            out[name] = (spots[0], "".join(b for b, _ in new), [q for _, q in new])
    return out


@pytest.fixture(scope="module")
def reads():
    rng = random.Random(11)
    text = "".join(rng.choice("ACGT") for _ in range(400))

    def read(a, b, errors, with_quality):
        seq = [rng.choice("ACGT") if rng.random() < errors else c for c in text[a:b]]
        return "".join(seq), [rng.randint(1, 60) for _ in seq] if with_quality else None

    targets = {"t": read(120, 260, 0.0, True), "plain": read(100, 180, 0.0, False), "lone": ("ACACACAC", None), "empty": ("", None), "null": (None, None)}
    extensions = {f"e{i}": read(a, a + 90, 0.04, i % 2 == 0) for i, a in enumerate(range(40, 300, 13))}
    extensions["copy"] = extensions["e5"]
    extensions["none"] = ("", None)
    return targets, extensions


SCHEMA = "id string, seq string, quality array<int>"


@pytest.mark.parametrize("piece", [1 << 14, 16])
def test_consensus_equals_votes_one_by_one(spark, reads, piece):
    targets, extensions = reads
    t, e = (spark.createDataFrame([(k, *v) for k, v in side.items()], SCHEMA) for side in (targets, extensions))
    placed = consensus.overlaps(e, t, 12)
    places = [(r["query"], r["ref"], r["offset"]) for r in placed.collect()]
    assert len(places) > 15 and ("none", "t") not in {p[:2] for p in places}
    found = {r["id"]: (r["begin"], r["seq"], r["quality"]) for r in consensus.joined(consensus.extended(t, e, placed, piece)).collect()}
    assert found == brute(targets, extensions, places)
    assert found["lone"] == (0, "ACACACAC", [30] * 8) and len(found["t"][1]) > 200


def test_overlap_is_the_longest_shared_stretch(spark):
    t = spark.createDataFrame([("t", "AAAACCCCGGGGTTTTACGTACGTAC")], "id string, seq string")
    e = spark.createDataFrame([("left", "GGAAAACCCCGG"), ("right", "TTTTACGTACGTACGGG"), ("far", "CCATCCATCCAT")], "id string, seq string")
    found = {r["query"]: (r["offset"], r["length"]) for r in consensus.overlaps(e, t, 8).collect()}
    assert found == {"left": (-2, 10), "right": (12, 14)}
    new = consensus.joined(consensus.extended(t, e, consensus.overlaps(e, t, 8))).first()
    assert (new["begin"], new["seq"]) == (-2, "GGAAAACCCCGGGGTTTTACGTACGTACGGG")


def test_the_better_base_wins_and_ties_go_to_the_extension(spark):
    t = spark.createDataFrame([("t", "ACGTACGTAAC", [40] * 11)], SCHEMA)
    e = spark.createDataFrame([("e", "ACGTACGTTTG", [20] * 8 + [50, 30, 40])], SCHEMA)
    new = consensus.joined(consensus.extended(t, e, consensus.overlaps(e, t, 8))).first()
    assert (new["seq"], new["quality"]) == ("ACGTACGTTAG", [60] * 8 + [10, 10, 0])


def test_nothing_to_extend(spark):
    none = spark.createDataFrame([], "id string, seq string")
    assert consensus.extended(none, none, consensus.overlaps(none, none)).count() == 0

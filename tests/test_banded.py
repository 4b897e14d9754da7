"""End-to-end alignment in growing bands against the full table."""

import numpy as np
import pytest

from sigloom.functions import alignment


def _changed(rng, a, times):
    b = list(a)
    for _ in range(times):
        if b:
            at, kind = int(rng.integers(len(b))), rng.integers(3)
            if kind == 0:
                b[at] = int(rng.integers(4))
            elif kind == 1:
                del b[at:at + int(rng.integers(1, 6))]
            else:
                b[at:at] = [int(x) for x in rng.integers(0, 4, rng.integers(1, 6))]
    return np.array(b, np.uint8)


@pytest.mark.parametrize("first", [1, 3, 32])
def test_bands_equal_the_full_table(monkeypatch, first):
    monkeypatch.setattr(alignment, "_FIRST_BAND", first)
    monkeypatch.setattr(alignment, "_TIDY", 3)
    rng, queries, targets = np.random.default_rng(first), [], []
    for i in range(250):
        a = rng.integers(0, 5 if i % 7 == 0 else 4, rng.integers(0, 70)).astype(np.uint8)
        queries.append(a)
        targets.append(_changed(rng, a, int(rng.integers(0, 9))) if i % 3 else rng.integers(0, 4, rng.integers(0, 70)).astype(np.uint8))
    want = np.hstack([np.array(alignment.align_block([q], [t], False)) for q, t in zip(queries, targets)])
    assert (alignment.align_many(queries, targets) == want).all()
    assert alignment.align_many([], []).shape == (4, 0)


def test_long_pairs_are_aligned_in_narrow_bands(monkeypatch):
    rng, widths, band = np.random.default_rng(2), [], alignment._band
    monkeypatch.setattr(alignment, "_band", lambda q, t, half: (widths.append(half), band(q, t, half))[1])
    a = rng.integers(0, 4, 120_000).astype(np.uint8)
    b = a.copy()
    b[::20_000] = (b[::20_000] + 1) % 4
    b = np.delete(b, np.s_[70_001:70_011])
    cost, identities, length, _ = alignment.align_many([a], [b])[:, 0]
    # six changed bases and one gap of ten
    assert (cost, identities, length) == (6 * 2 + 3 + 9, 120_000 - 16, 120_000) and max(widths) <= 64
    # more than 2^19 bases in all
    c = rng.integers(0, 4, 270_000).astype(np.uint8)
    assert alignment.align_many([c], [c])[:3, 0].tolist() == [0, 270_000, 270_000]

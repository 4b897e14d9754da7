"""Block distances used inside the tiles of a pairwise job.

A block distance takes two matrices (rows are signatures) and returns the full matrix of distances between
their rows.  Spark decides which rows meet (see ``operators.pairs``); these functions only do the arithmetic.
"""

from dataclasses import dataclass
from typing import Callable, Optional

import numpy as np

from sigloom.functions.alignment import gene_set_distance

SCALES = ("none", "dims", "inverse_dims", "mean")
_ROW_BLOCK = 64
_COLUMN_BLOCK, _FLOAT_COLUMNS = 4096, 1024  # columns of a block of small integers, of doubles


def _whole_numbers(a, b, cap, square):
    """The matrices in the narrowest integers that hold every sum of differences (at most ``cap`` each), None where they are no small whole numbers."""
    if not a.size or not b.size:
        return None
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    if not (-(1 << 30) < low and high < 1 << 30) or cap is not None and not (0 < cap < 1 << 30 and cap == int(cap)):
        return None
    most = int(high - low) if cap is None else min(int(high - low), int(cap))
    largest = max(int(high - low), 1 if cap is None else int(cap), a.shape[1] * (most * most if square else most))
    kind = next((k for k in (np.int16, np.int32) if largest <= np.iinfo(k).max), None)
    if kind is None:
        return None
    return [(m - low).astype(kind) for m in (a, b)] if all((np.rint(m) == m).all() for m in (a, b)) else None


def _accumulate_whole(a, b, cap, square):
    """As ``_accumulate`` of ``min(difference, cap)``, squared or not, in integers."""
    out = np.empty((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    for left in range(0, len(b), _COLUMN_BLOCK):
        some = columns[:, left:left + _COLUMN_BLOCK]
        for start in range(0, len(a), _ROW_BLOCK):
            rows = a[start:start + _ROW_BLOCK]
            total = np.zeros((len(rows), some.shape[1]), a.dtype)
            delta = np.empty_like(total)
            caps = None if cap is None else np.full_like(total, int(cap))
            for j in range(a.shape[1]):
                np.subtract(rows[:, j, None], some[j], out=delta)
                np.abs(delta, out=delta)
                if caps is not None:
                    np.minimum(delta, caps, out=delta)
                if square:
                    np.multiply(delta, delta, out=delta)
                total += delta
            out[start:start + _ROW_BLOCK, left:left + _COLUMN_BLOCK] = total
    return out


def _accumulate(a, b, step, cap=None, square=False, exact=False):
    """Sum ``step(|a_j - b_j|)`` over the dimensions, a cache-sized block of rows at a time.

    ``exact`` says that the step is ``min(difference, cap)``, squared or not, of whole numbers: small ones are summed as integers, which gives the same
    sums in a fraction of the time.
    """
    if exact and (whole := _whole_numbers(a, b, cap, square)):
        return _accumulate_whole(*whole, cap, square)
    out = np.empty((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    for left in range(0, len(b), _FLOAT_COLUMNS):
        some = columns[:, left:left + _FLOAT_COLUMNS]
        for start in range(0, len(a), _ROW_BLOCK):
            rows = a[start:start + _ROW_BLOCK]
            total = np.zeros((len(rows), some.shape[1]))
            delta = np.empty_like(total)
            for j in range(a.shape[1]):
                np.subtract(rows[:, j, None], some[j], out=delta)
                np.abs(delta, out=delta)
                total += step(delta)
            out[start:start + _ROW_BLOCK, left:left + _FLOAT_COLUMNS] = total
    return out


def _scaling(a, b, scale):
    dims = a.shape[1]
    if scale == "none":
        return 1.0
    if scale == "dims":
        return 1.0 / dims
    if scale == "inverse_dims":
        return float(dims)
    if scale == "mean":
        return 2.0 / (a.mean(axis=1)[:, None] + b.mean(axis=1)[None, :])
    raise ValueError(f"unknown scale {scale!r}; expected one of {SCALES}")


def manhattan(a, b, scale="none"):
    return _accumulate(a, b, lambda d: d, exact=True) * _scaling(a, b, scale)


def euclid_sq(a, b, scale="none"):
    return _accumulate(a, b, lambda d: np.square(d, out=d), square=True, exact=True) * np.square(_scaling(a, b, scale))


def saturated_manhattan(a, b, theta=0.02):
    """Mean of ``min(|a-b|, theta) / theta``; with ``theta = 0`` the share of differing elements."""
    if theta == 0:
        return _accumulate(a, b, lambda d: d > 0, cap=1, exact=True) / a.shape[1]
    return _accumulate(a, b, lambda d: np.minimum(d, theta, out=d), cap=theta, exact=True) / (a.shape[1] * theta)


def hamming(a, b):
    return saturated_manhattan(a, b, 0.0)


def saturated_euclid(a, b, theta=0.02):
    total = _accumulate(a, b, lambda d: np.square(np.minimum(d, theta, out=d), out=d))
    return np.sqrt(total / (a.shape[1] * theta * theta))


def exceed_share(a, b, theta=0.02):
    """Share of positions whose absolute difference is above ``theta``."""
    return _accumulate(a, b, lambda d: d > theta) / a.shape[1]


def element_hamming(a, b, scale="none"):
    """Number of unequal elements; ``mean`` divides by the average number of non-zero elements."""
    count = _accumulate(a, b, lambda d: d != 0, cap=1, exact=True)
    if scale == "mean":
        present = (a != 0).sum(axis=1)[:, None] + (b != 0).sum(axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return 2.0 * count / present
    return count * _scaling(a, b, scale)


def log_length_saturated(a, b, theta=0.02):
    """Saturated distance of log profiles whose last element is the k-mer total of the genome."""
    with np.errstate(divide="ignore", invalid="ignore"):
        la, lb = a[:, -1], b[:, -1]
        pa = np.log(a[:, :-1]) * np.log(la)[:, None]
        pb = np.log(b[:, :-1]) * np.log(lb)[:, None]
        cap = np.log1p(theta) * np.log((la[:, None] + lb[None, :]) / 2.0)
        out = np.zeros((len(a), len(b)))
        for j in range(pa.shape[1]):
            out += np.minimum(np.abs(pa[:, j, None] - pb[None, :, j]), cap)
        return out / (pa.shape[1] * cap)


def _standardise(m):
    centred = m - m.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return centred / np.sqrt(np.square(centred).sum(axis=1, keepdims=True))


def ordinal_ranks(m):
    """Rank of every element within its row; equal values are ranked by position."""
    ranks = np.empty(m.shape)
    order = np.argsort(m, axis=1, kind="stable")
    np.put_along_axis(ranks, order, np.broadcast_to(np.arange(m.shape[1], dtype=float), m.shape), axis=1)
    return ranks


def correlation(a, b):
    """Product of standardised rows; the clip keeps rounding from leaving [-1, 1]."""
    return np.clip(a @ b.T, -1.0, 1.0)


def correlation_distance(a, b):
    return 1.0 - (correlation(a, b) + 1.0) / 2.0


# ---------------------------------------------------------------- sketches

class Sketches:
    """Sorted arrays with an index of their words, made once for all blocks that they take part in."""

    def __init__(self, lists):
        self.lists = list(lists)
        sizes = np.array([len(x) for x in self.lists], dtype=np.int64)
        self.flat = np.concatenate(self.lists) if self.lists else np.empty(0)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(self.flat, kind="stable")
        self._index(self.flat[order], self.owner[order])

    def _index(self, words, rows):
        self.words, self.rows = words, rows
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
        self.vocabulary, self.starts = words[first], np.append(first, len(words))

    def __len__(self):
        return len(self.lists)

    def __getitem__(self, keep):
        """The sketches of a mask; their index is part of this one."""
        if keep.all():
            return self
        part = object.__new__(Sketches)
        part.lists = [self.lists[i] for i in np.flatnonzero(keep)]
        place = np.cumsum(keep) - 1
        part.flat, part.owner = (x[keep[self.owner]] for x in (self.flat, place[self.owner]))
        held = keep[self.rows]
        part._index(self.words[held], place[self.rows[held]])
        return part

    def tops(self, size):
        """Up to where each sketch is complete: one with fewer than ``size`` values is the whole set."""
        return np.array([x[-1] if len(x) >= size else np.inf for x in self.lists])


def _indexed(lists):
    return lists if isinstance(lists, Sketches) else Sketches(lists)


def shared_counts(a, b):
    """Number of common elements of every pair of sorted arrays, at the cost of the actual co-occurrences."""
    a, b = _indexed(a), _indexed(b)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for i, words in enumerate(a.lists):
        at = np.searchsorted(b.vocabulary, words)
        found = at < len(b.vocabulary)
        found[found] = b.vocabulary[at[found]] == words[found]
        at = at[found]
        if len(at):
            held = [b.rows[x:y] for x, y in zip(b.starts[at].tolist(), b.starts[at + 1].tolist())]
            out[i] = np.bincount(np.concatenate(held), minlength=len(b))
    return out


def _counts_up_to(b, limits):
    """How many words of every sketch of ``b`` are at most each limit: one row per limit.  The index is walked once, from the least limit to the largest."""
    out, counts, done = np.empty((len(limits), len(b)), dtype=np.int64), np.zeros(len(b), dtype=np.int64), 0
    stops = np.searchsorted(b.words, limits, side="right")
    for i in np.argsort(stops, kind="stable").tolist():
        if stops[i] > done:
            counts += np.bincount(b.rows[done:stops[i]], minlength=len(b))
            done = stops[i]
        out[i] = counts
    return out


def _counts_below(a, limits):
    """The same with one column per limit, for few sketches and many limits."""
    order = np.argsort(limits, kind="stable")
    first = np.searchsorted(limits[order], a.flat, side="left")  # the least limit that a word is within
    seen = np.bincount(a.owner * (len(limits) + 1) + first, minlength=len(a) * (len(limits) + 1)).reshape(len(a), -1)
    out = np.empty((len(a), len(limits)), dtype=np.int64)
    out[:, order] = np.cumsum(seen[:, :-1], axis=1)
    return out


def sketch_resemblance(a, b, sketch_size):
    """Jaccard estimate over the hash range that both sketches cover completely.

    A sketch with fewer than ``sketch_size`` values is the whole set; a full one is complete up to its largest value, so
    its own values are never beyond that and only the other sketch sets a limit to them.
    """
    a, b = _indexed(a), _indexed(b)
    within = _counts_below(a, b.tops(sketch_size)) + _counts_up_to(b, a.tops(sketch_size))
    shared = shared_counts(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return shared / (within - shared)


def sketch_distance(a, b, theta=21.0, sketch_size=3000):
    """Mutation distance ``-ln(2J / (1 + J)) / k``; 1 when nothing is shared, undefined for two empty sketches."""
    j = sketch_resemblance(a, b, sketch_size)
    with np.errstate(divide="ignore"):
        return np.where(j == 0, 1.0, -np.log(2 * j / (1 + j)) / theta + 0.0)


def sketch_identity(a, b, theta=21.0, sketch_size=3000):
    percent = 100.0 - 100.0 * sketch_distance(a, b, theta, sketch_size)
    return np.where(percent > 100, 0.0, percent)


@dataclass(frozen=True)
class Method:
    name: str
    block: Callable
    prepare: Optional[Callable] = None
    similarity: Optional[Callable] = None
    takes_theta: bool = False
    takes_scale: bool = False
    profile_tail: str = "use"  # what to do with the length element of a length-extended profile
    sets: bool = False  # rows are sorted sets of any size rather than vectors of one length

    def bind(self, theta=None, scale="none", common_format=False, sketch_size=None):
        """A function of two raw blocks with the parameters fixed."""
        block = self.similarity if common_format and self.similarity else self.block
        extra = {}
        if self.takes_theta and theta is not None:
            extra["theta"] = theta
        if self.takes_scale:
            extra["scale"] = scale
        if self.sets and self.takes_theta and sketch_size is not None:
            extra["sketch_size"] = sketch_size
        prepare = self.prepare or (lambda m: m)
        return prepare, lambda a, b: block(a, b, **extra)


def _rank_standardise(m):
    return _standardise(ordinal_ranks(m))


METHODS = {
    m.name: m
    for m in (
        Method("manhattan", manhattan, takes_scale=True),
        Method("euclid", euclid_sq, takes_scale=True),
        Method("PaSiT", saturated_manhattan, takes_theta=True, profile_tail="skip"),
        Method("hamming", hamming, profile_tail="skip"),
        Method("sateucl", saturated_euclid, takes_theta=True, profile_tail="skip"),
        Method("PaSiTL", log_length_saturated, takes_theta=True),
        Method("pearson", correlation_distance, prepare=_standardise, similarity=correlation),
        Method("spearman", correlation_distance, prepare=_rank_standardise, similarity=correlation),
        Method("approxANI", sketch_distance, prepare=Sketches, similarity=sketch_identity, takes_theta=True, sets=True),
        Method("alignseqs", gene_set_distance, sets=True),
        Method("exceed", exceed_share, takes_theta=True),
        Method("element_hamming", element_hamming, takes_scale=True),
    )
}
ALIASES = {
    "AMD": "manhattan",
    "reldist": "manhattan",
    "ED": "euclid",
    "SVC": "PaSiT",
    "satman": "PaSiT",
    "corr": "pearson",
    "rankcorr": "spearman",
}


def method_named(name):
    resolved = ALIASES.get(name, name)
    if resolved not in METHODS:
        raise ValueError(f"unknown method {name!r}; expected one of {sorted(METHODS) + sorted(ALIASES)}")
    return METHODS[resolved]

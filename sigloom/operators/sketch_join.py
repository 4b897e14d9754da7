"""Close pairs of MinHash sketches through an inverted index: two sketches meet only where they share a hash.

* Sketches become postings ``(hash, id, place)``.  A hash with many postings is split into slices counted from the postings, and its pairs
  are made slice against slice, so no task gets all sketches that hold it.  A hash that only one sketch holds leaves at once.
* Shared hashes are counted per pair, before the shuffle and after it.  The places of the last shared hash bound the union from below; what cannot
  reach the limit goes before any sketch is looked at.
* Only the pairs that are left learn the hash range that both sketches cover.  A sketch is joined once per side, and a sketch that is
  close to very many others is repeated over salts.
* Where hashes are so common that most sketches meet in many of them, a row per meeting would be far more than the sketches.  What the index would make is counted
  first; if it is more than a grid of slices ships, the sketches form that grid, and each tile counts through an index of its own.  Nothing then grows with
  the meetings except time.

Pairs that share nothing have distance 1 and are never made, so the limit must be below 1.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sigloom.operators.dealing import dealt_join
from sigloom.operators.pairs import _SIDE_A, _SIDE_B, _SIDE_BOTH, _SLICE_BYTES, _rectangle, _spread, _triangle, slice_count
from sigloom.operators.sketch import DEFAULT_K, DEFAULT_SIZE
from sigloom.session import cut_lineage, is_written

#: Postings of one hash that make one slice.
SLICE = 1_000
#: Meetings of two sketches in one hash that the index may always make.
MEETINGS = 1 << 24
_EMIT_PAIRS = 1 << 18  # pairs that a tile holds before it sends them
_SLICE_ROWS = 24_576  # sketches of one slice of the grid
_COMMON = 1 / 1024  # share of a tile's pairs that meet in a hash from which it gets a column of the matrices
_MATRIX_BYTES = 16 << 20  # bytes of one such matrix
_BLOCK_ROWS, _BLOCK_COLUMNS, _MET = 1_024, 4_096, 1 << 19  # sketches of a block of pairs, meetings looked at together
_WHOLE = (1 << 63) - 1  # the top of a sketch that holds all hashes of its genome


def least_resemblance(limit, k):
    """The Jaccard estimate at which the mutation distance reaches ``limit``."""
    x = math.exp(-k * limit)
    return x / (2 - x)


def _held(sketches, id_col):
    rows = sketches.select(F.col(id_col).alias("id"), "sig").where(F.size("sig") > 0)
    return rows if is_written(sketches) else cut_lineage(rows)


def _postings(rows):
    return rows.select("id", F.posexplode("sig").alias("pos", "hash"))


def _slices(postings, name):
    return postings.groupBy("hash").agg(F.count("*").alias("n")).select("hash", F.col("n").alias(f"n_{name}"), F.ceil(F.col("n") / SLICE).cast("int").alias(name))


def _of_slices(name):
    return F.pmod(F.xxhash64("id"), F.col(name)).cast("int")


def _met_within(rows):
    """``id_a, id_b, pos_a, pos_b`` of every shared hash, each unordered pair once per hash."""
    postings = _postings(rows)
    several = cut_lineage(_slices(postings, "slices").where("n_slices > 1").drop("n_slices"))
    sliced = dealt_join(postings, several, ["hash"], ["id"]).withColumn("slice", _of_slices("slices"))
    up, down = F.explode(F.sequence("slice", F.col("slices") - 1)), F.explode(F.sequence(F.lit(0), "slice"))
    a = sliced.select("hash", F.col("slice").alias("i"), up.alias("j"), F.col("id").alias("x"), F.col("pos").alias("p"))
    b = sliced.select("hash", down.alias("i"), F.col("slice").alias("j"), F.col("id").alias("y"), F.col("pos").alias("q"))
    met = a.join(b, ["hash", "i", "j"]).where("i < j or x < y")
    first = F.col("x") < F.col("y")
    return met.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("id_a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("id_b"),
                      F.when(first, F.col("p")).otherwise(F.col("q")).alias("pos_a"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("pos_b"))


def _met_between(refs, queries):
    left, right = _postings(refs), _postings(queries)
    both = cut_lineage(_slices(left, "s_a").join(_slices(right, "s_b"), "hash").select("hash", "s_a", "s_b"))
    a = dealt_join(left, both, ["hash"], ["id"]).select("hash", _of_slices("s_a").alias("i"), F.explode(F.sequence(F.lit(0), F.col("s_b") - 1)).alias("j"),
                                                        F.col("id").alias("id_a"), F.col("pos").alias("pos_a"))
    b = dealt_join(right, both, ["hash"], ["id"]).select("hash", F.explode(F.sequence(F.lit(0), F.col("s_a") - 1)).alias("i"), _of_slices("s_b").alias("j"),
                                                         F.col("id").alias("id_b"), F.col("pos").alias("pos_b"))
    return a.join(b, ["hash", "i", "j"]).select("id_a", "id_b", "pos_a", "pos_b")


# ---------------------------------------------------------------- a grid, where hashes are common


def _meetings(refs, asked=None):
    """Rows that the index would make: one per pair of sketches and hash."""
    n = F.col("n").cast("double")
    held = lambda rows: _postings(rows).groupBy("hash").agg(F.count("*").alias("n"))
    if asked is None:
        return held(refs).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    return held(refs).join(held(asked).withColumnRenamed("n", "m"), "hash").agg(F.sum(n * F.col("m"))).first()[0] or 0


def _rows_that_fit(widest):
    return max(1, min(_SLICE_ROWS, _SLICE_BYTES // (8 * max(1, widest))))


def _grid(refs, asked=None):
    """The tiles of a grid of the sketches, or None where the index makes fewer rows than the grid would ship hashes."""
    met = _meetings(refs, asked)
    if met <= MEETINGS:
        return None
    parallelism = refs.sparkSession.sparkContext.defaultParallelism
    measure = [F.count("*"), F.max(F.size("sig")), F.sum(F.size("sig"))]
    refs = refs.where("id is not null")
    n, widest, hashes = refs.agg(*measure).first()
    if asked is None:
        slices = slice_count(n, _rows_that_fit(widest), parallelism)
        return None if met <= hashes * slices else _spread(_triangle(refs, "id", slices), slices * (slices + 1) // 2, parallelism)
    asked = asked.where("id is not null")
    m, wider, more = asked.agg(*measure).first()
    r, q = (max(1, math.ceil(x / _rows_that_fit(max(widest, wider)))) for x in (n, m))
    r = max(r, min(2 * parallelism, n // 128))
    return None if met <= hashes * q + more * r else _spread(_rectangle(refs, asked, "id", r, q), r * q, parallelism)


class _Sketches:
    """One side of a tile, the shortest sketches first: all hashes as one array, by sketch."""

    def __init__(self, table, least, size):
        sigs = table.column("sig").combine_chunks()
        lengths = sigs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(lengths, kind="stable")
        self.ids = table.column("id").combine_chunks().take(pa.array(order))
        self.lengths = lengths[order]
        self.stops = np.cumsum(self.lengths)
        self.starts = self.stops - self.lengths
        shift = (np.cumsum(lengths) - lengths)[order] - self.starts
        self.hashes = sigs.flatten().to_numpy(zero_copy_only=False)[np.repeat(shift, self.lengths) + np.arange(self.lengths.sum())]
        self.rows = np.repeat(np.arange(len(order), dtype=np.int32), self.lengths)
        self.top = np.where(self.lengths >= size, self.hashes[self.stops - 1], _WHOLE)
        # the union holds all of the sketch that is covered whole, which is the fuller one
        self.need = np.maximum(np.ceil(least * np.minimum(self.lengths, size) - 1e-9), 1)
        self.whole = int(np.searchsorted(self.lengths, size))  # sketches before this one hold all hashes of their genome
        self.part = least / (1 + least) * self.lengths - 1e-4  # two of those are near if they share the sum of this

    def up_to(self, rows, cut):
        """How many hashes of each row are at most ``cut``."""
        out = self.lengths[rows]
        some = np.flatnonzero(cut < self.hashes[self.stops - 1][rows])
        low, high, cut = self.starts[rows[some]], self.stops[rows[some]], cut[some]
        for _ in range(int(self.lengths.max()).bit_length()):
            middle = np.minimum((low + high) // 2, len(self.hashes) - 1)
            beyond = (low < high) & (self.hashes[middle] <= cut)
            low, high = np.where(beyond, middle + 1, low), np.where(beyond, high, middle)
        out[some] = low - self.starts[rows[some]]
        return out

    def columns(self, place):
        """The sketches as rows of a matrix: ``place`` tells the column of each hash, -1 where it has none."""
        out = np.zeros((len(self.lengths), int(place.max(initial=-1)) + 1), np.uint8)
        held = np.flatnonzero(place >= 0)
        np.add.at(out, (self.rows[held], place[held]), 1)
        return out


def _places(words, hashes):
    """Where each hash is among the ascending ``words``, -1 if it is not."""
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1).astype(np.int32)
    return np.where(words[at] == hashes, at, np.int32(-1))


def _shared(left, right, same):
    """``i, j, shared`` of the pairs with enough common hashes, a block of pairs at a time.

    Hashes that many sketches hold on both sides are counted by a product of matrices, at a fixed cost per pair; the others at the cost of a look at each meeting.
    """
    words = np.intersect1d(np.unique(left.hashes), np.unique(right.hashes), assume_unique=True)
    if not len(words):
        return
    n = len(right.lengths)
    mine, theirs = (_places(words, x.hashes) for x in (left, right))
    met = np.prod([np.bincount(c[c >= 0], minlength=len(words)).astype(float) for c in (mine, theirs)], axis=0)
    common = np.flatnonzero(met > _COMMON * len(left.lengths) * n)
    room = max(1, _MATRIX_BYTES // max(len(left.lengths), n))
    common = common[np.argsort(-met[common], kind="stable")[:room]]
    place = np.full(len(words) + 1, -1, np.int32)  # the last one is that of a hash of one side only
    place[common] = np.arange(len(common))
    a, b = left.columns(place[mine])[:, :len(common)], right.columns(place[theirs])[:, :len(common)]
    rare = lambda codes: np.flatnonzero((codes >= 0) & (place[codes] < 0))
    at, postings = rare(mine), rare(theirs)
    at_row, at_word = left.rows[at], mine[at]
    postings = np.sort(theirs[postings].astype(np.int64) * n + right.rows[postings])
    del mine, theirs, at
    for c in range(0, n, _BLOCK_COLUMNS):
        d = min(n, c + _BLOCK_COLUMNS)
        others = b[c:d].astype(np.float32).T
        first, last = (np.searchsorted(postings, np.arange(len(words)) * n + x) for x in (c, d))
        for r in range(0, len(left.lengths), _BLOCK_ROWS):
            s = min(len(left.lengths), r + _BLOCK_ROWS)
            if same and r >= d or right.lengths[d - 1] < left.need[r] or left.lengths[s - 1] < right.need[c]:
                continue  # no sketch of these is long enough for one of the others
            shared = a[r:s].astype(np.float32) @ others
            some = slice(*np.searchsorted(at_row, (r, s)))
            _look(shared, at_row[some] - r, first[at_word[some]], last[at_word[some]], postings, n, c)
            if s <= left.whole and d <= right.whole:
                keep = shared >= np.maximum(left.part[r:s, None].astype(np.float32) + right.part[None, c:d].astype(np.float32), np.float32(1))
            else:
                keep = shared >= np.maximum(left.need[r:s, None].astype(np.float32), right.need[None, c:d].astype(np.float32))
            if same:
                keep &= np.arange(r, s)[:, None] < np.arange(c, d)[None, :]
            i, j = np.nonzero(keep)
            if len(i):
                yield i + r, j + c, shared[i, j].astype(np.int64)


def _look(shared, rows, first, last, postings, n, c):
    """Count every meeting of ``rows`` with the postings between ``first`` and ``last``, a bounded number at once."""
    many = last - first
    rows, first, many = (x[many > 0] for x in (rows, first, many))
    done, upto = 0, np.cumsum(many)
    while done < len(rows):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + _MET, side="right")))
        held = many[done:stop]
        before = np.cumsum(held) - held
        met = postings[np.repeat(first[done:stop] - before, held) + np.arange(held.sum())] % n - c
        flat = np.repeat(rows[done:stop] * shared.shape[1], held) + met
        np.add.at(shared.reshape(-1), flat, np.float32(1))
        done = stop


def _emit_close(least, size, oriented, names):
    def batch_of(left, right, found):
        i, j, shared = (np.concatenate(x) for x in zip(*found))
        cut = np.minimum(left.top[i], right.top[j])
        ids_a, ids_b = left.ids.take(pa.array(i)), right.ids.take(pa.array(j))
        if oriented:
            swap = pc.greater(ids_a, ids_b)
            ids_a, ids_b = pc.if_else(swap, ids_b, ids_a), pc.if_else(swap, ids_a, ids_b)
        every = left.up_to(i, cut) + right.up_to(j, cut) - shared
        near = pa.array(shared >= least * every)
        return pa.RecordBatch.from_arrays([x.filter(near) for x in (ids_a, ids_b, pa.array(shared), pa.array(every))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table.column("_side").to_numpy()
        same = bool((side == _SIDE_BOTH).any())
        if not same and (side == side[0]).all():
            return
        left = _Sketches(table if same else table.filter(pa.array(side == _SIDE_A)), least, size)
        right = left if same else _Sketches(table.filter(pa.array(side == _SIDE_B)), least, size)
        del table
        found, n = [], 0
        for some in _shared(left, right, same):
            found, n = [*found, some], n + len(some[0])
            if n >= _EMIT_PAIRS:
                yield batch_of(left, right, found)
                found, n = [], 0
        if found:
            yield batch_of(left, right, found)
    return run


def _sides(rows, side, size):
    top = F.when(F.size("sig") >= size, F.element_at("sig", -1)).otherwise(_WHOLE)
    return rows.select(F.col("id").alias(f"id_{side}"), F.size("sig").alias(f"n_{side}"), top.alias(f"top_{side}"))


def neighbours(sketches: DataFrame, limit: float, k=DEFAULT_K, size=DEFAULT_SIZE, queries: DataFrame = None, id_col="id") -> DataFrame:
    """``id_a, id_b, dist`` of all pairs whose mutation distance is at most ``limit`` (below 1).

    Within ``sketches`` each unordered pair comes once, the smaller id first; with ``queries`` every sketch meets every query.  Ids are unique per
    table.  Empty and missing sketches have no neighbours.
    """
    if not limit < 1:
        raise ValueError("pairs that share no hash have distance 1: the limit must be below 1")
    refs = _held(sketches, id_col)
    asked = refs if queries is None else _held(queries, id_col)
    least = least_resemblance(limit, k) * (1 - 1e-12)

    def close(pairs, j):
        dist = -F.log(2 * j / (1 + j)) / k + 0.0
        return pairs.select("id_a", "id_b", dist.alias("dist")).where(F.col("dist") <= limit)

    tiles = _grid(refs, None if queries is None else asked)
    if tiles is not None:
        schema = T.StructType([T.StructField("id_a", refs.schema["id"].dataType), T.StructField("id_b", asked.schema["id"].dataType),
                               T.StructField("shared", T.LongType()), T.StructField("every", T.LongType())])
        pairs = tiles.groupBy("_part", "_tile").applyInArrow(_emit_close(least, size, queries is None, schema.fieldNames()), schema)
        return close(pairs, F.col("shared") / F.col("every"))
    met = _met_within(refs) if queries is None else _met_between(refs, asked)
    counted = met.groupBy("id_a", "id_b").agg(F.count("*").alias("shared"), (F.max("pos_a") + 1).alias("from_a"), (F.max("pos_b") + 1).alias("from_b"))
    pairs = cut_lineage(counted.where(F.col("shared") >= least * (F.col("from_a") + F.col("from_b") - F.col("shared"))).drop("from_a", "from_b"))
    pairs = dealt_join(pairs, _sides(refs, "a", size), ["id_a"], ["id_b"])
    pairs = cut_lineage(dealt_join(pairs, _sides(asked, "b", size), ["id_b"], ["id_a"]))
    # the sketch that reaches less far is covered whole, of the other one counts what lies below that
    longer_a = pairs.where("top_a > top_b").select("id_a", "id_b", "shared", F.col("n_b").alias("whole"), F.col("top_b").alias("cut"))
    longer_b = pairs.where("top_a <= top_b").select("id_a", "id_b", "shared", F.col("n_a").alias("whole"), F.col("top_a").alias("cut"))

    def covered(part, rows, side, other):
        cut = dealt_join(part, rows.select(F.col("id").alias(side), "sig"), [side], [other])
        return cut.select("id_a", "id_b", "shared", "whole", F.size(F.filter("sig", lambda x: x <= F.col("cut"))).alias("part"))

    ranged = covered(longer_a, refs, "id_a", "id_b").unionAll(covered(longer_b, asked, "id_b", "id_a"))
    return close(ranged, F.col("shared") / (F.col("whole") + F.col("part") - F.col("shared")))

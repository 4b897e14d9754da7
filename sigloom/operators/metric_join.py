"""Pairs of vectors within a distance: pivots and the triangle inequality take rows apart before any two are compared.

* A bounded number of rows are pivots.  Every row belongs to the cell of its nearest pivot.  A row of another cell can be within ``r`` of a
  row of cell ``p`` only if its distance to ``p`` exceeds that to its nearest pivot by at most ``2 r``; it visits that cell then.  A pair is made in the cell of
  the smaller number only.
* In a cell, rows are ranged by their distance to the pivot.  Ranges are at least ``r`` wide, so partners lie in the same range or the next.  A range
  that holds more rows than a task should get (copies, say) is split into slices, counted from its rows.
* In a tile the distances to the pivot, and to a few further ones, rule out most pairs; only the others reach the distance itself.

Everything rests on the triangle inequality, so the method must be a metric; what is compared grows with the pairs that are near and not with the square of the rows.
Where distances hardly differ (many dimensions, a wide limit) rows would visit nearly every cell.  What the cells would ship is counted first; if that is more than a
grid of large slices ships, the rows of one length form that grid, and the distances to the pivots and a blocked kernel rule pairs out.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sigloom.functions.kernels import _accumulate, method_named
from sigloom.operators.dealing import dealt_join
from sigloom.operators.pairs import _flatten, rows_that_fit, slice_count
from sigloom.session import cut_lineage, is_written

#: Rows per pivot, bytes that all pivots may take, and pivots whose distances every row carries.
ROWS_PER_PIVOT, PIVOT_BYTES, PROBES = 500, 32 << 20, 6
#: Rows of a range that make one slice.
ROWS = 2_000
_BLOCK, _CELLS = 256, 1 << 20  # left rows of a block, numbers that one step of differences may hold
_COLUMNS = 2_048  # right rows of a step of the blocked kernel
_DENSE = 0.1  # share of a block's pairs from which all of them are compared at once
_VISITS = 16  # rows that cells may always ship for each row


@dataclass(frozen=True)
class Metric:
    """``each`` maps absolute differences to what is summed; ``total`` maps the sum and the number of dimensions to the distance."""
    each: Callable
    total: Callable
    saturated: bool = False
    theta: float = 0.0
    squared: bool = False

    def between(self, a, b):
        """Distances of all rows of ``a`` to all rows of ``b``."""
        out = np.empty((len(a), len(b)))
        step = max(1, _CELLS // max(1, b.size))
        for at in range(0, len(a), step):
            out[at:at + step] = self.each(np.abs(a[at:at + step, None, :] - b[None, :, :])).sum(axis=2)
        return self.total(out, a.shape[1])

    def of_pairs(self, a, b):
        """Distances of equal rows of two matrices."""
        return self.total(self.each(np.abs(a - b)).sum(axis=1), a.shape[1])

    def block(self, a, b):
        """As ``between``, a dimension at a time; the sums may differ from it in their last digits."""
        with np.errstate(invalid="ignore"):
            summed = [_accumulate(a, b[at:at + _COLUMNS], self.each) for at in range(0, len(b), _COLUMNS)]
        return self.total(np.concatenate(summed, axis=1), a.shape[1])

    def bound(self, a, b, limit):
        """A function that tells for a slice of the rows of ``a`` which of them can be within ``limit`` of which rows of ``b``; None where only the distance itself tells."""
        if self.theta > 0:
            return _bound_by_steps(a, b, limit, self.theta)
        return _bound_by_products(a, b, limit) if self.squared else None


def _bound_by_products(a, b, limit):
    """Squared differences as one product of matrices, with room for its rounding."""
    eps, width = np.finfo(float).eps, a.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        middle = b.mean(axis=0)
        moved = 8 * math.sqrt(width) * eps * max(np.abs(m).max(initial=0.0) for m in (a, b))
        a, b = a - middle, b - middle
        long_a, long_b = (np.square(m).sum(axis=1) for m in (a, b))
        room = (limit + moved) ** 2 + 64 * (width + 8) * eps * (long_a.max(initial=0.0) + long_b.max(initial=0.0))
    if not np.isfinite(room):
        return None
    left = np.column_stack((-2 * a, long_a, np.ones(len(a))))
    right = np.column_stack((b, np.ones(len(b)), long_b)).T
    return lambda rows: np.concatenate([left[rows] @ right[:, at:at + _COLUMNS] <= room for at in range(0, len(b), _COLUMNS)], axis=1)


_STEPS = 25  # steps of a cap
_STEP_ROWS, _STEP_COLUMNS = 64, 4_096


def _bound_by_steps(a, b, limit, theta):
    """Capped differences in steps of one byte; their mean is at most the limit, and at most the root mean square.

    Numbers are taken modulo 256 steps, which can only bring them nearer.  What rounding to steps moves a row is added up for the row: the sum of the
    differences is not smaller than that of the steps less what both rows were moved.
    """
    width = a.shape[1]
    if not width or width * _STEPS > 60_000:
        return None
    sides = []
    for m in (a, b):
        with np.errstate(over="ignore"):
            scaled = m / (theta / _STEPS)
        if not (np.abs(scaled) < 1e9).all():
            return None
        whole = np.rint(scaled)
        sides.append((np.mod(whole, 256).astype(np.uint8), np.ceil(np.abs(whole - scaled).sum(axis=1)) + 1))
    (low, off_a), (high, off_b) = sides
    room_a = np.clip(np.floor(limit * width * _STEPS * (1 + 1e-9)) + off_a, 0, 62_000).astype(np.uint16)
    room_b = off_b.astype(np.uint16)
    columns = np.ascontiguousarray(high.T)
    flush = 255 // _STEPS

    def near(rows):
        mine, room = low[rows], room_a[rows]
        out = np.empty((len(mine), len(high)), bool)
        for c in range(0, len(high), _STEP_COLUMNS):
            some = columns[:, c:c + _STEP_COLUMNS]
            for r in range(0, len(mine), _STEP_ROWS):
                part = mine[r:r + _STEP_ROWS]
                apart = np.empty((len(part), some.shape[1]), np.uint8)
                signed, held, caps = apart.view(np.int8), np.zeros_like(apart), np.full_like(apart, _STEPS)
                total = np.zeros(apart.shape, np.uint16)
                for j in range(width):
                    np.subtract(part[:, j, None], some[j], out=apart)
                    np.abs(signed, out=signed)
                    np.minimum(apart, caps, out=apart)
                    np.add(held, apart, out=held)
                    if j % flush == flush - 1 or j == width - 1:
                        np.add(total, held, out=total)
                        held[:] = 0
                out[r:r + _STEP_ROWS, c:c + _STEP_COLUMNS] = total <= room[r:r + _STEP_ROWS, None] + room_b[None, c:c + _STEP_COLUMNS]
        return out
    return near


def metric_of(method, theta=None, scale="none") -> Metric | None:
    """The metric of a method, or None where the triangle inequality does not hold.  ``euclid`` is squared in the library; here it is its root."""
    name = method_named(method).name
    theta = 0.02 if theta is None else theta
    if name == "manhattan" and scale in ("none", "dims"):
        return Metric(lambda d: d, (lambda s, n: s) if scale == "none" else lambda s, n: s / n)
    if name == "hamming" or name == "PaSiT" and theta == 0:
        return Metric(lambda d: d > 0, lambda s, n: s / n)
    if name == "PaSiT":
        return Metric(lambda d: np.minimum(d, theta, out=d), lambda s, n: s / (n * theta), True, theta)
    if name == "sateucl":
        return Metric(lambda d: np.square(np.minimum(d, theta, out=d), out=d), lambda s, n: np.sqrt(s / (n * theta * theta)), True, theta, True)
    if name == "euclid" and scale == "none":
        return Metric(lambda d: np.square(d, out=d), lambda s, n: np.sqrt(s), squared=True)
    return None


# ---------------------------------------------------------------- cells

def _rows(frame, id_col, saturated):
    """``id, sig`` of the rows that can have a partner: not empty, no missing value; an infinite one only where differences are capped."""
    bad = F.exists("sig", lambda x: x.isNull() | F.isnan(x) | (F.lit(not saturated) & (F.abs(x) == float("inf"))))
    rows = frame.select(F.col(id_col).alias("id"), F.col("sig").cast("array<double>").alias("sig")).where((F.size("sig") > 0) & ~bad)
    return rows if is_written(frame) else cut_lineage(rows)


def pivots_of(rows: DataFrame, n: int, widest: int) -> list[np.ndarray]:
    """Distinct pivot vectors: the rows with the smallest hash of their id, as many as ``PIVOT_BYTES`` hold at most."""
    many = max(PROBES, min(math.ceil(n / ROWS_PER_PIVOT), PIVOT_BYTES // (8 * widest)))
    finite = rows.where(~F.exists("sig", lambda x: F.abs(x) == float("inf")))
    return [np.array(sig) for sig in sorted({tuple(r["sig"]) for r in finite.orderBy(F.xxhash64("id"), "id").limit(many).select("sig").collect()})]


_PLACED = [T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()), T.StructField("guest", T.BooleanType()),
           T.StructField("probes", T.ArrayType(T.DoubleType()))]


def _numbers_by_width(pivots):
    by_width = {}
    for number, pivot in enumerate(pivots):
        by_width.setdefault(len(pivot), []).append(number)
    return by_width


def _parts(batch, by_width):
    """The rows of a batch by length, in parts of bounded work: positions, vectors, numbers of the pivots of that length."""
    lengths, values = _flatten(batch.column("sig"))
    starts = np.r_[0, np.cumsum(lengths)][:-1]
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        numbers = np.array(by_width.get(int(width), []), np.int64)
        for part in np.array_split(at, max(1, math.ceil(len(at) * max(1, len(numbers)) / 500_000))):
            yield part, values[starts[part][:, None] + np.arange(width)], numbers


def _visits(far, limit, guests_only):
    """Positions, columns of ``far`` and nearest columns: the cells that rows belong to or visit."""
    nearest = far.argmin(axis=1)
    visits = far <= far.min(axis=1)[:, None] + 2 * limit * (1 + 1e-9) + 1e-12
    if not guests_only:  # a pair is made in the smaller cell: rows visit cells before their own
        visits &= np.arange(far.shape[1])[None, :] <= nearest[:, None]
    return *np.nonzero(visits), nearest


def _placed(rows: DataFrame, pivots: list[np.ndarray], metric: Metric, limit: float, guests_only: bool, grid: bool) -> DataFrame:
    """Each row once per cell it belongs to or visits: ``id, sig, cell, away`` (distance to the cell's pivot), ``guest, probes``.

    A cell's number is that of its pivot; vectors of a length without a pivot share a cell per length, below zero, and are not ranged.  So do all with ``grid``.
    """
    schema = T.StructType([rows.schema["id"], rows.schema["sig"], *_PLACED])
    names = schema.fieldNames()
    by_width = _numbers_by_width(pivots)
    if grid:
        by_width = {width: numbers[:PROBES] for width, numbers in by_width.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors, numbers in _parts(batch, by_width):
                probes = metric.between(vectors, np.stack([pivots[k] for k in numbers])) if len(numbers) else np.zeros((len(part), 0))
                if grid or not len(numbers):
                    row, cell, away, guest = part, np.full(len(part), -vectors.shape[1]), np.zeros(len(part)), np.full(len(part), guests_only)
                else:
                    far = probes
                    i, k, nearest = _visits(far, limit, guests_only)
                    row, cell, away, guest, probes = part[i], numbers[k], far[i, k], np.full(len(i), True) if guests_only else k != nearest[i], far[i][:, :PROBES]
                picked = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([picked.column("id"), picked.column("sig"), pa.array(cell, pa.int32()), pa.array(away), pa.array(guest),
                                                  pa.array(list(probes), pa.list_(pa.float64()))], names=names)
    return rows.mapInArrow(run, schema)


def _visited(rows: DataFrame, pivots: list[np.ndarray], metric: Metric, limit: float, guests_only=False, own_only=False) -> DataFrame:
    """``cell, band, n``: the rows that cells would get, by their distance to the pivot in units of the limit, counted per batch."""
    by_width = _numbers_by_width(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors, numbers in _parts(batch, by_width):
                if not len(numbers):
                    continue
                far = metric.between(vectors, np.stack([pivots[k] for k in numbers]))
                i, k, nearest = _visits(far, limit, guests_only)
                if own_only:
                    i, k = np.arange(len(far)), nearest
                found, n = np.unique(np.stack([numbers[k].astype(float), np.floor(far[i, k] / limit)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int32)), pa.array(found[1]), pa.array(n.astype(np.int64))], names=["cell", "band", "n"])
    return rows.select("sig").mapInArrow(run, "cell int, band double, n long")


def _cells_ship(visited: DataFrame, rows_per_slice: int) -> int:
    """Rows that the tiles of all cells would get: each band meets the next one, in slices."""
    bands = visited.select("cell", "n", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band")).groupBy("cell", "band").agg(F.sum("n").alias("n"))
    return bands.agg(F.sum(F.col("n") * F.ceil(F.col("n") / rows_per_slice))).first()[0] or 0


# ---------------------------------------------------------------- tiles

def _tiles(placed: DataFrame, limit: float, rows_per_slice: int) -> DataFrame:
    """Rows by ``cell, range, i, j``: each in its own range and, as ``next``, in the one before; large ranges as slices that meet in pairs."""
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("span"))  # one row per pivot
    cells = cells.select("cell", F.greatest(F.lit(float(limit)), F.col("span") / F.ceil(F.col("n") / rows_per_slice)).alias("width"))
    ranged = placed.join(F.broadcast(cells), "cell").withColumn("range", F.when(F.col("width") > 0, F.floor(F.col("away") / F.col("width"))).otherwise(F.lit(0).cast("long")))
    twice = F.explode(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("next")), F.struct((F.col("range") - 1).alias("range"), F.lit(True).alias("next"))))
    twice = ranged.drop("width").withColumn("_in", twice).drop("range").select("*", "_in.range", "_in.next").drop("_in").where("range >= 0")
    sizes = cut_lineage(twice.groupBy("cell", "range").agg(F.ceil(F.count("*") / rows_per_slice).cast("int").alias("slices")))
    sliced = dealt_join(twice, sizes, ["cell", "range"], ["id"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    met = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return met.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "left": F.col("mine") <= F.col("other"), "right": F.col("mine") >= F.col("other")}) \
        .drop("mine", "other", "slices")


class _Side:
    def __init__(self, table):
        self.ids = table.column("id").combine_chunks()
        self.away = table.column("away").to_numpy()
        self.guest, self.next = (table.column(c).to_numpy(zero_copy_only=False) for c in ("guest", "next"))
        lengths, self.values = _flatten(table.column("sig"))
        self.matrix = self.values.reshape(len(lengths), -1)  # a cell holds one length
        probes, values = _flatten(table.column("probes"))
        self.probes = values.reshape(len(lengths), -1)


def _candidates(left, right, same, metric, limit, between):
    """Index pairs that no lower bound rules out, a block of left rows at a time."""
    reach = limit * (1 + 1e-9) + 1e-12
    ranged, guests, following = (x.any() or y.any() for x, y in ((left.away, right.away), (left.guest, right.guest), (left.next, right.next)))
    bound = metric.bound(left.matrix, right.matrix, reach) if len(left.away) * len(right.away) > _BLOCK else None
    for at in range(0, len(left.away), _BLOCK):
        rows = slice(at, at + _BLOCK)
        open_ = np.ones((len(left.away[rows]), len(right.away)), bool)
        if ranged:
            open_ &= np.abs(left.away[rows, None] - right.away[None, :]) <= reach
        if following:
            open_ &= ~(left.next[rows, None] & right.next[None, :])
        if between:
            open_ &= left.guest[rows, None] != right.guest[None, :]
        elif guests:
            open_ &= ~(left.guest[rows, None] & right.guest[None, :])
        if same:
            open_ &= np.arange(at, at + open_.shape[0])[:, None] < np.arange(len(right.away))[None, :]
        quick = bound is not None and open_.mean() > _DENSE
        if quick:
            open_ &= bound(rows)
        for k in range(0 if quick else left.probes.shape[1]):
            if not open_.any():
                break
            open_ &= np.abs(left.probes[rows, k, None] - right.probes[None, :, k]) <= reach
        if open_.mean() > _DENSE:
            open_ &= metric.block(left.matrix[rows], right.matrix) <= reach
        i, j = np.nonzero(open_)
        if len(i):
            yield i + at, j


def _emit(metric, limit, between, audit, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        is_left, is_right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        same = bool((is_left & is_right).any())
        left = _Side(table.filter(pa.array(is_left)))
        right = left if same else _Side(table.filter(pa.array(is_right)))
        looked = near = 0
        for i, j in _candidates(left, right, same, metric, limit, between):
            step = max(1, _CELLS // max(1, left.matrix.shape[1]))
            for at in range(0, len(i), step):
                a, b = i[at:at + step], j[at:at + step]
                dist = metric.of_pairs(left.matrix[a], right.matrix[b])
                keep = dist <= limit
                looked, near = looked + len(a), near + int(keep.sum())
                if audit or not keep.any():
                    continue
                a, b, dist = a[keep], b[keep], dist[keep]
                ids_a, ids_b = left.ids.take(pa.array(a)), right.ids.take(pa.array(b))
                swap = pa.array(left.guest[a]) if between else pc.greater(ids_a, ids_b)
                first, second = pc.if_else(swap, ids_b, ids_a), pc.if_else(swap, ids_a, ids_b)
                yield pa.RecordBatch.from_arrays([first, second, pa.array(dist)], names=names)
        if audit:
            yield pa.RecordBatch.from_arrays([pa.array([table.num_rows]), pa.array([looked]), pa.array([near])], names=names)
    return run


def within(sigs: DataFrame, method: str, limit: float, theta=None, scale="none", queries: DataFrame = None, id_col="id", rows_per_slice=None, audit=False) -> DataFrame:
    """``id_a, id_b, dist`` of all pairs with a distance of at most ``limit``; ``euclid`` is the true distance here, not its square.

    Within ``sigs`` each unordered pair comes once, the smaller id first; with ``queries`` every row meets every query.  Ids are unique per table.
    Missing, empty and incomplete vectors, and vectors of different length, have no distance.  ``audit`` gives ``rows, compared, near`` per tile instead.
    """
    metric = metric_of(method, theta, scale)
    if metric is None:
        raise ValueError(f"{method} is no metric")
    if limit < 0:
        raise ValueError("the limit must not be negative")
    rows = _rows(sigs, id_col, metric.saturated)
    n, widest = rows.agg(F.count("*"), F.max(F.size("sig"))).first()
    fields = [T.StructField(c, T.LongType()) for c in ("rows", "compared", "near")] if audit else [
        T.StructField("id_a", rows.schema["id"].dataType), T.StructField("id_b", rows.schema["id"].dataType), T.StructField("dist", T.DoubleType())]
    schema = T.StructType(fields)
    if not n:
        return sigs.sparkSession.createDataFrame([], schema)
    pivots = pivots_of(rows, n, widest)
    asked = None if queries is None else _rows(queries, id_col, metric.saturated)
    fit, per_slice = rows_that_fit(widest), rows_per_slice or min(ROWS, rows_that_fit(widest))
    grid = False
    if limit > 0 and pivots:
        visited, every = _visited(rows, pivots, metric, limit, own_only=asked is not None), n
        if asked is not None:
            visited, every = visited.unionAll(_visited(asked, pivots, metric, limit, guests_only=True)), n + asked.count()
        slices = slice_count(every, fit, sigs.sparkSession.sparkContext.defaultParallelism)
        grid = _cells_ship(visited, per_slice) > every * max(_VISITS, slices)
        if grid:
            per_slice = rows_per_slice or math.ceil(every / slices)
    placed = _placed(rows, pivots, metric, limit, False, grid)
    if asked is not None:
        placed = placed.where("not guest").unionAll(_placed(asked, pivots, metric, limit, True, grid))
    tiles = _tiles(cut_lineage(placed), limit, per_slice)
    return tiles.groupBy("cell", "range", "i", "j").applyInArrow(_emit(metric, limit, queries is not None, audit, schema.fieldNames()), schema)

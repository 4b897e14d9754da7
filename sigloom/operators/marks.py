"""Runs and gaps on marked positions: one row per position with a boolean mark.

All operators take ``key`` columns, an integer position column without holes and a mark column.  Positions are cut
into fixed-size chunks that carry a halo of neighbours, so one enormous sequence is spread over many tasks.
"""

from pyspark.sql import DataFrame, Window, functions as F

CHUNK = 1 << 16


def _with_halo(marks, key, pos, reach, chunk):
    """Copy every row to the chunks whose positions lie within ``reach`` of it."""
    first = F.floor((F.col(pos) - reach) / chunk).cast("long")
    last = F.floor((F.col(pos) + reach) / chunk).cast("long")
    return marks.withColumn("_chunk", F.explode(F.sequence(first, last)))


def _own(df, pos, chunk):
    return df.where(F.floor(F.col(pos) / chunk) == F.col("_chunk")).drop("_chunk")


def _neighbourhood(marks, key, pos, mark, amount, chunk, fold):
    near = Window.partitionBy(*key, "_chunk").orderBy(pos).rangeBetween(-amount, amount)
    spread = _with_halo(marks, key, pos, amount, chunk)
    return _own(spread.withColumn(mark, fold(F.col(mark).cast("int")).over(near) == 1), pos, chunk)


def dilate(marks: DataFrame, key, pos, mark, amount, chunk=CHUNK) -> DataFrame:
    """Mark every position within ``amount`` of a mark."""
    return _neighbourhood(marks, list(key), pos, mark, amount, chunk, F.max)


def erode(marks: DataFrame, key, pos, mark, amount, chunk=CHUNK) -> DataFrame:
    """Unmark every position within ``amount`` of an unmarked one (the ends of the sequence do not count)."""
    return _neighbourhood(marks, list(key), pos, mark, amount, chunk, F.min)


def runs(marks: DataFrame, key, pos, mark, chunk=CHUNK) -> DataFrame:
    """``key…, mark, begin, length``: maximal runs of equal marks.

    Runs are found per chunk.  Only those touching a chunk border, at most two per chunk, go on to a pass over chunks of ``chunk`` chunks,
    and only those touching the border of such a large chunk to the pass along the sequence; all others are final.
    """
    key = list(key)
    chunked = marks.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    local = Window.partitionBy(*key, "_chunk").orderBy(pos)
    turn = F.coalesce((F.col(mark) != F.lag(mark).over(local)).cast("int"), F.lit(1))
    pieces = (chunked.withColumn("_turn", turn).withColumn("_piece", F.sum("_turn").over(local))
              .groupBy(*key, "_chunk", "_piece", mark).agg(F.min(pos).alias("begin"), F.count("*").alias("length")))
    done = []
    for size, wider in ((chunk, chunk * chunk), (chunk * chunk, None)):
        touches = (F.col("begin") % size == 0) | ((F.col("begin") + F.col("length")) % size == 0)
        done.append(pieces.where(~touches).select(*key, mark, "begin", "length"))
        within = key if wider is None else [*key, "_wide"]
        border = pieces.where(touches) if wider is None else pieces.where(touches).withColumn("_wide", F.floor(F.col("begin") / wider))
        along = Window.partitionBy(*within).orderBy("begin")
        joins = (F.lag(mark).over(along) == F.col(mark)) & (F.lag(F.col("begin") + F.col("length")).over(along) == F.col("begin"))
        pieces = (border.withColumn("_turn", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("_run", F.sum("_turn").over(along))
                  .groupBy(*within, "_run", mark).agg(F.min("begin").alias("begin"), F.sum("length").alias("length")))
    return done[0].unionByName(done[1]).unionByName(pieces.select(*key, mark, "begin", "length"))


def split_marked(marks: DataFrame, key, pos, mark, keep="marked", chunk=CHUNK) -> DataFrame:
    """Runs that are ``marked``, ``unmarked``, or unmarked ``intervals`` lying between two marked runs."""
    key = list(key)
    found = runs(marks, key, pos, mark, chunk)
    if keep == "marked":
        return found.where(F.col(mark)).drop(mark)
    if keep == "unmarked":
        return found.where(~F.col(mark)).drop(mark)
    # an unmarked run has marked neighbours on both sides unless it begins or ends its sequence
    ends = marks.groupBy(*key).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    inside = (F.col("begin") > F.col("_lo")) & (F.col("begin") + F.col("length") - 1 < F.col("_hi"))
    return found.where(~F.col(mark)).join(ends, key).where(inside).drop(mark, "_lo", "_hi")


def bridge_gaps(marks: DataFrame, key, pos, mark, amount, chunk=CHUNK) -> DataFrame:
    """Mark the unmarked runs of at most ``amount`` positions that lie between two marked runs.

    A gap that short is visible within ``amount`` positions, so no position needs more than its halo.
    """
    key = list(key)
    spread = _with_halo(marks, key, pos, amount + 1, chunk)
    ordered = Window.partitionBy(*key, "_chunk").orderBy(pos)
    behind = F.max(F.when(F.col(mark), F.col(pos))).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col(mark), F.col(pos))).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    gap = spread.withColumn("_b", behind).withColumn("_a", ahead)
    bridged = F.col(mark) | F.coalesce(F.col("_a") - F.col("_b") - 1 <= amount, F.lit(False))
    return _own(gap.withColumn(mark, bridged).drop("_a", "_b"), pos, chunk)


def high_deltas(values: DataFrame, key, pos, value, threshold, expected_change=0, chunk=CHUNK) -> DataFrame:
    """Rows whose value rises by more than ``threshold + expected`` or falls by more than ``threshold - expected``."""
    key = list(key)
    spread = _with_halo(values, key, pos, 1, chunk)
    before = F.lag(value).over(Window.partitionBy(*key, "_chunk").orderBy(pos))
    delta = F.col(value) - F.col("_before")
    jump = ((delta > 0) & (delta > threshold + expected_change)) | ((delta <= 0) & (-delta > threshold - expected_change))
    return _own(spread.withColumn("_before", before).where(jump).drop("_before"), pos, chunk)

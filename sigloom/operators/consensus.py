"""Sequences extended by others that overlap them, the bases of the new sequence decided by weighted votes.

An overlap is the diagonal of the longest maximal exact match of two sequences.  Every base of a target and of what is laid along it votes for its position with its
quality; the votes are summed per position and base before the shuffle, so neither a target that attracts most of the reads nor a deep position gathers in one
task.  The new sequences come in pieces of a fixed number of positions.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sigloom.operators.matches import maximal_matches

# --- fixed values -----------------------------------------------------------------------------
DEFAULT_QUALITY = 30  # of a base that comes without one
MOST_QUALITY = 96
# ----------------------------------------------------------------------------------------------

#: Positions of one piece of a new sequence.
PIECE = 1 << 14
_SLICE = 1 << 18


def overlaps(extensions: DataFrame, targets: DataFrame, seed=20) -> DataFrame:
    """``query, ref, offset, length``: for each extension and target that share at least ``seed`` bases in a row, where the extension begins along the target.

    The longest shared stretch decides, then its first place in the target, then in the extension.  Both sides are ``id, seq``.
    """
    found = maximal_matches(extensions, targets, seed)
    longest = F.min(F.struct((-F.col("length")).alias("short"), "ref_pos", "query_pos")).alias("m")
    return found.groupBy("query", "ref").agg(longest).select(
        "query", "ref", (F.col("m.ref_pos") - F.col("m.query_pos")).cast("long").alias("offset"), (-F.col("m.short")).cast("long").alias("length"))


def _ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per base: its target, position, character and weight, and the weight again where it is not the target's own."""
    for batch in batches:
        ids, held, size = batch.column("id"), [], 0

        def rows():
            row, pos, base, weight, added = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *map(pa.array, (pos, base, weight, added))], names=["id", "pos", "base", "weight", "added"])

        for row, (offset, seq, quality, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("offset", "seq", "quality", "own")))):
            bases = np.frombuffer(seq.encode("ascii", "replace"), np.uint8).astype(np.int16)
            weights = np.full(len(bases), DEFAULT_QUALITY, np.int64)
            if quality is not None:
                given = np.array([DEFAULT_QUALITY if q is None else q for q in quality[:len(bases)]], np.int64)
                weights[:len(given)] = given
            for at in range(0, len(bases), _SLICE):
                base, weight = bases[at:at + _SLICE], weights[at:at + _SLICE]
                held.append((np.full(len(base), row), offset + at + np.arange(len(base)), base, weight, np.zeros_like(weight) if own else weight))
                size += len(base)
                if size >= _SLICE:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()


def extended(targets: DataFrame, extensions: DataFrame, placed: DataFrame, piece=PIECE) -> DataFrame:
    """``id, begin, seq, quality``: the pieces of every extended target, ``begin`` counted from the first base of the target before the extension.

    ``targets`` and ``extensions`` are ``id, seq`` and, if known, ``quality`` (an array of one integer per base; a missing one counts as 30).  ``placed`` is the
    result of ``overlaps``.  The base with the largest weight wins; on a tie the one that the extensions favour, then the first in the alphabet.
    Its quality is its weight less that of all others, from 0 to 96.  A target without extensions comes back as it is, one without bases has no pieces,
    and a NULL sequence counts as empty.
    """
    def rows(frame, offset, own):
        quality = F.col("quality").cast("array<int>") if "quality" in frame.columns else F.lit(None).cast("array<int>")
        return frame.select("id", offset.cast("long").alias("offset"), F.coalesce("seq", F.lit("")).alias("seq"), quality.alias("quality"), F.lit(own).alias("own"))

    by_query = extensions.withColumnRenamed("id", "query")
    along = by_query.join(placed.select("query", "ref", "offset"), "query").withColumnRenamed("ref", "id")
    laid = rows(targets, F.lit(0), True).unionByName(rows(along, F.col("offset"), False))
    schema = T.StructType([laid.schema["id"], T.StructField("pos", T.LongType()), T.StructField("base", T.ShortType()), T.StructField("weight", T.LongType()), T.StructField("added", T.LongType())])
    votes = laid.mapInArrow(_ballots, schema).groupBy("id", "pos", "base").agg(F.sum("weight").alias("weight"), F.sum("added").alias("added"))
    winner = F.max(F.struct("weight", "added", (-F.col("base")).alias("first"))).alias("w")
    won = votes.groupBy("id", "pos").agg(winner, F.sum("weight").alias("all")).select(
        "id", "pos", F.char(-F.col("w.first")).alias("base"), F.greatest(F.lit(0), F.least(F.lit(MOST_QUALITY), 2 * F.col("w.weight") - F.col("all"))).cast("int").alias("q"))
    part = won.withColumn("_piece", F.floor(F.col("pos") / piece))
    ordered = part.groupBy("id", "_piece").agg(F.sort_array(F.collect_list(F.struct("pos", "base", "q"))).alias("x"))
    return ordered.select("id", F.col("x")[0]["pos"].alias("begin"), F.array_join(F.col("x.base"), "").alias("seq"), F.col("x.q").alias("quality"))


def joined(pieces: DataFrame) -> DataFrame:
    """``id, begin, seq, quality``: pieces put together, for targets that are small enough to be one value."""
    order = F.sort_array(F.collect_list(F.struct("begin", "seq", "quality")))
    return pieces.groupBy("id").agg(order.alias("x")).select("id", F.col("x")[0]["begin"].alias("begin"), F.array_join(F.col("x.seq"), "").alias("seq"), F.flatten(F.col("x.quality")).alias("quality"))

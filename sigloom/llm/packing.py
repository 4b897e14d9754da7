"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest length.  Each task packs a bounded share of the pieces, longest first: a piece goes
into the open bin that it fills best, or into a new bin of the length that costs least for what is likely to fill it.  At the end every
bin is closed at the smallest permitted length that holds its contents.
"""

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Written, pick

OUT = "doc_id long, piece int, start long, length int, bin long, bin_length int, bin_start int"


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths and the cost of a sequence: ``fixed + per_token * L + per_square * L**2``."""
    permitted: tuple[int, ...] = (2048, 4096, 8192, 16384)
    fixed: float = 64.0
    per_token: float = 1.0
    per_square: float = 1.0 / 65536
    #: Pieces that one task packs; the number of tasks follows from it.
    pieces_per_task: int = 100_000

    def __post_init__(self):
        if not self.permitted or min(self.permitted) < 1:
            raise ValueError("permitted lengths must be positive")

    def cost(self, length):
        return self.fixed + self.per_token * length + self.per_square * length * length


def pack(lengths, how: Lengths):
    """``bin, start, bin_length`` of each piece, for an array of piece lengths; pieces of length 0 go where there is room.

    Best fit over all open bins: of those with room the one with the least room left, and of those the oldest.
    """
    sizes = sorted(set(how.permitted))
    lengths = np.asarray(lengths, "i8")
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order]
    below = np.r_[np.cumsum(ranked[::-1])[::-1], 0]  # total of the pieces from a rank on
    bins, starts = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    used, capacity = [], []
    rooms: list[int] = []  # the distinct amounts of room, sorted
    by_room: dict[int, list[int]] = {}
    for rank, (at, length) in enumerate(zip(order.tolist(), ranked.tolist())):
        found = bisect_left(rooms, length)
        if found == len(rooms):
            bin_ = len(used)
            capacity.append(_opened(length, rank, ranked, below, sizes, how))
            used.append(0)
        else:
            room = rooms[found]
            bin_ = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[found]
        bins[at], starts[at] = bin_, used[bin_]
        used[bin_] += length
        left = capacity[bin_] - used[bin_]
        if left in by_room:
            by_room[left].append(bin_)
        elif left:
            by_room[left] = [bin_]
            insort(rooms, left)
    closed = np.array([sizes[bisect_left(sizes, u)] for u in used], "i8")
    return bins, starts, closed[bins] if len(bins) else bins


def _opened(length, rank, ranked, below, sizes, how):
    """The capacity with the least cost per token, given that smaller pieces fill it as far as they last."""
    best = None
    for size in sizes:
        if size < length:
            continue
        # pieces after this one that fit beside it: ranked is descending
        first = max(rank + 1, int(np.searchsorted(-ranked, -(size - length), "left")))
        filled = min(size, length + int(below[first]))
        closed = sizes[bisect_left(sizes, filled)]
        price = how.cost(closed) / max(filled, 1)
        if best is None or price < best[0]:
            best = (price, size)
    return best[1]


def pieces_of(docs: DataFrame, longest: int, id_col="doc_id", length_col="length") -> DataFrame:
    """``doc_id, piece, start, length``: each document in pieces of at most ``longest``; a null or negative length counts as 0."""
    rows = pick(docs, doc_id=id_col, length=length_col)
    length = F.greatest(F.coalesce(F.col("length"), F.lit(0)), F.lit(0)).cast("long")
    rows = rows.select(F.col("doc_id").cast("long"), length.alias("total"))
    last = F.greatest(F.ceil(F.col("total") / longest), F.lit(1)) - 1
    cut = rows.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * longest
    return cut.select("doc_id", F.col("piece").cast("int"), start.alias("start"), F.least(F.col("total") - start, F.lit(longest)).cast("int").alias("length"))


def pack_documents(docs: DataFrame, how: Lengths = Lengths(), id_col="doc_id", length_col="length") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, bin, bin_length, bin_start``.

    Every document's pieces cover it without gaps; every bin is one permitted length, and its pieces do not overlap.  A document of length 0
    is one empty piece.  Pieces are dealt to the tasks in turn, so repeated ids or lengths make no task larger; which bin a piece gets depends on
    how its table is split, which pieces and which totals do not.
    """
    written = Written(docs.sparkSession)
    pieces = written.table(pieces_of(docs, max(how.permitted), id_col, length_col))
    tasks = max(1, -(-pieces.count() // how.pieces_per_task))

    def run(batches):
        import itertools

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = pa.Table.from_batches(list(itertools.chain([first], batches)))
        bins, starts, closed = pack(rows["length"].to_numpy(), how)
        rows = rows.append_column("bin", pa.array((np.int64(part) << 32) + bins))
        rows = rows.append_column("bin_length", pa.array(closed, pa.int32())).append_column("bin_start", pa.array(starts, pa.int32()))
        yield from rows.to_batches(max_chunksize=10_000)

    return pieces.repartition(tasks).mapInArrow(run, OUT)


def utf8_lengths(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, length`` under a byte vocabulary: the UTF-8 bytes and one end mark; a null text has the mark alone."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.select("doc_id", (F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1).cast("long").alias("length"))

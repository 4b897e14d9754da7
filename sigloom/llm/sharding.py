"""Reproducible shuffle into shards: a keyed Feistel permutation of global row numbers, walked until it stays in range.

A row's place is a pure function of its row number, the number of rows and the seed, so shard and slot can be computed for any
row without touching the others, and the row of any place by the inverse.  Everything is a Column expression.
"""

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Written, pick

HALF_ROUNDS = 8
PRIME = 2**31 - 1
MULTIPLIERS = (1103515245, 48271)
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row in the partition below


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:4], "big") % PRIME for i in range(HALF_ROUNDS)]


def radices(n: int) -> tuple[int, int]:
    """The two halves of the Feistel domain: the smallest near-square that holds ``n``, at most ``sqrt(n)`` too large."""
    left = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return left, max(1, -(-n // left))


def _mix(value: Column, key: Column) -> Column:
    once = (value * MULTIPLIERS[0] + key) % PRIME
    return (once * once % PRIME * MULTIPLIERS[1] + key) % PRIME


def _quotient(value: Column, by: int) -> Column:
    """Whole division of non-negative numbers; the remainder goes first, so the division of doubles is exact below 2**53."""
    return ((value - value % by) / by).cast("long")


def _feistel(value: Column, n: int, keys: list[int], inverse: bool) -> Column:
    left, right = radices(n)
    sign = -1 if inverse else 1
    rounds = [(i % 2, k) for i, k in enumerate(keys)]
    rounds = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(key).cast("long").alias("key"))
                       for side, key in (rounds[::-1] if inverse else rounds)])

    def step(at, r):
        return F.struct(
            F.when(r["side"] == 0, F.pmod(at["l"] + sign * _mix(at["r"], r["key"]), F.lit(left))).otherwise(at["l"]).alias("l"),
            F.when(r["side"] == 1, F.pmod(at["r"] + sign * _mix(at["l"], r["key"]), F.lit(right))).otherwise(at["r"]).alias("r"))

    start = F.struct(_quotient(value, right).alias("l"), (value % F.lit(right)).cast("long").alias("r"))
    return F.aggregate(rounds, start, step, lambda at: at["l"] * F.lit(right) + at["r"])


def permuted(row: Column, n: int, seed: int = 0, inverse: bool = False) -> Column:
    """A bijection of ``0 … n-1``.

    The domain of the Feistel network has at most ``sqrt(n)`` numbers too many.  A row that lands on one of them is sent on until it
    is back in range.  Each step leaves the range with odds below ``1/sqrt(n)``; ``steps`` covers every possible walk up to 64 and
    beyond that all but odds under ``n * n**-32``.  A row still outside would raise, never be misplaced.
    """
    left, right = radices(n)
    steps = min(left * right - n + 1, 64)
    keys = round_keys(seed)
    row = row.cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(row.alias("at"), F.lit(True).alias("out")),
        lambda acc, _: F.when(acc["out"], _landed(_feistel(acc["at"], n, keys, inverse), n)).otherwise(acc))
    return F.when(~walked["out"], walked["at"]).otherwise(F.raise_error(F.lit("the walk did not return to the range")).cast("long"))


def _landed(place: Column, n: int) -> Column:
    # a one-element transform names the place, which is then used twice without being computed twice
    return F.transform(F.array(place), lambda p: F.struct(p.alias("at"), (p >= F.lit(n)).alias("out")))[0]


def numbered(df: DataFrame, order: list[str], written: Written) -> tuple[DataFrame, int]:
    """``df`` with ``row``, its rank in ``order`` from 0, and the number of rows.

    Range partitions are sorted on their own and written; one row per partition then gives the offsets.  Rows that agree in every
    ``order`` column are interchangeable; a random last key lets even a single repeated row fill many partitions.
    """
    tied = df.withColumn("tie", F.rand(17))
    placed = tied.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    placed = written.table(placed.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", _ROW_BITS).alias("part")
    counts = placed.groupBy(part).agg(F.count("*").alias("rows"))
    starts = counts.selectExpr("part", "coalesce(sum(rows) over (order by part rows between unbounded preceding and 1 preceding), 0) as start")
    # one row per partition: bounded by the number of tasks, not by the data
    out = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    row = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return out.select(*df.columns, row.alias("row")), placed.count()


def shard_rows(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, row``.

    Rows are numbered in the order of id (nulls first), checksum and size, permuted, and dealt out in turn, so the counts of two
    shards differ by one at most and slots have no gaps (law ``rows``).  ``size`` is the UTF-8 length of the text plus 8; a null
    text has no bytes and checksum 0.  Repeated rows are places of their own.  An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(keyed, ["doc_id", "text_crc32", "size"], Written(docs.sparkSession))
    place = permuted(F.col("row"), n, seed)
    return rows.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        _quotient(F.col("place"), shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row")


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """The row number at a place: the inverse of ``shard_rows``."""
    return permuted(slot * shards + shard, n, seed, inverse=True)

"""Joins on keys of which one may hold a large share of all rows."""

from pyspark.sql import DataFrame, functions as F

from sigloom.session import cut_lineage

#: Keys that are dealt over salts: the largest ones, at most so many, so their list may be broadcast.  Any other key has fewer than one row in so many.
MOST = 1_000
#: Rows of a key that one task may get.
PER_TASK = 100_000


def large_keys(rows: DataFrame, keys: list[str], per_task=None) -> DataFrame:
    """``*keys, _salts``: the keys with more rows than a task should get, and the number of tasks they are dealt over."""
    per_task = per_task or PER_TASK
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > per_task)
    return cut_lineage(counted.orderBy(F.desc("_n"), *keys).limit(MOST).select(*keys, F.ceil(F.col("_n") / per_task).cast("int").alias("_salts")))


def dealt_join(large: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how="inner", per_task=None) -> DataFrame:
    """``large`` joined with ``small`` on ``keys`` (inner or left).

    The rows of a large key are dealt by ``spread`` over salts counted from ``large``; the rows that ``small`` has of it are repeated for each salt.
    """
    hot = large_keys(large, keys, per_task)
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"))
    dealt = large.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    repeated = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")

"""Random sequences for trials: every row is a function of its id and the seed."""

from pyspark.sql import DataFrame, functions as F

# --- fixed values -----------------------------------------------------------------------------
GENERATOR_FACTOR, GENERATOR_MODULUS = 48271, 2 ** 31 - 1  # minimal standard generator
# ----------------------------------------------------------------------------------------------


def random_sequences(spark, rows, length, seed=1) -> DataFrame:
    """``id, seq``: uniform bases from the minimal standard generator, one stream per row."""
    start = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(GENERATOR_MODULUS - 1)) + 1
    step = lambda state, _: F.struct(
        (state["x"] * GENERATOR_FACTOR % GENERATOR_MODULUS).alias("x"),
        F.concat(state["s"], F.substring(F.lit("ACGT"), (state["x"] * 4 / GENERATOR_MODULUS).cast("int") + 1, F.lit(1))).alias("s"))
    built = F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.struct(start.alias("x"), F.lit("").alias("s")), step, lambda state: state["s"])
    return spark.range(rows).select("id", built.alias("seq"))

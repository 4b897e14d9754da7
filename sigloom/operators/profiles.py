"""Element-wise statistics of groups of signatures, and per-group representatives."""

from pyspark.sql import DataFrame, functions as F

from sigloom.operators.pairs import PairJob


def _positions(sigs, by, weight_col=None):
    """Long form ``by…, pos, x, w``; partial sums per position are combined before the shuffle."""
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    return sigs.select(*by, weight.alias("w"), F.posexplode_outer("sig").alias("pos", "x")).where("pos is not null")


def _gather(stats, by, columns):
    entries = F.sort_array(F.collect_list(F.struct("pos", *columns)))
    grouped = stats.groupBy(*by).agg(entries.alias("_e")) if by else stats.agg(entries.alias("_e"))
    return grouped.select(*by, *[F.col(f"_e.{c}").alias(c) for c in columns])


def average_signature(sigs: DataFrame, by=(), weight_col=None) -> DataFrame:
    """Element-wise (weighted) mean of the signatures of every group."""
    stats = _positions(sigs, by, weight_col).groupBy(*by, "pos").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("sig"))
    return _gather(stats, list(by), ["sig"])


def variance_signature(sigs: DataFrame, by=(), weight_col=None) -> DataFrame:
    """Element-wise (weighted) population variance: mean of squares minus square of the mean."""
    stats = _positions(sigs, by, weight_col).groupBy(*by, "pos").agg(_variance().alias("sig"))
    return _gather(stats, list(by), ["sig"])


def _variance():
    x, w = F.col("x"), F.col("w")
    mean = F.try_divide(F.sum(x * w), F.sum(w))
    return F.try_divide(F.sum(x * x * w), F.sum(w)) - mean * mean


def normal_parameters(sigs: DataFrame, by=(), weight_col=None) -> DataFrame:
    """``by…, mean, sd``: parameters of a normal distribution per element."""
    x, w = F.col("x"), F.col("w")
    stats = _positions(sigs, by, weight_col).groupBy(*by, "pos").agg(
        F.try_divide(F.sum(x * w), F.sum(w)).alias("mean"), F.sqrt(F.greatest(_variance(), F.lit(0.0))).alias("sd"))
    return _gather(stats, list(by), ["mean", "sd"])


def medoids(sigs: DataFrame, group_col, method="manhattan", **options) -> DataFrame:
    """``group, id, dist_sum``: the row of each group with the smallest summed distance to its group.

    Distances stay in the tiles; only one partial sum per row and tile is shuffled.  The later row wins a tie.
    """
    sums = PairJob(sigs, method, within=group_col, **options).row_sums()
    groups = sigs.select(F.col("id"), F.col(group_col))
    joined = groups.join(sums, "id", "left").withColumn("dist_sum", F.coalesce("dist_sum", F.lit(0.0)))
    best = F.min_by(F.struct("id", "dist_sum"), F.struct(F.col("dist_sum"), -F.col("id"))).alias("_b")
    return joined.groupBy(group_col).agg(best).select(group_col, "_b.id", "_b.dist_sum")

"""Expressions on ``ARRAY<DOUBLE>`` columns: distances of two arrays already side by side, arithmetic, reductions.

For all-pairs work use ``operators.pairs``; these builders serve rows that a join has already put together.
Incomparable arrays (empty or of different length) give NULL.
"""

from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def array_sum(a):
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def _sum_of(a, b, term):
    return array_sum(F.zip_with(_col(a), _col(b), term))


def _comparable(a, b, value):
    a, b = _col(a), _col(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value)


def _scale(a, b, scale):
    n = F.size(_col(a)).cast("double")
    if scale == "dims":
        return 1.0 / n
    if scale == "inverse_dims":
        return n
    if scale == "mean":
        return F.try_divide(F.lit(2.0), array_sum(a) / n + array_sum(b) / n)
    return F.lit(1.0)


def manhattan(a, b, scale="none"):
    return _comparable(a, b, _sum_of(a, b, lambda x, y: F.abs(x - y)) * _scale(a, b, scale))


def euclid_sq(a, b, scale="none"):
    factor = _scale(a, b, scale)
    return _comparable(a, b, _sum_of(a, b, lambda x, y: (x - y) * (x - y)) * factor * factor)


def euclid(a, b):
    return F.sqrt(euclid_sq(a, b))


def saturated_manhattan(a, b, theta=0.02):
    n = F.size(_col(a))
    if theta == 0:
        return _comparable(a, b, _sum_of(a, b, lambda x, y: (x != y).cast("double")) / n)
    return _comparable(a, b, _sum_of(a, b, lambda x, y: F.least(F.abs(x - y), F.lit(theta))) / (n * theta))


def saturated_euclid(a, b, theta=0.02):
    capped = _sum_of(a, b, lambda x, y: F.least((x - y) * (x - y), F.lit(theta * theta)))
    return _comparable(a, b, F.sqrt(capped / (F.size(_col(a)) * theta * theta)))


def exceed_share(a, b, theta=0.02):
    return _comparable(a, b, _sum_of(a, b, lambda x, y: (F.abs(x - y) > theta).cast("double")) / F.size(_col(a)))


def covariance(a, b):
    """Population covariance of two arrays."""
    n = F.size(_col(a))
    return _comparable(a, b, _sum_of(a, b, lambda x, y: x * y) / n - array_sum(a) / n * (array_sum(b) / n))


def pearson(a, b):
    """Correlation of two arrays, NULL when one is constant."""
    n = F.size(_col(a)).cast("double")
    sx, sy = array_sum(a), array_sum(b)
    xy = _sum_of(a, b, lambda x, y: x * y)
    xx, yy = _sum_of(a, a, lambda x, y: x * y), _sum_of(b, b, lambda x, y: x * y)
    spread = F.sqrt(F.greatest(n * xx - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * yy - sy * sy, F.lit(0.0)))
    return _comparable(a, b, F.try_divide(n * xy - sx * sy, spread))


def pearson_distance(a, b):
    return 1.0 - (pearson(a, b) + 1.0) / 2.0


def average_z(sample, mean, sd):
    """Mean of ``|x - mean| / sd`` over the positions."""
    zs = F.zip_with(F.zip_with(_col(sample), _col(mean), lambda x, m: F.abs(x - m)), _col(sd), lambda d, s: F.try_divide(d, s))
    return _comparable(sample, mean, array_sum(zs) / F.size(_col(sample)))


# ---------------------------------------------------------------- arithmetic

def add(a, b):
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def subtract(a, b):
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def multiply(a, b):
    return F.zip_with(_col(a), _col(b), lambda x, y: x * y)


def scale(a, factor):
    return F.transform(_col(a), lambda x: x * factor)


def negate(a):
    return F.transform(_col(a), lambda x: -x)


def inverse(a):
    return F.transform(_col(a), lambda x: F.try_divide(F.lit(1.0), x))


def absolute(a):
    return F.transform(_col(a), F.abs)


def fill(value, n):
    return F.array_repeat(F.lit(value), n)


def convert(a, element_type):
    return _col(a).cast(f"array<{element_type}>")


def permute(a, order):
    """Elements of ``a`` in the order of the 0-based positions in ``order``."""
    a = _col(a)
    return F.transform(_col(order), lambda i: F.get(a, i.cast("int")))


def ordinal_ranks(a):
    """0-based ranks within the array; equal values are ranked by position."""
    a = _col(a)
    indexed = F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    by_rank = F.transform(F.sort_array(indexed), lambda s, r: F.struct(s["i"].alias("i"), r.cast("double").alias("r")))
    return F.transform(F.sort_array(by_rank), lambda s: s["r"])


# ---------------------------------------------------------------- reductions

def average(a):
    return F.try_divide(array_sum(a), F.size(_col(a)).cast("double"))


def norm(a):
    return F.sqrt(_sum_of(a, a, lambda x, y: x * y))


def minimum(a):
    return F.array_min(_col(a))


def maximum(a):
    return F.array_max(_col(a))


def argmin(a):
    """0-based position of the first smallest element."""
    return (F.array_position(_col(a), F.array_min(_col(a))) - 1).cast("int")


def argmax(a):
    return (F.array_position(_col(a), F.array_max(_col(a))) - 1).cast("int")


def quantile(a, q):
    """Element at rank ``floor(q * n)`` of the sorted array (the last one for q = 1)."""
    a = _col(a)
    at = F.least(F.floor(F.size(a) * F.lit(float(q))).cast("int"), F.size(a) - 1)
    return F.get(F.sort_array(a), at)


def median(a):
    return quantile(a, 0.5)


def variance(a):
    """Population variance of the elements."""
    mean = average(a)
    return average(F.transform(_col(a), lambda x: x * x)) - mean * mean

"""Whitening of embeddings: leading components of the covariance by FEAST contour integration.

* The covariance comes from two passes over the rows.  The first sums integers, so the mean is exact; the second multiplies centred rows.
  Tasks hand over one partial matrix each, summed by cell.
* Interval ends come from inertia counts: by Sylvester's law the number of negative pivots of a shifted matrix is the number of
  eigenvalues below the shift.  Each interval holds a few eigenvalues and is one Spark row, solved on its own.
* In an interval, quadrature of ``(z I - V)^-1 Y`` over a circle projects random vectors onto the wanted eigenspace; Rayleigh-Ritz takes the
  components out of the subspace, and the round repeats from the Ritz vectors until the residuals are at the limit of rounding.  As many
  components as the inertia count says must come out.

What the driver holds is the matrix (dimension squared), never a row of the table.

Which rows count: a vector that is null, empty, or holds a null, NaN or infinite entry is left out.  The dimension is the length that most of the
remaining vectors have (the smaller one on a tie); vectors of another length cannot be compared and are left out too.  Rows that repeat count
each time; a null id is kept.  Components without variance (constant vectors, fewer rows than dimensions) do not exist, so the result
has fewer than the wanted number of components, down to none for an empty table.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Written, pick

SCALE, OFFSET = 1024, 100_000
#: Wanted eigenvalues per interval, and Gauss-Legendre nodes on the upper half circle.
PER_INTERVAL, NODES = 4, 8
_ROUNDS = 40


# ---------------------------------------------------------------------------------------------------------------- rows
def usable_vectors(table: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """``vec_id, v`` (array of double) of the rows that count; one aggregate finds the dimension."""
    rows = pick(table, vec_id=id_col, v=vector_col).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (lengths["d"] if lengths else -1))


def _integers(batch):
    """The vectors of a batch as a matrix of whole numbers."""
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * flat)
    if x.size and np.abs(x).max() > 2.0 ** 62:
        raise OverflowError("a scaled entry does not fit into a long")
    return x.astype(np.int64).reshape(batch.num_rows, -1) + OFFSET


def moments(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums per dimension (Python integers)."""
    def partial(batches):
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch)
                some = x.sum(axis=0, dtype=object)
                n, sums = n + len(x), some if sums is None else sums + some
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array([str(s) for s in [n, *sums]])], names=["i", "total"])

    got = vectors.select("v").mapInArrow(partial, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = {r["i"]: int(r["total"]) for r in got}
    return sums.pop(-1, 0), np.array([sums[i] for i in sorted(sums)], dtype=object)


def _centre(n, sums):
    """The mean as a whole number and a small remainder, so that centring keeps every digit."""
    base = np.array([round(s / n) if abs(s) < 1 << 52 else (2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(b)) / n for s, b in zip(sums, base)], dtype=np.float64)
    return base, rest


def covariance(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    base, rest = _centre(n, sums)
    d = len(base)

    def partial(batches):
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = (_integers(batch) - base) - rest
                total += x.T @ x
        if total.any():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = vectors.select("v").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # d * (d + 1) / 2 rows
    out = np.zeros((d, d))
    out[cells["i"], cells["j"]] = cells["v"]
    return (out + np.triu(out, 1).T) / n


# ---------------------------------------------------------------------------------------------------------------- inertia
def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder reflections): same inertia under every shift."""
    a, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        x[0] += math.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size == 0.0:
            continue
        u = x / size
        part = a[k + 1:, k + 1:]
        p = part @ u
        p -= u * (u @ p)
        part -= 2.0 * (np.outer(u, p) + np.outer(p, u))
        tail = a[k + 1:, k].copy()
        a[k + 1:, k] = a[k, k + 1:] = tail - 2.0 * u * (u @ tail)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diagonal, off, shift: float) -> int:
    """Eigenvalues above ``shift``: the positive pivots of the shifted matrix."""
    pivot, count = 1.0, 0
    smallest = np.finfo(float).tiny ** 0.5
    for i, x in enumerate(diagonal):
        pivot = x - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < smallest:
            pivot = -smallest
        count += pivot > 0
    return count


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` from the top down, covering at least the ``wanted`` largest eigenvalues, with ends inside gaps.

    Eigenvalues that no gap wider than rounding parts stay in one interval.  Those within rounding of zero are not covered.
    """
    diagonal, off = tridiagonal(matrix)
    pad = np.r_[0.0, np.abs(off)] + np.r_[np.abs(off), 0.0]
    bound = float((diagonal + pad).max())
    floor = len(matrix) * np.finfo(float).eps * max(float(np.trace(matrix)), 0.0)
    positive = above(diagonal, off, floor) if bound > floor else 0
    top, width = bound * (1 + 1e-12) + floor, 1e-6 * bound

    def value(k):
        """The k-th largest eigenvalue, by halving."""
        low, high = floor, top
        while high - low > 1e-3 * width + 1e-13 * high:
            middle = 0.5 * (low + high)
            low, high = (middle, high) if above(diagonal, off, middle) >= k else (low, middle)
        return 0.5 * (low + high)

    out, done, high, upper = [], 0, top, value(1) if positive else 0.0
    while done < min(wanted, positive):
        # the widest gap behind one of the next eigenvalues ends the interval; a cluster makes it longer
        values = [upper]
        while True:
            k = done + len(values)
            values.append(value(k + 1) if k < positive else floor)
            gaps = -np.diff(values)
            if len(gaps) >= min(PER_INTERVAL, wanted - done) or k >= positive:
                usable = np.flatnonzero(gaps > width)
                if len(usable) or k >= positive:
                    break
        last = wanted - done - 1
        late = [g for g in usable if g >= min(last, PER_INTERVAL - 1)]  # the last interval must reach the wanted number
        at = (max(usable, key=lambda g: gaps[g]) if not late or done + PER_INTERVAL < wanted else late[0]) if len(usable) else len(gaps) - 1
        low = 0.5 * (values[at] + values[at + 1])
        count = above(diagonal, off, low) - done
        out.append((float(low), float(high), int(count)))
        done, high, upper = done + count, low, values[at + 1]
    return out


# ---------------------------------------------------------------------------------------------------------------- FEAST
def feast(matrix: np.ndarray, low: float, high: float, count: int, seed=0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in ``(low, high)``, largest first; raises when the contour integral yields another number."""
    d = len(matrix)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angle = 0.5 * np.pi * (1.0 + nodes)
    centre, radius = 0.5 * (low + high), 0.5 * (high - low)
    turn = np.exp(1j * angle)
    size = min(d, 2 * count + 6)
    y = np.random.default_rng(seed).standard_normal((d, size))
    scale, best = max(np.abs(matrix).sum(axis=1).max(), np.finfo(float).tiny), None
    for _ in range(_ROUNDS):
        q = np.zeros((d, size))
        for t, w in zip(turn, weights):  # the lower half circle is the conjugate of the upper
            q += 0.5 * w * np.real(radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - matrix, y))
        basis, _ = np.linalg.qr(q)
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ small
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0) / scale
        if inside.sum() == count:
            worst = residual[inside].max()
            if best is not None and worst >= 0.5 * best[0]:
                break  # no further gain: the limit of rounding
            best = (worst, values[inside][::-1], vectors[:, inside][:, ::-1])
            if worst < np.finfo(float).eps:
                break
        y = vectors
    if best is None or best[0] > 1e-10:
        raise ArithmeticError(f"an interval should hold {count} eigenvalues, the contour integral did not find them")
    return best[1], best[2]


def components(spark, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns), largest first; every interval is solved by a task of its own."""
    found = intervals(matrix, wanted) if matrix.size else []
    if not found:
        return np.zeros(0), np.zeros((len(matrix), 0))
    shared = spark.sparkContext.broadcast(matrix)  # dimension squared

    def solve(batches):
        for batch in batches:
            for low, high, count in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "count"))):
                values, vectors = feast(shared.value, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["value", "vector"])

    rows = spark.createDataFrame(found, "low double, high double, count int").repartition(len(found))
    got = sorted(rows.mapInArrow(solve, "value double, vector array<double>").collect(), key=lambda r: -r["value"])
    if len(got) != sum(count for *_, count in found):
        raise ArithmeticError("components are missing")
    # the intervals' vectors are orthogonal up to rounding; one more Ritz step over all of them takes that away
    basis, _ = np.linalg.qr(np.array([r["vector"] for r in got]).T)
    values, small = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], (basis @ small)[:, order]


# ---------------------------------------------------------------------------------------------------------------- whitening
def _projected(vectors: DataFrame, n, sums, values, axes) -> DataFrame:
    base, rest = _centre(n, sums)
    left = np.array([s - n * int(b) for s, b in zip(sums, base)], dtype=object)
    small = max((abs(int(x)) for x in left), default=0) < 1 << 62
    turned = axes / np.sqrt(values)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch) - base
            if small and (n * float(np.abs(x).max()) + float(np.abs(left.astype(float)).max())) ** 2 * x.shape[1] < 2.0 ** 62:
                deviation = ((n * x - left.astype(np.int64)) ** 2).sum(axis=1)
            else:
                deviation = [int(v) for v in ((n * x.astype(object) - left) ** 2).sum(axis=1)]  # raises below where a long is too small
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.array(list((x - rest) @ turned), pa.list_(pa.float64()))],
                                             names=["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest entry of the covariance of ``whitened`` minus the identity, centred on the measured mean."""
    at = [F.col("whitened")[i] for i in range(k)]
    mean = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)]).first()
    off = [c - mean[f"m{i}"] for i, c in enumerate(at)]
    got = rows.agg(*[F.sum(off[i] * off[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(got[f"c{i}_{j}"] / mean["n"] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(table: DataFrame, wanted=8, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """One row per vector that counts and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Entries become whole numbers ``floor(1024 c) + 100000`` first.  The components are those of their covariance (divisor ``n``), numbered
    from 1 by falling eigenvalue; ``deviation`` is the exact squared distance of ``n x`` from the sums and raises where a long is too small.
    """
    spark, written = table.sparkSession, Written(table.sparkSession)
    vectors = usable_vectors(table, id_col, vector_col)
    n, sums = moments(vectors)
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    matrix = covariance(vectors, n, sums)
    values, axes = components(spark, matrix, wanted)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    rows = written.table(_projected(vectors, n, sums, values, axes))
    error = identity_error(rows, k)
    explained = F.array(*[F.lit(float(v)) for v in values / np.trace(matrix)])
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))

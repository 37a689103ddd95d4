"""Operator 12, whitening of embeddings from an exact scatter by residue numbers.

Entries become integers.  The sums of products of all pairs of dimensions (and, by a column of ones, the sums of the
dimensions and the number of vectors) are taken modulo several primes: residues are centred, so a block of rows is one
floating-point matrix product whose entries stay below 2**53 and are exact.  Every partition reduces its blocks
modulo the prime, rows of the matrix are added up over partitions, and Chinese remaindering gives the exact sums, as the
primes' product exceeds twice the largest value that they can have.  The covariance is formed from them in integers
and rounded once; its eigenvectors in double precision give the components.

The integers of the fit are what is not spread: a square of the number of dimensions for each prime."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, partitions, staged, table

SCALE, SHIFT = 64, 1_000_000
PRIME_BITS = 21
ROWS_AT_ONCE = 1 << 13  # (2**(PRIME_BITS - 1))**2 * ROWS_AT_ONCE = 2**53
MOST = 16


def primes(above: int) -> list[int]:
    """The largest primes of ``PRIME_BITS`` bits whose product is more than ``above``."""
    out, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= above:
        if all(p % k for k in range(3, math.isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Centred residues as doubles."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def modular_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """The sums of products of the columns of ``x`` modulo ``p``."""
    out = np.zeros((x.shape[1],) * 2, np.int64)
    for a in range(0, len(x), ROWS_AT_ONCE):
        r = residues(x[a : a + ROWS_AT_ONCE], p)
        out = (out + (r.T @ r).astype(np.int64)) % p
    return out


def combined(parts: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers (of either sign) that have the given residues, as objects."""
    product = math.prod(moduli)
    out = np.zeros(parts[0].shape, object)
    for r, p in zip(parts, moduli):
        rest = product // p
        out = out + r.astype(object) * (rest * pow(rest, -1, p))
    out %= product
    return np.where(out > product // 2, out - product, out)


def integers(vector: Column) -> Column:
    """The entries as integers."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vectors: DataFrame, vector: str, dims: int | None) -> DataFrame:
    """Rows whose vector has ``dims`` entries, all there, finite and within 2**52 when scaled."""
    v = F.col(vector)
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < 2.0**52))
    return vectors.where(v.isNotNull() & ((F.size(v) == dims) if dims is not None else (F.size(v) > 0)) & ok)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Model:
    """Number of vectors, sums of dimensions, components (columns) with their variances, shares and scales."""

    def __init__(self, scatter: np.ndarray, most: int):
        self.n = int(scatter[-1, -1])
        self.sums = scatter[-1, :-1]
        exact = self.n * scatter[:-1, :-1] - np.outer(self.sums, self.sums)  # n * n * covariance
        square = self.n * self.n
        cov = np.array([[int(x) / square for x in r] for r in exact], np.float64)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[: min(most, self.rank(values, len(cov)))]
        self.values, self.vectors = values[order], vectors[:, order]
        trace = int(np.trace(exact)) / square
        self.explained = self.values / trace if trace else self.values
        self.scale = self.vectors / np.sqrt(self.values)

    @staticmethod
    def rank(values: np.ndarray, dims: int) -> int:
        top = float(values.max(initial=0.0))
        return int((values > top * dims * np.finfo(np.float64).eps).sum()) if top > 0 else 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, in 64-bit integers where they are large enough, else as objects."""
        if self.n * (int(np.abs(x).max(initial=0)) + max((abs(int(s)) // self.n + 1 for s in self.sums), default=0)) < 2**62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.scale

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 2**63:
            return (centred * centred).sum(1).tolist()
        exact = [sum(int(c) ** 2 for c in r) for r in centred]
        return [d if d < 2**63 else None for d in exact]


def exact_scatter(fit: DataFrame, dims: int, moduli: list[int]) -> np.ndarray:
    """The exact sums of products of all pairs of dimensions and a column of ones, of the vectors ``x`` of ``fit``."""

    def scatters(batches):
        total = [np.zeros((dims + 1,) * 2, np.int64) for _ in moduli]
        for batch in batches:
            x = matrix(batch.column(0), dims)
            x = np.concatenate((x, np.ones((len(x), 1), np.int64)), 1)
            for k, p in enumerate(moduli):
                total[k] = (total[k] + modular_scatter(x, p)) % p
        for k in range(len(moduli)):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1) + k * (dims + 1)), pa.array(total[k].tolist(), pa.list_(pa.int64()))], ["line", "sums"])

    def added(batches):
        for line, t in grouped(batches, "line"):
            p = moduli[int(line) // (dims + 1)]
            total = np.zeros(dims + 1, np.int64)
            for a in range(0, t.num_rows, 1 << 12):
                total = (total + matrix(t.column("sums").slice(a, 1 << 12).combine_chunks(), dims + 1).sum(0)) % p
            yield pa.RecordBatch.from_arrays([pa.array([int(line)]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["line", "sums"])

    kind = "line long, sums array<long>"
    lines = fit.select("x").mapInArrow(scatters, kind).repartition(partitions(fit.sparkSession), "line").sortWithinPartitions("line").mapInArrow(added, kind)
    got = dict((line, sums) for line, sums in lines.collect())  # a row of the matrix for each dimension and prime
    return combined([np.array([got[k * (dims + 1) + i] for i in range(dims + 1)], np.int64) for k in range(len(moduli))], moduli)


def identity_error(fit: DataFrame, model: Model, dims: int) -> float:
    """The largest entry by which the covariance of the whitened fit differs from the identity."""
    k = len(model.values)

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = model.whitened(model.centred(matrix(batch.column(0), dims)))
            first += z.sum(0)
            second += z.T @ z
        names = np.arange(k + k * k)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate((first, second.ravel())))], ["name", "v"])

    sums = fit.select("x").mapInArrow(moments, "name long, v double").groupBy("name").agg(F.sum("v").alias("v")).toPandas()
    v = np.zeros(k + k * k)
    v[sums["name"].to_numpy()] = sums["v"].to_numpy()
    # z is centred by the exact mean already; what is left of its mean is rounding
    mean = v[:k] / model.n
    return float(np.abs(v[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vector: str = "embedding", most: int = MOST) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row with a usable vector and up to ``most`` components.

    An entry c becomes floor(64 * c) + 1000000.  The fit takes each distinct vector once, however many rows have it; every row is
    whitened, repeated ones each.  Rows are dropped whose vector is null or has an entry that is null, not finite, or 2**46 and
    more; a vector shorter than the longest one of the table lacks entries, which count as null.  A null vec_id stays null.  Components
    without variance (beyond the rank of the fit list) are not returned, as nothing can be scaled by them: a table whose rows are all
    equal, or an empty one, gives no rows.  A deviation that exceeds 64 bits is null.  Other columns are not read."""
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"))
    dims = own.agg(F.max(F.size("v"))).first()[0] or 0
    if dims <= 0:
        return spark.createDataFrame([], OUT)
    rows = usable(own, "v", dims).select("vec_id", integers(F.col("v")).alias("x"))
    fit = staged(rows.select("x").distinct(), "fit-list")
    n, largest = fit.agg(F.count("*"), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()
    if not n:
        return spark.createDataFrame([], OUT)
    model = Model(exact_scatter(fit, dims, primes(2 * n * max(largest, 1) ** 2)), most)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], OUT)
    error = identity_error(fit, model, dims)

    def transformed(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                c = model.centred(matrix(part.column(1), dims))
                m = len(c)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array(model.deviations(c), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation, pa.array(model.whitened(c).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(transformed, OUT)


def op12_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))

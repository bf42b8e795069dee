"""Embedding whitening: MLlib's computeSVD on centred distributed rows, singular values rescaled by the number of rows.

Entries become integers x = floor(64 c) + 1000000, so sums, means and deviations are exact. With S the sums over the n
distinct vectors (the fit list), each dimension's S is split as n * whole + rest with 0 <= rest < n: x - S / n is
(x - whole) - rest / n, which loses nothing to the large offset. computeSVD of the centred rows gives singular values s
and right singular vectors: the covariance with divisor n has the same vectors and the eigenvalues s * s / n. Total
variance isn't taken from them: it is the exact sum of all deviations, (n x - S) squared, over n cubed.

Spark shuffles the distinct vectors once; what reaches the driver is d sums, d x d sums inside MLlib, and k x k sums of
the check, whatever the number of rows.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite entry or one of 1e17 and more in size
(64 c would leave 64 bits) give no rows; nor do vectors of another length than the commonest one among the distinct
vectors (ties: the longest), which no component fits. Equal vectors count once in the fit and each get their rows.
Rows that repeat an id, or have none, each get their rows. Components whose singular value is no more than 1e-6 of
the first are noise of arithmetic and are left out; without variance, or without rows, the result is empty. Columns
other than the two named ones are ignored. `deviation` is decimal(38, 0) here; the query casts it to long, null where
it doesn't fit (not below 10**7 distinct vectors of such spread as in the tables).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutewise.llm.shared import staged

#: Up to so many dimensions all singular values are asked for, which MLlib then computes by LAPACK; beyond, the first ones by ARPACK.
LAPACK = 4096
RCOND = 1e-6
LIMB = 24
DEVIATION = pa.decimal128(38, 0)


def scaled_rows(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, x: the rows that can be whitened."""
    v = F.col(vector)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e17))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * 64).cast("long") + F.lit(1_000_000).cast("long"))
    return vectors.where(usable).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and each dimension's sum."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"), d)
                n += len(x)
                small = int(np.abs(x).max()) < 2**40  # and a batch has fewer than 2**22 rows
                total = total + (x.sum(0) if small and len(x) < 2**22 else x.astype(object).sum(0))
        if n:
            made = pa.array([Decimal(int(s)) for s in [*total, n]], DEVIATION)
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), made], names=["dim", "s"])

    rows = fit.select("x").mapInArrow(part, "dim int, s decimal(38, 0)").groupBy("dim").agg(F.sum("s").alias("s")).orderBy("dim").collect()
    sums = [int(r["s"]) for r in rows] or [0] * (d + 1)
    return sums[d], sums[:d]


class Centre:
    """n and each dimension's mean as whole + rest / n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, parts = n, [divmod(s, n) for s in sums]
        self.whole, self.rest = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
        self.part = self.rest / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """Each row's sum of (n x - S) squared, exact: in two limbs of 24 bits and more, or by Python's integers."""
        off = x - self.whole
        if len(x) and (int(np.abs(off).max()) + 1) * self.n < 2**48 and x.shape[1] <= 2**14:
            far = off * self.n - self.rest
            high = far >> LIMB
            low = far - (high << LIMB)
            hh, hl, ll = (np.einsum("ij,ij->i", a, b).tolist() for a, b in ((high, high), (high, low), (low, low)))
            return [(a << (2 * LIMB)) + (b << (LIMB + 1)) + c for a, b, c in zip(hh, hl, ll, strict=True)]
        far = off.astype(object) * self.n - self.rest.astype(object)
        return [int(s) for s in (far * far).sum(1)]


def total_deviation(fit: DataFrame, centre: Centre, d: int) -> int:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(centre.deviations(matrix(b.column("x"), d))) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(total)], DEVIATION)], names=["s"])

    return int(fit.select("x").mapInArrow(part, "s decimal(38, 0)").agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0])


def components(fit: DataFrame, centre: Centre, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as columns by falling variance (the entry of largest size is positive), and their variances."""
    literal = lambda values: F.array(*(F.lit(v) for v in values))
    off = F.zip_with("x", literal(centre.whole.tolist()), lambda a, b: a - b)
    rows = fit.select(array_to_vector(F.zip_with(off, literal(centre.part.tolist()), lambda a, b: a.cast("double") - b)).alias("v"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), centre.n if centre.n < 2**31 else 0, d).computeSVD(d if d <= LAPACK else k, False, RCOND)
    s, v = found.s.toArray(), found.V.toArray()
    keep = s > RCOND * s[0]
    s, v = s[keep][:k], v[:, keep][:, :k]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return v, s * s / centre.n


def identity_error(fit: DataFrame, centre: Centre, project: np.ndarray) -> float:
    """The largest entry of the whitened fit list's covariance (centred, divisor n) less the identity."""
    d, k = project.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            w = centre.centred(matrix(b.column("x"), d)) @ project
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) * k), pa.int32()), pa.array(total.ravel())], names=["at", "s"])

    sums = fit.select("x").mapInArrow(part, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    total = np.array([r["s"] for r in sums]).reshape(k + 1, k) / centre.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


SCHEMA = "vec_id {}, component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = 16, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row a usable vector and component: the whitened coordinate and what tells of the fit."""
    spark = vectors.sparkSession
    rows = scaled_rows(vectors, vec_id, vector)
    schema = SCHEMA.format(rows.schema["vec_id"].dataType.simpleString())
    fit = staged(rows.select("x").distinct(), "fit")
    length = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length["d"]
    fit = fit.where(F.size("x") == d)
    n, sums = exact_sums(fit, d)
    centre = Centre(n, sums)
    total = total_deviation(fit, centre, d)
    if not total:
        return spark.createDataFrame([], schema)
    v, e = components(fit, centre, d, min(k, d))
    project, share = v / np.sqrt(e), e / float(Fraction(total, n**3))
    error, found = identity_error(fit, centre, project), len(e)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), d)
            m = len(x) * found
            far = pa.array([Decimal(s) for s in centre.deviations(x)], DEVIATION)
            each = pa.array(np.repeat(np.arange(len(x)), found))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)), far.take(each),
                    pa.array((centre.centred(x) @ project).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(m, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == d).mapInArrow(whitened, schema)


def whitening_query(vectors: DataFrame, k: int = 16) -> DataFrame:
    return whiten(vectors, k).withColumn("deviation", F.expr("try_cast(deviation AS long)"))

"""Embedding whitening: principal components by the singular values of the centred rows.

Components come from MLlib's computeSVD over a distributed matrix of centred rows:
singular values become eigenvalues of the covariance by s * s / n. Rows are centred
before anything is multiplied, from exact sums of whole numbers, so a mean far from
zero costs no digits. The total variance is not taken from the singular values (only
as many are computed as asked for) but from the rows' exact deviations, whole numbers
that Spark adds up as decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import stored
from .vectors import matrix_of, whole_vectors

#: Directions whose deviation is below this share of the first one's count as none: doubles do not resolve them in a covariance.
LEAST = 1e-5


def _column_sums(rows: DataFrame, length: int) -> list[int]:
    """The exact sum of each dimension; one row a dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            total += matrix_of(batch.column("__x")).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"s": pa.array([total])})

    each = rows.select("__x").mapInArrow(add, "s array<long>").select(F.posexplode("s").alias("at", "v"))
    found = dict(each.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    return [int(found[i]) for i in range(length)]


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit numbers, Python's where those do not hold n * x."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over the dimensions of (n * x - S) ** 2, for each row."""
    c = _scaled(x, n, sums)
    most = max(int(c.max(initial=0)), -int(c.min(initial=0)))
    if most * most * x.shape[1] >= 1 << 63:
        c = c.astype(object)
    return [int(v) for v in (c * c).sum(axis=1)]


def _matrix(rows: DataFrame, column: str, n: int, length: int) -> RowMatrix:
    """A distributed matrix of the arrays in column; rows stay in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, length)


def _covariance(rows: DataFrame, column: str, n: int, length: int) -> np.ndarray:
    """Covariance of the arrays in column, centred before multiplying, divisor n."""
    return _matrix(rows, column, n, length).computeCovariance().toArray() * ((n - 1) / n)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = 32) -> DataFrame:
    """A row for each kept vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, hold null or non-finite entries or have another
    length than most are dropped; the others become long x = floor(scale * entry) +
    offset and are what everything is fitted on: n rows with sums S. deviation is
    the sum of (n * x - S) ** 2, exact (decimal of up to 38 digits); whitened the
    centred row on the unit eigenvector, over the root of its eigenvalue; explained
    the eigenvalue's share of the total variance; identity_error the largest entry
    of the whitened rows' covariance minus the identity. There are fewer components
    where the vectors have fewer dimensions or spread in fewer directions (LEAST),
    none and so no rows where all vectors are equal or there is one at most.
    Repeated rows and keys count and return each, null keys stay, other columns are
    ignored, an empty table returns no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    rows, n, length = whole_vectors(df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{vector}`").alias("__v")), "__v", scale, offset)
    rows = rows.drop("__v")
    out_schema = f"__key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    none = df.sparkSession.createDataFrame([], out_schema).withColumnRenamed("__key", key)
    if not n:
        return none
    sums = _column_sums(rows, length)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("__x"))
            centred = (_scaled(x, n, sums) / n).astype(float)
            own = pa.array([str(v) for v in deviations(x, n, sums)], pa.string())
            flat = pa.FixedSizeListArray.from_arrays(pa.array(centred.ravel()), length).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"__key": batch.column("__key"), "deviation": own, "centred": flat})

    measured = rows.mapInArrow(measure, f"__key {kind}, deviation string, centred array<double>")
    centred = stored(measured.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")), "centred")
    total = int(centred.agg(F.sum("deviation").alias("t")).first()["t"])
    if not total:
        return none
    trace = Fraction(total, n**3)

    matrix = centred.select("centred").persist(StorageLevel.MEMORY_AND_DISK)  # long vectors are multiplied many times
    try:
        found = _matrix(matrix, "centred", n, length).computeSVD(min(components, length), computeU=False, rCond=LEAST)
        s, axes = found.s.toArray(), found.V.toArray()
    finally:
        matrix.unpersist()
    values = s * s / n
    project = axes / np.sqrt(values)
    k = len(values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.asarray(batch.column("centred").flatten()).reshape(batch.num_rows, length)
            w = pa.FixedSizeListArray.from_arrays(pa.array((c @ project).ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"__key": batch.column("__key"), "deviation": batch.column("deviation"), "w": w})

    white = stored(centred.mapInArrow(apply, f"__key {kind}, deviation decimal(38,0), w array<double>"), "white")
    error = float(np.abs(_covariance(white, "w", n, k) - np.eye(k)).max())
    shares = [float(Fraction(float(v)) / trace) for v in values]
    spread = white.select("__key", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.lit(shares), F.col("at") + 1)
    out = spread.select("__key", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
    return out.withColumnRenamed("__key", key)

"""Vectors as whole numbers: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(v: Column) -> Column:
    """Whether a vector is there, has entries, and has only finite ones."""
    finite = F.forall(v, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))


def whole_vectors(df: DataFrame, vector: str, scale: int, offset: int = 0) -> tuple[DataFrame, int, int]:
    """(rows of df with `__x`: floor(scale * entry) + offset of each entry as long, their number, their length).

    Rows go whose vector is null, empty, or holds null or non-finite entries (NaN
    included: it is greater than any number here), and so do those whose length is
    not the most frequent one (the smallest of these), as they have no distance to
    the others. One row a length reaches the driver at most, the first of them.
    """
    at = F.col(f"`{vector}`")
    kept = df.where(_whole(at))
    size = kept.groupBy(F.size(at).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    n, length = (size["n"], size["size"]) if size else (0, 0)
    x = F.transform(at, lambda e: F.floor(e.cast("double") * scale) + offset)
    return kept.where(F.size(at) == length).withColumn("__x", x), n, length


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as an int64 matrix."""
    return np.asarray(column.flatten()).astype(np.int64, copy=False).reshape(len(column), -1)

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records of one Arrow batch handed to Python, whatever the session says.
BATCH_BYTES = 4 << 20

#: The ASCII white space that separates words everywhere in this subpackage.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


_local_root: list[str] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder that spark.checkpoint.dir names.

    Where the setting is absent, one local temporary folder serves this process if
    Spark runs on this machine alone (tests); on a cluster that is an error, as
    executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = getattr(spark, "sparkContext", None)
        if context is not None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local_root:
            _local_root.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        root = _local_root[0]
    elif "://" not in root and getattr(spark, "_jvm", None):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)  # a bare path is on the default file system, whichever that is
        root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again (compressed, unlike a checkpoint)."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, limit: int) -> Iterator[None]:
    """Jobs run inside hand Python Arrow batches of at most about limit bytes, on both sides of the pipe (Spark's own bound is 64 MB)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shards_for(df: DataFrame, column: str, target_bytes: int = 32 << 20) -> int:
    """How many shards of about target_bytes the values of column fill (one at least)."""
    total = df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // target_bytes))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column holds at most about limit bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        if sizes.sum() <= limit:
            yield batch
            continue
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def map_texts(
    df: DataFrame,
    column: str,
    rows: Callable[[pa.RecordBatch, list], dict | None],
    schema: str,
    limit: int = BATCH_BYTES,
) -> DataFrame:
    """mapInArrow over bounded slices: rows(batch, texts) gives the output columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, limit):
            out = rows(batch, batch.column(column).to_pylist())
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours in keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.append(starts[1:], len(keys))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on each input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def write_file(folder: str, name: str, content: bytes) -> str:
    """Write one file into a shared folder from a task; a repeated attempt replaces the whole file.

    Local and file: folders are written directly, others through Arrow's file systems.
    """
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    if folder.startswith(("file:", "/")):
        base = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
        os.makedirs(base, exist_ok=True)
        with open(f"{base}/.{part}", "wb") as out:
            out.write(content)
        os.replace(f"{base}/.{part}", f"{base}/{name}")
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/.{part}") as out:
            out.write(content)
        store.move(f"{base}/.{part}", f"{base}/{name}")
    return name

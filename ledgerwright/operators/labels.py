"""A dictionary of a dataset's labels, so that filters without regard to case reach the scan.

`lower(segment) = 'building'` says nothing to a Parquet reader. The dictionary lists
each text column's values under their lower-case form, sorted by it; a filter is looked
up there and becomes a plain IN over the spellings that occur, which row-group
statistics, dictionary pages and bloom filters can answer. A label that does not
occur makes the filter false before anything is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import quoted

#: Spellings that one filter may become. More (a contains that meets many labels) stay a lower() filter, which is as exact.
MOST_SPELLINGS = 1000
#: Scan options under which a plain IN of that length is pushed as it is, not as its smallest and largest value.
PUSH_ALL = {"spark.sql.parquet.pushdown.inFilterThreshold": str(MOST_SPELLINGS)}


def label_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, folded, value, n) of each value of the text columns (all by default); nulls are no labels.

    One pass: values are counted in each task before they are shuffled, so a
    frequent value is one row a task.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)] if columns is None else list(columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, folded string, value string, n long")
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in names]))
    counted = df.select(pairs).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counted.select("column", F.lower("value").alias("folded"), "value", "n")


@dataclass(frozen=True)
class Labels:
    """The dictionary stored at path, of some columns of one version of a dataset."""

    spark: SparkSession
    path: str
    columns: frozenset[str]

    @classmethod
    def build(cls, df: DataFrame, path: str, columns: Sequence[str] | None = None) -> Labels:
        """Write the dictionary of df, sorted by column and folded label, with bloom filters on the latter."""
        found = label_table(df, columns)
        spread = found.repartitionByRange("column", "folded").sortWithinPartitions("column", "folded", "value")
        spread.write.mode("errorifexists").option("parquet.bloom.filter.enabled#folded", "true").parquet(path)
        return cls.read(df.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Labels:
        table = spark.read.parquet(path)
        return cls(spark, path, frozenset(r["column"] for r in table.select("column").distinct().collect()))  # as many rows as columns

    @property
    def table(self) -> DataFrame:
        return self.spark.read.schema("column string, folded string, value string, n long").parquet(self.path)

    def knows(self, column: str) -> bool:
        return column in self.columns

    def _found(self, column: str, test: Column) -> list[str] | None:
        found = self.table.where((F.col("column") == column) & test).select("value").limit(MOST_SPELLINGS + 1).collect()
        return sorted(r["value"] for r in found) if len(found) <= MOST_SPELLINGS else None

    def spellings(self, column: str, folded: Sequence[str]) -> list[str] | None:
        """The values of column whose lower-case form is one of folded; None if they are too many to list."""
        return self._found(column, F.col("folded").isin(*folded))

    def containing(self, column: str, parts: Sequence[str]) -> list[str] | None:
        """The values of column whose lower-case form contains one of parts; None if they are too many to list."""
        test = F.lit(False)
        for part in parts:
            test |= F.col("folded").contains(part)
        return self._found(column, test)

"""Rows: search, sort, page, project, sample, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from .aggregate import aggregate_column
from .filters import Filter, apply_filters, kind_of, quoted, typed
from .paging import order_levels, seek_page, sort_columns
from .ranks import ACCURACY, range_number

MAX_LIMIT, MAX_OFFSET = 200, 2_000_000
#: Up to this offset a page is the end of the first rows that Spark keeps; beyond, it is sought by counting.
SHALLOW = 10_000


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows where any text column contains text, without regard to case."""
    columns = [c for c in df.columns if kind_of(df, c) == "string"]
    if not columns:
        return df.where(F.lit(False))
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(typed(df, c)).contains(text.lower()), F.lit(False)) for c in columns)))


def sort_rows(df: DataFrame, column: str, descending: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Sorted by one column, blanks last either way, text without regard to case, ties by the tie columns."""
    return df.orderBy(*sort_columns(df, column, descending, tie))


def query_rows(
    df: DataFrame, filters: Sequence[Filter] = (), text: str | None = None, sort: str | None = None, descending: bool = False, tie: Sequence[str] = (), columns: Sequence[str] | None = None, offset: int = 0, limit: int = 50
) -> DataFrame:
    """One page of rows: filter, search, sort, slice, project."""
    if not 1 <= limit <= MAX_LIMIT or not 0 <= offset <= MAX_OFFSET:
        raise AnalysisError("invalid_page", f"limit is 1 to {MAX_LIMIT}, offset 0 to {MAX_OFFSET}.")
    out = apply_filters(df, filters)
    out = search(out, text) if text else out
    if offset > SHALLOW and (sort or tie):
        out = seek_page(out, sort, descending, tie, offset, limit)
    else:
        out = out.orderBy(*sort_columns(out, sort, descending, tie)) if sort or tie else out
        out = out.offset(offset).limit(limit) if offset else out.limit(limit)
    return out.select(*map(quoted, columns)) if columns else out


def matching_rows(df: DataFrame, filters: Sequence[Filter] = (), text: str | None = None, cap: int = 100_000) -> tuple[DataFrame, bool]:
    """All rows that match, cap at most, and whether there are more: an export."""
    out = apply_filters(df, filters)
    out = search(out, text) if text else out
    return out.limit(cap), len(out.offset(cap).limit(1).take(1)) > 0


#: Ranges that the copies of a row are numbered in.
RUNS = 64
#: Bits of a row by which equal rows meet.
_PRINTS = ("__print_a", "__print_b")


def _printed(df: DataFrame, same: Sequence[str]) -> DataFrame:
    cells = [*map(quoted, same)] or [F.lit(1)]
    return df.withColumns({_PRINTS[0]: F.xxhash64(*cells), _PRINTS[1]: F.xxhash64(F.lit(1), *cells)})


def _repeating(df: DataFrame, same: Sequence[str]) -> DataFrame:
    """Rows of df whose 128 bits over same occur more than once: only 16 bytes a row are shuffled to find them."""
    rows = _printed(df, same)
    again = rows.groupBy(*_PRINTS).agg(F.count("*").alias("__n")).where("__n > 1").select(*_PRINTS)
    return rows.join(again, list(_PRINTS), "left_semi").select(*map(quoted, df.columns))


def _copies(df: DataFrame) -> DataFrame:
    """df's distinct repeated rows with seq 2 up to their number, a block of a million numbers at a time."""
    groups = _repeating(df, df.columns).groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("seq")).where("seq > 1")
    block = 1_000_000
    blocks = groups.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("seq") - 2) / block))))
    low = F.col("__block") * block + 2
    return blocks.select(*map(quoted, df.columns), F.explode(F.sequence(low, F.least(low + block - 1, F.col("seq")))).alias("seq"))


def duplicate_rows(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one in all columns but order: df and seq, from 2 on.

    Rows without a double leave early. The others are numbered within RUNS ranges of the
    first order column, and each range goes on from the counts of those before it, so that
    a row repeated very often is not one task. Without an order the copies have no
    difference, and are counted.
    """
    if not order:
        return _copies(df)
    same = [c for c in df.columns if c not in order]
    held = _repeating(df, same)
    flag, x = order_levels(held, quoted(order[0]), False, False)[:2]
    cuts = held.agg(F.percentile_approx(x, F.array(*[F.lit(i / RUNS) for i in range(1, RUNS)]), ACCURACY).alias("q")).first()["q"] or []
    run = F.when(flag < 0, 0).when(flag > 0, RUNS + 1).otherwise(range_number(x, sorted(set(cuts))) + 1)
    rows = held.withColumn("__run", run)
    keys = [*same, "__run"]
    numbered = rows.withColumn("__seq", F.row_number().over(Window.partitionBy(*map(quoted, keys)).orderBy(*map(quoted, order))))
    ahead = Window.partitionBy(*map(quoted, same) if same else [F.lit(1)]).orderBy("__run")  # RUNS + 2 rows at most
    counts = rows.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(ahead) - F.col("__n"))
    counts = counts.select(*[quoted(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__before")
    on = reduce(lambda a, b: a & b, (quoted(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)))
    return numbered.join(counts, on).withColumn("seq", (F.col("__seq") + F.col("__before")).cast("bigint")).where("seq > 1").select(*map(quoted, df.columns), "seq")


def drop_duplicate_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first, by order, of rows that are equal in all other columns."""
    same = [c for c in df.columns if c not in order]
    first = F.min_by(F.struct(*map(quoted, order)), F.struct(*map(quoted, order)))
    return df.groupBy(*map(quoted, same)).agg(first.alias("__first")).select(*map(quoted, same), *[F.col(f"__first.`{c}`").alias(c) for c in order]).select(*map(quoted, df.columns))


def count_duplicates(df: DataFrame) -> DataFrame:
    """One row: duplicates, the rows beyond the first of each."""
    held = _repeating(df, df.columns)
    return held.groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def sample_rows(df: DataFrame, n: int = 8, column: str | None = None, contains: str | None = None) -> DataFrame:
    """A few rows, of those whose column contains a text if one is given."""
    out = apply_filters(df, [Filter(column, "contains", contains)]) if column and contains else df
    return out.limit(min(8, max(1, n)))


def scenario(df: DataFrame, metric: str, percent: float, dependent: str | None = None) -> DataFrame:
    """One row: base, projected, and the dependent metric at its observed ratio: dependent_base, dependent_projected."""
    total = aggregate_column(typed(df, metric), "sum").alias("base")
    other = aggregate_column(typed(df, dependent), "sum").alias("dependent_base") if dependent else F.lit(None).cast("double").alias("dependent_base")
    scale = 1 + percent / 100
    sums = df.agg(total, other)
    return sums.select("base", (F.col("base") * scale).alias("projected"), "dependent_base", (F.try_divide("dependent_base", "base") * F.col("base") * scale).alias("dependent_projected"))

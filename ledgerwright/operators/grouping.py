"""Group-by on one dimension, cross-tabs, shares, ranks and concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions.calendar import ordinal, period_key
from ..session import written
from .aggregate import aggregate_column
from .filters import kind_of, quoted, typed
from .ranks import running_totals

BLANK = "(blank)"


def with_totals(groups: DataFrame, **totals: Column) -> DataFrame:
    """groups with columns that aggregate all of them: one row, broadcast back."""
    return groups.join(F.broadcast(groups.agg(*[c.alias(name) for name, c in totals.items()])))


def group_key(df: DataFrame, dimension: str, grain: str | None = None) -> Column:
    """The dimension's label; blanks stay null here. Dates need a grain."""
    c, kind = typed(df, dimension), kind_of(df, dimension)
    if kind == "date":
        if not grain:
            raise AnalysisError("wrong_type", f'"{dimension}" holds dates and needs a grain.', "Use time_series.")
        return period_key(ordinal(c, grain), grain)
    if kind == "number":
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def group_by(
    df: DataFrame, dimension: str, metric: str | None = None, agg: str | None = None, percentile: float = 50.0, grain: str | None = None, order: str = "desc", limit: int | None = None, blanks: bool = True, min_rows: int = 1
) -> DataFrame:
    """key, value, n (non-blank values), n_rows, total, share.

    agg defaults to sum of the metric, or a count of rows without one. A group
    whose metric is all blank keeps 0 under sum, counts and std and is left out
    under the others. share is a percentage of the signed total for sum and count,
    null else. blanks: whether rows without a key form a (blank) group.
    """
    agg = agg or ("sum" if metric else "count")
    value = typed(df, metric) if metric else F.lit(1)
    if metric and agg not in ("count", "distinct_count") and kind_of(df, metric) != "number":
        raise AnalysisError("wrong_type", f'{agg} needs numbers; "{metric}" does not hold any.')
    rows = df.select(group_key(df, dimension, grain).alias("__k"), value.alias("__v"))
    rows = rows.withColumn("key", F.coalesce("__k", F.lit(BLANK))) if blanks else rows.where("__k is not null").withColumnRenamed("__k", "key")
    found = rows.groupBy("key").agg(aggregate_column(F.col("__v"), agg, percentile).cast("double").alias("value"), F.count("__v").alias("n"), F.count(F.lit(1)).alias("n_rows"))
    if agg in ("sum", "std"):
        found = found.withColumn("value", F.coalesce("value", F.lit(0.0)))
    elif agg not in ("count", "distinct_count"):
        found = found.where("n > 0")
    found = found.where(F.col("n_rows") >= min_rows)
    if agg in ("sum", "count"):
        found = with_totals(found, total=F.sum("value"))
        found = found.withColumn("share", F.when(F.col("total") == 0, 0.0).otherwise(F.col("value") / F.col("total") * 100))
    else:
        found = found.withColumn("total", F.lit(None).cast("double")).withColumn("share", F.lit(None).cast("double"))
    orders = {"desc": (F.desc("value"), F.asc("key")), "asc": (F.asc("value"), F.asc("key")), "key": (F.asc("key"),)}
    out = found.orderBy(*orders[order])
    return out.limit(limit) if limit else out


def group_many(df: DataFrame, dimensions: Sequence[str], metric: str | None = None) -> DataFrame:
    """dimension, key, value (sum of the metric, or rows), n_rows of the non-blank labels of several dimensions, from one aggregation."""
    value = typed(df, metric) if metric else F.lit(1)
    labels = F.array(*[F.struct(F.lit(d).alias("dimension"), group_key(df, d).alias("key")) for d in dimensions])
    rows = df.select(value.alias("v"), F.explode(labels).alias("l")).select("l.dimension", "l.key", "v").where("key is not null")
    return rows.groupBy("dimension", "key").agg(F.coalesce(F.sum("v"), F.lit(0)).cast("double").alias("value"), F.count(F.lit(1)).alias("n_rows"))


def ranked(df: DataFrame, dimension: str, metric: str | None = None, agg: str | None = None, n: int = 5, ascending: bool = False, min_rows: int = 1, percentile: float = 50.0) -> DataFrame:
    """rank, key, value, n_rows, share of the n first groups; blanks are left out.

    share: the positive part of a group over the signed total of all ranked groups.
    """
    groups = group_by(df, dimension, metric, agg, percentile, blanks=False, min_rows=min_rows)
    agg = agg or ("sum" if metric else "count")
    share = F.greatest("value", F.lit(0.0)) / F.nullif("total", F.lit(0.0)) * 100
    groups = groups.select("key", "value", "n_rows", (share if agg in ("sum", "count") else F.lit(None).cast("double")).alias("share"))
    first = groups.orderBy(F.asc("value") if ascending else F.desc("value"), F.asc("key")).limit(n)
    by = Window.partitionBy(F.lit(1)).orderBy(F.asc("value") if ascending else F.desc("value"), F.asc("key"))
    return first.withColumn("rank", F.row_number().over(by).cast("bigint"))


def share_of_total(df: DataFrame, dimension: str, metric: str | None = None, agg: str | None = None) -> DataFrame:
    """key, value, share of the positive total, rank; every non-blank group."""
    groups = written(group_by(df, dimension, metric, agg, blanks=False).select("key", "value"), "groups")  # looked at four times
    positive = F.greatest("value", F.lit(0.0))
    before = running_totals(groups.groupBy("value").agg(F.count("*").alias("m")), "value", descending=True, before=F.col("m")).drop("m")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("value").orderBy("key"))
    return with_totals(groups, positive=F.sum(positive)).join(before, "value").select(
        "key", "value", F.when(F.col("positive") > 0, positive / F.col("positive") * 100).otherwise(0.0).alias("share"), rank.cast("bigint").alias("rank")
    )


def compare_groups(df: DataFrame, dimension: str, group_a: str, group_b: str, metric: str | None = None, agg: str | None = None) -> DataFrame:
    """One row: value_a, value_b, difference, ratio, pct (a against b); groups are found without regard to case."""
    agg = agg or ("sum" if metric else "count")
    label = F.lower(group_key(df, dimension))
    value = typed(df, metric) if metric else F.lit(1)

    def side(name: str) -> Column:
        out = aggregate_column(F.when(label == name.strip().lower(), value), agg).cast("double")
        return F.coalesce(out, F.lit(0.0)) if agg == "sum" else out

    sides = df.where(label.isin(group_a.strip().lower(), group_b.strip().lower())).agg(side(group_a).alias("value_a"), side(group_b).alias("value_b"))
    apart = F.col("value_a") - F.col("value_b")
    nonzero = F.abs("value_b") >= 1e-12
    return sides.select("value_a", "value_b", apart.alias("difference"), F.when(nonzero, F.col("value_a") / F.col("value_b")).alias("ratio"), F.when(nonzero, apart / F.abs("value_b") * 100).alias("pct"))


def cross_tab(df: DataFrame, row_dimension: str, column_dimension: str, metric: str | None = None, agg: str | None = None, max_labels: int = 12) -> DataFrame:
    """row_key, column_key, value, n for the labels of each axis with the largest sum of absolute values.

    sum, avg or count. Rows with a blank metric take no part; blanks are labels
    of their own. One aggregation: the label sets are windows over its cells.
    """
    agg = agg or ("sum" if metric else "count")
    if agg not in ("sum", "avg", "count"):
        raise AnalysisError("invalid_aggregate", "A cross-tab takes sum, avg or count.")
    value = typed(df, metric) if metric else F.lit(1)
    rows = df.select(F.coalesce(group_key(df, row_dimension), F.lit(BLANK)).alias("row_key"), F.coalesce(group_key(df, column_dimension), F.lit(BLANK)).alias("column_key"), value.alias("v")).where("v is not null")
    cells = rows.groupBy("row_key", "column_key").agg(aggregate_column(F.col("v"), agg).cast("double").alias("value"), F.count("v").alias("n"), (F.sum(F.abs("v")) if metric and agg != "count" else F.count("v")).cast("double").alias("w"))

    def top(axis: str) -> DataFrame:
        return cells.groupBy(axis).agg(F.sum("w").alias("w")).orderBy(F.desc("w"), F.asc(axis)).limit(max_labels).select(axis)

    kept = cells.join(F.broadcast(top("row_key")), "row_key", "left_semi").join(F.broadcast(top("column_key")), "column_key", "left_semi")  # max_labels rows each
    return kept.select("row_key", "column_key", "value", "n").orderBy(F.desc("value"), "row_key", "column_key")


def pareto(df: DataFrame, dimension: str, metric: str | None = None, agg: str | None = None) -> DataFrame:
    """One row: groups, total of the positive values, and how many of the largest groups reach 50 and 80 percent of it."""
    groups = group_by(df, dimension, metric, agg, blanks=False).select(F.greatest("value", F.lit(0.0)).alias("v"))
    levels = written(groups.groupBy("v").agg(F.count("*").alias("m")), "levels")  # groups of one value are interchangeable
    running = running_totals(levels, "v", descending=True, before=F.col("m"), reached=F.col("m") * F.col("v"))
    totals = levels.agg(F.sum("m").alias("groups"), F.sum(F.col("m") * F.col("v")).alias("total"))

    def reach(part: float) -> Column:
        more = F.col("total") * part - 1e-9 - F.col("reached")  # what the groups of this value must add
        steps = F.greatest(F.ceil(more / F.col("v")), F.lit(1))
        return F.min(F.when((F.col("v") > 0) & (steps <= F.col("m")), F.col("before") + steps)).cast("bigint")

    found = running.join(F.broadcast(totals)).agg(reach(0.5).alias("reach_50"), reach(0.8).alias("reach_80"))
    return totals.select(F.coalesce("groups", F.lit(0)).alias("groups"), "total").join(F.broadcast(found))


def concentration(groups: DataFrame, top_n: int = 3, value: str = "value") -> DataFrame:
    """One row over grouped values (negatives count as 0): groups, top_share, hhi, hhi_normalised, baseline, multiple.

    top_n is at most one less than the groups; baseline is what equal groups would
    give, multiple how far the top ones exceed it.
    """
    v = groups.select(F.greatest(quoted(value), F.lit(0.0)).alias("v"))
    sums = v.agg(F.count("*").alias("groups"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))
    first = v.orderBy(F.desc("v")).limit(top_n).agg(F.sort_array(F.collect_list("v"), asc=False).alias("first"))
    k, total = F.col("groups"), F.col("total")
    taken = F.least(F.lit(top_n), F.greatest(k - 1, F.lit(1)))
    one = sums.where("total > 0").join(F.broadcast(first)).withColumn("top_n", taken).withColumn("top", F.aggregate(F.slice("first", F.lit(1), F.col("top_n").cast("int")), F.lit(0.0), lambda a, x: a + x) / total)
    one = one.withColumn("hhi", F.col("squares") / (total * total))
    return one.where("groups > 0").select(
        "groups", F.col("top_n").cast("bigint").alias("top_n"), (F.col("top") * 100).alias("top_share"), "hhi",
        F.when(k > 1, (F.col("hhi") - 1 / k) / (1 - 1 / k)).otherwise(1.0).alias("hhi_normalised"), (F.col("top_n") / k * 100).alias("baseline"), (F.col("top") / (F.col("top_n") / k)).alias("multiple"),
    )


def is_concentrated(groups: int, multiple: float, hhi_normalised: float) -> bool:
    """Whether a concentration says more than that there are few groups."""
    return groups >= 5 and multiple >= 1.4 and hhi_normalised >= 0.15

"""The nine aggregates, descriptive statistics, histograms and value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from .filters import kind_of, typed
from .ranks import exact_quantiles

AGGREGATES = ("sum", "avg", "count", "distinct_count", "min", "max", "median", "std", "percentile")


def aggregate_column(c: Column, agg: str, percentile: float = 50.0) -> Column:
    """One aggregate over the non-blank values of a typed column.

    Blank in, nothing out: sum to percentile are null without values, counts are
    0, std is 0 below two values. Distinct counts and percentiles are exact.
    """
    if agg == "count":
        return F.count(c)
    if agg == "distinct_count":
        return F.count_distinct(c)
    if agg == "std":
        return F.when(F.count(c) < 2, 0.0).otherwise(F.stddev_samp(c))
    if agg in ("median", "percentile"):
        return F.percentile(c, 0.5 if agg == "median" else min(100.0, max(0.0, percentile)) / 100)
    if agg in ("sum", "avg", "min", "max"):
        return getattr(F, agg)(c)
    raise AnalysisError("invalid_aggregate", f"There is no aggregate {agg!r}.", "One of " + ", ".join(AGGREGATES))


def aggregate(df: DataFrame, agg: str, column: str | None = None, percentile: float = 50.0) -> DataFrame:
    """One row: value. Without a column, count is the number of rows."""
    if column is None:
        if agg != "count":
            raise AnalysisError("missing_column", f"{agg} needs a column.")
        return df.agg(F.count(F.lit(1)).alias("value"))
    kind = kind_of(df, column)
    if agg not in ("count", "distinct_count") and kind != "number" and not (kind == "date" and agg in ("min", "max")):
        raise AnalysisError("wrong_type", f'{agg} needs numbers; "{column}" holds {kind} values.')
    if agg in ("median", "percentile"):  # without a key one task would hold all different values
        q = 0.5 if agg == "median" else min(100.0, max(0.0, percentile)) / 100
        return df.sparkSession.createDataFrame([tuple(exact_quantiles(df, typed(df, column), [q]))], "value double")
    return df.agg(aggregate_column(typed(df, column), agg, percentile).alias("value"))


def numeric_stats(df: DataFrame, column: str) -> DataFrame:
    """Twenty descriptive statistics of a numeric column, one row.

    Fences are 1.5 quartile ranges out; outliers lie strictly beyond. Skew divides
    by the sample deviation. Quantiles come first, so one pass does the rest.
    """
    x = df.select(typed(df, column).alias("x")).where("x is not null")
    quantiles = exact_quantiles(df, typed(df, column), (0.05, 0.25, 0.5, 0.75, 0.95))
    q = F.array(*[F.lit(v).cast("double") for v in quantiles])
    reach = 1.5 * ((quantiles[3] or 0.0) - (quantiles[1] or 0.0))
    beyond = F.count_if((F.col("x") < (quantiles[1] or 0.0) - reach) | (F.col("x") > (quantiles[3] or 0.0) + reach))
    first = x.agg(
        beyond.alias("outliers"),
        F.count("x").alias("n"), F.sum("x").alias("total"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.when(F.count("x") < 2, 0.0).otherwise(F.stddev_samp("x")).alias("std"),
        F.when(F.count("x") < 2, 0.0).otherwise(F.var_samp("x")).alias("variance"), F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.col("x") < 0).alias("negatives"), F.skewness("x").alias("g"),
    )
    first = first.select("*", *(F.get(q, F.lit(i)).alias(name) for i, name in enumerate(("p05", "q1", "median", "q3", "p95"))), F.pow((F.col("n") - 1) / F.col("n"), 1.5).alias("k"))
    first = first.withColumn("iqr", F.col("q3") - F.col("q1"))
    first = first.withColumn("fence_low", F.col("q1") - 1.5 * F.col("iqr")).withColumn("fence_high", F.col("q3") + 1.5 * F.col("iqr"))
    first = first.withColumn("skew", F.when(F.col("std") > 0, F.col("g") * F.col("k")).otherwise(0.0)).drop("g", "k")
    return first.withColumn("outlier_pct", F.when(F.col("n") > 0, F.col("outliers") / F.col("n") * 100).otherwise(0.0))


def histogram(df: DataFrame, column: str, bins: int = 24) -> DataFrame:
    """bin, low, high, n: equal bins between the 5th and 95th percentile, tails in the end bins. No rows without a spread."""
    x = df.select(typed(df, column).alias("x")).where("x is not null")
    ends = df.sparkSession.createDataFrame([tuple(exact_quantiles(df, typed(df, column), (0.05, 0.95)))], "lo double, hi double")
    span = ends.where("hi > lo").withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.col("w"))))
    counts = x.join(F.broadcast(span), F.lit(True)).groupBy(place.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    frame = span.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"), "lo", "w")
    return frame.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str, limit: int | None = 12, contains: str | None = None) -> DataFrame:
    """value, n, pct of non-blank rows; most frequent first, ties by value."""
    c = typed(df, column)
    text = c if kind_of(df, column) == "string" else c.cast("string")
    counts = df.select(text.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    total = df.agg(F.count(c).alias("total"))
    out = counts.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total") * 100).alias("pct"))
    if contains:
        out = out.where(F.lower("value").contains(contains.lower()))
    out = out.orderBy(F.desc("n"), F.asc("value"))
    return out.limit(limit) if limit else out

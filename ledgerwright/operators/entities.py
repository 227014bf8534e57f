"""Customers, cohorts and funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import calendar as cal
from ..session import written
from .filters import kind_of, typed
from .ranks import running_totals

# Known funnels, first stage first.
FUNNELS = (
    ("lead", "prospect", "mql", "sql", "qualified", "opportunity", "proposal", "negotiation", "won", "closed won", "customer"),
    ("visit", "visitor", "view", "product view", "add to cart", "cart", "checkout", "purchase", "order"),
    ("impression", "click", "signup", "sign up", "trial", "activation", "activated", "paid", "subscribed"),
    ("applied", "screened", "screening", "interview", "offer", "offered", "hired", "accepted"),
)


def per_customer(df: DataFrame, customer: str, metric: str | None = None) -> DataFrame:
    """customer, n_rows, value (n_rows without a metric); blanks left out."""
    value = typed(df, metric) if metric else F.lit(1)
    rows = df.select(typed(df, customer).cast("string").alias("customer"), value.alias("v")).where("customer is not null")
    return rows.groupBy("customer").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("v"), F.lit(0)).cast("double").alias("value"))


def customer_summary(df: DataFrame, customer: str, metric: str | None = None) -> DataFrame:
    """One row: customers, repeat_rate, avg_rows, top_decile, top_decile_share.

    The top decile is a tenth of the customers, rounded up; negative values count
    as 0. Its bound is a percentile of the values, so no global sort is needed:
    customers above it are in, and those on it fill the remaining places.
    """
    each = written(per_customer(df, customer, metric).withColumn("v", F.greatest("value", F.lit(0.0))), "customers")
    first = each.agg(F.count("*").alias("customers"), F.avg((F.col("n_rows") > 1).cast("double")).alias("repeat_rate"), F.avg("n_rows").alias("avg_rows"), F.sum("v").alias("total"))
    first = first.withColumn("top_decile", F.ceil(F.col("customers") / 10))
    # values with how many customers have them, largest first: one row per distinct value
    levels = each.groupBy("v").agg(F.count("*").alias("m"))
    levels = running_totals(levels, "v", descending=True, before=F.col("m")).join(F.broadcast(first.select("top_decile")))
    taken = F.greatest(F.lit(0), F.least("m", F.col("top_decile") - F.col("before")))
    top = levels.agg(F.sum(F.col("v") * taken).alias("top"))
    out = first.join(F.broadcast(top))
    return out.select("customers", (F.col("repeat_rate") * 100).alias("repeat_rate"), "avg_rows", "top_decile", F.when(F.col("total") > 0, F.col("top") / F.col("total") * 100).otherwise(0.0).alias("top_decile_share"))


def new_vs_returning(df: DataFrame, customer: str, date_column: str, grain: str = "month") -> DataFrame:
    """ord, period, new, returning: customers seen for the first time ever, and before."""
    seen = df.select(typed(df, customer).cast("string").alias("c"), cal.ordinal(typed(df, date_column), grain).alias("ord")).where("c is not null and ord is not null").distinct()
    first = seen.withColumn("first", F.min("ord").over(Window.partitionBy("c")))
    out = first.groupBy("ord").agg(F.count_if(F.col("ord") == F.col("first")).alias("new"), F.count_if(F.col("ord") > F.col("first")).alias("returning"))
    return out.select("ord", cal.period_key(F.col("ord"), grain).alias("period"), "new", "returning").orderBy("ord")


def cohort_retention(df: DataFrame, customer: str, date_column: str, grain: str = "month", first_ord: int | None = None, last_ord: int | None = None, max_cohorts: int = 12, max_offset: int | None = None) -> DataFrame:
    """cohort, period, offset, active, size, retention of the last max_cohorts cohorts.

    A customer's cohort is the first period of activity inside first_ord..last_ord.
    """
    seen = df.select(typed(df, customer).cast("string").alias("c"), cal.ordinal(typed(df, date_column), grain).alias("ord")).where("c is not null and ord is not null")
    if first_ord is not None:
        seen = seen.where(F.col("ord") >= first_ord)
    if last_ord is not None:
        seen = seen.where(F.col("ord") <= last_ord)
    each = seen.distinct().withColumn("cohort", F.min("ord").over(Window.partitionBy("c")))
    cells = each.groupBy("cohort", (F.col("ord") - F.col("cohort")).alias("offset")).agg(F.count("*").alias("active"))  # distinct (customer, period): count is exact
    if max_offset is not None:
        cells = cells.where(F.col("offset") <= max_offset)
    sizes = cells.where("offset = 0").select("cohort", F.col("active").alias("size")).orderBy(F.desc("cohort")).limit(max_cohorts)
    out = cells.join(F.broadcast(sizes), "cohort")  # max_cohorts rows
    return out.select("cohort", cal.period_key(F.col("cohort"), grain).alias("period"), "offset", "active", "size", (F.col("active") / F.col("size") * 100).alias("retention")).orderBy("cohort", "offset")


def stage_order(labels: Sequence[str]) -> list[str] | None:
    """The labels in the order of a known funnel that names at least three and three fifths of them, or None."""
    low = {x.strip().lower(): x for x in labels}
    best: list[str] = []
    for funnel in FUNNELS:
        hits = [low[s] for s in funnel if s in low]
        if len(hits) > len(best):
            best = hits
    return best if len(best) >= 3 and len(best) >= 0.6 * len(low) else None


def funnel(df: DataFrame, stage: str, order: Sequence[str], entity: str | None = None, mode: str | None = None) -> DataFrame:
    """place, stage, n, reached, from_previous, from_first (percent).

    Without an entity, n and reached are rows at the stage. With one: in events
    mode, entities seen at the stage; in snapshot mode, entities whose furthest
    stage it is, reached counting that stage or later. The mode follows the data
    unless given: events if more than a fifth of the entities have two stages.
    """
    if kind_of(df, stage) != "string":
        raise AnalysisError("wrong_type", f'"{stage}" does not hold stage names.')
    places = F.array(*[F.lit(s.strip().lower()) for s in order])
    rows = df.select(F.array_position(places, F.lower(F.trim(typed(df, stage)))).cast("int").alias("place"), *([typed(df, entity).cast("string").alias("e")] if entity else [])).where("place > 0")
    if entity:
        each = rows.where("e is not null").distinct()
        if mode is None:
            per = each.groupBy("e").agg(F.count("*").alias("stages")).agg(F.avg((F.col("stages") > 1).cast("double")).alias("many")).first()
            mode = "events" if (per["many"] or 0) > 0.2 else "snapshot"
        counts = each.groupBy("place").agg(F.count("*").alias("n")) if mode == "events" else each.groupBy("e").agg(F.max("place").alias("place")).groupBy("place").agg(F.count("*").alias("n"))
    else:
        mode, counts = "rows", rows.groupBy("place").agg(F.count("*").alias("n"))
    stages = df.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(order)], "place int, stage string")
    full = F.broadcast(stages).join(counts, "place", "left").select("place", "stage", F.coalesce("n", F.lit(0)).alias("n"))
    by = Window.partitionBy(F.lit(1)).orderBy("place")
    reached: Column = F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing)) if mode == "snapshot" else F.col("n")
    out = full.withColumn("reached", reached)
    before, top = F.lag("reached").over(by), F.first("reached").over(by)
    return out.select("place", "stage", "n", "reached", F.when(before > 0, F.col("reached") / before * 100).alias("from_previous"), F.when(top > 0, F.col("reached") / top * 100).alias("from_first")).orderBy("place")

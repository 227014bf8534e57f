"""Calendar buckets over an event stream: a period is emitted once the watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError

_WIDTH = {"hour": "1 hour", "day": "1 day", "week": "7 days"}


def calendar_series(events: DataFrame, time: str, metric: str | None = None, grain: str = "day", delay: str = "1 day", key: str | None = None) -> DataFrame:
    """period_start, n, value (and key) per calendar bucket, for append mode: a partial last period is never emitted.

    Works on a stream and on a table alike. Weeks begin on Monday. Rows later than
    delay after the newest event are dropped by the stream, as its watermark says.
    """
    if grain not in _WIDTH:
        raise AnalysisError("invalid_grain", "A stream is bucketed by hour, day or week.")
    start = "4 days" if grain == "week" else None  # the epoch was a Thursday
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", delay)
    bucket = F.window("__t", _WIDTH[grain], startTime=start) if start else F.window("__t", _WIDTH[grain])
    keys = [F.col(key).alias("key")] if key else []
    value = F.sum(metric) if metric else F.count(F.lit(1)).cast("double")
    out = stamped.groupBy(bucket.alias("w"), *keys).agg(F.count(metric or F.lit(1)).alias("n"), value.alias("value"))
    return out.select(F.col("w.start").alias("period_start"), *(["key"] if key else []), "n", "value")


def sessions(events: DataFrame, time: str, entity: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """entity, session_start, session_end, n: activity without a pause longer than gap."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", delay)
    out = stamped.groupBy(F.session_window("__t", gap).alias("s"), F.col(entity).alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("entity", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")

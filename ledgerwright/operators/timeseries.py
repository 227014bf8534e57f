"""Calendar series, period comparison, trend, anomalies, seasonality and forecasts.

Building a series is one aggregation by period ordinal. What follows works on one
row per period: it is collected (a bounded number of periods) and done in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import calendar as cal
from ..functions import stats
from .aggregate import aggregate_column
from .filters import kind_of, typed
from .grouping import BLANK, group_key, with_totals

MAX_PERIODS = 200_000


def time_series(df: DataFrame, date_column: str, metric: str | None = None, agg: str | None = None, grain: str = "month") -> DataFrame:
    """ord, period, n, value of every period with usable values, in order.

    n counts non-blank metric values (rows without a metric): a period whose rows
    are all blank is missing, not zero.
    """
    agg = agg or ("sum" if metric else "count")
    if agg not in ("sum", "avg", "count", "min", "max", "distinct_count"):
        raise AnalysisError("invalid_aggregate", f"A series cannot be built with {agg!r}.")
    value = typed(df, metric) if metric else F.lit(1)
    rows = df.select(cal.ordinal(typed(df, date_column), grain).alias("ord"), value.alias("v")).where("ord is not null")
    out = rows.groupBy("ord").agg(F.count("v").alias("n"), aggregate_column(F.col("v"), agg).cast("double").alias("value")).where("n > 0")
    return out.select("ord", cal.period_key(F.col("ord"), grain).alias("period"), "n", "value").orderBy("ord")


def missing_periods(series: DataFrame, grain: str) -> DataFrame:
    """ord, period of the holes between the first and the last period."""
    span = series.agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b")).alias("ord"))
    return every.join(series.select("ord"), "ord", "left_anti").select("ord", cal.period_key(F.col("ord"), grain).alias("period")).orderBy("ord")


def adjacent_change(series: DataFrame) -> DataFrame:
    """series with pct_change against the period right before; null across holes and tiny bases.

    A base below 1e-9, or below a tenth of the median absolute value, gives null.
    """
    by = Window.partitionBy(F.lit(1)).orderBy("ord")
    typical = series.agg(F.median(F.abs("value")).alias("typical"))
    with_last = series.withColumn("last", F.lag("value").over(by)).withColumn("gap", F.col("ord") - F.lag("ord").over(by)).join(F.broadcast(typical))
    usable = (F.col("gap") == 1) & (F.abs("last") >= 1e-9) & (F.abs("last") >= 0.1 * F.col("typical"))
    return with_last.withColumn("pct_change", F.when(usable, (F.col("value") - F.col("last")) / F.abs("last") * 100)).drop("last", "gap", "typical")


@dataclass(frozen=True)
class Point:
    ord: int
    n: int
    value: float


@dataclass(frozen=True)
class Series:
    """A collected series; complete leaves out partial periods at its ends."""

    grain: str
    points: tuple[Point, ...]
    trimmed_start: int = 0
    trimmed_end: int = 0
    observed: tuple[Point, ...] = field(default=())

    @property
    def values(self) -> list[float]:
        return [p.value for p in self.points]


def collect_series(series: DataFrame, grain: str) -> Series:
    """The series' points on the driver; more than MAX_PERIODS are refused."""
    rows = series.select("ord", "n", "value").orderBy("ord").limit(MAX_PERIODS + 1).collect()
    if len(rows) > MAX_PERIODS:
        raise AnalysisError("too_many_periods", f"More than {MAX_PERIODS:,} periods.", "Choose a coarser grain.")
    points = tuple(Point(int(r["ord"]), int(r["n"]), float(r["value"])) for r in rows if r["value"] is not None)
    return Series(grain, points, observed=points)


def complete(series: Series, first_day: date | None = None, last_day: date | None = None, min_share: float = 0.3, min_coverage: float = 0.8, keep: int = 3) -> Series:
    """The series without partial periods at its ends.

    An end period goes while it has less than min_share of the typical number of
    rows (the upper median), or while it is the first or last one observed and the
    data cover less than min_coverage of its days. At least keep points stay.
    """
    points = list(series.points)
    if len(points) <= keep:
        return series
    typical = sorted(p.n for p in points)[len(points) // 2]
    lo, hi = points[0].ord, points[-1].ord

    def partial(p: Point) -> bool:
        if p.n < min_share * typical:
            return True
        if series.grain == "day":
            return False
        start, end, days = cal.start_of(p.ord, series.grain), cal.end_of(p.ord, series.grain), cal.length_of(p.ord, series.grain)
        covered = days
        if p.ord == lo and first_day:
            covered = (end - max(start, first_day)).days + 1
        if p.ord == hi and last_day:
            covered = min(covered, (min(end, last_day) - start).days + 1)
        return covered < min_coverage * days

    start = end = 0
    while len(points) > keep and partial(points[0]):
        points.pop(0)
        start += 1
    while len(points) > keep and partial(points[-1]):
        points.pop()
        end += 1
    return Series(series.grain, tuple(points), start, end, series.points)


def gap_fraction(points: Sequence[Point]) -> float:
    return 1 - len(points) / (points[-1].ord - points[0].ord + 1) if points else 0.0


def contiguous(points: Sequence[Point], additive: bool) -> list[Point] | None:
    """Points without holes: holes of an additive metric become 0 if at most a fifth is missing; None otherwise."""
    gap = gap_fraction(points)
    if gap == 0:
        return list(points)
    if not additive or gap > 0.2:
        return None
    have = {p.ord: p for p in points}
    return [have.get(o, Point(o, 0, 0.0)) for o in range(points[0].ord, points[-1].ord + 1)]


def latest_pair(series: Series) -> tuple[Point, Point] | None:
    """The last two periods (last, before) if they are neighbours."""
    if len(series.points) < 2 or series.points[-1].ord - series.points[-2].ord != 1:
        return None
    return series.points[-1], series.points[-2]


def trend(values: Sequence[float]) -> dict:
    """Direction, slope and whether it is significant; None-like {} below four values."""
    n = len(values)
    if n < 4:
        return {}
    line, tau = stats.linear_fit(values), stats.mann_kendall(values)
    level = abs(stats.mean(values) or 0.0)
    slope_pct = line.slope / level * 100 if level > 1e-12 else 0.0
    significant = line.p_value < 0.05 and abs(tau) >= 0.2 and abs(slope_pct) >= 0.5
    acceleration = "steady"
    if n >= 8 and level > 1e-12:
        a, b = stats.linear_fit(values[: n // 2]).slope / level, stats.linear_fit(values[n // 2 :]).slope / level
        if abs(b - a) > 0.01:
            acceleration = "accelerating" if abs(b) > abs(a) else "slowing"
    direction = ("rising" if line.slope > 0 else "falling") if significant else "flat"
    return {"n": n, "slope": line.slope, "slope_pct": slope_pct, "r2": line.r2, "p_value": line.p_value, "tau": tau, "significant": significant, "direction": direction, "acceleration": acceleration, "intercept": line.intercept}


def anomalies(points: Sequence[Point], threshold: float = 3.2) -> list[dict]:
    """Periods whose distance from the trend is beyond threshold robust deviations, furthest first; at least 8 points."""
    if len(points) < 8:
        return []
    y = np.array([p.value for p in points])
    line = stats.linear_fit(y)
    fit = line.intercept + line.slope * np.arange(len(y))
    r = y - fit
    spread = 1.4826 * stats.mad(r)
    if spread <= 1e-12:
        return []
    z = (r - np.median(r)) / spread
    out = [{"ord": p.ord, "value": p.value, "expected": float(f), "z": float(s), "direction": "high" if s > 0 else "low"} for p, f, s in zip(points, fit, z, strict=True) if abs(s) >= threshold]
    return sorted(out, key=lambda a: (-abs(a["z"]), a["ord"]))


def seasonality(points: Sequence[Point], grain: str) -> dict | None:
    """Seasonal index by position, F, p and whether it is significant; monthly and daily series of two full cycles without holes."""
    length = {"month": 12, "day": 7}.get(grain)
    if not length or len(points) < 2 * length or gap_fraction(points) > 0:
        return None
    y, h = np.array([p.value for p in points]), length // 2
    ratios, places = [], []
    for i in range(h, len(y) - h):
        window = y[i - h : i + h + 1]
        centre = window.mean() if length % 2 else (window[1:-1].sum() + (window[0] + window[-1]) / 2) / length
        if abs(centre) > 1e-12:
            ratios.append(y[i] / centre)
            # 1970-01-01 was a Thursday: ordinal + 3 counts days from a Monday
            places.append(points[i].ord % 12 if grain == "month" else (points[i].ord + 3) % 7)
    if len(set(places)) < length:
        return None
    index = {k: float(np.mean([r for r, q in zip(ratios, places, strict=True) if q == k])) for k in range(length)}
    level = np.mean(list(index.values()))
    index = {k: v / level for k, v in index.items()} if abs(level) > 1e-12 else index
    f, p = stats.anova_f(ratios, places)
    spread = max(index.values()) - min(index.values())
    high, low = max(index, key=lambda k: index[k]), min(index, key=lambda k: index[k])
    return {"length": length, "index": index, "f": f, "p_value": p, "spread": spread, "significant": p < 0.05 and spread > 0.1, "peak": high, "trough": low}


def _predict(model: str, y: np.ndarray, season: int, steps: int) -> np.ndarray:
    ahead = np.arange(len(y), len(y) + steps)
    if model == "level":
        return np.full(steps, y[-3:].mean())
    if model == "seasonal_linear":
        place = np.arange(len(y)) % season
        line = stats.linear_fit(y)
        fit = line.intercept + line.slope * np.arange(len(y))
        usable = np.abs(fit) > 1e-12
        ratio = np.array([np.mean((y[usable & (place == k)] / fit[usable & (place == k)]) if (usable & (place == k)).any() else 1.0) for k in range(season)])
        ratio = ratio / ratio.mean() if abs(ratio.mean()) > 1e-12 else ratio
        adjusted = stats.linear_fit(np.divide(y, ratio[place], out=y.copy(), where=np.abs(ratio[place]) > 1e-12))
        return (adjusted.intercept + adjusted.slope * ahead) * ratio[ahead % season]
    line = stats.linear_fit(y)
    return line.intercept + line.slope * ahead


MODELS = ("level", "linear", "seasonal_linear")


def forecast(points: Sequence[Point], grain: str, horizon: int = 3, additive: bool = True, models: Sequence[str] = MODELS) -> dict:
    """Forecasts of the next periods with a range, by the model with the smallest one-step error in a backtest.

    Models: the mean of the last three periods, a line, a line with seasonal
    factors (which must win by a tenth); models narrows the choice. Refused: fewer than six periods, holes
    that cannot be filled, an average backtest error above 150 percent.
    """
    if not 1 <= horizon <= 12:
        raise AnalysisError("invalid_horizon", "A forecast reaches 1 to 12 periods ahead.")
    filled = contiguous(points, additive) if points else None
    if len(points) < 6:
        raise AnalysisError("not_enough_data", f"A forecast needs six complete periods; there are {len(points)}.")
    if filled is None:
        raise AnalysisError("gaps_in_series", "Too many periods are missing for a forecast.")
    y, season = np.array([p.value for p in filled]), cal.SEASON[grain]
    n = len(y)
    tests = min(6, max(2, n // 3))
    unknown = [m for m in models if m not in MODELS]
    if unknown or not models:
        raise AnalysisError("unknown_model", f"There is no model {', '.join(unknown) or 'at all'}.", "Models: " + ", ".join(MODELS))
    models = [m for m in MODELS if m in models and (m != "seasonal_linear" or (season and n - tests >= 2 * season))]
    if not models:
        raise AnalysisError("not_enough_data", "A seasonal model needs two whole seasons before the tests.")
    errors = {m: [abs(_predict(m, y[: n - t], season, 1)[0] - y[n - t]) for t in range(tests, 0, -1)] for m in models}
    mae = {m: float(np.mean(e)) for m, e in errors.items()}
    best = min((m for m in models if m != "seasonal_linear"), key=lambda m: mae[m], default="seasonal_linear")
    if "seasonal_linear" in mae and mae["seasonal_linear"] < 0.9 * mae[best]:
        best = "seasonal_linear"
    actual = np.abs(y[n - tests :])
    shares = [e / a for e, a in zip(errors[best], actual, strict=True) if a > 1e-9]
    mape = float(np.mean(shares) * 100) if shares else None
    if mape is not None and mape > 150:
        raise AnalysisError("unpredictable", "Past forecasts would have been off by more than the values themselves.")
    sigma = float(np.std(errors[best], ddof=1)) if tests > 2 else 0.0
    sigma = max(sigma, sqrt(float(np.mean(np.square(errors[best])))))
    nonnegative = bool((y >= 0).all())
    ahead = _predict(best, y, season, horizon)
    out = []
    for k, v in enumerate(ahead.tolist()):
        band = 1.96 * sigma * sqrt(1 + (k + 1) / n)
        low, mid = (max(0.0, v - band), max(0.0, v)) if nonnegative else (v - band, v)
        out.append({"ord": filled[-1].ord + 1 + k, "period": cal.key_of(filled[-1].ord + 1 + k, grain), "value": mid, "low": low, "high": v + band if not nonnegative else max(0.0, v + band)})
    return {"model": best, "points": out, "mae": mae[best], "mape": mape, "n": n, "tests": tests}


def compare_periods(df: DataFrame, date_column: str, period_a: str, period_b: str, metric: str | None = None, agg: str | None = None, dimension: str | None = None, grain: str | None = None) -> DataFrame:
    """a against b in one pass: value_a, value_b, change, pct (and key, share of the change, by dimension).

    Without a dimension one row. With one, a row per group of either period: a
    group that a period lacks counts as 0 there.
    """
    agg = agg or ("sum" if metric else "count")
    spans = [cal.range_of_key(p, grain) for p in (period_a, period_b)]
    if None in spans:
        raise AnalysisError("invalid_period", f"{period_a if spans[0] is None else period_b!r} is not a period.", "For example 2025-03, 2025-Q1 or 2025.")
    day, value = typed(df, date_column), typed(df, metric) if metric else F.lit(1)
    (a0, a1), (b0, b1) = spans
    rows = df.where(day.between(a0, a1) | day.between(b0, b1)).select(
        *([F.coalesce(group_key(df, dimension), F.lit(BLANK)).alias("key")] if dimension else []), F.when(day.between(a0, a1), value).alias("a"), F.when(day.between(b0, b1), value).alias("b")
    )

    def side(c: str) -> Column:
        out = aggregate_column(F.col(c), agg).cast("double")
        return F.coalesce(out, F.lit(0.0)) if dimension or agg in ("sum", "count") else out

    found = rows.groupBy(*(["key"] if dimension else [])).agg(side("a").alias("value_a"), side("b").alias("value_b"))
    change = F.col("value_a") - F.col("value_b")
    found = found.withColumn("change", change).withColumn("pct", F.when(F.abs("value_b") >= 1e-12, change / F.abs("value_b") * 100))
    if not dimension:
        return found
    found = with_totals(found, total=F.sum("change"))
    return found.withColumn("share_of_change", F.when(F.abs("total") >= 1e-12, F.col("change") / F.col("total") * 100)).drop("total").orderBy(F.desc(F.abs("change")), "key")


def compare_by(df: DataFrame, date_column: str, period_a: str, period_b: str, dimensions: Sequence[str], metric: str | None = None, grain: str | None = None) -> DataFrame:
    """dimension, key, value_a, value_b, change of sums (or rows) by several dimensions, from one aggregation."""
    (a0, a1), (b0, b1) = (cal.range_of_key(p, grain) for p in (period_a, period_b))
    day, value = typed(df, date_column), typed(df, metric) if metric else F.lit(1)
    labels = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(group_key(df, d), F.lit(BLANK)).alias("key")) for d in dimensions])
    rows = df.where(day.between(a0, a1) | day.between(b0, b1)).select(F.explode(labels).alias("l"), F.when(day.between(a0, a1), value).alias("a"), F.when(day.between(b0, b1), value).alias("b"))
    side = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    found = rows.groupBy("l.dimension", "l.key").agg(side("a").alias("value_a"), side("b").alias("value_b"))
    return found.withColumn("change", F.col("value_a") - F.col("value_b"))


def pattern_of(groups: DataFrame) -> str:
    """change_pattern of groups(change), however many: it takes their sums and the two largest changes in the total's direction."""
    moved = groups.where(F.abs("change") > 1e-12)
    s = moved.agg(F.count("*").alias("n"), F.sum("change").alias("total"), F.count_if(F.col("change") > 0).alias("up")).first()
    total = s["total"] or 0.0
    if not s["n"] or abs(total) < 1e-12:
        return "none"
    first = [r["change"] / total for r in moved.orderBy(F.desc(F.col("change") * (1 if total > 0 else -1))).select("change").limit(2).collect()]
    if s["n"] > 1 and (first[0] >= 0.5 or sum(first) >= 0.7):
        return "concentrated"
    along = s["up"] if total > 0 else s["n"] - s["up"]
    return "broad-based" if along / s["n"] >= 0.7 else "mixed"


def change_pattern(changes: Sequence[float]) -> str:
    """concentrated, broad-based, mixed or none, from the changes of groups."""
    moved = [c for c in changes if abs(c) > 1e-12]
    total = sum(moved)
    if not moved or abs(total) < 1e-12:
        return "none"
    shares = sorted((c / total for c in moved), reverse=True)
    if len(moved) > 1 and (shares[0] >= 0.5 or sum(shares[:2]) >= 0.7):
        return "concentrated"
    return "broad-based" if sum((c > 0) == (total > 0) for c in moved) / len(moved) >= 0.7 else "mixed"


def volume_vs_margin(df: DataFrame, date_column: str, period_a: str, period_b: str, revenue: str, profit: str) -> DataFrame:
    """One row: what volume and what margin contributed to the change of profit; the parts add up."""
    (a0, a1), (b0, b1) = cal.range_of_key(period_a), cal.range_of_key(period_b)
    day, r, p = typed(df, date_column), typed(df, revenue), typed(df, profit)
    sides = df.where(day.between(a0, a1) | day.between(b0, b1)).agg(
        F.sum(F.when(day.between(a0, a1), r)).alias("revenue_a"), F.sum(F.when(day.between(b0, b1), r)).alias("revenue_b"),
        F.sum(F.when(day.between(a0, a1), p)).alias("profit_a"), F.sum(F.when(day.between(b0, b1), p)).alias("profit_b"),
    )
    ma, mb = F.try_divide("profit_a", "revenue_a"), F.try_divide("profit_b", "revenue_b")
    return sides.select(
        "*", (ma * 100).alias("margin_a"), (mb * 100).alias("margin_b"), (F.col("profit_a") - F.col("profit_b")).alias("profit_change"),
        ((F.col("revenue_a") - F.col("revenue_b")) * mb).alias("volume_effect"), (F.col("revenue_a") * (ma - mb)).alias("margin_effect"),
    )


def margin_series(df: DataFrame, date_column: str, revenue: str, profit: str, grain: str = "month") -> DataFrame:
    """ord, period, revenue, profit, margin: sum of profit over sum of revenue, where revenue is positive."""
    rows = df.select(cal.ordinal(typed(df, date_column), grain).alias("ord"), typed(df, revenue).alias("r"), typed(df, profit).alias("p")).where("ord is not null")
    sums = rows.groupBy("ord").agg(F.sum("r").alias("revenue"), F.sum("p").alias("profit")).where("revenue > 0 and profit is not null")
    return sums.select("ord", cal.period_key(F.col("ord"), grain).alias("period"), "revenue", "profit", (F.col("profit") / F.col("revenue") * 100).alias("margin")).orderBy("ord")


def date_span(df: DataFrame, date_column: str) -> tuple[date, date] | None:
    if kind_of(df, date_column) != "date":
        raise AnalysisError("wrong_type", f'"{date_column}" does not hold dates.')
    row = df.agg(F.min(typed(df, date_column)).alias("a"), F.max(typed(df, date_column)).alias("b")).first()
    return (row["a"], row["b"]) if row["a"] else None

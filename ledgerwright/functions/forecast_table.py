"""Forecasts in SQL: a table function that takes any table of series.

    SELECT * FROM forecast_series(
      TABLE(SELECT nation, month_start, sales FROM monthly) PARTITION BY nation ORDER BY month_start,
      period => 'month_start', value => 'sales', grain => 'month', horizon => 3)

Every partition is one series: Spark deals the partitions out, sorts them and calls the
function for each, so any number of series is forecast side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from ..errors import AnalysisError
from . import calendar as cal

NAME = "forecast_series"
_FOUND = (("period", T.StringType()), ("value", T.DoubleType()), ("low", T.DoubleType()), ("high", T.DoubleType()), ("model", T.StringType()), ("mae", T.DoubleType()), ("refused", T.StringType()))


def _text(argument: AnalyzeArgument | None, fallback: str) -> str:
    if argument is None:
        return fallback
    if not argument.isConstantExpression or not isinstance(argument.value, str):
        raise AnalysisError("invalid_argument", "period, value, grain and models are constant texts.")
    return argument.value


def ordinal_in(value: object, grain: str) -> int | None:
    """The period's number of a date, a time or a period key ('2024-05'); null for what is none."""
    if isinstance(value, datetime):
        value = value.date()
    if isinstance(value, date):
        return cal.ordinal_of(value, grain)
    span = cal.range_of_key(str(value)) if value is not None else None
    return cal.ordinal_of(span[0], grain) if span else None


class Forecast:
    """forecast_series(TABLE(...) PARTITION BY ... ORDER BY ..., period, value, grain, horizon, additive, models).

    The columns of the table besides period and value are the series' own; they come
    back in front of the forecast: period, value, low, high, model, mae. They should
    be what the table is partitioned by, as the values of the last row of a partition
    are returned. A series that cannot be forecast is one row with the reason in
    `refused`. Values of one period add up, null periods, null values and NaN are
    missing, holes are handled as in timeseries.forecast.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, period: AnalyzeArgument = None, value: AnalyzeArgument = None, grain: AnalyzeArgument = None, horizon: AnalyzeArgument = None, additive: AnalyzeArgument = None, models: AnalyzeArgument = None) -> AnalyzeResult:
        from ..operators.timeseries import MODELS

        if not table.isTable:
            raise AnalysisError("invalid_argument", f"{NAME} takes a table: TABLE(...) PARTITION BY ... ORDER BY ...")
        names = table.dataType.names
        at, of = _text(period, "period"), _text(value, "value")
        missing = [c for c in (at, of) if c not in names]
        if missing:
            raise AnalysisError("unknown_column", f"The table has no column {', '.join(missing)}.", "Columns: " + ", ".join(names))
        if not isinstance(table.dataType[of].dataType, T.NumericType):
            raise AnalysisError("wrong_type", f'"{of}" holds no numbers.')
        if _text(grain, "month") not in cal.GRAINS:
            raise AnalysisError("invalid_grain", "One of " + ", ".join(cal.GRAINS))
        unknown = [m for m in _text(models, "level").replace(" ", "").split(",") if m not in MODELS]
        if unknown:
            raise AnalysisError("unknown_model", f"There is no model {', '.join(unknown)}.", "Models: " + ", ".join(MODELS))
        own = [f for f in table.dataType.fields if f.name not in (at, of)]
        clash = [f.name for f in own if f.name in dict(_FOUND)]
        if clash:
            raise AnalysisError("name_clash", f"Rename {', '.join(clash)}: the forecast has a column of that name.")
        return AnalyzeResult(T.StructType([*own, *(T.StructField(n, t) for n, t in _FOUND)]))

    def __init__(self) -> None:
        self.values: dict[int, float] = {}
        self.counts: dict[int, int] = {}
        self.own: list = []
        self.how: dict | None = None

    def eval(self, row, period: str = "period", value: str = "value", grain: str = "month", horizon: int = 3, additive: bool = True, models: str = "level,linear,seasonal_linear") -> None:
        fields = row.asDict(recursive=False)
        self.how = {"grain": grain, "horizon": horizon, "additive": additive, "models": tuple(models.replace(" ", "").split(","))}
        at, v = fields.pop(period), fields.pop(value)
        self.own = list(fields.values())
        o = ordinal_in(at, grain)
        if o is None or v is None or math.isnan(v):
            return
        self.values[o] = self.values.get(o, 0.0) + float(v)
        self.counts[o] = self.counts.get(o, 0) + 1

    def terminate(self) -> Iterator[tuple]:
        from ..operators.timeseries import MAX_PERIODS, Point, forecast

        if self.how is None:
            return
        try:
            if len(self.values) > MAX_PERIODS:
                raise AnalysisError("too_many_periods", f"More than {MAX_PERIODS:,} periods.")
            points = [Point(o, self.counts[o], self.values[o]) for o in sorted(self.values)]
            found = forecast(points, **self.how)
        except AnalysisError as e:
            yield (*self.own, None, None, None, None, None, None, e.code)
            return
        for p in found["points"]:
            yield (*self.own, p["period"], float(p["value"]), float(p["low"]), float(p["high"]), found["model"], found["mae"], None)


def register(spark: SparkSession) -> None:
    """Make forecast_series known to spark.sql of this session."""
    spark.udtf.register(NAME, udtf(Forecast))

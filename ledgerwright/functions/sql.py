"""The engine's scalars as functions of Spark SQL: period_key, parse_number, t_two_sided_p."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import t_p_value
from .values import number_of

_EU = str.maketrans(",.", ".,")


@F.pandas_udf(T.DoubleType())
def _parse_number(text: pd.Series, locale: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else number_of(t.translate(_EU) if where == "eu" else t) for t, where in zip(text, locale, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(n) or n <= 0 else t_p_value(float(a), float(n)) for a, n in zip(t, df, strict=True)], dtype="float64")


def register(spark: SparkSession) -> None:
    """Make the functions known to spark.sql of this session.

    period_key(date, grain) is SQL itself, so it stays in the JVM; the others run on
    Arrow batches. Null in, null out; an unknown grain gives null.
    """
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION period_key(day DATE, grain STRING) RETURNS STRING RETURN CASE grain
        WHEN 'day' THEN date_format(day, 'yyyy-MM-dd') WHEN 'week' THEN date_format(date_trunc('week', day), 'yyyy-MM-dd') WHEN 'month' THEN date_format(day, 'yyyy-MM')
        WHEN 'quarter' THEN concat(year(day), '-Q', quarter(day)) WHEN 'year' THEN date_format(day, 'yyyy') END"""
    )
    spark.udf.register("parse_number", _parse_number)
    spark.udf.register("t_two_sided_p", _t_two_sided_p)

"""Calendars, statistics and cell parsers against known answers and the standard library."""

from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from ledgerwright.functions import calendar as cal
from ledgerwright.functions import stats
from ledgerwright.functions import values as val
from pyspark.sql import functions as F


@pytest.mark.parametrize("grain", cal.GRAINS)
def test_ordinals_agree_with_the_driver_side_for_every_day(spark, grain):
    days = [date(1968, 12, 25) + timedelta(days=i * 3) for i in range(3000)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", cal.ordinal(F.col("d"), grain).alias("o"))
    for r in df.select("d", "o", cal.period_start(F.col("o"), grain).alias("s"), cal.period_key(F.col("o"), grain).alias("k")).collect():
        n = cal.ordinal_of(r["d"], grain)
        assert (r["o"], r["s"], r["k"]) == (n, cal.start_of(n, grain), cal.key_of(n, grain))
        assert cal.start_of(n, grain) <= r["d"] <= cal.end_of(n, grain)


@given(st.dates(date(1900, 1, 1), date(2100, 12, 31)), st.sampled_from(cal.GRAINS))
def test_periods_have_no_gaps(day, grain):
    n = cal.ordinal_of(day, grain)
    assert cal.start_of(n + 1, grain) == cal.end_of(n, grain) + timedelta(days=1)
    first, last = cal.range_of_key(cal.key_of(n, grain), grain)
    assert (first, last) == (cal.start_of(n, grain), cal.end_of(n, grain))


def test_period_texts():
    assert cal.range_of_key("2025-02") == (date(2025, 2, 1), date(2025, 2, 28))
    assert cal.range_of_key("2025-13") is None and cal.range_of_key("soon") is None
    assert [cal.normalize_key(t) for t in ("May 2026", "Q2 2026", "2026/05", "2026 q3", "x")] == ["2026-05", "2026-Q2", "2026-05", "2026-Q3", "x"]
    assert cal.label_of(cal.ordinal_of(date(2026, 5, 1), "month"), "month") == "May 2026"
    assert [cal.pick_grain(date(2025, 1, 1), date(2025, 1, 1) + timedelta(days=n)) for n in (45, 46, 200, 201, 1200, 1201)] == ["day", "week", "week", "month", "month", "quarter"]


def test_distributions():
    assert stats.t_p_value(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert stats.f_p_value(4.965, 1, 10) == pytest.approx(0.05, abs=1e-3)
    assert stats.incomplete_beta(0.5, 2, 2) == pytest.approx(0.5)
    assert stats.r_p_value(0.632, 10) == pytest.approx(0.05, abs=1e-3)
    assert stats.r_p_value(0.5, 2) == 1.0


def test_series_statistics():
    line = stats.linear_fit([1, 3, 5, 7])
    assert (line.slope, line.intercept, line.r2) == (pytest.approx(2), pytest.approx(1), pytest.approx(1))
    assert stats.mann_kendall([1, 2, 3]) == 1 and stats.mann_kendall([3, 2, 1]) == -1
    assert stats.stdev([5]) == 0 and stats.mad([1, 1, 9]) == 0 and stats.quantile([], 0.5) is None
    assert stats.pct_change(5, 0) is None and stats.pct_change(-5, -10) == 50
    f, p = stats.anova_f([1, 1.1, 5, 5.1], [0, 0, 1, 1])
    assert f > 100 and p < 0.01


def _parsed(spark, cells, make):
    return [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(make(F.col("c"))).collect()]


def test_numbers_of_both_locales(spark):
    cells = ["1,234.5", "1.234,5", "1.234", "1,234", "12,34,567.8", "$ 5", "(€7)", "5%", "-", None, "", "1e400", "x" * 50, "1 234", "−3"]
    assert _parsed(spark, cells, val.parse_number) == [1234.5, None, 1.234, 1234.0, 1234567.8, 5.0, -7.0, 0.05, None, None, None, None, None, 1234.0, -3.0]
    assert _parsed(spark, cells[:4], lambda c: val.parse_number(c, "eu")) == [1234.5, 1234.5, 1234.0, 1.234]
    assert _parsed(spark, ["$1", "EUR 5", "5 Rs", "7", None, "₹3"], val.currency_of) == ["USD", "EUR", "INR", None, None, "INR"]
    assert [val.number_of(v) for v in ("$1,000", "5%", 3, True, None, "x", "(4)")] == [1000.0, 0.05, 3.0, None, None, None, -4.0]


@given(st.floats(-1e9, 1e9).map(lambda x: round(x, 2)))
def test_number_of_reads_what_python_writes(x):
    assert val.number_of(f"{x:,.2f}") == pytest.approx(x)


def test_dates_of_both_orders(spark):
    cells = ["05/03/2025", "13/03/2025", "3/13/2025", "2024-02-29", "2023-02-29", "29 Feb 2024", "December 3rd, 1999", "2024Q4", "2025-03-05T10:00:00Z", None, "99-1-1"]
    got = _parsed(spark, cells, lambda c: val.parse_date(c, "dmy"))
    assert got == [date(2025, 3, 5), date(2025, 3, 13), None, date(2024, 2, 29), None, date(2024, 2, 29), date(1999, 12, 3), date(2024, 10, 1), date(2025, 3, 5), None, None]
    assert _parsed(spark, cells[:3], val.parse_date) == [date(2025, 5, 3), None, date(2025, 3, 13)]


def test_quantiles_match_spark(spark):
    x = np.random.default_rng(0).normal(size=101)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for q in (0.05, 0.5, 0.9):
        assert df.agg(F.percentile("x", q)).first()[0] == pytest.approx(stats.quantile(x, q))


def test_sql_functions(spark):
    from ledgerwright.functions.sql import register

    register(spark)
    row = spark.sql("select period_key(date '2025-05-20', 'quarter') q, period_key(date '2025-05-20', 'week') w, period_key(null, 'day') n, parse_number('$1,234.50', 'us') a, parse_number('1.234,50', 'eu') b, parse_number(null, 'us') c, t_two_sided_p(2.228D, 10) p").first()
    assert (row["q"], row["w"], row["n"], row["a"], row["b"], row["c"]) == ("2025-Q2", "2025-05-19", None, 1234.5, 1234.5, None)
    assert row["p"] == pytest.approx(0.05, abs=1e-3)
    days = spark.createDataFrame([(date(2023, 12, 25) + timedelta(days=i),) for i in range(400)], "d date")
    for grain in cal.GRAINS:
        assert days.where(cal.period_key(cal.ordinal(F.col("d"), grain), grain) != F.expr(f"period_key(d, '{grain}')")).count() == 0


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip().endswith("True"), said.stderr[-2000:]

"""Blanks, empty groups, ties and small cases of every operator."""

from datetime import date, timedelta

import numpy as np
import pytest
from ledgerwright.errors import AnalysisError
from ledgerwright.operators import aggregate as agg
from ledgerwright.operators import entities as ent
from ledgerwright.operators import explorer as exp
from ledgerwright.operators import grouping as grp
from ledgerwright.operators import ranks
from ledgerwright.operators import relations as rel
from ledgerwright.operators import timeseries as ts
from ledgerwright.operators.filters import Filter, apply_filters, closest_values, describe
from pyspark.sql import functions as F

SCHEMA = "id int, region string, sales double, day date, ok boolean"


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "East", 10.0, date(2025, 1, 5), True), (2, "east", 20.0, date(2025, 1, 20), False), (3, "West", None, date(2025, 2, 1), None), (4, None, 5.0, date(2025, 3, 31), True),
        (5, "North", float("nan"), None, True), (6, "West", -4.0, date(2025, 3, 1), False), (7, "West", 4.0, date(2024, 12, 31), None),
    ]
    return spark.createDataFrame(data, SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (Filter("region", "eq", "EAST"), [1, 2]), (Filter("region", "neq", "east"), [3, 5, 6, 7]), (Filter("region", "not_in", values=("east", "west")), [5]), (Filter("region", "contains", "ST"), [1, 2, 3, 6, 7]),
        (Filter("region", "is_null"), [4]), (Filter("sales", "is_null"), [3, 5]), (Filter("sales", "gt", 4), [1, 2, 4]), (Filter("sales", "neq", 4), [1, 2, 4, 6]), (Filter("sales", "between", values=("20", "5")), [1, 2, 4]),
        (Filter("day", "eq", "2025-01"), [1, 2]), (Filter("day", "gt", "2025-Q1"), []), (Filter("day", "gte", "2025"), [1, 2, 3, 4, 6]), (Filter("day", "neq", "2025"), [7]), (Filter("day", "lte", "2025-02"), [1, 2, 3, 7]),
        (Filter("ok", "eq", "yes"), [1, 4, 5]), (Filter("ok", "neq", "yes"), [2, 6]),
    ],
)
def test_filters_and_blanks(rows, f, want):
    assert ids(apply_filters(rows, [f])) == want
    assert f.column in describe(f)


@pytest.mark.parametrize("f", [Filter("region", "gt", "a"), Filter("sales", "eq", "many"), Filter("day", "eq", "someday"), Filter("ok", "eq", "perhaps"), Filter("nothing", "eq", 1), Filter("sales", "like", 1), Filter("day", "between", "2025")])
def test_senseless_filters_are_refused(rows, f):
    with pytest.raises(AnalysisError):
        apply_filters(rows, [f])


def test_filters_reach_the_scan(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "p"))
    plan = apply_filters(spark.read.parquet(str(tmp_path / "p")), [Filter("day", "eq", "2025-01"), Filter("sales", "gt", 4)]).select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(day" in plan.replace("`", "")


def test_closest_values(rows):
    assert [r["value"] for r in closest_values(rows, "region", "wst").collect()] == ["West", "East", "east"]


def test_aggregates_of_nothing(rows):
    none = rows.where("false")
    assert agg.aggregate(none, "sum", "sales").first()["value"] is None
    assert agg.aggregate(none, "std", "sales").first()["value"] == 0 and agg.aggregate(none, "count").first()["value"] == 0
    assert agg.aggregate(rows, "count", "sales").first()["value"] == 5
    assert agg.aggregate(rows, "max", "day").first()["value"] == date(2025, 3, 31)
    with pytest.raises(AnalysisError):
        agg.aggregate(rows, "sum", "region")
    assert agg.histogram(none, "sales").count() == 0 and agg.numeric_stats(none, "sales").first()["n"] == 0
    assert [(r["value"], r["n"]) for r in agg.value_counts(rows, "region").collect()] == [("West", 3), ("East", 1), ("North", 1), ("east", 1)]


def test_groups_keep_and_drop_as_they_should(rows):
    got = {r["key"]: (r["value"], r["n"], r["n_rows"]) for r in grp.group_by(rows, "region", "sales").collect()}
    assert got == {"East": (10, 1, 1), "east": (20, 1, 1), "West": (0, 2, 3), "(blank)": (5, 1, 1), "North": (0, 0, 1)}
    assert {r["key"] for r in grp.group_by(rows, "region", "sales", "avg").collect()} == {"East", "east", "West", "(blank)"}
    assert {r["key"]: r["value"] for r in grp.group_by(rows, "region", "sales", "std").collect()}["North"] == 0
    first = grp.ranked(rows, "region", "sales", n=2).orderBy("rank").collect()
    assert [(r["key"], r["share"]) for r in first] == [("east", pytest.approx(200 / 3)), ("East", pytest.approx(100 / 3))]
    assert [r["key"] for r in grp.group_by(rows, "day", "sales", grain="quarter", order="key").collect()] == ["(blank)", "2024-Q4", "2025-Q1"]
    with pytest.raises(AnalysisError):
        grp.group_by(rows, "day", "sales")
    assert {r["key"] for r in grp.group_by(rows, "sales").collect()} == {"10", "20", "5", "-4", "4", "(blank)"}
    assert grp.group_by(rows.where("false"), "region", "sales").count() == 0


def test_shares_pareto_and_concentration(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 25.0), ("d", -5.0)], "k string, v double")
    got = {r["key"]: (round(r["share"], 2), r["rank"]) for r in grp.share_of_total(df, "k", "v").collect()}
    assert got == {"a": (47.62, 1), "b": (28.57, 2), "c": (23.81, 3), "d": (0.0, 4)}
    row = grp.pareto(df, "k", "v").first()
    assert (row["groups"], row["total"], row["reach_50"], row["reach_80"]) == (4, 105, 2, 3)
    c = grp.concentration(grp.group_by(df, "k", "v"), 9).first()
    assert c["top_n"] == 3 and c["top_share"] == pytest.approx(100) and grp.is_concentrated(5, 1.4, 0.15) and not grp.is_concentrated(4, 3, 1)
    side = grp.compare_groups(df, "k", "A", "d", "v").first()
    assert (side["difference"], side["ratio"], side["pct"]) == (55, -10, 1100)
    assert grp.cross_tab(df, "k", "k", "v", max_labels=2).count() == 2


def points(values, start=100, n=30):
    return [ts.Point(start + i, n, float(v)) for i, v in enumerate(values)]


def test_series_holes_and_partial_ends(spark):
    data = [(date(2025, m, d), float(m)) for m in range(1, 13) if m != 6 for d in range(1, 29)] + [(date(2026, 1, 2), 5.0)] + [(date(2025, 6, 1), None)]
    df = spark.createDataFrame(data, "day date, v double")
    series = ts.time_series(df, "day", "v")
    assert [r["period"] for r in ts.missing_periods(series, "month").collect()] == ["2025-06"]
    changes = {r["period"]: r["pct_change"] for r in ts.adjacent_change(series).collect()}
    assert changes["2025-07"] is None and changes["2025-05"] == pytest.approx(25)
    found = ts.complete(ts.collect_series(series, "month"), *ts.date_span(df, "day"))
    assert found.trimmed_end == 1 and found.trimmed_start == 0 and len(found.points) == 11
    pair = ts.latest_pair(found)
    assert pair and pair[0].ord - pair[1].ord == 1
    assert ts.contiguous(found.points, True)[5].value == 0 and ts.contiguous(found.points, False) is None
    assert ts.gap_fraction(found.points) == pytest.approx(1 / 12)
    assert ts.complete(ts.Series("month", tuple(points([1, 2, 3], n=1))), None, None).trimmed_end == 0


def test_trend_anomaly_season_forecast():
    assert ts.trend([1, 2, 3]) == {}
    up = ts.trend([100 + 5 * i for i in range(12)])
    assert up["direction"] == "rising" and up["significant"] and up["acceleration"] == "steady"
    assert ts.trend([10, 11, 9, 10, 11, 9, 10, 11])["direction"] == "flat"
    odd = points([10, 11, 10, 12, 11, 10, 40, 11, 10, 12, 11, 10])
    assert [a["ord"] for a in ts.anomalies(odd)] == [106] and ts.anomalies(odd[:7]) == []
    wave = points([100 + 40 * ((i % 12) == 11) for i in range(36)], start=2020 * 12)
    s = ts.seasonality(wave, "month")
    assert s["significant"] and s["peak"] == 11 and ts.seasonality(wave[:20], "month") is None and ts.seasonality(wave, "quarter") is None
    flat = ts.forecast(points([50] * 8), "month", 2)
    assert [p["value"] for p in flat["points"]] == [pytest.approx(50)] * 2 and flat["points"][0]["ord"] == 108
    line = ts.forecast(points([10 * i for i in range(1, 13)]), "month", 3)
    assert line["model"] == "linear" and line["points"][2]["value"] == pytest.approx(150)
    seasonal = ts.forecast(wave, "month", 12)
    assert seasonal["model"] == "seasonal_linear" and max(seasonal["points"], key=lambda p: p["value"])["ord"] % 12 == 11
    for bad in (points([1] * 5), points([1, 2, 3]) + points([1, 2, 3], start=200)):
        with pytest.raises(AnalysisError):
            ts.forecast(bad, "month")
    assert min(p["low"] for p in ts.forecast(points([5, 4, 3, 2, 1, 0]), "month", 3)["points"]) >= 0


def test_period_comparison(spark):
    df = spark.createDataFrame([(date(2025, 1, 3), "a", 10.0), (date(2025, 2, 3), "a", 15.0), (date(2025, 2, 4), "b", 7.0), (date(2025, 3, 1), "a", 99.0)], "d date, k string, v double")
    row = ts.compare_periods(df, "d", "2025-02", "2025-01", "v").first()
    assert (row["value_a"], row["value_b"], row["change"], row["pct"]) == (22, 10, 12, 120)
    groups = {r["key"]: (r["value_a"], r["value_b"], r["pct"]) for r in ts.compare_periods(df, "d", "2025-02", "2025-01", "v", dimension="k").collect()}
    assert groups == {"a": (15, 10, 50), "b": (7, 0, None)}
    assert [ts.change_pattern(c) for c in ([9, 1], [3, 3, 3, 3], [5, -4, 5, -4, 1], [], [1, -1])] == ["concentrated", "broad-based", "concentrated", "none", "none"]
    with pytest.raises(AnalysisError):
        ts.compare_periods(df, "d", "soon", "2025-01", "v")


def test_volume_and_margin_add_up(spark):
    df = spark.createDataFrame([(date(2025, 1, 1), 100.0, 20.0), (date(2025, 2, 1), 150.0, 45.0)], "d date, r double, p double")
    row = ts.volume_vs_margin(df, "d", "2025-02", "2025-01", "r", "p").first()
    assert row["volume_effect"] == pytest.approx(10) and row["margin_effect"] == pytest.approx(15) and row["profit_change"] == 25


def test_relations_and_correlation(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), float(i) * (i % 7), float(i) - i % 7, None if i % 3 else 1.0) for i in range(60)], "a double, b double, ab double, d double, e double")
    found = {(r["target"], r["form"], r["left"], r["right"]) for r in rel.relations(df, ["a", "b", "ab", "d"])}
    assert ("ab", "*", "a", "b") in found and any({t, left, right} == {"a", "b", "d"} for t, _, left, right in found)
    assert rel.correlation(df, "a", "a").first()["r"] == pytest.approx(1)
    assert rel.correlation(df, "a", "e").first()["r"] is None
    assert rel.spearman(df.selectExpr("a", "a * a * a as c"), "a", "c").first()["rho"] == pytest.approx(1)
    assert rel.correlation_pairs(df, ["a", "b", "d"]).count() == 3
    assert rel.tautology("Sales", "Total Sales", 0.5, None) and rel.tautology("x", "y", 0.995, None) and rel.tautology("x", "y", 0.5, 0.001) and not rel.tautology("x", "y", 0.5, 0.5)
    assert rel.ratio_spread(df.where("a > 0"), "ab", "a").first()["cv"] > 0.02


def test_relations_do_not_depend_on_the_first_rows(spark):
    """An identity of 95 % of the rows counts, though the first 6,000 lack a column or break it."""
    n = F.col("id")
    df = spark.range(0, 120000, 1, 1).select((n % 97 + 100).cast("double").alias("r"), (n % 31).cast("double").alias("k"), n)
    late = df.select("r", "k", F.when(n >= 6000, F.col("r") - F.col("k")).alias("p"))
    broken = df.select("r", "k", F.when(n >= 6000, F.col("r") - F.col("k")).otherwise(5000.0 + n).alias("p"))
    for x, share in ((late, 1.0), (broken, 0.95)):
        assert rel.relations(x, ["r", "k", "p"]) == [{"target": "k", "left": "r", "right": "p", "form": "-", "share": share}]


def test_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [10, 11, 12, 10, 11, 12, 10, 11, 100]] + [(None,)], "v double")
    assert [rel.outliers(df, "v", m).first()["outliers"] for m in ("iqr", "mad")] == [1, 1]
    row = rel.outliers(df.limit(5), "v").first()
    assert row["low"] is None and row["outliers"] == 0
    with pytest.raises(AnalysisError):
        rel.outliers(df, "v", "guess")


def test_profitability_is_sum_over_sum(spark):
    df = spark.createDataFrame([("a", 1000.0, 100.0), ("a", 10.0, 9.0), ("b", 100.0, -5.0), ("c", 0.0, 1.0)], "k string, r double, p double")
    got = {r["key"]: (r["margin"], r["loss"]) for r in rel.profitability(df, "k", "r", "p").collect()}
    assert got["a"][0] == pytest.approx(109 / 1010 * 100) and got["b"] == (-5, True) and got["c"] == (None, False)
    assert rel.high_revenue_low_margin(rel.profitability(df, "k", "r", "p")).count() == 1


def test_customers_cohorts_and_funnels(spark):
    base = date(2025, 1, 10)
    seen = [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 2), ("c", 1), (None, 1)]
    df = spark.createDataFrame([(c, base + timedelta(days=31 * m), 10.0 * (m + 1)) for c, m in seen], "c string, d date, v double")
    s = ent.customer_summary(df, "c", "v").first()
    assert (s["customers"], s["top_decile"], round(s["repeat_rate"], 2)) == (3, 1, 66.67) and s["top_decile_share"] == pytest.approx(50)
    assert [(r["new"], r["returning"]) for r in ent.new_vs_returning(df, "c", "d").collect()] == [(2, 0), (1, 1), (0, 2)]
    cells = {(r["period"], r["offset"]): r["retention"] for r in ent.cohort_retention(df, "c", "d").collect()}
    assert cells == {("2025-01", 0): 100, ("2025-01", 1): 50, ("2025-01", 2): 100, ("2025-02", 0): 100}
    f = spark.createDataFrame([("x", "Lead"), ("x", "won"), ("y", "lead"), ("z", "proposal"), ("z", None)], "e string, s string")
    order = ["lead", "proposal", "won"]
    assert [r["reached"] for r in ent.funnel(f, "s", order).collect()] == [2, 1, 1]
    assert [r["reached"] for r in ent.funnel(f, "s", order, "e").collect()] == [2, 1, 1]
    snap = ent.funnel(f, "s", order, "e", "snapshot").collect()
    assert [(r["n"], r["reached"]) for r in snap] == [(1, 3), (1, 2), (1, 1)] and snap[1]["from_previous"] == pytest.approx(200 / 3)
    assert ent.stage_order(["Won", "lead", "Proposal"]) == ["lead", "Proposal", "Won"] and ent.stage_order(["x", "y"]) is None


def test_explorer(rows, spark):
    assert [r["id"] for r in exp.sort_rows(rows, "region", tie=["id"]).collect()] == [1, 2, 5, 3, 6, 7, 4]
    assert [r["id"] for r in exp.sort_rows(rows, "sales", True, ["id"]).collect()][-2:] == [3, 5]
    page = exp.query_rows(rows, [Filter("region", "not_null")], "st", "id", tie=["id"], columns=["id"], offset=1, limit=2)
    assert [r["id"] for r in page.collect()] == [2, 3] and page.columns == ["id"]
    with pytest.raises(AnalysisError):
        exp.query_rows(rows, limit=500)
    some, more = exp.matching_rows(rows, cap=3)
    assert some.count() == 3 and more
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "i int, k string")
    assert [(r["i"], r["seq"]) for r in exp.duplicate_rows(d, ["i"]).orderBy("i").collect()] == [(2, 2), (4, 2)]
    assert ids(exp.drop_duplicate_rows(d, ["i"]).withColumnRenamed("i", "id")) == [1, 3, 5]
    assert exp.count_duplicates(d.select("k")).first()["duplicates"] == 2
    assert exp.sample_rows(rows, 50).count() == 7


@pytest.mark.parametrize("most", [20, 10**6])
def test_quantiles_are_exact_however_they_are_found(spark, monkeypatch, most):
    """Small brackets, bracketed again and again, or all values at once: the same as the definition."""
    import numpy as np
    from ledgerwright.operators import ranks

    monkeypatch.setattr(ranks, "MOST_VALUES", most)
    monkeypatch.setattr(ranks, "ACCURACY", 20 if most < 100 else 10_000)
    rng = np.random.default_rng(most)
    two_heavy = np.concatenate([np.zeros(300), rng.random(60), np.ones(300)])  # points at both ends, values between
    for values in (rng.normal(size=400), two_heavy, np.array([7.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        quantiles = (0.0, 0.25, 0.5, 1.0)
        assert ranks.exact_quantiles(df, F.col("v"), quantiles) == pytest.approx(np.quantile(values, quantiles).tolist(), abs=1e-12)
    order = np.sort(two_heavy)
    x = spark.createDataFrame([(float(v),) for v in two_heavy], "x double")
    assert ranks.order_statistics(x, [0, 310, 659]) == {r: order[r] for r in (0, 310, 659)}
    assert ranks.exact_quantiles(df.where("false"), F.col("v"), (0.5,)) == [None]


@pytest.mark.parametrize("ranges", [1, 4, 256])
def test_running_totals_over_ranges(spark, monkeypatch, ranges):
    import numpy as np
    from ledgerwright.operators import ranks

    monkeypatch.setattr(ranks, "RANGES", ranges)
    rng = np.random.default_rng(ranges)
    levels = {float(v): int(rng.integers(1, 9)) for v in np.unique(rng.normal(size=300).round(2))}
    df = spark.createDataFrame(list(levels.items()), "v double, m long").repartition(5)
    for descending in (False, True):
        seen, want = 0, {}
        for v in sorted(levels, reverse=descending):
            want[v] = seen
            seen += levels[v]
        assert {r["v"]: r["before"] for r in ranks.running_totals(df, "v", descending, before=F.col("m")).collect()} == want
    assert ranks.running_totals(df.where("false"), "v", before=F.col("m")).count() == 0


def test_ranks_of_many_groups_need_no_single_task(spark):
    df = spark.createDataFrame([(f"k{i % 97}", float(i % 13), float(i)) for i in range(500)], "k string, a double, b double")
    for found in (grp.share_of_total(df, "k", "a"), grp.pareto(df, "k", "a"), grp.concentration(grp.group_by(df, "k", "a")), rel.spearman(df, "a", "b"), ent.customer_summary(df, "k", "a")):
        text = found._jdf.queryExecution().executedPlan().toString()
        assert all("__range" in w or "value" in w or "key" in w for w in [x for x in text.splitlines() if " Window " in x])
    shares = [r for r in grp.share_of_total(df, "k", "a").orderBy("rank").collect()]
    assert [r["rank"] for r in shares] == list(range(1, 98)) and [(-r["value"], r["key"]) for r in shares] == sorted((-r["value"], r["key"]) for r in shares)


@pytest.mark.parametrize("others", [0, 11, 12, 14, 30])
def test_identities_among_any_number_of_columns(spark, others):
    rng = np.random.default_rng(others)
    revenue, cost = rng.uniform(50, 100, 200), rng.uniform(10, 40, 200)
    noise = {f"m{i}": rng.uniform(-1e6, 1e6, 200) ** 3 for i in range(others)}
    frame = {**noise, "revenue": revenue, "cost": cost, "profit": revenue - cost}
    df = spark.createDataFrame([tuple(float(v) if (i + k) % 50 else None for k, v in enumerate(row)) for i, row in enumerate(zip(*frame.values()))], ", ".join(f"{c} double" for c in frame)).repartition(3)
    found = rel.relations(df, list(frame))
    assert [({r["target"], r["left"], r["right"]}, r["share"]) for r in found] == [({"revenue", "cost", "profit"}, 1.0)]
    assert rel.relations(df, ["revenue", "cost"]) == []


def test_correlations_far_from_zero_with_blanks(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, 3000)
    frame = {"a": a + 1e9, "b": 2 * a + rng.normal(0, 1, 3000) - 5e8, "c": rng.normal(0, 1e-3, 3000) + 7, "flat": np.full(3000, 0.1 + 0.2), "few": rng.normal(0, 1, 3000)}
    gone = {c: rng.random(3000) < (0.3 if c != "few" else 0.9995) for c in frame}
    df = spark.createDataFrame([tuple(None if gone[c][i] else float(frame[c][i]) for c in frame) for i in range(3000)], ", ".join(f"{c} double" for c in frame)).repartition(5)
    got = {(r["a"], r["b"]): (r["r"], r["n"]) for r in rel.correlation_pairs(df, list(frame)).collect()}
    assert len(got) == 10
    for (x, y), (r, n) in got.items():
        both = ~gone[x] & ~gone[y]
        assert n == both.sum()
        want = np.corrcoef(frame[x][both], frame[y][both])[0, 1] if n >= 3 and "flat" not in (x, y) else None
        assert r == (None if want is None else pytest.approx(want, abs=1e-7))
    assert [tuple(r) for r in rel.correlation_pairs(df.limit(0), ["a", "b"]).collect()] == [("a", "b", None, 0)] and rel.correlation_pairs(df, ["a"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 32, 33, 255])
def test_range_numbers(spark, n):
    bounds = [float(3 * i) for i in range(n)]
    for r in spark.range(-2, 3 * n + 4).select(F.col("id"), ranks.range_number(F.col("id").cast("double"), bounds).alias("k")).collect():
        assert r["k"] == sum(b < r["id"] for b in bounds)

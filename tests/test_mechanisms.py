"""Label dictionaries, forecasts in SQL and the sentence gate as a stream."""

import os
import shutil
from datetime import date

import pytest
from ledgerwright.errors import AnalysisError
from ledgerwright.functions import forecast_table
from ledgerwright.operators import labels as lab
from ledgerwright.operators import timeseries as ts
from ledgerwright.operators.filters import Filter, apply_filters
from ledgerwright.plans.catalog import QUERIES, conversation_pieces
from ledgerwright.streaming import gate_stream as gs
from pyspark.sql import Window
from pyspark.sql import functions as F

# --- labels ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def sorted_file(spark, tmp_path_factory):
    """20,000 rows in many row groups, ordered by label; one label in three spellings."""
    path = str(tmp_path_factory.mktemp("labels"))
    label = F.when(F.col("id") % 1000 == 7, F.element_at(F.array(F.lit("Needle"), F.lit("NEEDLE"), F.lit("needle")), (F.floor(F.col("id") / 1000) % 3 + 1).cast("int"))).otherwise(F.format_string("label %05d", F.col("id")))
    df = spark.range(20_000).select("id", F.when(F.col("id") % 500 != 3, label).alias("label"), F.lit("x").alias("odd.name"))
    df.coalesce(1).orderBy("label").write.option("parquet.block.size", 16 * 1024).option("parquet.page.size", 4096).parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    return rows, lab.Labels.build(rows, f"{path}/dictionary")


def rows_read(df):
    """Rows that came out of the file scan."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().get("numOutputRows").get().value()


def test_the_dictionary_lists_every_spelling(sorted_file):
    rows, labels = sorted_file
    assert labels.columns == {"label", "odd.name"}
    assert labels.spellings("label", ["needle"]) == ["NEEDLE", "Needle", "needle"]
    assert labels.spellings("odd.name", ["x"]) == ["x"] and labels.spellings("label", ["absent"]) == []
    assert labels.containing("label", ["eedl", "00042"]) == ["NEEDLE", "Needle", "label 00042", "needle"]
    assert labels.containing("label", ["label"]) is None  # more than a filter should list
    assert labels.table.agg(F.sum("n")).first()[0] == rows.where("label is not null").count() + rows.count()


@pytest.mark.parametrize("op, values", [("eq", ("NeedlE",)), ("neq", ("needle",)), ("in", ("needle", "Label 00011", "absent")), ("not_in", ("needle", "label 00011")), ("contains", ("EEDL",)), ("contains", ("label 0",)), ("eq", ("absent",)), ("neq", ("absent",))])
def test_filters_by_the_dictionary_equal_those_by_lower(sorted_file, op, values):
    rows, labels = sorted_file
    f = Filter("label", op, values=values)
    got, want = (sorted(r["id"] for r in apply_filters(rows, [f], x).collect()) for x in (labels, None))
    assert got == want


def test_the_filter_reaches_the_scan(spark, sorted_file):
    rows, labels = sorted_file
    by_label, by_lower = (apply_filters(rows, [Filter("label", "eq", "NEEDLE")], x) for x in (labels, None))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (by_label, by_lower)]
    assert "In(label, [NEEDLE,Needle,needle])" in plans[0] and "In(label" not in plans[1]
    assert rows_read(by_lower) == 20_000
    one = apply_filters(rows, [Filter("label", "eq", "LABEL 00042")], labels)
    assert rows_read(one) < 10_000  # row groups without the label are not read
    nothing = apply_filters(rows, [Filter("label", "eq", "absent")], labels)
    assert "LocalTableScan" in nothing._jdf.queryExecution().optimizedPlan().toString() or "LocalRelation" in nothing._jdf.queryExecution().optimizedPlan().toString()


# --- forecasts ------------------------------------------------------------------


@pytest.fixture(scope="module")
def monthly(spark):
    forecast_table.register(spark)
    rows = [(k, date(2020 + i // 12, i % 12 + 1, 1), v) for k, f in {"line": lambda i: 100.0 + 5 * i, "season": lambda i: 200 + i + (80 if i % 12 == 11 else 0), "flat": lambda i: 50 + (-1) ** i}.items() for i in range(40) if (v := float(f(i))) is not None]
    rows += [("short", date(2024, m, 1), 1.0) for m in range(1, 4)] + [("holes", date(2020 + 2 * m, 1, 1), 3.0) for m in range(1, 8)] + [("nulls", date(2024, 1, 1), None), (None, None, 4.0)]
    df = spark.createDataFrame(rows, "series string, month date, value_ double")
    df.createOrReplaceTempView("monthly_series")
    return df


def test_one_statement_forecasts_every_series(spark, monthly):
    got = spark.sql("SELECT * FROM forecast_series(TABLE(monthly_series) PARTITION BY series ORDER BY month, period => 'month', value => 'value_', horizon => 4)").collect()
    by = {}
    for r in got:
        by.setdefault(r["series"], []).append(r)
    assert {k: v[0]["refused"] for k, v in by.items()} == {"line": None, "season": None, "flat": None, "short": "not_enough_data", "holes": "gaps_in_series", "nulls": "not_enough_data", None: "not_enough_data"}
    for key in ("line", "season", "flat"):
        points = ts.collect_series(ts.time_series(monthly.where(F.col("series") == key), "month", "value_"), "month").points
        want = ts.forecast(points, "month", 4)
        assert by[key][0]["model"] == want["model"]
        for r, p in zip(by[key], want["points"], strict=True):
            assert (r["period"], r["value"], r["low"], r["high"], r["mae"]) == (p["period"], pytest.approx(p["value"]), pytest.approx(p["low"]), pytest.approx(p["high"]), pytest.approx(want["mae"]))
    assert [by["line"][0]["model"], by["season"][0]["model"]] == ["linear", "seasonal_linear"]


def test_models_can_be_narrowed_and_wrong_calls_say_so(spark, monthly):
    call = "SELECT * FROM forecast_series(TABLE(SELECT series, month, value_ FROM monthly_series WHERE series = 'line') PARTITION BY series ORDER BY month, period => 'month', value => 'value_', {})"
    assert {r["model"] for r in spark.sql(call.format("models => 'level'")).collect()} == {"level"}
    for wrong, said in (("models => 'oracle'", "no model"), ("grain => 'fortnight'", "One of"), ("horizon => 99", None)):
        if said is None:
            assert [r["refused"] for r in spark.sql(call.format(wrong)).collect()] == ["invalid_horizon"]
        else:
            with pytest.raises(Exception, match=said):
                spark.sql(call.format(wrong)).collect()
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM forecast_series(TABLE(monthly_series) PARTITION BY series ORDER BY month, period => 'day', value => 'value_')")
    with pytest.raises(AnalysisError):
        ts.forecast([ts.Point(i, 1, 1.0) for i in range(12)], "month", models=())


def test_period_keys_are_periods_too():
    assert forecast_table.ordinal_in("2024-05", "month") == forecast_table.ordinal_in(date(2024, 5, 31), "month")
    assert forecast_table.ordinal_in("soon", "month") is None and forecast_table.ordinal_in(None, "month") is None


# --- the gate -------------------------------------------------------------------


def conversations(spark, first, last):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", None if (c, t) == (3, 1) else f"text {'x' * (c * 7 + t)} goes on. And on!\nNever three times, though {c} of us") for c in range(first, last) for t in range(4)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def run_gate(spark, folder, pieces_of):
    turns = spark.readStream.schema("conv_id long, turn long, role string, text string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = gs.gated(pieces_of(turns), "conv_id")
    with gs.state_store(spark):
        query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


def test_a_restarted_stream_equals_the_batch_gate(spark, tmp_path):
    """Turns of the same conversations come in two runs of the query; a sentence begun in the first ends in the second."""

    def pieces(turns):
        found = conversation_pieces(turns).where("kind <> 'end' or conv_id % 2 = 0")  # odd ones hold their last sentence
        return found.withColumn("text", F.when(F.col("kind") == "text", F.regexp_replace("text", "\n", " ")).otherwise(F.col("text")))

    folder = str(tmp_path)
    every = conversations(spark, 0, 6)
    every.where("turn < 2").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    first = run_gate(spark, folder, pieces).count()
    every.where("turn >= 2").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    got = run_gate(spark, folder, pieces)
    assert 0 < first < got.count()
    want = gs.gated_at_once(pieces(every), "conv_id")
    held = want.groupBy("conv_id").agg(F.max("n").alias("n")).where("conv_id % 2 = 1")  # the batch gate flushes what the stream still holds
    want = want.join(held, ["conv_id", "n"], "left_anti").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["kept"] for r in got.where("sentence rlike '[0-9]'").collect()} == {True, False}


@pytest.mark.parametrize("parts", [1, 3])
def test_the_gate_reads_a_table_of_one_file_or_of_several(spark, tmp_path, parts):
    """A folder's part files have other names than the table; all of them are read, in one go."""
    turns = spark.createDataFrame([(c, t, "user", f"text {'x' * (c + 1)}") for c in range(5) for t in range(13)], "conv_id long, turn long, role string, text string")
    turns.repartition(parts).write.parquet(str(tmp_path / "conversations.parquet"))
    if parts == 1:
        (only,) = (tmp_path / "conversations.parquet").glob("part-*")
        os.rename(only, tmp_path / "only")
        shutil.rmtree(tmp_path / "conversations.parquet")
        os.rename(tmp_path / "only", tmp_path / "conversations.parquet")
    found = sorted(map(tuple, QUERIES["gate_stream"](spark, str(tmp_path)).collect()))
    expected = [(c, 2 * t + 2, f"The user wrote {6 + c + 7 * (t % 2)} characters.", t % 2 == 0) for c in range(5) for t in range(13)]
    assert found == sorted(expected)


def test_a_quiet_conversation_is_let_out_and_forgotten(spark, tmp_path):
    folder = str(tmp_path)
    os.makedirs(f"{folder}/in")
    schema = "conv long, seq long, kind string, text string, value double, unit string, at timestamp"

    def send(i, *rows):
        spark.createDataFrame([(*r[:6], r[6]) for r in rows], "conv long, seq long, kind string, text string, value double, unit string, s long").select("*", F.timestamp_seconds("s").alias("at")).drop("s").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        found = gs.gated(spark.readStream.schema(schema).parquet(f"{folder}/in"), "conv", "at", idle_ms=60_000)
        with gs.state_store(spark):
            found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{folder}/out").collect()))

    send(0, (1, 1, "fact", "sales", 40.0, "number", 100), (1, 2, "text", "Sales were 4", None, None, 101), (1, 3, "text", "0 then. Half a sen", None, None, 102), (2, 1, "text", "Hello", None, None, 103))
    assert run() == [(1, 1, "Sales were 40 then.", True)]
    send(1, (2, 2, "text", " there. It", None, None, 110))
    assert run() == [(1, 1, "Sales were 40 then.", True), (2, 1, "Hello there.", True)]
    send(2, (3, 1, "text", "x", None, None, 10_000))  # time goes on: the others are quiet
    assert run() == [(1, 1, "Sales were 40 then.", True), (1, 2, "Half a sen", True), (2, 1, "Hello there.", True), (2, 2, "It", True)]
    send(3, (1, 9, "text", "It was 40 again. Yes", None, None, 10_001))  # its facts are forgotten
    assert (1, 1, "It was 40 again.", False) in run()


@pytest.mark.parametrize("column,descending", [("v", False), ("v", True), ("s", False), ("s", True), ("d", True), ("n", True), (None, False)])
def test_a_deep_page_is_the_page_of_the_whole_order(spark, column, descending):
    from ledgerwright.operators.paging import seek_page, sort_columns

    s = F.when(F.col("id") % 3 == 0, F.lit("a rather long label")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("A rather long la"), F.repeat(F.lit("\0"), (F.col("id") % 3).cast("int")), F.pmod(F.xxhash64("id"), F.lit(40)).cast("string")))
    v = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 0, F.lit(2.5)).otherwise(F.hash("id") / 7.0)
    df = spark.range(3000).select(F.col("id").alias("key"), s.alias("s"), v.alias("v"), F.expr("date_add(DATE '2024-01-01', cast(id % 400 as int))").alias("d"), F.when(F.col("id") % 9 > 0, F.xxhash64("id")).alias("n"))
    whole = [r["key"] for r in df.orderBy(*sort_columns(df, column, descending, ["key"])).collect()]
    for offset, limit in ((990, 200), (2010, 30), (2990, 100), (3000, 10)):
        page = [r["key"] for r in seek_page(df, column, descending, ["key"], offset, limit, most=50).collect()]
        assert page == whole[offset : offset + limit], (offset, limit)


def test_copies_of_a_row_are_numbered_in_ranges(spark):
    from ledgerwright.operators import explorer

    order = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise((F.hash("id") % 300).cast("double"))
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 5 > 0, F.concat(F.lit("t"), (F.col("id") / 3).cast("int"))).alias("text"), order.alias("at"), "id")
    expected = df.select("*", F.row_number().over(Window.partitionBy("text").orderBy("at", "id")).alias("seq")).where("seq > 1")
    got = explorer.duplicate_rows(df, ["at", "id"])
    assert sorted((r["id"], r["seq"]) for r in got.collect()) == sorted((r["id"], r["seq"]) for r in expected.collect())
    plain = df.select("text")
    n = plain.groupBy("text").count().where("count > 1").agg(F.sum(F.col("count") - 1)).first()[0]
    copies = explorer.duplicate_rows(plain)
    assert copies.count() == n == explorer.count_duplicates(plain).first()["duplicates"] and copies.where("text = 'hot'").agg(F.max("seq")).first()[0] == 1000
    assert explorer.count_duplicates(plain.limit(0)).first()["duplicates"] == 0 and explorer.duplicate_rows(df.limit(0), ["id"]).count() == 0

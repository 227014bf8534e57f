"""Tools as queries: what a tool answers over the fact view, with the SQL that gives the same figures."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as val
from ..functions.sql import register
from ..operators import grouping as grp
from ..operators.filters import Filter, apply_filters
from ..session import shared_folder
from ..sources.readers import ingest
from ..sources.sinks import write_csv, write_json, write_parquet
from .catalog import QUERIES, SQL, _SALES_SQL, add, r, rounded, sales, table
from .clean import ROW_ID, clean, label_clashes, normalize_labels
from .context import Context
from .insights import kpis
from .profile import Profile, profile
from .tools import registry

#: By session and folder: where the fact view was written, and its profile.
_facts: dict[tuple[str, str], tuple[str, Profile]] = {}


def _context(spark: SparkSession, sf_dir: str) -> Context:
    """The fact view under analysis, with its profile.

    A profile and a tool read the view ten to forty times, so its joins run once for a
    session and folder: it is written to the shared folder and read from there, and
    written again where whoever owns that folder has removed it.
    """
    view, key = sales(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key in _facts:
        path, known = _facts[key]
        try:
            return Context(spark.read.schema(view.schema).parquet(path), known)
        except AnalysisException:
            del _facts[key]
    path = shared_folder(spark, "facts")
    view.write.option("compression", "zstd").parquet(path)
    df = spark.read.schema(view.schema).parquet(path)
    _facts[key] = (path, profile(df))
    return Context(df, _facts[key][1])


def _register(name: str, schema: str, rows: Callable[[Context], list[tuple]], sql: str, places: int = 2) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(spark.createDataFrame(rows(_context(spark, sf_dir)), schema), places)

    QUERIES[name] = run
    sql = sql.strip()
    SQL[name] = f"WITH {_SALES_SQL}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {_SALES_SQL} {sql}"


def _tool(name: str, schema: str, rows: Callable[[dict], list], sql: str, places: int = 2, query: str | None = None, **params: object) -> None:
    """A query tool_<name>; rows(data) gives dictionaries or tuples in the schema's order."""
    columns = [x.split()[0] for x in schema.split(", ")]
    kinds = [x.split()[1] for x in schema.split(", ")]

    def found(ctx: Context) -> list[tuple]:
        answer = registry.call(ctx, name, **params)
        if not answer.ok:
            raise ValueError(f"{name}: {answer.code}: {answer.message}")
        cast = {"double": lambda v: None if v is None else float(v), "long": lambda v: None if v is None else int(v)}
        picked = [tuple(x[c] for c in columns) if isinstance(x, dict) else x for x in rows(answer.data)]
        return [tuple(cast.get(k, lambda v: v)(v) for k, v in zip(kinds, x, strict=True)) for x in picked]

    _register(query or f"tool_{name}", schema, found, sql, places)


def _one(data: dict) -> list[dict]:
    return [data]


_tool("describe_dataset", "rows long, columns long", lambda d: [(d["rows"], len(d["columns"]))], "SELECT count(*) AS rows, CAST(14 AS BIGINT) AS columns FROM sales")
_tool(
    "describe_column", "count long, missing_pct double, low double, high double, total double, negatives long", lambda d: [(d["count"], d["missing_pct"], *(d["stats"][k] for k in ("min", "max", "sum", "negatives")))],
    f"SELECT count(profit) AS count, {r('100.0 * (count(*) - count(profit)) / count(*)', 'missing_pct', 2)}, {r('min(profit)', 'low', 2)}, {r('max(profit)', 'high', 2)}, {r('sum(profit)', 'total', 2)}, count(*) FILTER (profit < 0) AS negatives FROM sales", column="profit",
)
_tool(
    "list_values", "value string, n long, pct double", lambda d: d["values"],
    f"SELECT brand AS value, count(*) AS n, {r('100.0 * count(*) / (SELECT count(*) FROM sales)', 'pct', 2)} FROM sales GROUP BY 1 ORDER BY n DESC, value LIMIT 10", column="brand", limit=10,
)
_tool(
    "aggregate", "value double", _one, f"SELECT {r('avg(sales)', 'value', 2)} FROM sales WHERE lower(region) = 'asia' AND year(order_date) BETWEEN 1996 AND 1998", metric="sales", agg="avg", date_from="1996", date_to="1998",
    filters=[{"column": "region", "op": "eq", "value": "Asia"}],
)
_tool("aggregate", "value double", _one, f"SELECT {r('quantile_cont(profit, 0.9)', 'value', 2)} FROM sales", query="tool_aggregate_percentile", metric="profit", agg="percentile", percentile=90)
_tool(
    "group_by", "rank long, key string, value double, n_rows long", lambda d: d["groups"],
    f"WITH g AS (SELECT brand AS key, avg(sales) AS v, count(*) AS n_rows FROM sales GROUP BY 1) SELECT row_number() OVER (ORDER BY v, key) AS rank, key, {r('v', 'value', 2)}, n_rows FROM g ORDER BY v, key LIMIT 10",
    dimension="brand", metric="sales", agg="avg", order="asc", limit=10,
)
_tool(
    "top_n", "rank long, key string, value double, share double", lambda d: d["groups"],
    f"WITH g AS (SELECT nation AS key, sum(sales) AS v FROM sales GROUP BY 1) SELECT row_number() OVER (ORDER BY v DESC, key) AS rank, key, {r('v', 'value', 2)}, {r('v / (SELECT sum(v) FROM g) * 100', 'share', 2)} FROM g ORDER BY v DESC, key LIMIT 7",
    dimension="nation", metric="sales", n=7,
)
_tool(
    "share_of_total", "key string, value double, share double, rank long", _one,
    f"WITH g AS (SELECT region AS key, sum(sales) AS v FROM sales GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY v DESC, key) AS rank, sum(v) OVER () AS t FROM g) SELECT key, {r('v', 'value', 2)}, {r('v / t * 100', 'share', 2)}, rank FROM k WHERE lower(key) = 'asia'",
    dimension="region", value="asia", metric="sales",
)
_tool(
    "compare_groups", "value_a double, value_b double, difference double, ratio double, pct double", _one,
    f"WITH g AS (SELECT sum(sales) FILTER (region = 'ASIA') AS a, sum(sales) FILTER (region = 'EUROPE') AS b FROM sales) SELECT {r('a', 'value_a', 2)}, {r('b', 'value_b', 2)}, {r('a - b', 'difference', 2)}, {r('a / b', 'ratio', 2)}, {r('(a - b) / abs(b) * 100', 'pct', 2)} FROM g",
    dimension="region", group_a="asia", group_b="Europe", metric="sales",
)
_tool(
    "cross_tab", "row_key string, column_key string, value double, n long", lambda d: d["cells"],
    f"SELECT region AS row_key, segment AS column_key, {r('sum(sales)', 'value', 2)}, count(*) AS n FROM sales GROUP BY 1, 2", row_dimension="region", column_dimension="segment", metric="sales",
)
_tool(
    "pareto", "groups long, total double, reach_50 long, reach_80 long", _one,
    f"""WITH g AS (SELECT nation AS key, sum(sales) AS v FROM sales GROUP BY 1), k AS (SELECT v, row_number() OVER (ORDER BY v DESC, key) AS i, sum(v) OVER (ORDER BY v DESC, key ROWS UNBOUNDED PRECEDING) AS c, sum(v) OVER () AS t FROM g)
    SELECT count(*) AS groups, {r('max(t)', 'total', 2)}, min(i) FILTER (c >= t * 0.5 - 1e-9) AS reach_50, min(i) FILTER (c >= t * 0.8 - 1e-9) AS reach_80 FROM k""", dimension="nation", metric="sales",
)
_tool(
    "distribution", "bin long, low double, high double, n long", lambda d: d["histogram"],
    f"""WITH s AS (SELECT quantile_cont(sales, 0.05) AS lo, (quantile_cont(sales, 0.95) - quantile_cont(sales, 0.05)) / 20 AS w FROM sales),
    c AS (SELECT CAST(greatest(0, least(19, floor((sales - lo) / w))) AS BIGINT) AS bin, count(*) AS n FROM sales, s GROUP BY 1)
    SELECT b.bin, {r('lo + b.bin * w', 'low', 2)}, {r('lo + (b.bin + 1) * w', 'high', 2)}, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(20)) AS BIGINT) AS bin) b CROSS JOIN s LEFT JOIN c ON c.bin = b.bin""", column="sales", bins=20,
)
#: Months without partial ones at the ends, as the series tools see them: a month at an end counts if the data cover four fifths of its days and it has three tenths of the usual rows.
_MONTHS = """m AS (SELECT date_trunc('month', order_date) AS s, sum(sales) AS v, count(*) AS n FROM sales GROUP BY 1),
e AS (SELECT min(order_date) AS lo, max(order_date) AS hi, (SELECT list_sort(list(n))[CAST(count(*) // 2 + 1 AS BIGINT)] FROM m) AS usual FROM sales),
w AS (SELECT CAST(s AS DATE) AS s, v, n FROM m, e WHERE NOT ((s = date_trunc('month', lo) AND (n < 0.3 * usual OR (last_day(s) - lo + 1) < 0.8 * day(last_day(s)))) OR (s = date_trunc('month', hi) AND (n < 0.3 * usual OR day(hi) < 0.8 * day(last_day(s))))))"""
_tool(
    "time_series", "period string, value double, n long, pct_change double", lambda d: d["points"],
    f"""WITH {_MONTHS}, p AS (SELECT s, v, n, lag(v) OVER (ORDER BY s) AS b, (SELECT quantile_cont(abs(v), 0.5) FROM w) AS usual FROM w)
    SELECT strftime(s, '%Y-%m') AS period, {r('v', 'value', 2)}, n, {r('CASE WHEN abs(b) >= 0.1 * usual THEN (v - b) / abs(b) * 100 END', 'pct_change', 2)} FROM p ORDER BY s DESC LIMIT 24""", metric="sales", grain="month",
)
_PAIR_SQL = "sum(sales) FILTER (order_date BETWEEN DATE '1998-04-01' AND DATE '1998-06-30') AS a, sum(sales) FILTER (order_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31') AS b"
_tool(
    "compare_periods", "key string, value_a double, value_b double, change double", lambda d: [("all", d["value_a"], d["value_b"], d["change"]), *((g["key"], g["value_a"], g["value_b"], g["change"]) for g in d["groups"])],
    f"""WITH g AS (SELECT 'all' AS key, {_PAIR_SQL}, 0 AS part FROM sales UNION ALL SELECT * FROM (SELECT nation AS key, {_PAIR_SQL}, 1 AS part FROM sales GROUP BY 1 ORDER BY abs(coalesce(a, 0) - coalesce(b, 0)) DESC, key LIMIT 5))
    SELECT key, {r('coalesce(a, 0)', 'value_a', 2)}, {r('coalesce(b, 0)', 'value_b', 2)}, {r('coalesce(a, 0) - coalesce(b, 0)', 'change', 2)} FROM g""",
    metric="sales", period_a="1998-Q2", period_b="1998-Q1", breakdown_dimension="nation",
)
_tool(
    "explain_change", "dimension string, key string, value_a double, value_b double, change double", lambda d: [(x["dimension"], g["key"], g["value_a"], g["value_b"], g["change"]) for x in d["dimensions"] if x["dimension"] in ("region", "segment") for g in x["groups"]],
    "WITH g AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS key, {_PAIR_SQL} FROM sales GROUP BY 2" for d in ("region", "segment"))
    + f") SELECT dimension, key, {r('coalesce(a, 0)', 'value_a', 2)}, {r('coalesce(b, 0)', 'value_b', 2)}, {r('coalesce(a, 0) - coalesce(b, 0)', 'change', 2)} FROM g QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY abs(coalesce(a, 0) - coalesce(b, 0)) DESC, key) <= 5",
    query="tool_explain_change", metric="sales", period_a="1998-Q2", period_b="1998-Q1",
)
_BRIDGE_SQL = "sum(sales) FILTER (year(order_date) = 1998) AS ra, sum(sales) FILTER (year(order_date) = 1997) AS rb, sum(profit) FILTER (year(order_date) = 1998) AS pa, sum(profit) FILTER (year(order_date) = 1997) AS pb"
_tool(
    "volume_vs_margin", "margin_a double, margin_b double, profit_change double, volume_effect double, margin_effect double", _one,
    f"WITH g AS (SELECT {_BRIDGE_SQL} FROM sales) SELECT {r('pa / ra * 100', 'margin_a', 2)}, {r('pb / rb * 100', 'margin_b', 2)}, {r('pa - pb', 'profit_change', 2)}, {r('(ra - rb) * pb / rb', 'volume_effect', 2)}, {r('ra * (pa / ra - pb / rb)', 'margin_effect', 2)} FROM g",
    period_a="1998", period_b="1997",
)
_tool(
    "explain_change", "change double, volume_effect double, margin_effect double", lambda d: [(d["change"], d["bridge"]["volume_effect"], d["bridge"]["margin_effect"])],
    f"WITH g AS (SELECT {_BRIDGE_SQL} FROM sales) SELECT {r('pa - pb', 'change', 2)}, {r('(ra - rb) * pb / rb', 'volume_effect', 2)}, {r('ra * (pa / ra - pb / rb)', 'margin_effect', 2)} FROM g", query="tool_explain_change_bridge",
    metric="profit", period_a="1998", period_b="1997",
)
_tool(
    "profitability", "key string, revenue double, profit double, margin double, n_rows long, loss boolean", lambda d: d["groups"],
    f"SELECT region AS key, {r('sum(sales)', 'revenue', 2)}, {r('sum(profit)', 'profit', 2)}, {r('sum(profit) / sum(sales) * 100', 'margin', 2)}, count(*) AS n_rows, sum(profit) < 0 AS loss FROM sales GROUP BY 1", dimension="region",
)
_tool(
    "correlation", "r double, n long, rho double", _one,
    f"""WITH k AS (SELECT rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2 AS a, rank() OVER (ORDER BY cost) + (count(*) OVER (PARTITION BY cost) - 1) / 2 AS b FROM sales)
    SELECT (SELECT round(corr(quantity, cost), 4) FROM sales) + 0.0 AS r, count(*) AS n, {r('corr(a, b)', 'rho')} FROM k""", 4, column_a="quantity", column_b="cost",
)
_tool(
    "outliers", "outliers long, low double, high double, pct_of_values double", _one,
    f"""WITH q AS (SELECT quantile_cont(profit, 0.25) AS a, quantile_cont(profit, 0.75) AS b, count(*) AS n FROM sales), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi, n FROM q)
    SELECT count(*) FILTER (profit < lo OR profit > hi) AS outliers, {r('max(lo)', 'low', 2)}, {r('max(hi)', 'high', 2)}, {r('100.0 * count(*) FILTER (profit < lo OR profit > hi) / max(n)', 'pct_of_values', 2)} FROM sales, f""", column="profit", method="iqr",
)
_tool(
    "customer_analysis", "customers long, repeat_rate double, top_decile long, top_decile_share double", _one,
    f"""WITH g AS (SELECT customer, count(*) AS n, greatest(sum(sales), 0) AS v FROM sales GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY v DESC) AS i, count(*) OVER () AS c FROM g)
    SELECT count(*) AS customers, {r('avg(CASE WHEN n > 1 THEN 100.0 ELSE 0 END)', 'repeat_rate', 2)}, CAST(ceil(max(c) / 10.0) AS BIGINT) AS top_decile, {r('sum(v) FILTER (i <= ceil(c / 10.0)) / sum(v) * 100', 'top_decile_share', 2)} FROM k""", metric="sales",
)
_tool(
    "scenario", "base double, projected double", _one, f"SELECT {r('sum(sales)', 'base', 2)}, {r('sum(sales) * 1.1', 'projected', 2)} FROM sales", metric="sales", percent=10,
)
_tool(
    "trend", "n long, slope double, tau double", _one,
    f"""WITH {_MONTHS}, x AS (SELECT v, row_number() OVER (ORDER BY s) - 1 AS i FROM w), t AS (SELECT sum(sign(b.v - a.v)) / count(*) AS tau FROM x a JOIN x b ON a.i < b.i)
    SELECT count(*) AS n, {r('regr_slope(v, i)', 'slope', 2)}, {r('max(tau)', 'tau', 2)} FROM x, t""", metric="sales", grain="month",
)
_tool(
    "data_quality", "missing_pct double, duplicate_pct double", _one,
    f"WITH d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM sales)) SELECT {r('0.0', 'missing_pct', 2)}, {r('100.0 * ((SELECT count(*) FROM sales) - n) / (SELECT count(*) FROM sales)', 'duplicate_pct', 2)} FROM d",
)
_register(
    "kpi_values", "label string, value double", lambda ctx: [(k["label"], float(k["value"])) for k in kpis(ctx) if k["label"] in ("Rows", "sales", "profit", "cost", "quantity", "Margin", "Customers")],
    " UNION ALL ".join(f"SELECT '{label}' AS label, {r(e, 'value', 2)} FROM sales" for label, e in (("Rows", "count(*)"), ("sales", "sum(sales)"), ("profit", "sum(profit)"), ("quantity", "sum(quantity)"), ("cost", "sum(cost)"), ("Margin", "sum(profit) / sum(sales) * 100"), ("Customers", "count(DISTINCT customer)"))),
)
_MEASURES = ("quantity", "discount", "sales", "cost", "profit")
_register(
    "profile_figures", "name string, n long, low double, high double, total double", lambda ctx: [(c.name, c.count, *(float(c.stats[k]) for k in ("min", "max", "sum"))) for c in ctx.profile.columns.values() if c.name in _MEASURES],
    " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, {r(f'min({c})', 'low', 2)}, {r(f'max({c})', 'high', 2)}, {r(f'sum({c})', 'total', 2)} FROM sales" for c in _MEASURES),
)


def _relations_sql() -> str:
    """All identities of all triples, counted in one pass; of each triple the first that holds."""
    forms = [(form, a, b, c) for t in combinations(_MEASURES, 3) for form in ("-", "*", "+") for a, b, c in permutations(t) if form == "-" or _MEASURES.index(b) < _MEASURES.index(c)]
    counts = ", ".join(f"count(*) FILTER (abs({a} - ({b} {form} {c})) <= greatest(abs({a}) * 0.01, 0.011)) AS h{i}" for i, (form, a, b, c) in enumerate(forms))
    rows = " UNION ALL ".join(f"SELECT {i} AS i, '{''.join(sorted((a, b, c)))}' AS triple, '{a}' AS target, '{b}' AS lhs, '{c}' AS rhs, '{form}' AS form, h{i} / n AS share FROM k" for i, (form, a, b, c) in enumerate(forms))
    return f"WITH k AS (SELECT count(*) AS n, {counts} FROM sales), x AS ({rows}) SELECT target, lhs, rhs, form, {r('share', 'share')} FROM x WHERE share >= 0.9 QUALIFY row_number() OVER (PARTITION BY triple ORDER BY i) = 1"


def _relations(ctx: Context) -> list[tuple]:
    from ..operators.relations import relations

    return [(x["target"], x["left"], x["right"], x["form"], float(x["share"])) for x in relations(ctx.df, _MEASURES)]


_register("relations_found", "target string, lhs string, rhs string, form string, share double", _relations, _relations_sql(), 4)


# --- parsers over whole columns, written as text in several ways ---------------


def _written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as $1,234.50, (1,234.50), 12 %, plain and with spaces, read back."""
    p, way = F.col("l_extendedprice"), F.pmod("l_orderkey", F.lit(5))
    grouped = F.format_number(p, 2)
    text = F.when(way == 0, F.concat(F.lit("$"), grouped)).when(way == 1, F.concat(F.lit("("), grouped, F.lit(")"))).when(way == 2, F.concat(p.cast("decimal(18,2)").cast("string"), F.lit("%"))).when(way == 3, F.translate(grouped, ",", " ")).otherwise(F.concat(grouped, F.lit("-")))
    return table(spark, sf_dir, "lineitem").select(way.alias("way"), val.parse_number(text).alias("v")).groupBy("way").agg(F.count("v").alias("n"), F.round(F.sum("v"), 2).alias("total"))


add(
    "parse_number_column", _written_numbers,
    f"SELECT l_orderkey % 5 AS way, count(*) AS n, {r('sum(round(l_extendedprice, 2) * CASE l_orderkey % 5 WHEN 1 THEN -1 WHEN 2 THEN 0.01 WHEN 4 THEN -1 ELSE 1 END)', 'total', 2)} FROM lineitem GROUP BY 1", None,
)


def _written_numbers_eu(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return table(spark, sf_dir, "orders").agg(F.count(val.parse_number(text, "eu")).alias("n"), F.round(F.sum(val.parse_number(text, "eu")), 2).alias("total"), F.sum(val.locale_votes(text)[0]).alias("eu"), F.sum(val.locale_votes(text)[1]).alias("us"))


add("parse_number_eu_column", _written_numbers_eu, f"SELECT count(*) AS n, {r('sum(round(o_totalprice, 2))', 'total', 2)}, count(*) AS eu, CAST(0 AS BIGINT) AS us FROM orders", None)


def _written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, way = F.col("o_orderdate").cast("date"), F.pmod("o_orderkey", F.lit(6))
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyy/M/d", "dd.MM.yy")
    text = F.coalesce(*[F.when(way == i, F.date_format(d, f)) for i, f in enumerate(forms)])
    found = table(spark, sf_dir, "orders").select(way.alias("way"), d.alias("d"), val.parse_date(text, "dmy").alias("v"))
    return found.groupBy("way").agg(F.count_if(F.col("d") == F.col("v")).alias("right"), F.min("v").alias("low"), F.max("v").alias("high"))


add(
    "parse_date_column", _written_dates,
    "SELECT o_orderkey % 6 AS way, count(*) AS \"right\", strftime(min(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS low, strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS high FROM orders GROUP BY 1", None,
)


# --- blanks, which the test tables do not have, made from them ------------------

_HOLES_SQL = "h AS (SELECT CASE WHEN region = 'ASIA' THEN NULL ELSE region END AS region, CASE WHEN region = 'AFRICA' OR quantity < 5 THEN NULL ELSE sales END AS sales, quantity > 25 AS large FROM sales)"


def _holes(df: DataFrame) -> DataFrame:
    region, amount = F.col("region"), F.col("sales")
    return df.select(F.when(region != "ASIA", region).alias("region"), F.when((region != "AFRICA") & (F.col("quantity") >= 5), amount).alias("sales"), (F.col("quantity") > 25).alias("large"))


add(
    "grp_blanks_sum", lambda df: rounded(grp.group_by(_holes(df), "region", "sales").select("key", "value", "n", "n_rows"), 2),
    f"WITH {_HOLES_SQL} SELECT coalesce(region, '(blank)') AS key, {r('coalesce(sum(sales), 0)', 'value', 2)}, count(sales) AS n, count(*) AS n_rows FROM h GROUP BY 1",
)
add(
    "grp_blanks_avg", lambda df: rounded(grp.group_by(_holes(df), "region", "sales", "avg", blanks=False).select("key", "value", "n", "n_rows"), 2),
    f"WITH {_HOLES_SQL} SELECT region AS key, {r('avg(sales)', 'value', 2)}, count(sales) AS n, count(*) AS n_rows FROM h WHERE region IS NOT NULL GROUP BY 1 HAVING count(sales) > 0",
)
add(
    "flt_blanks", lambda df: apply_filters(_holes(df), [Filter("region", "neq", "Europe"), Filter("large", "eq", "yes")]).agg(F.count(F.lit(1)).alias("n"), F.count("sales").alias("with_sales")),
    f"WITH {_HOLES_SQL} SELECT count(*) AS n, count(sales) AS with_sales FROM h WHERE region <> 'EUROPE' AND large",
)
add(
    "flt_bool", lambda df: apply_filters(_holes(df), [Filter("large", "neq", "true"), Filter("sales", "is_null")]).agg(F.count(F.lit(1)).alias("n")),
    f"WITH {_HOLES_SQL} SELECT count(*) AS n FROM h WHERE NOT large AND sales IS NULL",
)
add(
    "ranked_all", lambda df: grp.ranked(df, "nation", "sales", n=25).select("rank", "key", "n_rows"),
    "SELECT row_number() OVER (ORDER BY sum(sales) DESC, nation) AS rank, nation AS key, count(*) AS n_rows FROM sales GROUP BY 2 ORDER BY 1 LIMIT 25",
)


# --- labels, cleaning and files --------------------------------------------------

_SPELT_SQL = "(SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_brand) ELSE '  ' || p_brand END AS v FROM part)"


def _spelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, way = F.col("p_brand"), F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select(F.when(way == 0, F.upper(brand)).when(way == 1, F.lower(brand)).otherwise(F.concat(F.lit("  "), brand)).alias("v"), F.col("p_partkey").cast("long").alias(ROW_ID))


add(
    "label_clashes", lambda spark, sf_dir: spark.createDataFrame([(x["column"], x["labels"]) for x in label_clashes(_spelt(spark, sf_dir), ["v"])], "name string, labels long"),
    f"SELECT 'v' AS name, count(*) AS labels FROM (SELECT lower(trim(v)) AS label FROM {_SPELT_SQL} GROUP BY 1 HAVING count(DISTINCT v) > 1)", None,
)
add(
    "labels_normalized", lambda spark, sf_dir: normalize_labels(_spelt(spark, sf_dir), "v").groupBy(F.lower(F.trim("v")).alias("label")).agg(F.count_distinct("v").alias("spellings"), F.count("*").alias("n")),
    f"SELECT lower(trim(v)) AS label, CAST(1 AS BIGINT) AS spellings, count(*) AS n FROM {_SPELT_SQL} GROUP BY 1", None,
)


def _as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a spreadsheet would show them: text throughout, N/A for blanks."""
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).otherwise("N/A")
    return o.select(F.col("o_orderkey").cast("string").alias("Order"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Day"), price.alias("Total"), F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no").alias("Even"), F.col("o_orderpriority").alias("Priority"))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean(_as_text(spark, sf_dir))
    kinds = ",".join(f"{c}:{m.kind}" for c, m in found.meta.items())
    money = found.meta["Total"].currency
    return found.df.agg(
        F.lit(kinds).alias("kinds"), F.lit(money).alias("currency"), F.count(F.lit(1)).alias("n"), F.count("Total").alias("priced"), F.round(F.sum("Total"), 2).alias("total"), F.min("Day").alias("low"), F.max("Day").alias("high"), F.count_if("Even").alias("even")
    )


add(
    "clean_table", _cleaned,
    f"""SELECT 'Order:number,Day:date,Total:number,Even:boolean,Priority:string' AS kinds, 'USD' AS currency, count(*) AS n, count(*) FILTER (o_orderkey % 10 <> 0) AS priced, {r('sum(round(o_totalprice, 2)) FILTER (o_orderkey % 10 <> 0)', 'total', 2)},
    strftime(min(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS low, strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS high, count(*) FILTER (o_orderkey % 2 = 0) AS even FROM orders""", None,
)


def _round_trip(kind: str, write: Callable[[DataFrame, str], None]) -> None:
    """Customers written to files of one kind, found out, read and typed again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark, 'export')}/customer.{kind}"
        write(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
        found = clean(ingest(spark, path).tables[0].df).df
        return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("segments"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.max("c_custkey").cast("long").alias("last"))

    add(f"file_{kind}", run, f"SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS segments, {r('sum(c_acctbal)', 'total', 2)}, CAST(max(c_custkey) AS BIGINT) AS last FROM customer", None)


_round_trip("csv", write_csv)
_round_trip("ndjson", write_json)
_round_trip("parquet", write_parquet)


def _by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("ledgerwright_orders")
    return spark.sql("SELECT period_key(CAST(o_orderdate AS DATE), 'quarter') AS period, count(*) AS n, round(sum(parse_number(format_number(o_totalprice, 2), 'us')), 2) AS total FROM ledgerwright_orders GROUP BY 1")


add("sql_functions", _by_sql, f"SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period, count(*) AS n, {r('sum(round(o_totalprice, 2))', 'total', 2)} FROM orders GROUP BY 1", None)

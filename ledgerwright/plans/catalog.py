"""The engine's operators as queries over the star tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import forecast_table
from ..functions import values as val
from ..operators import aggregate as agg
from ..operators import entities as ent
from ..operators import explorer as exp
from ..operators import grouping as grp
from ..operators import relations as rel
from ..operators import timeseries as ts
from ..operators.filters import Filter, apply_filters, closest_values
from ..operators.labels import Labels
from ..session import shared_folder
from ..sources.workbook import read_workbook, write_workbook
from ..streaming.calendar_stream import calendar_series
from ..streaming.gate_stream import END, FACT, TEXT, gated, state_store
from .context import Context
from .grounding import Ledger, count_claims, sanitize
from .insights import generate, kpis, materialize, plan_dashboard
from .planner import plan
from .profile import profile
from .quality import quality
from .tools import registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_SALES_SQL = """sales AS (SELECT l.l_orderkey AS order_key, CAST(o.o_orderdate AS DATE) AS order_date, r.r_name AS region, n.n_name AS nation, c.c_mktsegment AS segment, o.o_custkey AS customer,
  p.p_brand AS brand, p.p_type AS ptype, o.o_orderpriority AS priority, l.l_quantity AS quantity, l.l_discount AS discount, l.l_extendedprice * (1 - l.l_discount) AS sales,
  1.45 * l.l_quantity * p.p_retailprice AS cost, l.l_extendedprice * (1 - l.l_discount) - 1.45 * l.l_quantity * p.p_retailprice AS profit
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact view over the star: one row per line item.

    Orders meet their customers and lines their parts before the two large sides meet,
    and names of nations and regions come last, so that narrow rows are shuffled.
    """
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part")}
    lines = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    bought = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    revenue, cost = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.lit(1.45) * F.col("l_quantity") * F.col("p_retailprice")
    return joined.select(
        F.col("l_orderkey").alias("order_key"), F.col("o_orderdate").cast("date").alias("order_date"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("segment"), F.col("o_custkey").alias("customer"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"), F.col("o_orderpriority").alias("priority"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), revenue.alias("sales"), cost.alias("cost"), (revenue - cost).alias("profit"),
    )


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded (sums depend on their order), dates as text: results that any engine can be held to."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c, places) + F.lit(0.0)).alias(name) if kind == "double" else F.date_format(c, "yyyy-MM-dd").alias(name) if kind == "date" else c)
    return df.select(*out)


def add(name: str, query: Callable[[DataFrame], DataFrame] | Query, sql: str | None = None, source: str | None = "sales") -> None:
    """Register a query over the fact view, one table, or (source None) the session and folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if source is None:
            return rounded(query(spark, sf_dir))
        return rounded(query(sales(spark, sf_dir) if source == "sales" else table(spark, sf_dir, source)))

    QUERIES[name] = run
    if sql:
        sql = sql.strip()
        if source == "sales":
            sql = f"WITH {_SALES_SQL}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {_SALES_SQL} {sql}"
        SQL[name] = sql


def r(expression: str, name: str, places: int = 4) -> str:
    return f"round({expression}, {places}) + 0.0 AS {name}"


# --- filters -----------------------------------------------------------------

_COUNT = "SELECT count(*) AS n, " + r("sum({v})", "total", 2) + " FROM {t} WHERE {w}"


def _filter(name: str, source: str, value: str, where: str, *filters: Filter) -> None:
    add(name, lambda df: apply_filters(df, filters).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")), _COUNT.format(v=value, t=source, w=where), source)


_filter("flt_str_eq", "lineitem", "l_quantity", "lower(l_returnflag) = 'r'", Filter("l_returnflag", "eq", "R"))
_filter("flt_str_neq", "customer", "c_acctbal", "lower(c_mktsegment) <> 'building'", Filter("c_mktsegment", "neq", "Building"))
_filter("flt_str_in", "customer", "c_acctbal", "lower(c_mktsegment) IN ('building', 'machinery')", Filter("c_mktsegment", "in", values=("building", "MACHINERY")))
_filter("flt_str_not_in", "customer", "c_acctbal", "lower(c_mktsegment) NOT IN ('building', 'machinery')", Filter("c_mktsegment", "not_in", values=("building", "machinery")))
_filter("flt_str_contains", "part", "p_retailprice", "contains(lower(p_type), 'e') OR contains(lower(p_type), 'st')", Filter("p_type", "contains", values=("E", "st")))
_filter("flt_num_eq", "lineitem", "l_extendedprice", "l_quantity = 10", Filter("l_quantity", "eq", "10"))
_filter("flt_num_neq", "lineitem", "l_extendedprice", "l_quantity <> 10", Filter("l_quantity", "neq", 10))
_filter("flt_num_gt", "orders", "o_totalprice", "o_totalprice > 200000", Filter("o_totalprice", "gt", "$200,000"))
_filter("flt_num_gte", "lineitem", "l_extendedprice", "l_quantity >= 40", Filter("l_quantity", "gte", 40))
_filter("flt_num_lt", "lineitem", "l_extendedprice", "l_discount < 0.05", Filter("l_discount", "lt", "5%"))
_filter("flt_num_lte", "customer", "c_acctbal", "c_acctbal <= 0", Filter("c_acctbal", "lte", 0))
_filter("flt_num_between", "lineitem", "l_extendedprice", "l_quantity BETWEEN 10 AND 20", Filter("l_quantity", "between", values=(20, 10)))
_filter("flt_num_in", "part", "p_retailprice", "p_size IN (1, 5, 50)", Filter("p_size", "in", values=(1, 5, 50)))
_filter("flt_num_not_in", "part", "p_retailprice", "p_size NOT IN (1, 5, 50)", Filter("p_size", "not_in", values=(1, 5, 50)))
_filter("flt_date_eq_month", "orders", "o_totalprice", "CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'", Filter("o_orderdate", "eq", "1997-03"))
_filter("flt_date_quarter", "orders", "o_totalprice", "CAST(o_orderdate AS DATE) BETWEEN DATE '1997-04-01' AND DATE '1997-06-30'", Filter("o_orderdate", "in", "1997-Q2"))
_filter("flt_date_between", "orders", "o_totalprice", "CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1997-12-31'", Filter("o_orderdate", "between", values=("1997", "1996-02")))
_filter("flt_date_gt_year", "orders", "o_totalprice", "CAST(o_orderdate AS DATE) > DATE '1998-12-31'", Filter("o_orderdate", "gt", "1998"))
_filter("flt_date_lt_day", "orders", "o_totalprice", "CAST(o_orderdate AS DATE) < DATE '1995-07-04'", Filter("o_orderdate", "lt", "1995-07-04"))
_filter("flt_date_not_in", "orders", "o_totalprice", "CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'", Filter("o_orderdate", "not_in", "1996"))
_filter("flt_is_null", "orders", "o_totalprice", "o_orderstatus IS NULL", Filter("o_orderstatus", "is_null"))
_filter("flt_not_null", "orders", "o_totalprice", "o_orderstatus IS NOT NULL", Filter("o_orderstatus", "not_null"))
_filter(
    "flt_and", "lineitem", "l_extendedprice", "lower(l_returnflag) = 'n' AND l_quantity > 25 AND CAST(l_shipdate AS DATE) >= DATE '1997-01-01'",
    Filter("l_returnflag", "eq", "n"), Filter("l_quantity", "gt", 25), Filter("l_shipdate", "gte", "1997"),
)
add(
    "flt_closest", lambda df: closest_values(df, "n_name", "NATION_1", 8),
    """SELECT value, CAST(CASE WHEN contains(lower(value), 'nation_1') OR contains('nation_1', lower(value)) THEN 0 ELSE levenshtein(lower(value), 'nation_1') END AS BIGINT) AS score
    FROM (SELECT DISTINCT n_name AS value FROM nation) WHERE score <= 3 ORDER BY score, value LIMIT 8""", "nation",
)

# --- aggregates --------------------------------------------------------------

_STD = "CASE WHEN count({0}) < 2 THEN 0 ELSE stddev_samp({0}) END"
for _name, _agg, _expr, _column in (
    ("agg_count", "count", "count(l_quantity)", "l_quantity"), ("agg_distinct_count", "distinct_count", "count(DISTINCT l_partkey)", "l_partkey"), ("agg_sum", "sum", "sum(l_extendedprice)", "l_extendedprice"),
    ("agg_avg", "avg", "avg(l_extendedprice)", "l_extendedprice"), ("agg_min", "min", "min(l_extendedprice)", "l_extendedprice"), ("agg_max", "max", "max(l_extendedprice)", "l_extendedprice"),
    ("agg_std", "std", _STD.format("l_extendedprice"), "l_extendedprice"), ("agg_median", "median", "quantile_cont(l_extendedprice, 0.5)", "l_extendedprice"),
    ("agg_percentile", "percentile", "quantile_cont(l_extendedprice, 0.9)", "l_extendedprice"),
):
    _places = 2 if _agg == "sum" else 4
    add(
        _name, lambda df, a=_agg, c=_column, p=_places: rounded(agg.aggregate(df, a, c, 90.0), p),
        f"SELECT {_expr} AS value FROM lineitem" if "count" in _agg else f"SELECT {r(_expr, 'value', _places)} FROM lineitem", "lineitem",
    )
add("agg_count_rows", lambda df: agg.aggregate(df, "count"), "SELECT count(*) AS value FROM lineitem", "lineitem")
add(
    "agg_date_range", lambda df: df.agg(agg.aggregate_column(F.col("l_shipdate").cast("date"), "min").alias("first"), agg.aggregate_column(F.col("l_shipdate").cast("date"), "max").alias("last")),
    "SELECT strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last FROM lineitem", "lineitem",
)
add(
    "agg_numstats", lambda df: rounded(agg.numeric_stats(df, "l_extendedprice"), 2).withColumn("skew", F.lit(0) + F.col("skew")),
    f"""WITH s AS (SELECT count(*) AS n, sum(x) AS total, avg(x) AS mean, min(x) AS mn, max(x) AS mx, stddev_samp(x) AS std, var_samp(x) AS variance, count(*) FILTER (x = 0) AS zeros, count(*) FILTER (x < 0) AS negatives,
      quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.95) AS p95 FROM (SELECT l_extendedprice AS x FROM lineitem)),
    f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s),
    o AS (SELECT count(*) FILTER (l_extendedprice < lo OR l_extendedprice > hi) AS outliers, avg(power((l_extendedprice - mean) / std, 3)) AS skew FROM lineitem, f)
    SELECT n, {r('total', 'total', 2)}, {r('mean', 'mean', 2)}, {r('mn', '"min"', 2)}, {r('mx', '"max"', 2)}, {r('std', 'std', 2)}, {r('variance', 'variance', 2)}, zeros, negatives, {r('p05', 'p05', 2)}, {r('q1', 'q1', 2)},
      {r('med', 'median', 2)}, {r('q3', 'q3', 2)}, {r('p95', 'p95', 2)}, {r('iqr', 'iqr', 2)}, {r('lo', 'fence_low', 2)}, {r('hi', 'fence_high', 2)}, {r('skew', 'skew', 2)}, outliers, {r('outliers / n * 100', 'outlier_pct', 2)} FROM f, o""", "lineitem",
)
add(
    "agg_histogram", lambda df: agg.histogram(df, "l_extendedprice", 24),
    f"""WITH s AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, (quantile_cont(l_extendedprice, 0.95) - quantile_cont(l_extendedprice, 0.05)) / 24 AS w FROM lineitem),
    c AS (SELECT CAST(greatest(0, least(23, floor((l_extendedprice - lo) / w))) AS BIGINT) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
    SELECT b.bin, {r('lo + b.bin * w', 'low')}, {r('lo + (b.bin + 1) * w', 'high')}, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(24)) AS BIGINT) AS bin) b CROSS JOIN s LEFT JOIN c ON c.bin = b.bin""", "lineitem",
)
add(
    "agg_top_values", lambda df: agg.value_counts(df, "p_type", 12),
    f"SELECT p_type AS value, count(*) AS n, {r('count(*) / (SELECT count(*) FROM part) * 100', 'pct')} FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 12", "part",
)
add(
    "list_values", lambda df: agg.value_counts(df, "brand", None, "1"),
    f"SELECT brand AS value, count(*) AS n, {r('count(*) / (SELECT count(*) FROM sales) * 100', 'pct')} FROM sales WHERE contains(lower(brand), '1') GROUP BY 1",
)

# --- grouping ----------------------------------------------------------------

_GROUP = "SELECT {key} AS key, {value}, count({m}) AS n, count(*) AS n_rows, {total}, {share} FROM {t} GROUP BY 1"


def _group(name: str, kind: str, expr: str, metric: str | None = "sales", dimension: str = "brand", key: str | None = None, **options) -> None:
    additive = kind in ("sum", "count")
    total = r(f"sum({expr}) OVER ()", "total", 2) if additive else "CAST(NULL AS DOUBLE) AS total"
    share = r(f"{expr} / sum({expr}) OVER () * 100", "share") if additive else "CAST(NULL AS DOUBLE) AS share"
    sql = _GROUP.format(key=key or dimension, value=r(f"CAST({expr} AS DOUBLE)", "value", 2), m=metric or "*", total=total, share=share, t="sales")
    if options.get("min_rows"):
        sql += f" HAVING count(*) >= {options['min_rows']}"

    def run(df: DataFrame) -> DataFrame:
        out = grp.group_by(df, dimension, metric, kind, **options)
        return out.withColumn("value", F.round("value", 2)).withColumn("total", F.round("total", 2))

    add(name, run, sql)


_group("grp_sum", "sum", "sum(sales)")
_group("grp_avg", "avg", "avg(sales)")
_group("grp_count", "count", "count(*)", metric=None, dimension="segment")
_group("grp_distinct", "distinct_count", "count(DISTINCT customer)", metric="customer", dimension="nation")
_group("grp_min", "min", "min(sales)")
_group("grp_max", "max", "max(sales)")
_group("grp_median", "median", "quantile_cont(sales, 0.5)")
_group("grp_percentile", "percentile", "quantile_cont(sales, 0.9)", percentile=90.0)
_group("grp_std", "std", _STD.format("sales"))
_group("grp_share", "sum", "sum(profit)", metric="profit", dimension="region")
_group("grp_by_number", "sum", "sum(sales)", dimension="quantity", key="CAST(CAST(quantity AS BIGINT) AS VARCHAR)")
_group("grp_by_month", "sum", "sum(sales)", dimension="order_date", key="strftime(order_date, '%Y-%m')", grain="month")
_group("grp_min_rows", "avg", "avg(discount)", metric="discount", dimension="customer", key="CAST(customer AS VARCHAR)", min_rows=40)
add("grp_asc", lambda df: grp.group_by(df, "nation", "sales", order="asc", limit=5).select("key", F.round("value", 2).alias("value")), f"SELECT nation AS key, {r('sum(sales)', 'value', 2)} FROM sales GROUP BY 1 ORDER BY sum(sales), 1 LIMIT 5")
add("grp_key_order", lambda df: grp.group_by(df, "nation", "sales", order="key", limit=5).select("key", F.round("value", 2).alias("value")), f"SELECT nation AS key, {r('sum(sales)', 'value', 2)} FROM sales GROUP BY 1 ORDER BY 1 LIMIT 5")


def _ranked_sql(direction: str, n: int) -> str:
    return f"""WITH g AS (SELECT brand AS key, sum(sales) AS v, count(*) AS n_rows FROM sales GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY v {direction}, key) AS rank, greatest(v, 0) / sum(v) OVER () * 100 AS s FROM g)
    SELECT key, {r('v', 'value', 2)}, n_rows, {r('s', 'share')}, rank FROM k WHERE rank <= {n}"""


add("top_n", lambda df: grp.ranked(df, "brand", "sales", n=5).withColumn("value", F.round("value", 2)), _ranked_sql("DESC", 5))
add("bottom_n", lambda df: grp.ranked(df, "brand", "sales", n=7, ascending=True).withColumn("value", F.round("value", 2)), _ranked_sql("ASC", 7))
add(
    "share_of_total", lambda df: grp.share_of_total(df, "nation", "profit").withColumn("value", F.round("value", 2)),
    f"WITH g AS (SELECT nation AS key, sum(profit) AS v FROM sales GROUP BY 1) SELECT key, {r('v', 'value', 2)}, {r('greatest(v, 0) / sum(greatest(v, 0)) OVER () * 100', 'share')}, row_number() OVER (ORDER BY v DESC, key) AS rank FROM g",
)
add(
    "compare_groups", lambda df: rounded(grp.compare_groups(df, "segment", "building", "MACHINERY", "sales"), 2),
    f"""WITH g AS (SELECT sum(sales) FILTER (lower(segment) = 'building') AS a, sum(sales) FILTER (lower(segment) = 'machinery') AS b FROM sales)
    SELECT {r('a', 'value_a', 2)}, {r('b', 'value_b', 2)}, {r('a - b', 'difference', 2)}, {r('a / b', 'ratio', 2)}, {r('(a - b) / abs(b) * 100', 'pct', 2)} FROM g""",
)


def _xtab_sql(value: str, weight: str) -> str:
    return f"""WITH c AS (SELECT brand AS row_key, nation AS column_key, {value} AS v, count(*) AS n, {weight} AS w FROM sales GROUP BY 1, 2),
    a AS (SELECT row_key FROM c GROUP BY 1 ORDER BY sum(w) DESC, 1 LIMIT 12), b AS (SELECT column_key FROM c GROUP BY 1 ORDER BY sum(w) DESC, 1 LIMIT 12)
    SELECT row_key, column_key, {r('CAST(v AS DOUBLE)', 'value', 2)}, n FROM c WHERE row_key IN (SELECT row_key FROM a) AND column_key IN (SELECT column_key FROM b)"""


add("xtab", lambda df: rounded(grp.cross_tab(df, "brand", "nation", "sales"), 2), _xtab_sql("sum(sales)", "sum(abs(sales))"))
add("xtab_avg", lambda df: rounded(grp.cross_tab(df, "brand", "nation", "profit", "avg"), 2), _xtab_sql("avg(profit)", "sum(abs(profit))"))
add("xtab_count", lambda df: rounded(grp.cross_tab(df, "brand", "nation"), 2), _xtab_sql("count(*)", "count(*)"))
add(
    "pareto", lambda df: rounded(grp.pareto(df, "customer", "sales"), 2),
    f"""WITH g AS (SELECT CAST(customer AS VARCHAR) AS key, greatest(sum(sales), 0) AS v FROM sales GROUP BY 1),
    k AS (SELECT v, row_number() OVER w AS rank, sum(v) OVER (ORDER BY v DESC, key ROWS UNBOUNDED PRECEDING) AS reach, sum(v) OVER () AS total FROM g WINDOW w AS (ORDER BY v DESC, key))
    SELECT count(*) AS groups, {r('max(total)', 'total', 2)}, min(rank) FILTER (reach >= total * 0.5 - 1e-9) AS reach_50, min(rank) FILTER (reach >= total * 0.8 - 1e-9) AS reach_80 FROM k""",
)
add(
    "concentration", lambda df: grp.concentration(grp.group_by(df, "brand", "sales"), 3),
    f"""WITH g AS (SELECT brand, greatest(sum(sales), 0) AS v FROM sales GROUP BY 1),
    k AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS rank, sum(v) OVER () AS t, count(*) OVER () AS k, least(3, greatest(count(*) OVER () - 1, 1)) AS m FROM g),
    o AS (SELECT max(k) AS k, max(m) AS m, sum(v / t) FILTER (rank <= m) AS top, sum(power(v / t, 2)) AS h FROM k)
    SELECT k AS groups, CAST(m AS BIGINT) AS top_n, {r('top * 100', 'top_share')}, {r('h', 'hhi')}, {r('(h - 1.0 / k) / (1 - 1.0 / k)', 'hhi_normalised')}, {r('m / k * 100', 'baseline')}, {r('top / (m / k)', 'multiple')} FROM o""",
)

# --- rows --------------------------------------------------------------------

_CUSTOMER = "c_custkey, c_name, c_mktsegment, c_acctbal"
add(
    "explorer_page", lambda df: exp.query_rows(df, sort="c_mktsegment", tie=["c_custkey"], columns=_CUSTOMER.split(", "), offset=20, limit=30),
    f"SELECT c_custkey, c_name, c_mktsegment, {r('c_acctbal', 'c_acctbal')} FROM customer ORDER BY lower(c_mktsegment) ASC NULLS LAST, c_custkey LIMIT 30 OFFSET 20", "customer",
)
add(
    "explorer_search", lambda df: exp.query_rows(df, text="00012", tie=["c_custkey"], columns=["c_custkey", "c_name"], limit=200),
    "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), '00012') ORDER BY c_custkey LIMIT 200", "customer",
)
add(
    "explorer_sort_desc", lambda df: exp.query_rows(df, sort="c_acctbal", descending=True, tie=["c_custkey"], columns=_CUSTOMER.split(", "), limit=25),
    f"SELECT c_custkey, c_name, c_mktsegment, {r('c_acctbal', 'c_acctbal')} FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25", "customer",
)
add("explorer_project", lambda df: exp.query_rows(df, [Filter("p_size", "lte", 3)], tie=["p_partkey"], columns=["p_brand", "p_size"], limit=100), "SELECT p_brand, p_size FROM part WHERE p_size <= 3 ORDER BY p_partkey LIMIT 100", "part")
_DEEP = "l_orderkey, l_linenumber, l_returnflag, l_quantity"
add(
    "explorer_deep_page", lambda df: exp.query_rows(df, sort="l_returnflag", descending=True, tie=["l_orderkey", "l_linenumber", "l_quantity"], columns=_DEEP.split(", "), offset=33_333, limit=200),
    f"SELECT l_orderkey, l_linenumber, l_returnflag, {r('l_quantity', 'l_quantity')} FROM lineitem ORDER BY lower(l_returnflag) DESC NULLS LAST, l_orderkey, l_linenumber, l_quantity LIMIT 200 OFFSET 33333", "lineitem",
)
add(
    "dup_rows_hot", lambda df: exp.duplicate_rows(df.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]),
    """SELECT * FROM (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) AS seq FROM lineitem) WHERE seq > 1""",
    "lineitem",
)
_TWICE = "SELECT p_brand, p_type, p_size, p_partkey FROM part"
add(
    "dup_rows", lambda df: exp.duplicate_rows(df.select("p_brand", "p_type", "p_size", "p_partkey"), ["p_partkey"]),
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS seq FROM ({_TWICE})) WHERE seq > 1", "part",
)
add("dedupe", lambda df: exp.drop_duplicate_rows(df.select("p_brand", "p_type", "p_size", "p_partkey"), ["p_partkey"]), "SELECT p_brand, p_type, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2, 3", "part")
add("dup_count", lambda df: exp.count_duplicates(df.select("p_brand", "p_type", "p_size")), "SELECT (SELECT count(*) FROM part) - count(*) AS duplicates FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)", "part")
add(
    "scenario", lambda df: rounded(exp.scenario(df, "sales", 10, "profit"), 2),
    f"SELECT {r('sum(sales)', 'base', 2)}, {r('sum(sales) * 1.1', 'projected', 2)}, {r('sum(profit)', 'dependent_base', 2)}, {r('sum(profit) / sum(sales) * sum(sales) * 1.1', 'dependent_projected', 2)} FROM sales",
)

# --- time --------------------------------------------------------------------

ORDINAL_SQL = {
    "day": "date_diff('day', DATE '1970-01-01', {0})", "week": "CAST(floor((date_diff('day', DATE '1970-01-01', {0}) + 3) / 7) AS BIGINT)", "month": "year({0}) * 12 + month({0}) - 1",
    "quarter": "year({0}) * 4 + quarter({0}) - 1", "year": "year({0})",
}
KEY_SQL = {
    "day": "strftime({0}, '%Y-%m-%d')", "week": "strftime(date_trunc('week', {0}), '%Y-%m-%d')", "month": "strftime({0}, '%Y-%m')", "quarter": "year({0}) || '-Q' || quarter({0})", "year": "CAST(year({0}) AS VARCHAR)",
}


def _series_sql(grain: str, value: str, n: str = "count(*)", t: str = "sales", d: str = "order_date") -> str:
    return f"SELECT CAST({ORDINAL_SQL[grain].format(d)} AS BIGINT) AS ord, {KEY_SQL[grain].format(d)} AS period, {n} AS n, {r(f'CAST({value} AS DOUBLE)', 'value')} FROM {t} GROUP BY 1, 2"


for _grain in cal.GRAINS:
    add(f"ts_{_grain}", lambda df, g=_grain: ts.time_series(df, "order_date", "sales", grain=g), _series_sql(_grain, "sum(sales)"))
add("ts_count", lambda df: ts.time_series(df, "ts", grain="day"), _series_sql("day", "count(*)", t="(SELECT CAST(ts AS DATE) AS d FROM events)", d="d"), "events")
add("ts_avg", lambda df: ts.time_series(df, "order_date", "discount", "avg", "quarter"), _series_sql("quarter", "avg(discount)"))
add("ts_distinct", lambda df: ts.time_series(df, "order_date", "customer", "distinct_count"), _series_sql("month", "count(DISTINCT customer)"))
_DAYS = "(SELECT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 300000)"
add(
    "ts_missing", lambda df: ts.missing_periods(ts.time_series(df.where("o_totalprice > 300000"), "o_orderdate", grain="day"), "day"),
    f"""WITH o AS (SELECT DISTINCT d FROM {_DAYS}), e AS (SELECT unnest(generate_series((SELECT min(d) FROM o), (SELECT max(d) FROM o), INTERVAL 1 DAY)) AS d)
    SELECT date_diff('day', DATE '1970-01-01', CAST(d AS DATE)) AS ord, strftime(d, '%Y-%m-%d') AS period FROM e WHERE CAST(d AS DATE) NOT IN (SELECT d FROM o)""", "orders",
)


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir)
    found = ts.complete(ts.collect_series(ts.time_series(df, "order_date", "sales"), "month"), *ts.date_span(df, "order_date"))
    return spark.createDataFrame([(p.ord, cal.key_of(p.ord, "month"), p.n, p.value) for p in found.points], "ord long, period string, n long, value double").withColumn("value", F.round("value", 2))


# the rule itself, for the one partial period at each end that these tables have
add(
    "ts_complete", _complete,
    f"""WITH {_SALES_SQL}, m AS (SELECT year(order_date) * 12 + month(order_date) - 1 AS ord, strftime(order_date, '%Y-%m') AS period, count(*) AS n, sum(sales) AS v, min(order_date) AS a, max(order_date) AS b FROM sales GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS c, min(ord) OVER () AS lo, max(ord) OVER () AS hi, day(last_day(a)) AS days FROM m), t AS (SELECT n AS typical FROM k WHERE i = c // 2 + 1)
    SELECT CAST(ord AS BIGINT) AS ord, period, n, {r('v', 'value', 2)} FROM k, t
    WHERE NOT ((ord = lo AND (n < 0.3 * typical OR days - day(a) + 1 < 0.8 * days)) OR (ord = hi AND (n < 0.3 * typical OR day(b) < 0.8 * days)))""", None,
)
add(
    "ts_pop_change", lambda df: rounded(ts.adjacent_change(ts.time_series(df, "order_date", "sales")), 2),
    f"""WITH m AS (SELECT CAST(year(order_date) * 12 + month(order_date) - 1 AS BIGINT) AS ord, strftime(order_date, '%Y-%m') AS period, count(*) AS n, sum(sales) AS v FROM sales GROUP BY 1, 2),
    l AS (SELECT *, lag(v) OVER w AS p, ord - lag(ord) OVER w AS gap, (SELECT quantile_cont(abs(v), 0.5) FROM m) AS typical FROM m WINDOW w AS (ORDER BY ord))
    SELECT ord, period, n, {r('v', 'value', 2)}, {r('CASE WHEN gap = 1 AND abs(p) >= 1e-9 AND abs(p) >= 0.1 * typical THEN (v - p) / abs(p) * 100 END', 'pct_change', 2)} FROM l""",
)
add(
    "ts_margin", lambda df: rounded(ts.margin_series(df, "order_date", "sales", "profit"), 2),
    f"SELECT CAST(year(order_date) * 12 + month(order_date) - 1 AS BIGINT) AS ord, strftime(order_date, '%Y-%m') AS period, {r('sum(sales)', 'revenue', 2)}, {r('sum(profit)', 'profit', 2)}, {r('sum(profit) / sum(sales) * 100', 'margin', 2)} FROM sales GROUP BY 1, 2 HAVING sum(sales) > 0",
)


def _compare_sql(a: tuple[str, str], b: tuple[str, str], dimension: str | None = None) -> str:
    def inside(s: tuple[str, str]) -> str:
        return f"order_date BETWEEN DATE '{s[0]}' AND DATE '{s[1]}'"

    keys, by = (f"{dimension} AS key, ", " GROUP BY 1") if dimension else ("", "")
    share = f", {r('(a - b) / sum(a - b) OVER () * 100', 'share_of_change', 2)}" if dimension else ""
    return f"""WITH g AS (SELECT {keys}coalesce(sum(sales) FILTER ({inside(a)}), 0) AS a, coalesce(sum(sales) FILTER ({inside(b)}), 0) AS b FROM sales WHERE {inside(a)} OR {inside(b)}{by})
    SELECT {'key, ' if dimension else ''}{r('a', 'value_a', 2)}, {r('b', 'value_b', 2)}, {r('a - b', 'change', 2)}, {r('(a - b) / abs(b) * 100', 'pct', 2)}{share} FROM g"""


add("ts_compare", lambda df: rounded(ts.compare_periods(df, "order_date", "1998-Q2", "1998-Q1", "sales"), 2), _compare_sql(("1998-04-01", "1998-06-30"), ("1998-01-01", "1998-03-31")))
add("ts_compare_breakdown", lambda df: rounded(ts.compare_periods(df, "order_date", "1998", "1997", "sales", dimension="region"), 2), _compare_sql(("1998-01-01", "1998-12-31"), ("1997-01-01", "1997-12-31"), "region"))
add("ts_year_ago", lambda df: rounded(ts.compare_periods(df, "order_date", "1999-05", cal.key_of(cal.ordinal_of(cal.range_of_key("1999-05")[0], "month") - cal.SEASON["month"], "month"), "sales"), 2), _compare_sql(("1999-05-01", "1999-05-31"), ("1998-05-01", "1998-05-31")))
add(
    "volume_vs_margin", lambda df: rounded(ts.volume_vs_margin(df, "order_date", "1999", "1998", "sales", "profit"), 2),
    f"""WITH g AS (SELECT sum(sales) FILTER (year(order_date) = 1999) AS ra, sum(sales) FILTER (year(order_date) = 1998) AS rb, sum(profit) FILTER (year(order_date) = 1999) AS pa, sum(profit) FILTER (year(order_date) = 1998) AS pb FROM sales)
    SELECT {r('ra', 'revenue_a', 2)}, {r('rb', 'revenue_b', 2)}, {r('pa', 'profit_a', 2)}, {r('pb', 'profit_b', 2)}, {r('pa / ra * 100', 'margin_a', 2)}, {r('pb / rb * 100', 'margin_b', 2)}, {r('pa - pb', 'profit_change', 2)},
      {r('(ra - rb) * pb / rb', 'volume_effect', 2)}, {r('ra * (pa / ra - pb / rb)', 'margin_effect', 2)} FROM g""",
)
add(
    "new_vs_returning", lambda df: ent.new_vs_returning(df, "customer", "order_date"),
    """WITH s AS (SELECT DISTINCT customer, year(order_date) * 12 + month(order_date) - 1 AS ord, strftime(order_date, '%Y-%m') AS period FROM sales), f AS (SELECT *, min(ord) OVER (PARTITION BY customer) AS first FROM s)
    SELECT CAST(ord AS BIGINT) AS ord, period, count(*) FILTER (ord = first) AS "new", count(*) FILTER (ord > first) AS "returning" FROM f GROUP BY 1, 2""",
)
add(
    "cohort_retention", lambda df: rounded(ent.cohort_retention(df, "customer", "order_date", "quarter", max_offset=6), 2),
    f"""WITH s AS (SELECT DISTINCT customer, year(order_date) * 4 + quarter(order_date) - 1 AS ord FROM sales), f AS (SELECT *, min(ord) OVER (PARTITION BY customer) AS cohort FROM s),
    c AS (SELECT cohort, ord - cohort AS "offset", count(*) AS active FROM f GROUP BY 1, 2), z AS (SELECT cohort, active AS size FROM c WHERE "offset" = 0 ORDER BY cohort DESC LIMIT 12)
    SELECT CAST(c.cohort AS BIGINT) AS cohort, (c.cohort // 4) || '-Q' || (c.cohort % 4 + 1) AS period, CAST("offset" AS BIGINT) AS "offset", active, size, {r('active / size * 100', 'retention', 2)} FROM c JOIN z USING (cohort) WHERE "offset" <= 6""",
)

# --- statistics --------------------------------------------------------------

add("corr_pair", lambda df: rel.correlation(df, "quantity", "sales"), f"SELECT {r('corr(quantity, sales)', 'r')}, count(*) AS n FROM sales")
_MEASURES = ("quantity", "discount", "sales", "cost", "profit")
add(
    "corr_scan", lambda df: rel.correlation_pairs(df, _MEASURES),
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r')}, count(*) AS n FROM sales" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]),
)
add(
    "spearman", lambda df: rel.spearman(df, "discount", "sales"),
    f"""WITH k AS (SELECT rank() OVER (ORDER BY discount) + (count(*) OVER (PARTITION BY discount) - 1) / 2 AS a, rank() OVER (ORDER BY sales) + (count(*) OVER (PARTITION BY sales) - 1) / 2 AS b FROM sales)
    SELECT {r('corr(a, b)', 'rho')}, count(*) AS n FROM k""",
)
_MONTHS_SQL = "m AS (SELECT year(order_date) * 12 + month(order_date) - 1 AS ord, sum(sales) AS v FROM sales, (SELECT max(order_date) AS last FROM sales) e WHERE last = last_day(last) OR order_date < date_trunc('month', last) GROUP BY 1), x AS (SELECT ord, v, row_number() OVER (ORDER BY ord) - 1 AS i FROM m)"


def _months(spark: SparkSession, sf_dir: str) -> ts.Series:
    """Monthly sales; the last month counts if the data have its last day."""
    df = sales(spark, sf_dir)
    s = ts.collect_series(ts.time_series(df, "order_date", "sales"), "month")
    over = s.points and ts.date_span(df, "order_date")[1] == cal.end_of(s.points[-1].ord, "month")
    return s if over else ts.Series("month", s.points[:-1])


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ts.trend(_months(spark, sf_dir).values)
    return spark.createDataFrame([(t["n"], round(t["slope"], 2), round(t["intercept"], 2), t["r2"], t["tau"])], "n long, slope double, intercept double, r2 double, tau double")


add(
    "trend_fit", _trend,
    f"""WITH {_SALES_SQL}, {_MONTHS_SQL}, t AS (SELECT sum(sign(b.v - a.v)) / (count(*)) AS tau FROM x a JOIN x b ON a.i < b.i)
    SELECT count(*) AS n, {r('regr_slope(v, i)', 'slope', 2)}, {r('regr_intercept(v, i)', 'intercept', 2)}, {r('regr_r2(v, i)', 'r2')}, {r('max(tau)', 'tau')} FROM x, t""", None,
)


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ts.collect_series(ts.time_series(sales(spark, sf_dir), "order_date", "sales", grain="week"), "week")
    return spark.createDataFrame([(a["ord"], round(a["value"], 2), round(a["expected"], 2), round(a["z"], 3), a["direction"]) for a in ts.anomalies(daily.points, 2.5)], "ord long, value double, expected double, z double, direction string")


add(
    "anomalies", _anomalies,
    f"""WITH {_SALES_SQL}, m AS (SELECT {ORDINAL_SQL['week'].format('order_date')} AS ord, sum(sales) AS v FROM sales GROUP BY 1), x AS (SELECT ord, v, row_number() OVER (ORDER BY ord) - 1 AS i FROM m),
    f AS (SELECT regr_slope(v, i) AS s, regr_intercept(v, i) AS c FROM x), d AS (SELECT ord, v, c + s * i AS e, v - (c + s * i) AS d FROM x, f), k AS (SELECT quantile_cont(d, 0.5) AS med FROM d),
    z AS (SELECT ord, v, e, (d - med) / (1.4826 * (SELECT quantile_cont(abs(d - med), 0.5) FROM d, k)) AS z FROM d, k)
    SELECT CAST(ord AS BIGINT) AS ord, {r('v', 'value', 2)}, {r('e', 'expected', 2)}, {r('z', 'z', 3)}, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM z WHERE abs(z) >= 2.5""", None,
)


def _season(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ts.seasonality(_months(spark, sf_dir).points, "month")
    return spark.createDataFrame([(k, float(v)) for k, v in (s["index"] if s else {}).items()], "position long, season double")


add(
    "seasonal_index", _season,
    f"""WITH {_SALES_SQL}, {_MONTHS_SQL}, c AS (SELECT ord, v, (sum(v) OVER (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(v, 6) OVER (ORDER BY i) + lead(v, 6) OVER (ORDER BY i)) / 2) / 12 AS ma FROM x),
    g AS (SELECT ord % 12 AS p, avg(v / ma) AS q FROM c WHERE ma IS NOT NULL GROUP BY 1) SELECT CAST(p AS BIGINT) AS position, {r('q / avg(q) OVER ()', 'season')} FROM g""", None,
)
_OUT_SQL = """WITH b AS ({bounds}) SELECT n, {lo}, {hi}, count(*) FILTER (x < lo OR x > hi) AS outliers, count(*) FILTER (x < lo) AS below, count(*) FILTER (x > hi) AS above, {pct} FROM (SELECT o_totalprice AS x FROM orders), b GROUP BY n, lo, hi"""
for _method, _bounds in (
    ("iqr", "SELECT count(*) AS n, quantile_cont(o_totalprice, 0.25) - 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS lo, quantile_cont(o_totalprice, 0.75) + 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS hi FROM orders"),
    ("zscore", "SELECT count(*) AS n, avg(o_totalprice) - 3 * stddev_samp(o_totalprice) AS lo, avg(o_totalprice) + 3 * stddev_samp(o_totalprice) AS hi FROM orders"),
    ("mad", "SELECT count(*) AS n, max(m) - 3.5 * 1.4826 * quantile_cont(abs(o_totalprice - m), 0.5) AS lo, max(m) + 3.5 * 1.4826 * quantile_cont(abs(o_totalprice - m), 0.5) AS hi FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders)"),
):
    add(
        f"outliers_{_method}", lambda df, m=_method: rounded(rel.outliers(df, "o_totalprice", m), 2),
        _OUT_SQL.format(bounds=_bounds, lo=r("lo", "low", 2), hi=r("hi", "high", 2), pct=r("count(*) FILTER (x < lo OR x > hi) / n * 100", "pct_of_values", 2)), "orders",
    )


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rel.relations(sales(spark, sf_dir), ["sales", "cost", "profit", "quantity"])
    return spark.createDataFrame([(f["target"], f["left"], f["form"], f["right"], f["share"]) for f in found], 'target string, "left" string, form string, "right" string, share double'.replace('"', "`"))


add("relations", _relations, None, None)
_PROFIT_SQL = """g AS (SELECT nation AS key, sum(sales) AS rv, sum(profit) AS p, count(*) AS n_rows FROM sales GROUP BY 1),
    s AS (SELECT *, rv / sum(rv) OVER () * 100 AS rs, p / sum(p) OVER () * 100 AS ps FROM g)"""
_PROFIT_COLUMNS = f"key, {r('rv', 'revenue', 2)}, {r('p', 'profit', 2)}, n_rows, {r('CASE WHEN rv > 0 THEN p / rv * 100 END', 'margin', 2)}, {r('rs', 'revenue_share', 2)}, {r('ps', 'profit_share', 2)}, {r('ps - rs', 'share_gap', 2)}, p < 0 AS loss"
add("profitability", lambda df: rounded(rel.profitability(df, "nation", "sales", "profit"), 2), f"WITH {_PROFIT_SQL} SELECT {_PROFIT_COLUMNS} FROM s")
add("loss_makers", lambda df: rounded(rel.profitability(df, "customer", "sales", "profit").where("loss"), 2), f"WITH {_PROFIT_SQL.replace('nation', 'CAST(customer AS VARCHAR)')} SELECT {_PROFIT_COLUMNS} FROM s WHERE p < 0")

# --- entities ----------------------------------------------------------------

add(
    "customer_summary", lambda df: rounded(ent.customer_summary(df, "customer", "sales"), 2),
    f"""WITH c AS (SELECT customer, count(*) AS n, greatest(sum(sales), 0) AS v FROM sales GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY v DESC) AS i, CAST(ceil(count(*) OVER () / 10) AS BIGINT) AS d FROM c)
    SELECT count(*) AS customers, {r('avg(CASE WHEN n > 1 THEN 100.0 ELSE 0 END)', 'repeat_rate', 2)}, {r('avg(n)', 'avg_rows', 2)}, max(d) AS top_decile, {r('sum(v) FILTER (i <= d) / sum(v) * 100', 'top_decile_share', 2)} FROM k""",
)
_STAGES = ["view", "click", "signup", "purchase"]
_EVENT_SQL = "e AS (SELECT DISTINCT user_id, list_position(['view', 'click', 'signup', 'purchase'], lower(event_type)) AS place FROM events WHERE lower(event_type) IN ('view', 'click', 'signup', 'purchase'))"
_STAGE_SQL = "st AS (SELECT unnest(range(1, 5)) AS place, unnest(['view', 'click', 'signup', 'purchase']) AS stage)"


def _funnel_sql(counts: str, reached: str) -> str:
    return f"""WITH {_EVENT_SQL}, {_STAGE_SQL}, c AS ({counts}), f AS (SELECT st.place, stage, coalesce(n, 0) AS n FROM st LEFT JOIN c ON c.place = st.place), q AS (SELECT *, {reached} AS reached FROM f)
    SELECT CAST(place AS INTEGER) AS place, stage, n, CAST(reached AS BIGINT) AS reached, {r('reached / nullif(lag(reached) OVER (ORDER BY place), 0) * 100', 'from_previous', 2)}, {r('reached / nullif(first(reached) OVER (ORDER BY place), 0) * 100', 'from_first', 2)} FROM q"""


add("funnel_events", lambda df: rounded(ent.funnel(df, "event_type", _STAGES, "user_id", "events"), 2), _funnel_sql("SELECT place, count(*) AS n FROM e GROUP BY 1", "n"), "events")
add(
    "funnel_snapshot", lambda df: rounded(ent.funnel(df, "event_type", _STAGES, "user_id", "snapshot"), 2),
    _funnel_sql("SELECT place, count(*) AS n FROM (SELECT user_id, max(place) AS place FROM e GROUP BY 1) GROUP BY 1", "sum(n) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"), "events",
)
add(
    "funnel_rows", lambda df: rounded(ent.funnel(df, "event_type", _STAGES), 2),
    _funnel_sql("SELECT list_position(['view', 'click', 'signup', 'purchase'], lower(event_type)) AS place, count(*) AS n FROM events WHERE lower(event_type) IN ('view', 'click', 'signup', 'purchase') GROUP BY 1", "n"), "events",
)

# --- cells of text -----------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str, cells: list[str], make: Callable) -> DataFrame:
    """One of the cells in each order, by its key."""
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.get(F.array(*map(F.lit, cells)), F.col("o_orderkey") % len(cells)).alias("cell")).select("o_orderkey", make(F.col("cell")))


def _cell_query(name: str, cells: list[str], make: Callable, expected: list[str]) -> None:
    """The parsed value of a column as long as orders; the SQL states what each spelling is."""
    rows = ", ".join(f"({i}, {e})" for i, e in enumerate(expected))
    add(name, lambda spark, sf_dir: _cells(spark, sf_dir, cells, make), f"SELECT o_orderkey, v FROM orders JOIN (VALUES {rows}) AS t(i, v) ON o_orderkey % {len(cells)} = i", None)


_cell_query("null_tokens", ["", " N/A ", "none", "x", "#REF!", "0", "-", "nil"], lambda c: val.is_null_token(c).alias("v"), ["TRUE", "TRUE", "TRUE", "FALSE", "TRUE", "FALSE", "TRUE", "TRUE"])
_NUMBERS = ["$1,200.50", "(50.00)", "abc", "12%", "1.234,50", "12,34,567", "1'234.5", "1 234,5", "5-", "-EUR 7", "1e3", ".5", "Rs. 1,000", "--5", "+4", "1,2"]
_cell_query(
    "parse_number", _NUMBERS, lambda c: val.parse_number(c).alias("v"),
    ["CAST(1200.5 AS DOUBLE)", "-50", "NULL", "0.12", "NULL", "1234567", "1234.5", "1234.5", "-5", "NULL", "1000", "0.5", "1000", "NULL", "4", "NULL"],
)
_cell_query("parse_number_eu", ["1.234,50", "1.234", "12,5", "1,234", "1.5", "3"], lambda c: val.parse_number(c, "eu").alias("v"), ["CAST(1234.5 AS DOUBLE)", "1234", "12.5", "1.234", "1.5", "3"])
_DATES = ["2025-03-05", "2025/3/5 10:30", "13/03/2025", "03/13/2025", "5 May 2024", "May 5th, 2024", "Sept 2024", "2024-Q2", "Q3 2023", "2024-02-30", "1.2.70", "1.2.69", "2024-11", "soon"]
_cell_query(
    "parse_date", _DATES, lambda c: val.parse_date(c, "dmy").cast("string").alias("v"),
    ["'2025-03-05'", "'2025-03-05'", "'2025-03-13'", "NULL", "'2024-05-05'", "'2024-05-05'", "'2024-09-01'", "'2024-04-01'", "'2023-07-01'", "NULL", "'1970-02-01'", "'2069-02-01'", "'2024-11-01'", "NULL"],
)
_cell_query("parse_bool", ["Yes", "n", "TRUE", "0", " f ", "maybe"], lambda c: val.parse_bool(c).alias("v"), ["TRUE", "FALSE", "TRUE", "NULL", "FALSE", "NULL"])


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.date_format("o_orderdate", "dd/MM/yyyy")
    a, b, n = val.order_votes(c)
    return table(spark, sf_dir, "orders").agg(F.sum(a).alias("day_first"), F.sum(b).alias("month_first"), F.sum(n).alias("numeric"))


add("date_order", _votes, "SELECT CAST(count(*) FILTER (day(o_orderdate) > 12) AS BIGINT) AS day_first, CAST(0 AS BIGINT) AS month_first, count(*) AS numeric FROM orders", None)


def _locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    eu, us = val.locale_votes(F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit("")))
    return table(spark, sf_dir, "orders").agg(F.sum(eu).alias("eu"), F.sum(us).alias("us"))


add("decimal_locale", _locale, "SELECT CAST(0 AS BIGINT) AS eu, count(*) AS us FROM orders", None)
add(
    "label_variants", lambda df: df.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).when(F.col("p_partkey") % 3 == 1, F.lower("p_brand")).otherwise(F.concat(F.lit(" "), "p_brand")).alias("v"))
    .groupBy(F.lower(F.trim(F.regexp_replace("v", r"\s+", " "))).alias("label")).agg(F.count_distinct("v").alias("spellings"), F.count("*").alias("n")).where("spellings > 1"),
    """SELECT lower(trim(v)) AS label, count(DISTINCT v) AS spellings, count(*) AS n FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN lower(p_brand) ELSE ' ' || p_brand END AS v FROM part)
    GROUP BY 1 HAVING count(DISTINCT v) > 1""", "part",
)
add(
    "str_words", lambda df: df.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint").alias("words")),
    "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents", "documents",
)
add(
    "win_rank", lambda df: grp.group_by(df, "nation", "sales").select("key", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"))).cast("bigint").alias("by_rows")),
    "SELECT nation AS key, rank() OVER (ORDER BY count(*) DESC) AS by_rows FROM sales GROUP BY 1",
)


# --- whole analyses: checked by their tests, rows only here ------------------


@contextmanager
def _analysis(spark: SparkSession, sf_dir: str) -> Iterator[Context]:
    """The fact view under analysis: kept while its many small questions are asked, released after."""
    df = sales(spark, sf_dir).persist()
    try:
        yield Context(df, profile(df))
    finally:
        df.unpersist()


def _add_analysis(name: str, schema: str, rows: Callable[[Context], list[tuple]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with _analysis(spark, sf_dir) as ctx:
            return spark.createDataFrame(rows(ctx), schema)

    QUERIES[name] = run


def _facts(ctx: Context, name: str, **params: object) -> list[tuple]:
    found = registry.call(ctx, name, **params)
    return [(f.id, f.label, str(f.value), f.unit, f.display) for f in found.facts] if found.ok else [(found.code, found.message, None, None, None)]


_FACTS = "id string, label string, value string, unit string, display string"
_QUESTIONS = ("top 5 brands by sales", "monthly sales", "Compare ASIA and EUROPE", "what share of sales comes from ASIA", "why did sales change", "forecast for sales")
_add_analysis("forecast", _FACTS, lambda ctx: _facts(ctx, "forecast", grain="month", horizon=6))
_add_analysis("explain_change", _FACTS, lambda ctx: _facts(ctx, "explain_change"))
_add_analysis("planner", "question string, tool string, params string", lambda ctx: [(q, c.tool, str(sorted(c.params.items()))) for q in _QUESTIONS if (c := plan(ctx, q))])
_add_analysis("insights", "kind string, title string, text string, tool string, score double, priority string", lambda ctx: [(i.kind, i.title, i.text, i.tool, float(i.score), i.priority) for i in generate(ctx)])
_add_analysis("kpis", "label string, value double, unit string, display string", lambda ctx: [(k["label"], None if k["value"] is None else float(k["value"]), k["unit"], k["display"]) for k in kpis(ctx)])
_add_analysis("profile", "name string, kind string, role string, meaning string, additive boolean, unit string, n long", lambda ctx: [(c.name, c.kind, c.role, c.meaning, c.additive, c.unit, c.count) for c in ctx.profile.columns.values()])
_add_analysis("quality", "score long, label string, issues long", lambda ctx: [((q := quality(ctx.profile))["score"], q["label"], len(q["issues"]))])
_add_analysis("dashboard", "id string, title string, tool string, available boolean, summary string", lambda ctx: [(w["id"], w["title"], w["tool"], w["available"], w["result"].summary if w["available"] else w["reason"]) for w in materialize(ctx, plan_dashboard(ctx))])
_add_analysis("grounding", "sentence string", lambda ctx: [(s,) for s in _grounded(ctx)])


def _flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with faults: blanks, a constant, an empty column, values far out, negative prices, too many names and dates to come."""
    key = F.col("o_orderkey")
    price = 100 + key % 100
    return table(spark, sf_dir, "orders").select(
        key.alias("order_id"), F.when(key % 97 == 0, F.lit("2100-01-01").cast("date")).otherwise(F.col("o_orderdate").cast("date")).alias("order_date"),
        F.when(key % 10 != 0, F.get(F.array(F.lit("North"), F.lit("South"), F.lit("East")), key % 3)).alias("region"), F.lit("EUR").alias("currency_name"),
        F.when(key % 40 == 0, 1000.0).otherwise((1 + key % 10).cast("double")).alias("quantity"), F.when(key % 50 == 7, -price).otherwise(price).cast("double").alias("price"),
        F.lit(None).cast("string").alias("remark"), F.translate(F.floor(key * 0.7).cast("string"), "0123456789", "abcdefghij").alias("town"),
    )


def _quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of a table with known faults, and its score; the number of different names is an estimate and left out."""
    found = quality(profile(_flawed(spark, sf_dir)), today=date(2024, 1, 1))
    rows = [(i["kind"], i["severity"], i["column"], None if i["kind"] == "high_cardinality_text" else i["affected"]) for i in found["issues"]]
    return spark.createDataFrame([*rows, ("score", found["label"], None, found["score"])], "kind string, severity string, column string, affected long")


add(
    "quality_issues", _quality_issues,
    """WITH o AS (SELECT o_orderkey AS k FROM orders), n AS (SELECT count(*) AS n, count(*) FILTER (k % 10 = 0) AS blank FROM o),
    found AS (SELECT 'empty_column' AS kind, 'low' AS severity, 'remark' AS "column", n AS affected FROM n UNION ALL SELECT 'constant_column', 'low', 'currency_name', n FROM n UNION ALL SELECT 'missing_values', 'medium', 'region', blank FROM n
    UNION ALL SELECT 'outliers', 'low', 'quantity', count(*) FROM o WHERE k % 40 = 0 UNION ALL SELECT 'outliers', 'low', 'price', count(*) FROM o WHERE k % 50 = 7 UNION ALL SELECT 'implausible_values', 'medium', 'price', count(*) FROM o WHERE k % 50 = 7
    UNION ALL SELECT 'high_cardinality_text', 'low', 'town', NULL UNION ALL SELECT 'future_dates', 'medium', 'order_date', 1),
    score AS (SELECT floor(100 - least(30, 1.6 * 100.0 * (blank + n) / (8 * n)) - (SELECT sum(CASE severity WHEN 'medium' THEN 4 ELSE 1.2 END) FROM found) + 0.5) AS s FROM n)
    SELECT * FROM found UNION ALL SELECT 'score', CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 75 THEN 'Good' WHEN s >= 60 THEN 'Fair' ELSE 'Needs attention' END, NULL, CAST(s AS BIGINT) FROM score""", None,
)


def _grounded(ctx: Context) -> list[str]:
    """Sentences about a computed ranking, one of them wrong, through the gate."""
    found, ledger = registry.call(ctx, "top_n", dimension="region"), Ledger()
    ledger.add(found)
    kept, _ = sanitize(found.summary + "\nEverything grew by 77.7%.", ledger)
    return kept.split("\n")


def _claims(df: DataFrame) -> DataFrame:
    return count_claims(df.select("conv_id", "turn", "text")).select("conv_id", "turn", "n_claims")


add("gr_extract", _claims, None, "conversations")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily events as a stream over the table's file, with what the watermark has closed."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"calendar_{uuid.uuid4().hex[:8]}"
    root = shared_folder(spark, "calendar")
    stream = calendar_series(events, "ts", grain="day", delay="1 day")
    query = stream.writeStream.format("parquet").queryName(name).outputMode("append").option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows").select(F.date_format("period_start", "yyyy-MM-dd").alias("period"), "n")


add(
    "stream_calendar", _stream,
    "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS period, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT period, n FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)", None,
)


# --- labels that reach the scan ----------------------------------------------


def _labels(spark: SparkSession, sf_dir: str, name: str) -> Labels:
    return Labels.build(table(spark, sf_dir, name), shared_folder(spark, "labels"))


_BY_LABEL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", lower({c}) AS folded, {c} AS value, count(*) AS n FROM part GROUP BY ALL" for c in ("p_name", "p_brand", "p_type"))


def _label_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on text, with and without regard to what occurs, as comparisons with the spellings in the dictionary."""
    customers, labels = table(spark, sf_dir, "customer"), _labels(spark, sf_dir, "customer")
    filters = {
        "eq": Filter("c_mktsegment", "eq", "Building"), "neq": Filter("c_mktsegment", "neq", "building "), "in": Filter("c_mktsegment", "in", values=("MACHINERY", "household", "nothing")),
        "not_in": Filter("c_mktsegment", "not_in", values=("machinery",)), "contains": Filter("c_mktsegment", "contains", values=("UILD", "hold")), "absent": Filter("c_mktsegment", "eq", "no such label"),
    }
    counts = [apply_filters(customers, [f], labels).agg(F.lit(name).alias("filter"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")) for name, f in filters.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_SEGMENT = "lower(c_mktsegment)"
_LABEL_TESTS = {"eq": f"{_SEGMENT} = 'building'", "neq": f"{_SEGMENT} <> 'building'", "in": f"{_SEGMENT} IN ('machinery', 'household')", "not_in": f"{_SEGMENT} <> 'machinery'", "contains": f"contains({_SEGMENT}, 'uild') OR contains({_SEGMENT}, 'hold')", "absent": "FALSE"}
add("label_dictionary", lambda spark, sf_dir: _labels(spark, sf_dir, "part").table, _BY_LABEL, None)
add("flt_labels", _label_filters, " UNION ALL ".join(f"SELECT '{k}' AS \"filter\", count(*) AS n, {r('sum(c_acctbal)', 'total', 2)} FROM customer WHERE {w}" for k, w in _LABEL_TESTS.items()), None)


# --- forecasts as a table function -------------------------------------------


def _forecast_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of the next three months of every nation: one statement, one series a nation."""
    forecast_table.register(spark)
    view = f"monthly_{uuid.uuid4().hex[:8]}"
    sales(spark, sf_dir).groupBy("nation", F.trunc("order_date", "month").alias("month")).agg(F.sum("sales").alias("sales")).createOrReplaceTempView(view)
    return spark.sql(
        f"""SELECT nation, period, value, low, high, model, mae, refused FROM forecast_series(TABLE(SELECT nation, month, sales FROM {view}) PARTITION BY nation ORDER BY month,
        period => 'month', value => 'sales', grain => 'month', horizon => 3, models => 'level,linear')"""
    )


add(
    "forecast_sql", _forecast_sql,
    f"""WITH {_SALES_SQL}, seen AS (SELECT nation, date_trunc('month', order_date) AS m, sum(sales) AS v FROM sales GROUP BY ALL),
    span AS (SELECT nation, min(m) AS a, max(m) AS b, count(*) AS k, CAST(datediff('month', min(m), max(m)) + 1 AS BIGINT) AS n FROM seen GROUP BY nation),
    held AS (SELECT *, CASE WHEN k < 6 THEN 'not_enough_data' WHEN 1 - k / n > 0.2 THEN 'gaps_in_series' END AS why FROM span),
    y AS (SELECT h.nation, h.n, h.b, least(6, greatest(2, h.n // 3)) AS tests, x, coalesce(v, 0) AS v FROM (SELECT *, unnest(range(n)) AS x FROM held WHERE why IS NULL) h LEFT JOIN seen s ON s.nation = h.nation AND s.m = h.a + to_months(CAST(x AS INTEGER))),
    back AS (SELECT y.nation, t, any_value(tests) AS tests, max(v) FILTER (x = n - t) AS actual, avg(v) FILTER (x BETWEEN n - t - 3 AND n - t - 1) AS level,
      regr_intercept(v, x) FILTER (x < n - t) + regr_slope(v, x) FILTER (x < n - t) * max(n - t) AS linear FROM y, (SELECT unnest(range(1, 7)) AS t) WHERE t <= tests GROUP BY y.nation, t),
    scored AS (SELECT nation, any_value(tests) AS tests, avg(abs(level - actual)) <= avg(abs(linear - actual)) AS flat FROM back GROUP BY nation),
    errors AS (SELECT nation, s.tests, flat, CASE WHEN flat THEN abs(level - actual) ELSE abs(linear - actual) END AS e, abs(actual) AS a FROM back b JOIN scored s USING (nation)),
    spread AS (SELECT nation, any_value(flat) AS flat, avg(e) AS mae, avg(e / a) FILTER (a > 1e-9) * 100 AS mape, greatest(CASE WHEN any_value(tests) > 2 THEN stddev_samp(e) ELSE 0 END, sqrt(avg(e * e))) AS sigma FROM errors GROUP BY nation),
    fit AS (SELECT nation, any_value(n) AS n, any_value(b) AS b, min(v) >= 0 AS positive, avg(v) FILTER (x >= n - 3) AS level, regr_intercept(v, x) AS i, regr_slope(v, x) AS s FROM y GROUP BY nation),
    ahead AS (SELECT *, CASE WHEN flat THEN level ELSE i + s * (n + k) END AS v, 1.96 * sigma * sqrt(1 + (k + 1) / n) AS band FROM fit JOIN spread USING (nation), (SELECT unnest(range(3)) AS k) WHERE coalesce(mape, 0) <= 150)
    SELECT nation, strftime(b + to_months(CAST(k + 1 AS INTEGER)), '%Y-%m') AS period, {r("CASE WHEN positive THEN greatest(0, v) ELSE v END", "value")}, {r("CASE WHEN positive THEN greatest(0, v - band) ELSE v - band END", "low")}, {r("CASE WHEN positive THEN greatest(0, v + band) ELSE v + band END", "high")},
      CASE WHEN flat THEN 'level' ELSE 'linear' END AS model, {r("mae", "mae")}, CAST(NULL AS VARCHAR) AS refused FROM ahead
    UNION ALL SELECT nation, NULL, NULL, NULL, NULL, NULL, NULL, why FROM held WHERE why IS NOT NULL UNION ALL SELECT nation, NULL, NULL, NULL, NULL, NULL, NULL, 'unpredictable' FROM spread WHERE mape > 150""", None,
)


# --- the sentence gate as a stream -------------------------------------------


def conversation_pieces(turns: DataFrame) -> DataFrame:
    """Conversations as a service streams them: before each turn its length as a fact, then its text in pieces of 40 characters, with a sentence about its length at the end (wrong for odd turns); a minute a turn.

    Marks that end sentences are taken out of the text, so each turn is two sentences.
    """
    text = F.coalesce("text", F.lit(""))
    length = F.length(text)
    said = F.concat(F.translate(text, ".!?\n\r", "     "), F.lit(". The "), F.coalesce("role", F.lit("user")), F.lit(" wrote "), (length + F.when(F.col("turn") % 2 == 1, 7).otherwise(0)).cast("string"), F.lit(" characters.\n"))
    start = F.col("turn").cast("long") * 10_000_000

    def piece(seq, kind: str, words, value):
        return F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), words.alias("text"), value.cast("double").alias("value"), F.lit("number").alias("unit"))

    none = F.lit(None)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("said") - 1) / 40).cast("int")), lambda k: piece(start + 1 + k, TEXT, F.substr("said", k * 40 + 1, F.lit(40)), none))
    all_pieces = F.concat(F.array(piece(start, FACT, F.lit("characters"), length)), cut, F.array(piece(start + 9_999_999, END, none.cast("string"), none)))
    return turns.withColumn("said", said).select("conv_id", F.timestamp_seconds(60 * (F.col("turn") + 1)).alias("sent"), F.inline(all_pieces))


def _gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences with numbers of all conversations, read as a stream, as the gate judges them."""
    # a pattern finds a file as well as a folder of files; a filter on names would leave the folder's files out
    turns = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parque[t]")
    found, root = gated(conversation_pieces(turns), "conv_id", "sent"), shared_folder(spark, "gate")
    with state_store(spark):
        query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/rows").where("sentence rlike '[0-9]'")


add(
    "gate_stream", _gate_stream,
    """WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, length(coalesce(text, '')) AS n, 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    said AS (SELECT *, n + CASE WHEN turn % 2 = 1 THEN 7 ELSE 0 END AS c FROM t)
    SELECT s.conv_id, s.k AS n, 'The ' || role || ' wrote ' || c || ' characters.' AS sentence,
      c BETWEEN 1900 AND 2099 OR EXISTS (SELECT 1 FROM t WHERE t.conv_id = s.conv_id AND t.turn <= s.turn AND t.n = s.c) AS kept FROM said s""", None,
)


# --- workbooks in parts ------------------------------------------------------


def _workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written as one workbook by many tasks and read back by ranges of its sheets."""
    columns = ("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    path = shared_folder(spark, "orders") + ".xlsx"
    write_workbook(table(spark, sf_dir, "orders").select(*columns[:3], F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")), path, "Orders")
    rows = read_workbook(spark, path, range_bytes=4 << 20).where("row_no > 0")
    kinds = ("long", "string", "double", "string")
    return rows.select(*[F.get("cells", F.lit(i)).cast(kind).alias(c) for i, (c, kind) in enumerate(zip(columns, kinds, strict=True))])


add("workbook_round_trip", _workbook, f"SELECT o_orderkey, o_orderpriority, {r('o_totalprice', 'o_totalprice')}, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders", None)

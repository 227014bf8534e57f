"""Correlation, outliers, arithmetic relations and profitability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import stats
from ..session import written
from .filters import kind_of, typed
from .grouping import BLANK, group_key, with_totals
from .ranks import exact_quantiles, running_totals


def _numeric(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if kind_of(df, c) != "number":
            raise AnalysisError("wrong_type", f'"{c}" does not hold numbers.')


def _r(a: Column, b: Column) -> Column:
    """Pearson's r of two columns that are null together; null below three pairs or without spread (where corr raises)."""
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.count(a) >= 3) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: r and n over all rows where both are present; r is null below three pairs or without spread."""
    _numeric(df, a, b)
    pairs = df.select(typed(df, a).alias("a"), typed(df, b).alias("b")).where("a is not null and b is not null")
    return pairs.agg(_r(F.col("a"), F.col("b")).alias("r"), F.count("*").alias("n"))


class CoMoments:
    """For all pairs of k columns, over the rows where both are present: n, sums, squares and products about a pivot.

    The pivot of a column is the median of the first batch that has values, so
    columns far from zero lose no digits and constant ones stay at exactly zero.
    """

    def __init__(self, k: int) -> None:
        self.pivot = np.full(k, np.nan)
        self.n, self.sum, self.square, self.product = (np.zeros((k, k)) for _ in range(4))

    def add(self, columns: Sequence[np.ndarray]) -> None:
        """A batch; NaN is missing."""
        x = np.stack(columns, axis=1)
        there = ~np.isnan(x)
        for i in np.flatnonzero(np.isnan(self.pivot) & there.any(axis=0)):
            self.pivot[i] = np.median(x[there[:, i], i])
        z = np.where(there, x - self.pivot, 0.0)
        m = there.astype(float)
        self.n += m.T @ m
        self.sum += z.T @ m  # of row i, where column j is present
        self.square += (z * z).T @ m
        self.product += z.T @ z

    def rows(self) -> Iterator[tuple]:
        """(i, j, n, mean of i, of j, squares about them, products about them) of each pair i < j."""
        k = len(self.pivot)
        for i, j in combinations(range(k), 2):
            n = self.n[i, j]
            if n:
                a, b = self.sum[i, j] / n, self.sum[j, i] / n
                yield i, j, n, self.pivot[i] + a, self.pivot[j] + b, max(0.0, self.square[i, j] - n * a * a), max(0.0, self.square[j, i] - n * b * b), self.product[i, j] - n * a * b


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r, n of every pair of columns, from one pass over all rows; r is null below three pairs or without spread.

    Each task multiplies its batches' columns once for all pairs (CoMoments); tasks
    are merged pair by pair about their own means, so nothing cancels.
    """
    _numeric(df, *columns)
    k = len(columns)
    x = df.select(*[typed(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = ("i", "j", "n", "ma", "mb", "sa", "sb", "c")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = CoMoments(k)
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                if batch.num_rows:
                    found.add([np.asarray(v.fill_null(np.nan)) for v in batch.columns])
        rows = list(found.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[at] for r in rows], pa.int32() if at < 2 else pa.float64()) for at in range(len(names))], names=list(names))

    def merged(acc: Column, t: Column) -> Column:
        n = acc["n"] + t["n"]
        da, db, w = t["ma"] - acc["ma"], t["mb"] - acc["mb"], acc["n"] * t["n"] / n
        out = {"n": n, "ma": acc["ma"] + da * t["n"] / n, "mb": acc["mb"] + db * t["n"] / n, "sa": acc["sa"] + t["sa"] + da * da * w, "sb": acc["sb"] + t["sb"] + db * db * w, "c": acc["c"] + t["c"] + da * db * w}
        return F.struct(*[v.alias(name) for name, v in out.items()])

    each = x.mapInArrow(moments, "i int, j int, n double, ma double, mb double, sa double, sb double, c double")
    parts = each.groupBy("i", "j").agg(F.collect_list(F.struct(*names[2:])).alias("t"))  # a struct a task
    total = parts.select("i", "j", F.aggregate(F.slice("t", 2, F.size("t")), F.get("t", F.lit(0)), merged).alias("m"))
    r = F.try_divide(F.col("m.c"), F.sqrt(F.col("m.sa")) * F.sqrt(F.col("m.sb")))
    usable = (F.col("m.n") >= 3) & r.isNotNull() & ~F.isnan(r)
    found = total.select("i", "j", F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"), F.col("m.n").cast("long").alias("n"))
    every = df.sparkSession.createDataFrame([(i, j, columns[i], columns[j]) for i, j in combinations(range(k), 2)], "i int, j int, a string, b string")
    return F.broadcast(every).join(found, ["i", "j"], "left").select("a", "b", "r", F.coalesce("n", F.lit(0)).alias("n")) if k > 1 else every.select("a", "b", F.lit(None).cast("double").alias("r"), F.lit(0).cast("long").alias("n"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rho and n; ranks of ties are averaged.

    Ranks come from the distinct values: their counts, summed in order, so equal
    values cost one row however many there are.
    """
    _numeric(df, a, b)
    pairs = df.select(typed(df, a).alias("a"), typed(df, b).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = written(pairs, "pairs")  # looked at five times

    def ranks(c: str) -> DataFrame:
        counts = pairs.groupBy(c).agg(F.sum("n").alias("m"))
        return running_totals(counts, c, before=F.col("m")).select(c, (F.col("before") + (F.col("m") + 1) / 2).alias(f"r{c}"))

    joined = pairs.join(ranks("a"), "a").join(ranks("b"), "b")
    n = F.sum("n")

    def s(e: Column) -> Column:
        return F.sum(e * F.col("n"))

    x, y = F.col("ra"), F.col("rb")
    cov = s(x * y) / n - s(x) / n * s(y) / n
    va, vb = s(x * x) / n - F.pow(s(x) / n, 2), s(y * y) / n - F.pow(s(y) / n, 2)
    return joined.agg(F.when((va > 0) & (vb > 0) & (n >= 3), cov / F.sqrt(va * vb)).alias("rho"), F.coalesce(n, F.lit(0)).alias("n"))


def tautology(name_a: str, name_b: str, r: float | None, ratio_cv: float | None, related: bool = False) -> str | None:
    """Why a correlation says nothing new, or None."""
    a, b = ("".join(ch for ch in n.lower() if ch.isalnum()) for n in (name_a, name_b))
    if related:
        return "one is calculated from the other"
    if a and b and (a in b or b in a):
        return "the names say that they measure the same thing"
    if r is not None and abs(r) >= 0.99:
        return "they move in lockstep"
    return "their ratio is constant" if ratio_cv is not None and ratio_cv < 0.02 else None


def ratio_spread(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: cv, the deviation of a / b relative to its mean, over rows where b is not 0; null below eight."""
    ratio = F.try_divide(typed(df, a), typed(df, b))
    return df.select(ratio.alias("q")).where("q is not null").agg(F.when((F.count("q") >= 8) & (F.avg("q") != 0), F.stddev_pop("q") / F.abs(F.avg("q"))).alias("cv"))


def outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """One row: n, low, high, outliers, below, above, pct_of_values. Strictly beyond the bounds.

    iqr: 1.5 quartile ranges; zscore: 3 deviations from the mean; mad: 3.5 scaled
    median deviations, the deviation where that is 0. Fewer than eight values: no
    outliers and null bounds.
    """
    _numeric(df, column)
    x = df.select(typed(df, column).alias("x")).where("x is not null")
    if method == "iqr":
        k = threshold or 1.5
        q1, q3 = (F.lit(v).cast("double") for v in exact_quantiles(x, F.col("x"), (0.25, 0.75)))
        bounds = x.agg(F.count("*").alias("n")).select("n", (q1 - k * (q3 - q1)).alias("low"), (q3 + k * (q3 - q1)).alias("high"))
    elif method == "zscore":
        k = threshold or 3.0
        bounds = x.agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).select("n", (F.col("m") - k * F.col("s")).alias("low"), (F.col("m") + k * F.col("s")).alias("high"))
    elif method == "mad":
        k = threshold or 3.5
        (middle,) = exact_quantiles(x, F.col("x"), (0.5,))
        (apart,) = exact_quantiles(x, F.abs(F.col("x") - F.lit(middle)), (0.5,))
        m, d = (F.lit(v).cast("double") for v in (middle, apart))
        width = F.when(d > 0, 1.4826 * d).otherwise(F.stddev_samp("x"))
        bounds = x.agg(F.count("*").alias("n"), (m - k * width).alias("low"), (m + k * width).alias("high"))
    else:
        raise AnalysisError("invalid_method", f"There is no outlier method {method!r}.", "iqr, zscore or mad")
    bounds = bounds.select("n", *[F.when(F.col("n") >= 8, F.col(c)).alias(c) for c in ("low", "high")])
    counted = x.join(F.broadcast(bounds)).groupBy("n", "low", "high").agg(F.count_if(F.col("x") < F.col("low")).alias("below"), F.count_if(F.col("x") > F.col("high")).alias("above"))
    return counted.select("n", "low", "high", (F.col("below") + F.col("above")).alias("outliers"), "below", "above", ((F.col("below") + F.col("above")) / F.col("n") * 100).alias("pct_of_values"))


def relations(df: DataFrame, columns: Sequence[str], least: int = 20, share: float = 0.9) -> list[dict]:
    """Arithmetic identities a = b - c, a = b * c, a = b + c among numeric columns, counted over all rows.

    An identity holds if at least `least` rows have all three and `share` of them
    agree to 1 percent or 0.011. Of the forms of one triple the first counts. Any
    number of columns: what two of them make is held against all others at once, in
    numpy, batch by batch. A task returns one row of counts a form, Spark adds them
    up and only forms that hold reach the driver.
    """
    _numeric(df, *columns)
    columns = list(columns)
    k = len(columns)
    if k < 3:
        return []
    x = df.select(*[typed(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = [("-", b, c) for b, c in permutations(range(k), 2)] + [(form, b, c) for form in "*+" for b, c in combinations(range(k), 2)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, agree = np.zeros((len(pairs), k), np.int64), np.zeros((len(pairs), k), np.int64)
        for batch in batches:
            values = np.stack([np.asarray(v.fill_null(0.0)) for v in batch.columns])
            present = np.stack([np.asarray(v.is_valid()) for v in batch.columns])
            with np.errstate(all="ignore"):
                room = np.maximum(np.abs(values) * 0.01, 0.011)
                for i, (form, b, c) in enumerate(pairs):
                    rows = np.flatnonzero(present[b] & present[c])
                    if not len(rows):
                        continue
                    v, w = values[b, rows], values[c, rows]
                    made = v - w if form == "-" else v * w if form == "*" else v + w
                    there = present[:, rows]
                    known[i] += np.count_nonzero(there, axis=1)
                    agree[i] += np.count_nonzero(there & (np.abs(values[:, rows] - made) <= room[:, rows]), axis=1)
        yield pa.RecordBatch.from_pydict({"form": pa.array(range(len(pairs) * k), pa.int32()), "n": pa.array(known.ravel()), "h": pa.array(agree.ravel())})

    counted = x.mapInArrow(count, "form int, n long, h long").groupBy("form").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    holds = {r["form"]: r["h"] / r["n"] for r in counted.where((F.col("n") >= least) & (F.col("h") >= share * F.col("n"))).collect()}
    number = {pair: i for i, pair in enumerate(pairs)}
    out = []
    for triple in combinations(range(k), 3) if holds else ():
        forms = ((form, a, b, c) for form in ("-", "*", "+") for a, b, c in permutations(triple) if form == "-" or b < c)
        found = next(((f, at) for f in forms if (at := number[f[0], f[2], f[3]] * k + f[1]) in holds), None)
        if found:
            (form, a, b, c), at = found
            out.append({"target": columns[a], "left": columns[b], "right": columns[c], "form": form, "share": holds[at]})
    return out


def profitability(df: DataFrame, dimension: str, revenue: str, profit: str) -> DataFrame:
    """key, revenue, profit, margin, n_rows, revenue_share, profit_share, share_gap, loss; by revenue.

    Margins are sum over sum. Shares are of the totals over all groups.
    """
    _numeric(df, revenue, profit)
    rows = df.select(F.coalesce(group_key(df, dimension), F.lit(BLANK)).alias("key"), typed(df, revenue).alias("r"), typed(df, profit).alias("p"))
    groups = rows.groupBy("key").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("revenue"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("profit"), F.count("*").alias("n_rows"))
    groups = with_totals(groups, all_revenue=F.sum("revenue"), all_profit=F.sum("profit"))
    share = lambda c: F.try_divide(F.col(c), F.nullif(f"all_{c}", F.lit(0.0))) * 100
    out = groups.withColumn("margin", F.when(F.col("revenue") > 0, F.col("profit") / F.col("revenue") * 100)).withColumn("revenue_share", share("revenue")).withColumn("profit_share", share("profit")).drop("all_revenue", "all_profit")
    return out.withColumn("share_gap", F.col("profit_share") - F.col("revenue_share")).withColumn("loss", F.col("profit") < 0).orderBy(F.desc("revenue"), "key")


def high_revenue_low_margin(groups: DataFrame) -> DataFrame:
    """Of the eight largest groups that matter, those whose margin and profit share lag behind."""
    rows = with_totals(groups, overall=F.try_divide(F.sum("profit"), F.sum("revenue")) * 100, all_rows=F.sum("n_rows"))
    material = rows.withColumn("row_share", F.col("n_rows") / F.col("all_rows") * 100).where("revenue_share >= 2 and row_share >= 1").orderBy(F.desc("revenue"), "key").limit(8)
    return material.where("margin < overall - 5 and revenue_share - profit_share > 3").drop("overall", "row_share", "all_rows")


def correlation_strength(r: float) -> str:
    return "strong" if abs(r) >= 0.7 else "moderate" if abs(r) >= 0.4 else "weak"


def correlation_p(r: float, n: int) -> float:
    return stats.r_p_value(r, n)

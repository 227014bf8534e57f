"""Exact quantiles and ranks over many rows, without gathering them in one task.

Approximate quantiles cut the values into ranges; what lies in a range is then counted
or ranked exactly, range by range, and a few totals say how many rows stand before each.
The approximation only balances the work: every result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy asked of approximate quantiles: ranks are off by one in so many at most.
ACCURACY = 10_000
#: Values with their counts that one look into the ranges may bring to the driver.
MOST_VALUES = 100_000
#: Ranges that ranks are worked out in.
RANGES = 256


def _edges(parts: Sequence[float], slack: int) -> list[float]:
    """Where approximate quantiles are asked for: around each part of the rows."""
    return sorted({min(1.0, max(0.0, p + d)) for p in parts for d in (-slack / ACCURACY, slack / ACCURACY)})


def _listed(x: DataFrame, wanted: list[int]) -> dict[int, float]:
    """The values at ranks of a column with few different values, from all of them with their counts."""
    found, seen = {}, 0
    for r in x.groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect():
        found |= {w: r["x"] for w in wanted if seen <= w < seen + r["n"]}
        seen += r["n"]
    return found


def _between(x: DataFrame, wanted: list[int], points: Sequence[float], slack: int) -> dict[int, float]:
    """The values at ranks, given approximate quantiles around them: rows are counted below, at and between the points.

    A rank at a point is that point's value. Ranks between two points are looked for
    strictly between these, so each round leaves rows behind, most of them as a rule.
    """
    points = sorted(set(points))
    zone = sum(((F.col("x") >= p).cast("int") + (F.col("x") > p).cast("int") for p in points), F.lit(0))  # odd: at a point
    counts = x.groupBy(zone.alias("zone")).agg(F.count("*").alias("n"), F.approx_count_distinct("x").alias("kinds"))
    zones = {r["zone"]: r for r in counts.collect()}  # two rows a point and one
    found, before = {}, 0
    for z in range(2 * len(points) + 1):
        if z not in zones:
            continue
        n = zones[z]["n"]
        mine = [w for w in wanted if before <= w < before + n]
        if mine and z % 2:
            found |= dict.fromkeys(mine, points[z // 2])
        elif mine:
            part = x
            if z > 0:
                part = part.where(F.col("x") > points[z // 2 - 1])
            if z < 2 * len(points):
                part = part.where(F.col("x") < points[z // 2])
            inner = [w - before for w in mine]
            at = _listed(part, inner) if zones[z]["kinds"] <= MOST_VALUES else _located(part, inner, n, slack)
            found |= {w + before: v for w, v in at.items()}
        before += n
    return found


def _located(x: DataFrame, wanted: list[int], n: int, slack: int = 2) -> dict[int, float]:
    if n <= MOST_VALUES:
        return _listed(x, wanted)
    edges = _edges([w / n for w in wanted], slack)
    points = x.agg(F.percentile_approx("x", F.array(*map(F.lit, edges)), ACCURACY).alias("q")).first()["q"]
    return _between(x, wanted, points, slack)


def order_statistics(x: DataFrame, ranks: Sequence[int]) -> dict[int, float]:
    """The values at the given ranks (0 is the smallest) of the one non-null column x.

    Approximate quantiles bracket each rank; rows are counted below and inside the
    brackets, and a bracket's values are listed with their counts where they are
    few, bracketed again where not. Rounds are logarithmic in the rows.
    """
    wanted = sorted(set(ranks))
    return _located(x, wanted, x.count()) if wanted else {}


def exact_quantiles(df: DataFrame, column: Column, quantiles: Sequence[float]) -> list[float | None]:
    """Linear interpolation at (n - 1) q of the column's non-null values; None without values."""
    x = df.select(column.cast("double").alias("x")).where("x is not null")
    edges = _edges(quantiles, 2)
    head = x.agg(F.count("x").alias("n"), F.percentile_approx("x", F.array(*map(F.lit, edges)), ACCURACY).alias("q")).first()
    n = head["n"]
    if not n:
        return [None] * len(quantiles)
    places = [(n - 1) * q for q in quantiles]
    wanted = sorted({r for p in places for r in (int(p), min(n - 1, int(p) + 1))})
    at = _listed(x, wanted) if n <= MOST_VALUES else _between(x, wanted, head["q"], 2)
    return [at[int(p)] if p == int(p) else (int(p) + 1 - p) * at[int(p)] + (p - int(p)) * at[int(p) + 1] for p in places]


def range_number(x: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds are below x, by looking first at every sixteenth and then between two of these."""
    if not bounds:
        return F.lit(0)
    step = 16
    below = lambda values: F.size(F.filter(values, lambda b: b < x))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if len(rows) == 1:
        return below(F.array(*map(F.lit, bounds)))
    # the last bound of each row but the last: x lies in the row after those below it
    row = below(F.array(*[F.lit(r[-1]) for r in rows[:-1]]))
    return row * step + below(F.get(F.array(*[F.array(*map(F.lit, r)) for r in rows]), row))


def running_totals(levels: DataFrame, by: str, descending: bool = False, **sums: Column) -> DataFrame:
    """levels with, for each name of sums, the sum over the rows that stand before (by is distinct and numeric, not null).

    Rows are cut into RANGES of `by`; the ranges' sums, a row each, are added up
    and joined back, and a window inside each range does the rest.
    """
    fractions = [i / RANGES for i in range(1, RANGES)]
    bounds = levels.agg(F.percentile_approx(by, F.array(*map(F.lit, fractions)), ACCURACY).alias("q")).first()["q"] or []
    bounds = sorted(set(bounds))
    bucket = range_number(F.col(by), bounds)
    order = F.desc if descending else F.asc
    rows = levels.select("*", *[c.alias(f"__{name}") for name, c in sums.items()]).withColumn("__range", bucket)
    totals = rows.groupBy("__range").agg(*[F.sum(f"__{name}").alias(f"__{name}") for name in sums])
    one = Window.partitionBy(F.lit(1)).orderBy(order("__range"))  # RANGES rows
    ahead = totals.select("__range", *[(F.sum(f"__{name}").over(one) - F.col(f"__{name}")).alias(f"__ahead_{name}") for name in sums])
    inside = Window.partitionBy("__range").orderBy(order(by))
    out = rows.join(F.broadcast(ahead), "__range")
    added = [(F.col(f"__ahead_{name}") + F.sum(f"__{name}").over(inside) - F.col(f"__{name}")).alias(name) for name in sums]
    return out.select(*levels.columns, *added)

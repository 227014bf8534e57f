"""One page of a long order, found by counting instead of by sorting all rows.

The order is read as a list of whole numbers and doubles that ascend with it (text as
seven bytes at a time, descending columns turned round). Approximate quantiles cut the
first of them into zones, the zones' rows are counted exactly, and only a zone that a
page touches is looked into: by narrower zones, or by the next of the list where a
zone is one value. What is sorted in the end is at most MOST rows or so, whatever the offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import kind_of, quoted, typed
from .ranks import ACCURACY

#: Rows of a zone that one task may sort.
MOST = 20_000
#: Quantiles that cut a zone.
CUTS = 64
#: Bytes of text that one whole number holds in their order.
BYTES = 7


def sort_columns(df: DataFrame, column: str | None, descending: bool, tie: Sequence[str]) -> list[Column]:
    """The order of rows: by column, blanks last either way, text without regard to case, then by the tie columns."""
    first = []
    if column:
        c = typed(df, column)
        c = F.lower(c) if kind_of(df, column) == "string" else c
        first = [c.desc_nulls_last() if descending else c.asc_nulls_last()]
    return [*first, *[quoted(t).asc() for t in tie]]


def order_levels(df: DataFrame, c: Column, descending: bool, nulls_last: bool) -> list[Column]:
    """Numbers without null or NaN that sort, one after the other, as c does."""
    kind = df.select(c.alias("c")).schema["c"].dataType.typeName()
    turn = (lambda x: -x) if descending else (lambda x: x)
    null = F.when(c.isNull(), 1 if nulls_last else -1).otherwise(0)
    if kind in ("double", "float"):
        nan = turn(F.when(F.isnan(c), 1).otherwise(0))
        return [F.coalesce(null * 2 + F.when(c.isNull(), 0).otherwise(nan), F.lit(0)), F.coalesce(turn(F.nanvl(c, F.lit(0.0)).cast("double")), F.lit(0.0))]
    if kind in ("string", "char", "varchar"):
        code, long = c.cast("binary"), F.octet_length(c)
        most = df.agg(F.max(long)).first()[0] or 0
        parts = [F.conv(F.rpad(F.hex(F.substring(code, at, BYTES)), 2 * BYTES, "0"), 16, 10).cast("bigint") for at in range(1, most + 1, BYTES)]
        return [null, *[F.coalesce(turn(p), F.lit(0)) for p in parts], F.coalesce(turn(long), F.lit(0))]
    if kind == "decimal":
        return [null, F.coalesce(turn(c), F.lit(0))]
    whole = {"date": F.unix_date, "timestamp": F.unix_micros, "timestamp_ntz": lambda x: F.unix_micros(x.cast("timestamp"))}.get(kind, lambda x: x.cast("bigint"))(c)
    return [null, F.coalesce(F.bitwise_not(whole) if descending else whole, F.lit(0))]  # ~x has no overflow


def _zones(df: DataFrame, level: Column) -> list[tuple[Column, int, bool]]:
    """Where each zone of level lies, its rows, and whether it is one value: at and between approximate quantiles, in order."""
    x = df.select(level.alias("x"))
    fractions = [i / CUTS for i in range(CUTS + 1)]
    points = sorted(set(x.agg(F.percentile_approx("x", F.array(*map(F.lit, fractions)), ACCURACY).alias("q")).first()["q"] or []))
    zone = sum(((F.col("x") >= p).cast("int") + (F.col("x") > p).cast("int") for p in map(F.lit, points)), F.lit(0))  # odd: at a point
    counts = {r["zone"]: r["n"] for r in x.groupBy(zone.alias("zone")).agg(F.count("*").alias("n")).collect()}  # two rows a point and one
    out = []
    for z in sorted(counts):
        if z % 2:
            where = level == points[z // 2]
        else:
            ends = [level > points[z // 2 - 1]] if z else []
            ends += [level < points[z // 2]] if z < 2 * len(points) else []
            where = reduce(lambda a, b: a & b, ends)
        out.append((where, counts[z], z % 2 == 1))
    return out


def _slices(df: DataFrame, levels: Sequence[Column], skip: int, take: int, most: int) -> list[tuple[DataFrame, int, int]]:
    """Parts of df in order, each with how many of its first rows to skip and how many to take then."""
    if not levels:
        return [(df, skip, take)]
    zones = _zones(df, levels[0])
    total = sum(n for _, n, _ in zones)
    if total <= most:
        return [(df, skip, take)] if skip < total else []
    if len(zones) == 1:  # one value, or values that quantiles do not part any more
        return _slices(df, levels[1:], skip, take, most)
    out: list[tuple[DataFrame, int, int]] = []
    small: list[tuple[Column, int, int]] = []  # neighbours that are sorted together

    def close() -> None:
        if small:
            # the page begins in the first of them and ends in the last
            out.append((df.where(reduce(lambda a, b: a | b, (w for w, _, _ in small))), small[0][1], sum(t for _, _, t in small)))
            small.clear()

    before = 0
    for where, n, single in zones:
        low, high = max(skip - before, 0), min(skip + take - before, n)
        before += n
        if low >= high:
            continue
        if n <= most:
            small.append((where, low, high - low))
        else:
            close()
            out += _slices(df.where(where), levels[1:] if single else levels, low, high - low, most)
    close()
    return out


def seek_page(df: DataFrame, column: str | None, descending: bool, tie: Sequence[str], offset: int, limit: int, most: int = MOST) -> DataFrame:
    """Rows offset to offset + limit of df in the order of sort_columns, in that order.

    Ties in all these columns come in any order. An offset beyond the rows gives none.
    df is read twice for each zone that is looked into, its order's columns alone.
    """
    order = sort_columns(df, column, descending, tie)
    keys = [(typed(df, column), descending, True)] if column else []
    if column and kind_of(df, column) == "string":
        keys = [(F.lower(keys[0][0]), descending, True)]
    keys += [(quoted(t), False, False) for t in tie]
    levels: list[Column] = []
    for c, down, last in keys:
        levels += order_levels(df, c, down, last)
    parts = [p.orderBy(*order).offset(skip).limit(take) for p, skip, take in _slices(df, levels, offset, limit, most)]
    return reduce(DataFrame.unionAll, parts).orderBy(*order) if parts else df.limit(0)

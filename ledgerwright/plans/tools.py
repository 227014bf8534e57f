"""The named analyses: checked arguments in, a result with facts or a failure out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import calendar as cal
from ..functions import stats
from ..operators import aggregate as agg
from ..operators import entities as ent
from ..operators import grouping as grp
from ..operators import relations as rel
from ..operators import timeseries as ts
from ..operators.explorer import scenario
from ..operators.filters import OPS, Filter, closest_values, describe, kind_of, quoted
from .context import Context
from .facts import Builder, Failure, Result
from .quality import quality


@dataclass(frozen=True)
class Param:
    """One argument: str, int, number, list or filters; bounds refuse, choices match without regard to case."""

    kind: str = "str"
    default: object = None
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


COMMON = {"filters": Param("filters", ()), "date_from": Param(), "date_to": Param()}
_AGG = Param(choices=agg.AGGREGATES)
_GRAIN = Param(choices=cal.GRAINS)


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable
    params: dict[str, Param]
    gate: str | None
    about: str


def coerce(params: dict[str, Param], given: dict) -> dict:
    """Arguments as their types; unknown ones are dropped, bad ones raise invalid_arguments."""
    out = {}
    for name, p in params.items():
        v = given.get(name)
        if v is None or v == "":
            if p.required:
                raise AnalysisError("invalid_arguments", f"{name} is needed.")
            out[name] = p.default
            continue
        if p.kind in ("int", "number"):
            try:
                v = float(v)
            except (TypeError, ValueError):
                raise AnalysisError("invalid_arguments", f"{name} must be a number.") from None
            v = round(v) if p.kind == "int" else v
            if (p.low is not None and v < p.low) or (p.high is not None and v > p.high):
                raise AnalysisError("invalid_arguments", f"{name} must be from {p.low:g} to {p.high:g}.")
        elif p.kind == "list":
            v = list(v) if isinstance(v, (list, tuple)) else [v]
        elif p.kind == "filters":
            v = list(v) if isinstance(v, (list, tuple)) else [v]
            if len(v) > 12:
                raise AnalysisError("invalid_arguments", "At most 12 filters.")
            filters = []
            for f in v:
                if isinstance(f, dict):
                    op = str(f.get("op", "eq")).lower()
                    if not f.get("column") or op not in OPS:
                        raise AnalysisError("invalid_arguments", "A filter takes a column and an operation.", "One of " + ", ".join(OPS))
                    f = Filter(str(f["column"]), op, f.get("value"), tuple(f.get("values") or ()))
                filters.append(f)
            v = filters
        else:
            v = str(v)
            if p.choices:
                match = next((c for c in p.choices if c.lower() == v.lower()), None)
                if match is None:
                    raise AnalysisError("invalid_arguments", f"{name} must be one of " + ", ".join(p.choices) + ".")
                v = match
        out[name] = v
    return out


class Registry:
    """Tools by name; more can be added."""

    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}

    def add(self, name: str, about: str, gate: str | None = None, **params: Param) -> Callable:
        def put(run: Callable) -> Callable:
            if name in self.tools:
                raise ValueError(f"there is a tool {name!r} already")
            self.tools[name] = Tool(name, run, COMMON | params, gate, about)
            return run

        return put

    def available(self, ctx: Context) -> list[str]:
        caps = ctx.capabilities()
        return [t.name for t in self.tools.values() if not t.gate or caps.get(t.gate) is None]

    def call(self, ctx: Context, name: str, **given: object) -> Result | Failure:
        tool = self.tools.get(name)
        if tool is None:
            return Failure(name, "unknown_tool", f"There is no tool {name!r}.", ", ".join(self.tools))
        try:
            if tool.gate and (why := ctx.capabilities().get(tool.gate)):
                return Failure(name, "not_available", why)
            args = coerce(tool.params, given)
            scope = ctx.scope(args.pop("filters"), args.pop("date_from"), args.pop("date_to"))
            out = Builder(name)
            result = tool.run(scope, out, **args)
            result.provenance |= {"tool": name, "params": {k: v for k, v in given.items() if k != "filters"}, "filters": [describe(f) for f in scope.filters], "rows": scope.count()}
            return result
        except AnalysisError as e:
            return Failure(name, e.code, e.message, e.hint)


registry = Registry()
tool = registry.add


def _metric(ctx: Context, metric: str | None, how: str | None) -> tuple[str | None, str, str, str]:
    """(column, aggregate, unit, label) of a metric argument: none is the lead metric or a count of rows."""
    if metric is not None and how in ("count", "distinct_count"):
        c = ctx.column(metric)
        return c.name, how, "count", f"{'distinct ' if how == 'distinct_count' else ''}{c.name}"
    if metric is None and how == "count":
        return None, "count", "count", "rows"
    c = ctx.measure(metric)
    if c is None:
        return None, "count", "count", "rows"
    how = how or c.agg
    ctx.check_agg(c, how)
    return c.name, how, "count" if how in ("count", "distinct_count") else c.unit, f"{how} of {c.name}" if how != "sum" else c.name


def _scale(unit: str, ctx: Context, column: str | None) -> float:
    """Fractions of a percent column are shown times 100."""
    high = (ctx.profile.columns[column].stats.get("max") or 0) if column else 0
    return 100.0 if unit == "percent" and abs(high) <= 1 else 1.0


def _rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


@tool("describe_dataset", "What the data hold")
def describe_dataset(ctx: Context, out: Builder) -> Result:
    p = ctx.profile
    n = out.fact("rows", p.n_rows, "count")
    k = out.fact("columns", len(p.columns), "count")
    data = {"rows": p.n_rows, "columns": [{"name": c.name, "kind": c.kind, "role": c.role, "meaning": c.meaning, "additive": c.additive, "unit": c.unit} for c in p.columns.values()]}
    data |= {"date": p.date, "grain": p.grain, "lead": p.lead, "currency": p.currency}
    return out.done(data, f"The data have {n} rows and {k} columns." + (f" The main metric is {p.lead}." if p.lead else ""), {})


@tool("describe_column", "One column's profile", column=Param(required=True))
def describe_column(ctx: Context, out: Builder, column: str) -> Result:
    c = ctx.column(column)
    n, d, m = out.fact("values", c.count, "count"), out.fact("distinct values", c.distinct, "count"), out.fact("blank", c.missing_pct, "percent")
    data = {"name": c.name, "kind": c.kind, "role": c.role, "meaning": c.meaning, "count": c.count, "distinct": c.distinct, "missing_pct": c.missing_pct, "stats": {k: str(v) if hasattr(v, "isoformat") else v for k, v in c.stats.items()}}
    return out.done(data, f"{c.name} is a {c.role} with {n} values, about {d} of them distinct; {m} is blank.", {})


@tool("list_values", "A column's values with their counts", column=Param(required=True), limit=Param("int", 20, low=1, high=100), contains=Param())
def list_values(ctx: Context, out: Builder, column: str, limit: int, contains: str | None) -> Result:
    c = ctx.dimension(column)
    rows = _rows(agg.value_counts(ctx.df, c.name, limit, contains))
    shown = [f"{r['value']} ({out.fact(r['value'], r['n'], 'count')})" for r in rows[:10]]
    return out.done({"values": rows}, f"{c.name}: " + (", ".join(shown) or "no values") + ".", {})


@tool("find_value", "Values that may have been meant", column=Param(required=True), query=Param(required=True))
def find_value(ctx: Context, out: Builder, column: str, query: str) -> Result:
    c = ctx.column(column)
    rows = _rows(closest_values(ctx.df, c.name, query, 8))
    return out.done({"matches": rows}, ("Closest: " + ", ".join(r["value"] for r in rows) if rows else "Nothing is close") + ".", {})


@tool("aggregate", "One figure", metric=Param(), agg=_AGG, percentile=Param("number", 50.0, low=0, high=100))
def aggregate(ctx: Context, out: Builder, metric: str | None, agg: str | None, percentile: float) -> Result:
    from ..operators.aggregate import aggregate as one

    column, how, unit, label = _metric(ctx, metric, agg)
    value = one(ctx.df, how, column, percentile).first()["value"]
    value = value * _scale(unit, ctx, column) if value is not None and unit == "percent" else value
    shown = out.fact(label, value, unit)
    return out.done({"metric": column, "agg": how, "value": value}, f"The {label} is {shown}.", {})


def _ranking(ctx: Context, out: Builder, dimension: str | None, metric: str | None, how: str | None, percentile: float, n: int, order: str, min_rows: int | None) -> Result:
    d = ctx.dimension(dimension)
    column, how, unit, label = _metric(ctx, metric, how)
    additive = column is None or how in ("count", "distinct_count") or ctx.profile.columns[column].additive
    least = min_rows if min_rows is not None else 1 if additive else 5
    rows = _rows(grp.ranked(ctx.df, d.name, column, how, n, order == "asc", least, percentile))
    if not rows:
        raise AnalysisError("no_groups", f"No group of {d.name} has {least} row(s).")
    k = _scale(unit, ctx, column)
    rows = sorted(({**r, "value": r["value"] * k} for r in rows), key=lambda r: r["rank"])
    blank = ctx.df.where(F.col(f"`{d.name}`").isNull()).count()
    if blank:
        out.caveats.append(f"{out.fact('rows without ' + d.name, blank, 'count')} rows have no {d.name} and are left out.")
    shown = ", ".join(f"{r['key']} {out.fact(r['key'], r['value'], unit)}" for r in rows)
    for r in rows:
        if r["share"] is not None:
            out.fact(f"share of {r['key']}", r["share"], "percent")
    chart = {"kind": "bar", "x": [r["key"] for r in rows], "y": [r["value"] for r in rows], "unit": unit}
    return out.done({"groups": rows, "dimension": d.name, "metric": column, "agg": how}, f"{'Lowest' if order == 'asc' else 'Highest'} {label} by {d.name}: {shown}.", {}, chart)


_RANK = {"dimension": Param(), "metric": Param(), "agg": _AGG, "percentile": Param("number", 50.0, low=0, high=100), "order": Param("str", "desc", choices=("asc", "desc")), "min_rows": Param("int", low=1, high=1_000_000)}


@tool("group_by", "A metric by category", "group", **_RANK, limit=Param("int", 10, low=1, high=50))
def group_by(ctx: Context, out: Builder, dimension, metric, agg, percentile, order, min_rows, limit) -> Result:
    return _ranking(ctx, out, dimension, metric, agg, percentile, limit, order, min_rows)


@tool("top_n", "The first or last categories", "group", **_RANK, n=Param("int", 5, low=1, high=50))
def top_n(ctx: Context, out: Builder, dimension, metric, agg, percentile, order, min_rows, n) -> Result:
    return _ranking(ctx, out, dimension, metric, agg, percentile, n, order, min_rows)


@tool("share_of_total", "One category's part of the whole", "group", dimension=Param(required=True), value=Param(required=True), metric=Param(), agg=_AGG)
def share_of_total(ctx: Context, out: Builder, dimension, value, metric, agg) -> Result:
    d = ctx.dimension(dimension)
    column, how, unit, label = _metric(ctx, metric, agg)
    if how not in ("sum", "count"):
        raise AnalysisError("not_additive", "Shares take sums or counts.")
    row = grp.share_of_total(ctx.df, d.name, column, how).where(F.lower("key") == value.strip().lower()).first()
    if row is None:
        near = [r["value"] for r in closest_values(ctx.df, d.name, value, 3).collect()] if d.kind == "string" else []
        raise AnalysisError("unknown_value", f'"{value}" is not a value of {d.name}.', ", ".join(near) or None)
    v, s, r = out.fact(row["key"], row["value"], unit), out.fact("share", row["share"], "percent"), out.fact("rank", row["rank"], "count")
    return out.done(row.asDict(), f"{row['key']} has {v} of {label}, {s} of the total, rank {r}.", {})


@tool("compare_groups", "Two categories side by side", "group", dimension=Param(required=True), group_a=Param(required=True), group_b=Param(required=True), metric=Param(), agg=_AGG)
def compare_groups(ctx: Context, out: Builder, dimension, group_a, group_b, metric, agg) -> Result:
    d = ctx.dimension(dimension)
    column, how, unit, label = _metric(ctx, metric, agg)
    row = grp.compare_groups(ctx.df, d.name, group_a, group_b, column, how).first().asDict()
    if row["value_a"] is None or row["value_b"] is None:
        raise AnalysisError("unknown_value", "One of the groups has no values.")
    k = _scale(unit, ctx, column)
    a, b, diff = out.fact(group_a, row["value_a"] * k, unit), out.fact(group_b, row["value_b"] * k, unit), out.fact("difference", row["difference"] * k, unit)
    more = f", {out.fact('difference in percent', row['pct'], 'percent')}" if row["pct"] is not None else ""
    return out.done(row, f"{label}: {group_a} {a}, {group_b} {b}; the difference is {diff}{more}.", {})


@tool("cross_tab", "A metric by two categories", "group", row_dimension=Param(required=True), column_dimension=Param(required=True), metric=Param(), agg=Param(choices=("sum", "avg", "count")))
def cross_tab(ctx: Context, out: Builder, row_dimension, column_dimension, metric, agg) -> Result:
    a, b = ctx.dimension(row_dimension), ctx.dimension(column_dimension)
    if a.name == b.name:
        raise AnalysisError("invalid_arguments", "A cross-tab takes two different columns.")
    column, how, unit, label = _metric(ctx, metric, agg)
    cells = _rows(grp.cross_tab(ctx.df, a.name, b.name, column, how).limit(40))
    if not cells:
        raise AnalysisError("no_groups", "There are no values to cross.")
    k = _scale(unit, ctx, column)
    cells = [{**c, "value": c["value"] * k} for c in cells]
    shown = ", ".join(f"{c['row_key']} × {c['column_key']} {out.fact(c['row_key'] + ' × ' + c['column_key'], c['value'], unit)}" for c in cells[:5])
    matrix: dict[str, dict[str, float]] = {}
    for c in cells:
        matrix.setdefault(c["row_key"], {})[c["column_key"]] = c["value"]
    return out.done({"cells": cells, "matrix": matrix}, f"Highest {label}: {shown}.", {}, {"kind": "heatmap", "cells": cells, "unit": unit})


@tool("pareto", "How few categories make most of a metric", "group", dimension=Param(), metric=Param(), agg=_AGG)
def pareto(ctx: Context, out: Builder, dimension, metric, agg) -> Result:
    d = ctx.dimension(dimension)
    column, how, _, label = _metric(ctx, metric, agg)
    if how not in ("sum", "count"):
        raise AnalysisError("not_additive", "Concentration takes sums or counts.")
    row = grp.pareto(ctx.df, d.name, column, how).first().asDict()
    k, h, e = (out.fact(n, row[c], "count") for n, c in (("groups", "groups"), ("groups to half", "reach_50"), ("groups to four fifths", "reach_80")))
    half, most = out.fact("half", 50.0, "percent"), out.fact("four fifths", 80.0, "percent")
    return out.done(row, f"Of {k} values of {d.name}, {h} make {half} of {label} and {e} make {most}.", {})


@tool("distribution", "How a measure is spread", column=Param(), bins=Param("int", 20, low=4, high=40))
def distribution(ctx: Context, out: Builder, column, bins) -> Result:
    c = ctx.measure(column)
    if c is None:
        raise AnalysisError("no_measure", "There is no numeric measure.")
    s = agg.numeric_stats(ctx.df, c.name).first().asDict()
    h = _rows(agg.histogram(ctx.df, c.name, bins).orderBy("bin"))
    k = _scale(c.unit, ctx, c.name)
    med, lo, hi = (out.fact(n, s[x] * k if s[x] is not None else None, c.unit) for n, x in (("median", "median"), ("5th percentile", "p05"), ("95th percentile", "p95")))
    return out.done({"stats": s, "histogram": h}, f"The median {c.name} is {med}; nine in ten values lie between {lo} and {hi}.".replace("nine in ten", "most"), {}, {"kind": "histogram", "bins": h})


_SERIES = {"metric": Param(), "agg": _AGG, "grain": _GRAIN}


def _series(ctx: Context, metric: str | None, how: str | None, grain: str | None) -> tuple[ts.Series, str, str, bool, str | None]:
    """(series, unit, label, additive, column)."""
    if metric and metric.strip().lower() == "margin" and "margin" not in ctx.profile.columns:
        return ctx.series("margin", None, grain), "percent", "margin", False, "margin"
    column, how, unit, label = _metric(ctx, metric, how)
    if how in ("median", "std", "percentile"):
        raise AnalysisError("invalid_aggregate", f"A series cannot be built with {how}.")
    s = ctx.series(column, how, grain)
    k = _scale(unit, ctx, column)
    if k != 1:
        s = ts.Series(s.grain, tuple(ts.Point(p.ord, p.n, p.value * k) for p in s.points), s.trimmed_start, s.trimmed_end, s.observed)
    return s, unit, label, column is None or how in ("sum", "count"), column


def _partial(out: Builder, s: ts.Series) -> None:
    left = s.trimmed_start + s.trimmed_end
    if left:
        out.caveats.append(f"{out.fact('partial periods', left, 'count')} partial period(s) at the ends are left out.")


@tool("time_series", "A metric over time", "time", **_SERIES, limit=Param("int", 24, low=3, high=120))
def time_series(ctx: Context, out: Builder, metric, agg, grain, limit) -> Result:
    s, unit, label, _, _ = _series(ctx, metric, agg, grain)
    _partial(out, s)
    typical = stats.median([abs(v) for v in s.values]) or 0.0
    points, before = [], None
    for p in s.points:
        usable = before is not None and p.ord - before.ord == 1 and abs(before.value) >= max(1e-9, 0.1 * typical)
        points.append({"ord": p.ord, "period": cal.key_of(p.ord, s.grain), "value": p.value, "n": p.n, "pct_change": stats.pct_change(p.value, before.value) if usable else None})
        before = p
    points = points[-limit:]
    if not points:
        raise AnalysisError("not_enough_data", "There are no periods with values.")
    last = points[-1]
    shown = out.fact(f"{label} in {last['period']}", last["value"], unit)
    for p in points[:-1]:
        out.fact(f"{label} in {p['period']}", p["value"], unit)
    change = f", {out.fact('change', last['pct_change'], 'percent')} against the period before" if last["pct_change"] is not None else ""
    return out.done({"points": points, "grain": s.grain}, f"{label} was {shown} in {last['period']}{change}.", {"grain": s.grain}, {"kind": "line", "x": [p["period"] for p in points], "y": [p["value"] for p in points], "unit": unit})


_PERIODS = {"period_a": Param(), "period_b": Param(), "compare_to": Param("str", "previous", choices=("previous", "year_ago"))}


def _sides(ctx: Context, metric, how, period_a, period_b, compare_to):
    column, how, unit, label = _metric(ctx, metric, how)
    a, b, grain = ctx.periods(period_a, period_b, compare_to, column, how)
    row = ts.compare_periods(ctx.df, ctx.profile.date, a, b, column, how, grain=grain).first().asDict()
    if row["value_a"] is None or row["value_b"] is None:
        raise AnalysisError("not_enough_data", "One of the periods has no values.")
    return column, how, unit, label, a, b, grain, row


@tool("compare_periods", "Two periods side by side", "time", metric=Param(), agg=_AGG, **_PERIODS, breakdown_dimension=Param(), top_n=Param("int", 5, low=1, high=20))
def compare_periods(ctx: Context, out: Builder, metric, agg, period_a, period_b, compare_to, breakdown_dimension, top_n) -> Result:
    column, how, unit, label, a, b, grain, row = _sides(ctx, metric, agg, period_a, period_b, compare_to)
    va, vb, ch = out.fact(f"{label} in {a}", row["value_a"], unit), out.fact(f"{label} in {b}", row["value_b"], unit), out.fact("change", row["change"], unit)
    pct = row["pct"]
    direction = "flat" if pct is not None and abs(pct) < 0.5 else "up" if row["change"] > 0 else "down"
    text = f"{label} was {va} in {a} and {vb} in {b}: {direction} by {ch}" + (f" ({out.fact('change in percent', pct, 'percent')})." if pct is not None else ".")
    data = row | {"period_a": a, "period_b": b, "direction": direction}
    span = ctx.span()
    for key in (a, b):
        first, last = cal.range_of_key(key, grain)
        if span and (span[1] < last or span[0] > first):
            out.caveats.append(f"{key} is not complete in the data.")
    if breakdown_dimension:
        d = ctx.dimension(breakdown_dimension)
        moved = ts.compare_periods(ctx.df, ctx.profile.date, a, b, column, how, d.name, grain)
        groups = _rows(moved.limit(top_n))
        data |= {"groups": groups, "pattern": ts.pattern_of(moved) if how in ("sum", "count") else None}
        text += " Largest moves: " + ", ".join(f"{g['key']} {out.fact('change of ' + g['key'], g['change'], unit)}" for g in groups) + "."
    return out.done(data, text, {"grain": grain})


@tool("explain_change", "What drove a change", "time", metric=Param(), **_PERIODS)
def explain_change(ctx: Context, out: Builder, metric, period_a, period_b, compare_to) -> Result:
    column, how, unit, label, a, b, grain, row = _sides(ctx, metric, None, period_a, period_b, compare_to)
    if how not in ("sum", "count"):
        raise AnalysisError("not_additive", "Only sums and counts can be taken apart.")
    charts = [d.name for d in ctx.profile.chart_dimensions()[:5]]
    groups: dict[str, list[dict]] = {d: [] for d in charts}
    if charts:  # a chart dimension has at most 60 labels
        for r in _rows(ts.compare_by(ctx.df, ctx.profile.date, a, b, charts, column if how == "sum" else None, grain)):
            groups[r.pop("dimension")].append(r)
    found = []
    for d in charts:
        own = sorted(groups[d], key=lambda g: (-abs(g["change"]), g["key"]))
        found.append({"dimension": d, "pattern": ts.change_pattern([g["change"] for g in own]), "groups": own[:5]})
    rank = {"concentrated": 0, "broad-based": 1, "mixed": 2, "none": 3}
    found.sort(key=lambda f: rank[f["pattern"]])
    va, vb, ch = out.fact(f"{label} in {a}", row["value_a"], unit), out.fact(f"{label} in {b}", row["value_b"], unit), out.fact("change", row["change"], unit)
    text = f"{label} went from {vb} in {b} to {va} in {a}, a change of {ch}."
    if found and found[0]["groups"]:
        best = found[0]
        text += f" By {best['dimension']} the change is {best['pattern']}: " + ", ".join(f"{g['key']} {out.fact('change of ' + g['key'], g['change'], unit)}" for g in best["groups"][:3]) + "."
    data = row | {"period_a": a, "period_b": b, "dimensions": found}
    if column and ctx.capabilities()["margin"] is None and column == _money(ctx)[1]:  # a change of profit is a matter of volume and margin
        bridge = ts.volume_vs_margin(ctx.df, ctx.profile.date, a, b, *_money(ctx)).first().asDict()
        if bridge["margin_a"] is not None and bridge["margin_b"] is not None:
            v, m = (out.fact(n, bridge[c], unit) for n, c in (("volume effect", "volume_effect"), ("margin effect", "margin_effect")))
            text += f" Volume made {v} of it, the margin {m}."
            data["bridge"] = bridge
    return out.done(data, text, {"grain": grain})


@tool("trend", "Whether a metric rises or falls", "trend", **_SERIES)
def trend(ctx: Context, out: Builder, metric, agg, grain) -> Result:
    s, unit, label, additive, _ = _series(ctx, metric, agg, grain)
    _partial(out, s)
    points = ts.contiguous(s.points, additive)
    if not points or len(points) < 4:
        raise AnalysisError("not_enough_data", "A trend takes four periods without large holes.")
    t = ts.trend([p.value for p in points])
    slope = out.fact("slope per period", t["slope_pct"], "percent")
    out.fact("p value", t["p_value"], "ratio")
    return out.done(t, f"{label} is {t['direction']}" + (f", by {slope} a period." if t["significant"] else "; no trend stands out."), {"grain": s.grain})


@tool("anomalies", "Periods out of line", "trend", **_SERIES)
def anomalies(ctx: Context, out: Builder, metric, agg, grain) -> Result:
    s, unit, label, additive, _ = _series(ctx, metric, agg, grain)
    _partial(out, s)
    points = ts.contiguous(s.points, additive)
    if not points or len(points) < 8:
        raise AnalysisError("not_enough_data", "It takes eight periods without large holes.")
    found = [a | {"period": cal.key_of(a["ord"], s.grain)} for a in ts.anomalies(points)[:6]]
    shown = ", ".join(f"{a['period']} {out.fact(label + ' in ' + a['period'], a['value'], unit)} (expected {out.fact('expected in ' + a['period'], a['expected'], unit)})" for a in found)
    return out.done({"anomalies": found}, f"Unusual periods of {label}: {shown}." if found else f"No period of {label} stands out.", {"grain": s.grain})


@tool("seasonality", "Whether a metric follows the calendar", "seasonality", **_SERIES)
def seasonality(ctx: Context, out: Builder, metric, agg, grain) -> Result:
    s, _, label, additive, _ = _series(ctx, metric, agg, grain)
    found = ts.seasonality(ts.contiguous(s.points, additive) or [], s.grain)
    if found is None:
        raise AnalysisError("not_enough_data", "It takes two full cycles without holes, by month or by day.")
    names = cal.MONTHS if found["length"] == 12 else ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    high, low = out.fact("peak", (found["index"][found["peak"]] - 1) * 100, "percent"), out.fact("trough", (found["index"][found["trough"]] - 1) * 100, "percent")
    text = f"{label} peaks in {names[found['peak']]} ({high} against the average) and is lowest in {names[found['trough']]} ({low})." if found["significant"] else f"{label} shows no clear season."
    return out.done({**found, "index": {names[k]: v for k, v in found["index"].items()}}, text, {"grain": s.grain})


@tool("forecast", "The next periods, with a range", "forecast", **_SERIES, horizon=Param("int", 3, low=1, high=12))
def forecast(ctx: Context, out: Builder, metric, agg, grain, horizon) -> Result:
    s, unit, label, additive, _ = _series(ctx, metric, agg, grain)
    _partial(out, s)
    found = ts.forecast(s.points, s.grain, horizon, additive)
    shown = ", ".join(f"{p['period']} {out.fact('forecast for ' + p['period'], p['value'], unit)} ({out.fact('low', p['low'], unit)} to {out.fact('high', p['high'], unit)})" for p in found["points"])
    if found["mape"] is not None:
        out.caveats.append(f"Past forecasts were off by {out.fact('average error', found['mape'], 'percent')} on average.")
    return out.done(found, f"Forecast of {label}: {shown}.", {"grain": s.grain, "model": found["model"]})


def _money(ctx: Context) -> tuple[str, str]:
    revenue, profit = ctx.profile.meaning("revenue", role="measure"), ctx.profile.meaning("profit", role="measure")
    return revenue.name, profit.name


@tool("volume_vs_margin", "A profit change as volume and margin", "margin", **_PERIODS)
def volume_vs_margin(ctx: Context, out: Builder, period_a, period_b, compare_to) -> Result:
    revenue, profit = _money(ctx)
    a, b, grain = ctx.periods(period_a, period_b, compare_to, revenue, "sum")
    row = ts.volume_vs_margin(ctx.df, ctx.profile.date, a, b, revenue, profit).first().asDict()
    if row["margin_a"] is None or row["margin_b"] is None:
        raise AnalysisError("not_enough_data", "One of the periods has no revenue.")
    ch, v, m = (out.fact(n, row[c], "currency") for n, c in (("profit change", "profit_change"), ("volume effect", "volume_effect"), ("margin effect", "margin_effect")))
    return out.done(row | {"period_a": a, "period_b": b}, f"Profit changed by {ch} from {b} to {a}: {v} from volume, {m} from margin.", {"grain": grain})


@tool("profitability", "Margins overall and by category", "margin", dimension=Param(), limit=Param("int", 10, low=1, high=30))
def profitability(ctx: Context, out: Builder, dimension, limit) -> Result:
    revenue, profit = _money(ctx)
    d = ctx.dimension(dimension)
    groups = rel.profitability(ctx.df, d.name, revenue, profit)
    total = groups.agg(F.sum("revenue").alias("r"), F.sum("profit").alias("p"), F.count_if("loss").alias("l")).first()
    overall = total["p"] / total["r"] * 100 if total["r"] else None
    rows = _rows(groups.where(F.col("key") != grp.BLANK).limit(limit))
    m, n = out.fact("overall margin", overall, "percent"), out.fact("groups with a loss", total["l"], "count")
    shown = ", ".join(f"{r['key']} {out.fact('margin of ' + r['key'], r['margin'], 'percent')}" for r in rows if r["margin"] is not None)
    lag = _rows(rel.high_revenue_low_margin(groups))
    return out.done({"overall_margin": overall, "groups": rows, "lagging": lag}, f"The margin is {m}; {n} group(s) of {d.name} make a loss. By {d.name}: {shown}.", {})


@tool("correlation", "Whether measures move together", "correlation", column_a=Param(), column_b=Param(), top_k=Param("int", 5, low=1, high=10))
def correlation(ctx: Context, out: Builder, column_a, column_b, top_k) -> Result:
    known = [{r["target"], r["left"], r["right"]} for r in ctx.profile.relations]

    def judged(a: str, b: str, r: float | None, n: int) -> dict:
        cv = rel.ratio_spread(ctx.df, a, b).first()["cv"] if r is not None and abs(r) > 0.9 else None
        why = rel.tautology(a, b, r, cv, any({a, b} <= k for k in known))
        money = [ctx.profile.columns[c].unit == "currency" or ctx.profile.columns[c].meaning == "quantity" for c in (a, b)]
        return {"a": a, "b": b, "r": r, "n": n, "p_value": rel.correlation_p(r, n) if r is not None else None, "tautology": why, "structural": all(money)}

    def ranked(a: str, b: str) -> dict:
        """Rank correlation and up to 200 points to draw, spread over the rows."""
        n = max(1, ctx.count())
        points = ctx.df.select(F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")).where("x is not null and y is not null")
        drawn = points.where(F.pmod(F.xxhash64("x", "y"), F.lit(n)) < 400).limit(200)
        return {"rho": rel.spearman(ctx.df, a, b).first()["rho"], "points": [(p["x"], p["y"]) for p in drawn.collect()]}

    if column_a and column_b:
        a, b = ctx.measure(column_a).name, ctx.measure(column_b).name
        row = rel.correlation(ctx.df, a, b).first()
        if row["r"] is None:
            raise AnalysisError("not_enough_data", "There are too few different values in common.")
        found = judged(a, b, row["r"], row["n"]) | ranked(a, b)
        shown, n = out.fact(f"correlation of {a} and {b}", row["r"], "ratio"), out.fact("pairs", row["n"], "count")
        text = f"{a} and {b} have a {rel.correlation_strength(row['r'])} correlation of {shown} over {n} rows." + (f" It says little: {found['tautology']}." if found["tautology"] else "")
        return out.done(found, text, {})
    names = [c.name for c in ctx.profile.with_role("measure")][:12]
    pairs = [judged(r["a"], r["b"], r["r"], r["n"]) for r in rel.correlation_pairs(ctx.df, names).collect()]
    real = sorted((p for p in pairs if p["r"] is not None and not p["tautology"] and not p["structural"]), key=lambda p: -abs(p["r"]))[:top_k]
    real = [p | ({"rho": rel.spearman(ctx.df, p["a"], p["b"]).first()["rho"]} if i < 3 else {}) for i, p in enumerate(real)]
    shown = ", ".join(f"{p['a']} and {p['b']} {out.fact(p['a'] + ' and ' + p['b'], p['r'], 'ratio')}" for p in real)
    return out.done({"pairs": real, "excluded": [p for p in pairs if (p["a"], p["b"]) not in {(q["a"], q["b"]) for q in real}]}, f"Strongest correlations: {shown}." if real else "No pair of measures says something new.", {})


@tool("outliers", "Unusual values of a measure", "outliers", column=Param(), method=Param("str", "iqr", choices=("iqr", "zscore", "mad")))
def outliers(ctx: Context, out: Builder, column, method) -> Result:
    c = ctx.measure(column)
    row = rel.outliers(ctx.df, c.name, method).first()
    if row is None or row["low"] is None:
        raise AnalysisError("not_enough_data", "It takes eight values.")
    k = _scale(c.unit, ctx, c.name)
    n, pct = out.fact("outliers", row["outliers"], "count"), out.fact("share of values", row["pct_of_values"], "percent")
    lo, hi = out.fact("lower bound", row["low"] * k, c.unit), out.fact("upper bound", row["high"] * k, c.unit)
    value = F.col(f"`{c.name}`").cast("double")
    beyond = ctx.df.where((value < row["low"]) | (value > row["high"]))
    examples = _rows(beyond.orderBy(F.desc(F.greatest(F.lit(row["low"]) - value, value - F.lit(row["high"]))), *map(quoted, beyond.columns)).limit(5))
    return out.done(row.asDict() | {"examples": examples}, f"{n} values of {c.name} ({pct}) lie outside {lo} to {hi}.", {"method": method})


@tool("customer_analysis", "Customers: how many, how loyal, how concentrated", "customers", customer=Param(), metric=Param(), top_n=Param("int", 5, low=1, high=25))
def customer_analysis(ctx: Context, out: Builder, customer, metric, top_n) -> Result:
    c = ctx.column(customer) if customer else ctx.profile.meaning("customer")
    m = ctx.measure(metric) if metric or ctx.profile.lead else None
    column = m.name if m and m.additive else None
    s = ent.customer_summary(ctx.df, c.name, column).first().asDict()
    top = _rows(ent.per_customer(ctx.df, c.name, column).orderBy(F.desc("value"), "customer").limit(top_n))
    n, rr, td = out.fact("customers", s["customers"], "count"), out.fact("repeat rate", s["repeat_rate"], "percent"), out.fact("share of the top tenth", s["top_decile_share"], "percent")
    unit = m.unit if column else "count"
    shown = ", ".join(f"{t['customer']} {out.fact(t['customer'], t['value'], unit)}" for t in top)
    data = s | {"top": top, "concentration": (r.asDict() if (r := grp.concentration(ent.per_customer(ctx.df, c.name, column)).first()) else None)}
    if ctx.profile.date:
        data["new_vs_returning"] = _rows(ent.new_vs_returning(ctx.df, c.name, ctx.profile.date, ctx.profile.grain))
    return out.done(data, f"There are {n} customers; {rr} came back, and the top tenth makes {td}. Largest: {shown}.", {})


@tool("cohort_retention", "How many customers stay", "cohort", customer=Param(), grain=_GRAIN, max_cohorts=Param("int", 8, low=2, high=24), max_offset=Param("int", 6, low=1, high=24))
def cohort_retention(ctx: Context, out: Builder, customer, grain, max_cohorts, max_offset) -> Result:
    c = ctx.column(customer) if customer else ctx.profile.meaning("customer")
    grain = grain or ctx.profile.grain
    points = ctx.series(None, "count", grain).points
    if len(points) < 3:
        raise AnalysisError("not_enough_data", "It takes three complete periods.")
    cells = _rows(ent.cohort_retention(ctx.df, c.name, ctx.profile.date, grain, points[0].ord, points[-1].ord, max_cohorts, max_offset))
    average = {}
    for k in range(1, max_offset + 1):
        own = [x for x in cells if x["cohort"] + k <= points[-1].ord and x["offset"] == 0]
        active = sum(x["active"] for x in cells if x["offset"] == k and any(o["cohort"] == x["cohort"] for o in own))
        size = sum(o["size"] for o in own)
        if size:
            average[k] = active / size * 100
    shown = ", ".join(f"{out.fact(f'retention after {k}', v, 'percent')} after {out.fact('periods', k, 'count')}" for k, v in list(average.items())[:3])
    return out.done({"cells": cells, "average": average}, f"Customers active again: {shown} period(s)." if shown else "No cohort is old enough.", {"grain": grain})


@tool("funnel", "How far entities get", "funnel", stage_column=Param(), stage_order=Param("list"), entity_column=Param())
def funnel(ctx: Context, out: Builder, stage_column, stage_order, entity_column) -> Result:
    c = ctx.column(stage_column) if stage_column else ctx.profile.meaning("stage")
    if kind_of(ctx.df, c.name) != "string":
        raise AnalysisError("wrong_type", f'"{c.name}" does not hold stage names.')
    labels = [r["value"] for r in agg.value_counts(ctx.df, c.name, 50).collect()]
    order = stage_order or ent.stage_order(labels)
    if not order:
        raise AnalysisError("invalid_arguments", "The order of the stages is not known.", "Give stage_order; the stages are " + ", ".join(labels))
    rows = _rows(ent.funnel(ctx.df, c.name, order, ctx.column(entity_column).name if entity_column else None))
    drops = [r for r in rows if r["from_previous"] is not None]
    worst = min(drops, key=lambda r: r["from_previous"]) if drops else None
    shown = ", ".join(f"{r['stage']} {out.fact(r['stage'], r['reached'], 'count')}" for r in rows)
    text = f"Reached: {shown}." + (f" The largest drop is at {worst['stage']}: {out.fact('kept at ' + worst['stage'], worst['from_previous'], 'percent')} get there." if worst else "")
    return out.done({"stages": rows}, text, {}, {"kind": "funnel", "x": [r["stage"] for r in rows], "y": [r["reached"] for r in rows]})


@tool("data_quality", "How far the data can be trusted")
def data_quality(ctx: Context, out: Builder) -> Result:
    q = quality(ctx.profile)
    s, n = out.fact("score", q["score"], "count"), out.fact("issues", len(q["issues"]), "count")
    return out.done(q, f"The quality score is {s} ({q['label']}), with {n} issue(s).", {})


@tool("scenario", "What if a metric changed by a percentage", metric=Param(required=True), percent=Param("number", required=True, low=-100, high=1000), dependent=Param())
def scenario_tool(ctx: Context, out: Builder, metric, percent, dependent) -> Result:
    m = ctx.measure(metric)
    ctx.check_agg(m, "sum")
    d = ctx.measure(dependent) if dependent else None
    row = scenario(ctx.df, m.name, percent, d.name if d else None).first().asDict()
    p, a, b = out.fact("assumed change", percent, "percent"), out.fact(m.name, row["base"], m.unit), out.fact(f"projected {m.name}", row["projected"], m.unit)
    text = f"With {p}, {m.name} would go from {a} to {b}"
    if d:
        text += f" and {d.name} to {out.fact('projected ' + d.name, row['dependent_projected'], d.unit)} at today's ratio"
    return out.done(row, text + ".", {})

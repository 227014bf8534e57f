"""KPIs, ranked findings, and dashboards: tool calls whose results are weighed and arranged."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import stats
from ..operators import grouping as grp
from ..operators import timeseries as ts
from ..operators.aggregate import aggregate_column, value_counts
from ..operators.filters import typed
from .context import Context
from .facts import Failure, Result, display
from .quality import quality
from .tools import Registry, registry

# What makes a finding worth showing.
WEIGHTS = {"magnitude": 0.3, "relevance": 0.2, "significance": 0.2, "novelty": 0.1, "confidence": 0.1, "completeness": 0.1}


@dataclass
class Insight:
    kind: str
    title: str
    text: str
    tool: str
    params: dict
    factors: dict = field(default_factory=dict)
    score: float = 0.0
    priority: str = "low"


def kpis(ctx: Context) -> list[dict]:
    """Rows, the main measures, margin and customers, with the change of the last two complete periods.

    All figures come from one aggregation; changes from the memoised series. A
    change is left out where its base is below a twentieth of the typical period.
    """
    p = ctx.profile
    order = [p.lead, *(m.name for m in (p.meaning(x, role="measure") for x in ("revenue", "profit", "quantity", "cost", "marketing")) if m), *(m.name for m in p.with_role("measure"))]
    chosen = [m for m in dict.fromkeys(order) if m][:4]
    customer = p.meaning("customer")
    df = ctx.df
    aggs = [F.count(F.lit(1)).alias("rows"), *[aggregate_column(typed(df, m), p.columns[m].agg).alias(f"m{i}") for i, m in enumerate(chosen)]]
    if customer:
        aggs.append(F.count_distinct(typed(df, customer.name)).alias("customers"))
    revenue, profit = p.meaning("revenue", role="measure"), p.meaning("profit", role="measure")
    if revenue and profit and profit.additive:
        aggs += [F.sum(typed(df, revenue.name)).alias("revenue"), F.sum(typed(df, profit.name)).alias("profit")]
    row = df.agg(*aggs).first().asDict()

    def delta(metric: str | None, how: str) -> tuple[float | None, list[float]]:
        if not p.date:
            return None, []
        s = ctx.series(metric, None if metric == "margin" else how)
        pair, typical = ts.latest_pair(s), stats.median([abs(v) for v in s.values]) or 0.0
        change = stats.pct_change(pair[0].value, pair[1].value) if pair and abs(pair[1].value) >= 0.05 * typical else None
        return change, s.values[-24:]

    out = []

    def kpi(label: str, value: float | None, unit: str, metric: str | None, how: str) -> None:
        change, line = delta(metric, how)
        out.append({"label": label, "value": value, "unit": unit, "display": display(value, unit), "change_pct": change, "sparkline": line})

    kpi("Rows", row["rows"], "count", None, "count")
    for i, m in enumerate(chosen):
        kpi(m, row[f"m{i}"], p.columns[m].unit, m, p.columns[m].agg)
    if row.get("revenue"):
        kpi("Margin", row["profit"] / row["revenue"] * 100, "percent", "margin", "")
    if customer:
        kpi("Customers", row["customers"], "count", customer.name, "distinct_count")
    return out


def _call(ctx: Context, tools: Registry, name: str, **params: object) -> Result | None:
    found = tools.call(ctx, name, **params)
    return None if isinstance(found, Failure) else found


def generate(ctx: Context, tools: Registry = registry) -> list[Insight]:
    """Findings of all kinds that the data allow, ranked; what a tool refuses is left out."""
    p, found = ctx.profile, []
    lead = p.columns[p.lead] if p.lead else None
    dims = p.chart_dimensions()

    def add(kind: str, title: str, r: Result, params: dict, magnitude: float, significance: float = 0.7, confidence: float = 0.8, relevance: float = 0.7) -> None:
        complete = 1.0 if not r.caveats else 0.7
        found.append(Insight(kind, title, r.summary, r.tool, params, {"magnitude": min(1.0, magnitude), "relevance": relevance, "significance": significance, "confidence": confidence, "completeness": complete}))

    additive = lead is not None and lead.additive
    charts = [d.name for d in dims[:5]]
    groups: dict[str, list[float]] = {d: [] for d in charts}
    if charts:  # a chart dimension has at most 60 labels
        for r in grp.group_many(ctx.df, charts, lead.name if additive else None).collect():
            groups[r["dimension"]].append(r["value"])
    for d in dims[:5]:
        values = sorted(groups[d.name], reverse=True)
        row = stats.concentration(values)
        if row is None:
            continue
        args = {"dimension": d.name} | ({"metric": lead.name} if additive else {})
        top = values[:2]
        if grp.is_concentrated(row["groups"], row["multiple"], row["hhi_normalised"]):
            if r := _call(ctx, tools, "pareto", **args):
                add("concentration", f"Few values of {d.name} make most", r, args, row["top_share"] / 100)
        elif len(top) == 2 and row["groups"] >= 2 and top[1] > 0:
            total = sum(values)
            if total > 0 and top[0] / total >= 1.3 / row["groups"] and top[0] >= 1.15 * top[1]:
                if r := _call(ctx, tools, "top_n", n=3, **args):
                    add("leader", f"{d.name} has a clear leader", r, args | {"n": 3}, top[0] / total)
    if p.date:
        if (r := _call(ctx, tools, "trend")) and r.data.get("significant"):
            add("trend", f"{p.lead or 'Activity'} is {r.data['direction']}", r, {}, abs(r.data["slope_pct"]) / 10, 1 - r.data["p_value"])
        if (r := _call(ctx, tools, "explain_change" if additive or lead is None else "compare_periods")) and r.data.get("pct") is not None and abs(r.data["pct"]) >= 5:
            values = [abs(v) for v in ctx.series(lead.name if lead else None, lead.agg if lead else "count").values]
            if abs(r.data["value_b"]) >= 0.1 * (stats.median(values) or 0):
                add("period_change", f"{p.lead or 'Activity'} changed by {r.data['pct']:.0f}%", r, {"period_a": r.data["period_a"], "period_b": r.data["period_b"]}, abs(r.data["pct"]) / 50, relevance=0.9)
        if r := _call(ctx, tools, "anomalies"):
            for a in r.data["anomalies"][:2]:
                add("anomaly", f"{p.lead or 'Activity'} is unusually {a['direction']} in {a['period']}", r, {}, min(1.0, abs(a["z"]) / 8), 0.8)
        if (r := _call(ctx, tools, "seasonality")) and r.data["significant"]:
            add("seasonality", "There is a season", r, {}, r.data["spread"], 1 - r.data["p_value"])
        if r := _call(ctx, tools, "forecast", horizon=3):
            add("forecast", f"Outlook for {p.lead or 'activity'}", r, {"horizon": 3}, 0.4, 0.5, max(0.2, 1 - (r.data["mape"] or 50) / 100))
        if (r := _call(ctx, tools, "trend", metric="margin")) and r.data.get("significant"):
            add("margin_trend", f"The margin is {r.data['direction']}", r, {"metric": "margin"}, abs(r.data["slope_pct"]) / 5, 1 - r.data["p_value"], relevance=0.8)
    if (r := _call(ctx, tools, "profitability")) is not None:
        losses = [g for g in r.data["groups"] if g["loss"] and g["n_rows"] >= 3]
        if losses:
            add("loss_makers", "Some groups lose money", r, {}, 0.7, 0.9, relevance=0.9)
        elif r.data["lagging"]:
            add("profitability", "Large groups with thin margins", r, {}, 0.6, 0.8, relevance=0.9)
        if p.date and (v := _call(ctx, tools, "volume_vs_margin")) is not None and abs((v.data["margin_a"] or 0) - (v.data["margin_b"] or 0)) >= 1:
            add("volume_margin", "The margin moved profit", v, {}, 0.5, relevance=0.8)
    if (r := _call(ctx, tools, "correlation")) is not None:
        for pair in [q for q in r.data["pairs"] if abs(q["r"]) >= 0.5 and q["p_value"] < 0.01 and q["n"] >= 30][:2]:
            add("correlation", f"{pair['a']} and {pair['b']} move together", r, {}, abs(pair["r"]), 1 - pair["p_value"], relevance=0.5)
    if (r := _call(ctx, tools, "customer_analysis")) is not None and r.data["customers"] >= 20 and (r.data["top_decile_share"] >= 25 or r.data["repeat_rate"] >= 20):
        add("customers", "Who the customers are", r, {}, r.data["top_decile_share"] / 100)
    for issue in quality(p)["issues"]:
        if issue["severity"] in ("high", "medium") and (r := _call(ctx, tools, "data_quality")):
            found.append(Insight("quality", issue["message"], issue["message"], "data_quality", {}, {"magnitude": 0.8 if issue["severity"] == "high" else 0.4, "relevance": 0.6, "significance": 0.9, "confidence": 1.0, "completeness": 1.0}))
    return rank(found)


def rank(found: list[Insight], per_kind: int = 3, most: int = 14, least: float = 40.0) -> list[Insight]:
    """By weighted score; repeats of a kind lose novelty, at most per_kind of one kind, most in all."""
    base = lambda i: sum(WEIGHTS[k] * v for k, v in i.factors.items())
    seen: Counter[str] = Counter()
    out = []
    for i in sorted(found, key=lambda i: (-base(i), i.kind, i.title)):
        i.score = 100 * (base(i) + WEIGHTS["novelty"] * 0.6 ** seen[i.kind])
        i.priority = "high" if i.score >= 68 else "medium" if i.score >= 52 else "low"
        if i.score >= least and seen[i.kind] < per_kind:
            seen[i.kind] += 1
            out.append(i)
    return sorted(out, key=lambda i: (-i.score, i.kind, i.title))[:most]


def executive_summary(insights: list[Insight], most: int = 3) -> str:
    return " ".join(i.text for i in insights[:most]) or "Nothing stands out."


def plan_dashboard(ctx: Context) -> dict:
    """Widgets (tool and arguments) and filter controls that suit the data; never data."""
    p, caps = ctx.profile, ctx.capabilities()
    lead, dims = p.lead, p.chart_dimensions()
    widgets: list[dict] = []

    def widget(title: str, tool: str, **params: object) -> None:
        widgets.append({"id": f"w{len(widgets) + 1}", "title": title, "tool": tool, "params": params})

    metric = {"metric": lead} if lead else {}
    if caps["time"] is None:
        widget(f"{lead or 'Rows'} over time", "time_series", **metric)
    for d in dims[:3]:
        widget(f"{lead or 'Rows'} by {d.name}", "group_by", dimension=d.name, **metric)
    if len(dims) >= 2:
        widget(f"{dims[0].name} by {dims[1].name}", "cross_tab", row_dimension=dims[0].name, column_dimension=dims[1].name, **metric)
    if caps["margin"] is None and dims:
        widget("Profitability", "profitability", dimension=dims[0].name)
    if lead:
        widget(f"Spread of {lead}", "distribution", column=lead)
    for cap, title, tool in (("forecast", "Outlook", "forecast"), ("customers", "Customers", "customer_analysis"), ("cohort", "Retention", "cohort_retention"), ("funnel", "Funnel", "funnel")):
        if caps[cap] is None:
            widget(title, tool)
    controls = [{"column": d.name, "values": [r["value"] for r in value_counts(ctx.df, d.name, 20).collect()]} for d in dims[:4]]
    if p.date:
        controls.append({"column": p.date, "from": cal.key_of(cal.ordinal_of(p.span[0], p.grain), p.grain), "to": cal.key_of(cal.ordinal_of(p.span[1], p.grain), p.grain)})
    return {"widgets": widgets, "filters": controls}


def materialize(ctx: Context, plan: dict, filters: list | None = None, tools: Registry = registry) -> list[dict]:
    """Every widget's result under common filters, over rows cached once; what cannot be shown says why."""
    scope = ctx.narrow(filters or [])
    rows = scope.df.cache()
    try:
        cached = Context(rows, ctx.profile)
        out = []
        for w in plan["widgets"]:
            r = tools.call(cached, w["tool"], **w["params"])
            out.append(w | ({"available": True, "result": r} if r.ok else {"available": False, "reason": r.message}))
        return out
    finally:
        rows.unpersist()

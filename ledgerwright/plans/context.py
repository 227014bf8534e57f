"""A dataset under analysis: its rows, profile, filters and the series computed so far."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import calendar as cal
from ..operators import timeseries as ts
from ..operators.filters import Filter, apply_filters, closest_values, describe
from ..operators.labels import Labels
from .clean import ROW_ID
from .profile import ColumnProfile, Profile, capabilities

# Business words that name a column by its meaning.
ALIASES = {
    "revenue": ("revenue", "sales", "turnover", "income"),
    "profit": ("profit", "earnings"),
    "cost": ("cost", "costs", "expense", "expenses", "cogs"),
    "quantity": ("quantity", "units", "volume", "qty"),
    "price": ("price", "prices"),
    "discount": ("discount", "discounts"),
    "marketing": ("marketing", "advertising", "ad spend"),
    "customer": ("customer", "customers", "client", "clients", "buyer", "buyers"),
    "product": ("product", "products", "item", "items", "sku", "skus"),
    "region": ("region", "regions", "country", "countries", "state", "states", "geography", "territory", "market", "markets"),
    "channel": ("channel", "channels"),
    "segment": ("segment", "segments"),
    "stage": ("stage", "stages", "status"),
}


def folded(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())


@dataclass
class Context:
    """Rows are filtered lazily; series and counts are computed once per set of filters."""

    rows: DataFrame
    profile: Profile
    filters: tuple[Filter, ...] = ()
    labels: Labels | None = None
    _memo: dict = field(default_factory=dict)

    @property
    def df(self) -> DataFrame:
        if "rows" not in self._memo:  # labels are looked up once
            self._memo["rows"] = apply_filters(self.rows, self.filters, self.labels)
        out = self._memo["rows"]
        return out.drop(ROW_ID) if ROW_ID in out.columns else out

    def narrow(self, filters: Sequence[Filter]) -> Context:
        """The same data under further filters."""
        return Context(self.rows, self.profile, (*self.filters, *filters), self.labels) if filters else self

    def count(self) -> int:
        if "count" not in self._memo:
            self._memo["count"] = self.df.count()
        return self._memo["count"]

    def scope(self, filters: Sequence[Filter] = (), date_from: str | None = None, date_to: str | None = None) -> Context:
        """Narrowed by resolved filters and a date range; no rows raise no_matching_rows with near values."""
        extra = [Filter(self.column(f.column).name, f.op, f.value, f.values) for f in filters]
        if date_from or date_to:
            if not self.profile.date:
                raise AnalysisError("no_date_column", "There is no date to limit by.")
            extra += [Filter(self.profile.date, op, v) for op, v in (("gte", date_from), ("lte", date_to)) if v]
        out = self.narrow(extra)
        if extra and not out.count():
            hints = []
            for f in extra:
                if self.profile.columns[f.column].kind == "string" and f.op in ("eq", "in", "contains"):
                    for v in f.all_values():
                        near = [r["value"] for r in closest_values(self.rows, f.column, str(v), 3).collect()]
                        if near:
                            hints.append(f'Near "{v}" in {f.column}: ' + ", ".join(near))
            raise AnalysisError("no_matching_rows", "No rows match: " + "; ".join(map(describe, extra)) + ".", "; ".join(hints) or None)
        return out

    # names ------------------------------------------------------------------

    def column(self, ref: str) -> ColumnProfile:
        """The column meant by ref: its name, its name folded, a business word, a unique part of a name."""
        columns = self.profile.columns
        if ref in columns:
            return columns[ref]
        key = folded(ref)
        same = [c for c in columns.values() if folded(c.name) == key]
        if len(same) == 1:
            return same[0]
        for meaning, words in ALIASES.items():
            if key in map(folded, words) and (c := self.profile.meaning(meaning)):
                return c
        part = [c for c in columns.values() if key and key in folded(c.name)]
        if len(part) == 1:
            return part[0]
        near = ", ".join(c.name for c in part) or ", ".join(list(columns)[:12])
        raise AnalysisError("unknown_column", f'There is no column "{ref}".' if not part else f'"{ref}" could be several columns.', near)

    def measure(self, ref: str | None) -> ColumnProfile | None:
        """A measure; without a reference the lead metric, if there is one."""
        if ref is None:
            return self.profile.columns[self.profile.lead] if self.profile.lead else None
        c = self.column(ref)
        if c.role != "measure":
            raise AnalysisError("wrong_type", f'"{c.name}" is not a measure.', "Measures: " + ", ".join(x.name for x in self.profile.with_role("measure")))
        return c

    def dimension(self, ref: str | None) -> ColumnProfile:
        if ref is None:
            charts = self.profile.chart_dimensions()
            if not charts:
                raise AnalysisError("no_dimension", "There is no column to group by.")
            return charts[0]
        c = self.column(ref)
        if c.kind == "date":
            raise AnalysisError("wrong_type", f'"{c.name}" holds dates.', "Use time_series for dates.")
        if c.role == "measure":
            raise AnalysisError("wrong_type", f'"{c.name}" is a measure, not a category.', "Use distribution for measures.")
        if not c.groupable:
            raise AnalysisError("wrong_type", f'"{c.name}" cannot be grouped by: it holds {c.role} values.')
        return c

    def check_agg(self, c: ColumnProfile | None, agg: str) -> None:
        if c and agg == "sum" and not c.additive:
            raise AnalysisError("not_additive", f'Adding up "{c.name}" has no meaning.', "Use avg, median, min or max.")

    # series -----------------------------------------------------------------

    def series(self, metric: str | None = None, agg: str | None = None, grain: str | None = None) -> ts.Series:
        """The complete series of a metric (`margin` for profit over revenue), memoised."""
        if not self.profile.date:
            raise AnalysisError("no_date_column", "There is no column that says when things happened.")
        grain = grain or self.profile.grain
        key = ("series", metric, agg, grain)
        if key not in self._memo:
            if metric == "margin":
                revenue, profit = self.profile.meaning("revenue", role="measure"), self.profile.meaning("profit", role="measure")
                if not revenue or not profit or not profit.additive:
                    raise AnalysisError("not_available", "A margin takes a revenue and an additive profit column.")
                a, b = self.series(revenue.name, "sum", grain), self.series(profit.name, "sum", grain)
                other = {p.ord: p for p in b.points}
                points = tuple(ts.Point(p.ord, p.n, other[p.ord].value / p.value * 100) for p in a.points if p.ord in other and p.value > 0)
                self._memo[key] = ts.Series(grain, points, a.trimmed_start, a.trimmed_end, points)
            else:
                found = ts.collect_series(ts.time_series(self.df, self.profile.date, metric, agg, grain), grain)
                self._memo[key] = ts.complete(found, *(self.span() or (None, None)))
        return self._memo[key]

    def span(self):
        if "span" not in self._memo:
            self._memo["span"] = ts.date_span(self.df, self.profile.date) if self.profile.date else None
        return self._memo["span"]

    def capabilities(self) -> dict[str, str | None]:
        if "capabilities" not in self._memo:
            periods = len(self.series().points) if self.profile.date and self.profile.n_rows else 0
            self._memo["capabilities"] = capabilities(self.profile, periods)
        return self._memo["capabilities"]

    def periods(self, period_a: str | None, period_b: str | None, compare_to: str = "previous", metric: str | None = None, agg: str | None = None) -> tuple[str, str, str]:
        """(a, b, grain): as given, or the latest two complete periods, or a and the one before or a season ago."""
        grain = cal.grain_of_key(cal.normalize_key(period_a)) if period_a else self.profile.grain
        if self.profile.grain == "week" and grain == "day":
            grain = "week"
        if period_a and not grain:
            raise AnalysisError("invalid_period", f"{period_a!r} is not a period.", "For example 2025-03, 2025-Q1 or 2025.")
        back = (cal.SEASON[grain] or 1) if compare_to == "year_ago" else 1
        if period_a and period_b:
            return cal.normalize_key(period_a), cal.normalize_key(period_b), grain
        if period_a:
            n = cal.ordinal_of(cal.range_of_key(period_a, grain)[0], grain)
            return cal.key_of(n, grain), cal.key_of(n - back, grain), grain
        points = self.series(metric, agg, grain).points
        if len(points) < 2:
            raise AnalysisError("not_enough_data", "There are not two complete periods to compare.")
        last = points[-1].ord
        before = last - back if compare_to == "year_ago" else points[-2].ord
        return cal.key_of(last, grain), cal.key_of(before, grain), grain


def row_counts_by_filter(ctx: Context) -> DataFrame:
    """One row: rows in scope and in all."""
    return ctx.rows.agg(F.count("*").alias("all_rows")).join(ctx.df.agg(F.count("*").alias("in_scope")))

"""What each column means: role, meaning, additivity, unit, and the dataset's calendar.

The figures come from one aggregation over all columns (and one distinct count per
text column's shape); the decisions are rules on those figures and on the names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import cached_property
from math import log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators.filters import kind_of, quoted, typed
from ..operators.relations import relations
from .clean import ROW_ID, ColumnMeta

# Words of column names, with their weight, by the meaning they speak for; the first meaning wins ties.
NUMERIC_WORDS = {
    "margin": {1.0: "margin margins"},
    "profit": {1.0: "profit profits ebitda earnings netincome", 0.5: "contribution net"},
    "marketing": {1.0: "marketing advertising adspend cac", 0.5: "campaign media acquisition ad ads"},
    "cost": {1.0: "cost costs cogs expense expenses opex expenditure", 0.5: "spend spending"},
    "discount": {1.0: "discount discounts promo promotion coupon markdown rebate"},
    "price": {1.0: "price prices asp unitprice listprice", 0.5: "rate"},
    "quantity": {1.0: "qty quantity quantities units volume", 0.5: "unit count pieces items"},
    "revenue": {1.0: "revenue revenues sales turnover bookings gmv arr mrr linetotal totalprice totalamount netsales grosssales totalsales salesamount", 0.5: "amount total gross income booking"},
}
STRING_WORDS = {
    "customer": {1.0: "customer customers client clients buyer buyers member subscriber patient cust", 0.5: "account user"},
    "product": {1.0: "product products sku item items goods", 0.5: "service model title plan"},
    "region": {1.0: "region country state city territory geo location zone province area", 0.5: "market store"},
    "channel": {1.0: "channel platform referrer referral utm medium", 0.5: "source campaign"},
    "stage": {1.0: "stage funnel phase pipeline", 0.5: "status step"},
    "segment": {1.0: "segment tier category class industry department", 0.5: "type group"},
}
# Words of names that speak for free text, identifiers, rates, calendar parts, places and dates.
TEXT_NAMES = frozenset("note notes comment comments description descriptions remark remarks memo feedback review reviews text message messages summary detail details body content reason".split())
ID_NAMES = frozenset("id uuid guid key code no num number ref reference sku".split())
RATE_NAMES = frozenset("share pct percent percentage proportion ratio rate score index avg average mean median per age rating temperature temp latitude longitude lat lon lng percentile nps csat margin".split())
CALENDAR_NAMES = frozenset("year yr month quarter qtr week wk day hour weekday dow fy".split())
COORDINATE_NAMES = frozenset("latitude longitude lat lon lng".split())
EVENT_NAMES = frozenset("order invoice transaction created posted closed paid shipped sale booking event purchase timestamp".split())
DATE_NAMES = frozenset("date time datetime period day month week year".split())
ATTRIBUTE_NAMES = frozenset("since joined join signup registered registration birth birthday dob hire hired firstseen founded expiry expires expiration renewal due start enrolled".split())
MONEY = ("revenue", "cost", "profit", "price", "marketing")
#: Shares of unique values at which the role of a column of whole numbers, or of texts, changes.
WHOLE_SHARES, TEXT_SHARES = (0.5, 0.98, 0.99), (0.25, 0.5, 0.6, 0.9)


@dataclass
class ColumnProfile:
    name: str
    kind: str
    role: str = "dimension"  # measure, dimension, time, identifier, text, boolean
    meaning: str | None = None
    confidence: float = 0.0
    additive: bool = False
    agg: str = "sum"
    unit: str = "number"
    count: int = 0
    missing_pct: float = 0.0
    distinct: int = 0
    chart: bool = False
    groupable: bool = False
    score: float = 0.0
    stats: dict = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


@dataclass
class Profile:
    n_rows: int
    columns: dict[str, ColumnProfile]
    count_duplicates: Callable[[], int]
    relations: list[dict]
    count_outliers: Callable[[], dict[str, tuple[int, float, float]]] = dict
    date: str | None = None
    span: tuple[date, date] | None = None
    grain: str = "month"
    lead: str | None = None
    currency: str | None = None

    @cached_property
    def duplicates(self) -> int:
        """Rows that repeat an earlier one; counted when it is first asked for."""
        return self.count_duplicates()

    @cached_property
    def outliers(self) -> dict[str, tuple[int, float, float]]:
        """By measure: values beyond the quartile fences, and the fences; counted when first asked for."""
        return self.count_outliers()

    def with_role(self, role: str) -> list[ColumnProfile]:
        return [c for c in self.columns.values() if c.role == role]

    def meaning(self, *meanings: str, role: str | None = None) -> ColumnProfile | None:
        for m in meanings:
            found = [c for c in self.columns.values() if c.meaning == m and (role is None or c.role == role)]
            if found:
                return max(found, key=lambda c: c.confidence)
        return None

    def chart_dimensions(self) -> list[ColumnProfile]:
        order = ("product", "region", "channel", "segment", "customer", "stage")
        return sorted((c for c in self.columns.values() if c.chart), key=lambda c: order.index(c.meaning) if c.meaning in order else len(order))


def name_words(name: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())


def meaning_of(name: str, words: dict[str, dict[float, str]]) -> tuple[str | None, float]:
    """The meaning that a column's name speaks for most, and how much."""
    tokens, joined = set(name_words(name)), re.sub(r"[^a-z0-9]", "", name.lower())
    best, top = None, 0.0
    for meaning, weights in words.items():
        total = sum(w if x in tokens else 0.9 * w if len(x) >= 6 and x in joined else 0.0 for w, xs in weights.items() for x in xs.split())
        if total > top:
            best, top = meaning, total
    return best, min(1.0, top)


def _kinds_of_values(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Estimates of distinct values, within about two percent, exact for few; one pass of sketches."""
    if not names:
        return {}
    hashed = lambda c: F.when(typed(df, c).isNotNull(), F.xxhash64(typed(df, c)))
    row = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(hashed(c), 14)).alias(f"d{i}") for i, c in enumerate(names)]).first()
    return {c: row[f"d{i}"] or 0 for i, c in enumerate(names)}


def _settled(df: DataFrame, figures: dict[str, dict], kinds: dict[str, int]) -> dict[str, int]:
    """kinds with exact counts of the columns whose estimate lies near a share of unique values that decides a role."""
    shares = {c: WHOLE_SHARES if f["int"] == f["n"] else () for c, f in figures.items() if "int" in f} | {c: TEXT_SHARES for c, f in figures.items() if "words" in f}
    near = [c for c, d in kinds.items() if figures[c]["n"] and any(abs(d / figures[c]["n"] - share) <= 0.04 for share in shares.get(c, ()))]
    exact = df.agg(*[F.count_distinct(typed(df, c)).alias(f"d{i}") for i, c in enumerate(near)]).first() if near else ()
    return kinds | dict(zip(near, exact, strict=True))


def _figures(df: DataFrame, names: Sequence[str], kinds: dict[str, str]) -> dict[str, dict]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        x = typed(df, c)
        aggs.append(F.count(x).alias(f"n{i}"))
        if kinds[c] == "number":
            aggs += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.sum(x).alias(f"sum{i}"), F.count_if(x == F.floor(x)).alias(f"int{i}"), F.count_if(x < 0).alias(f"neg{i}")]
        elif kinds[c] == "date":
            aggs += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        elif kinds[c] == "string":
            t = F.trim(x)
            words = F.when(t.rlike(r"\s\s|[\t\n\r]"), F.size(F.split(t, r"\s+"))).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1)
            aggs += [F.avg(words).alias(f"words{i}"), F.avg(F.length(x)).alias(f"len{i}"), F.count_if(x.rlike(r"^[A-Za-z]*[-_ ]?\d[\w-]*$")).alias(f"code{i}")]
        else:
            aggs += [F.count_if(x).alias(f"true{i}")]
    row = df.agg(*aggs).first().asDict()
    out = {c: {k[: -len(str(i))]: v for k, v in row.items() if re.fullmatch(rf"[a-z]+{i}", k)} for i, c in enumerate(names)}
    distinct = _settled(df, out, _kinds_of_values(df, names))
    for c in names:
        out[c]["d"] = distinct[c]
    return out | {"": {"rows": row["rows"]}}


def _number(p: ColumnProfile, f: dict, rows: int, meta: ColumnMeta | None) -> None:
    words, n = set(name_words(p.name)), max(1, p.count)
    meaning, sure = meaning_of(p.name, NUMERIC_WORDS)
    whole, unique = f["int"] == p.count, p.distinct / n
    low, high = f["min"], f["max"]
    p.stats = {"min": low, "max": high, "sum": f["sum"], "negatives": f["neg"]}
    dense = whole and unique > 0.99 and low is not None and abs(high - low + 1 - p.count) <= max(1, 0.02 * p.count)
    if whole and p.distinct <= 2 and low is not None and {low, high} <= {0.0, 1.0}:
        p.role, p.unit, p.groupable, p.chart = "boolean", "count", True, True
    elif whole and words & CALENDAR_NAMES and not meaning and high is not None and (0 <= low and high <= 366 or 1900 <= low <= high <= 2100):
        p.role, p.groupable, p.chart, p.meaning = "dimension", True, p.distinct <= 60, "calendar_part"
    elif whole and not meaning and ((words & ID_NAMES and unique >= 0.5) or dense or (unique > 0.98 and p.distinct > 50)):
        p.role, p.meaning = "identifier", "identifier"
    elif dense and words & ID_NAMES:
        p.role, p.meaning = "identifier", "identifier"
    elif whole and not meaning and (entity := meaning_of(p.name, STRING_WORDS)) and entity[0] == "customer" and entity[1] >= 1:
        p.role, p.meaning, p.confidence, p.groupable = "identifier", "customer", entity[1], True  # customers by number
    elif words & COORDINATE_NAMES and low is not None and -180 <= low <= high <= 180:
        p.role, p.meaning = "dimension", "coordinate"
    else:
        p.role, p.meaning, p.confidence = "measure", meaning, sure
        total, shares = f["sum"] or 0.0, low is not None and 0 <= low and high <= 1
        rate = bool(words & RATE_NAMES) or meaning in ("price", "discount", "margin") or bool(meta and meta.percent) or (shares and not whole)
        rate = rate or (p.count >= 5 and (abs(total - 1) < 1e-6 or abs(total - 100) < 1e-6))
        p.additive, p.agg = not rate, "avg" if rate else "sum"
        percent = bool(meta and meta.percent) or bool(words & {"pct", "percent", "percentage", "margin", "discount", "share", "rate"} and shares)
        p.unit = "percent" if percent or meaning == "margin" else "currency" if meaning in MONEY or (meta and meta.currency) else "count" if meaning == "quantity" else "number"


def _string(p: ColumnProfile, f: dict, rows: int) -> None:
    words, n = set(name_words(p.name)), max(1, p.count)
    unique, average, length = p.distinct / n, f["words"] or 0, f["len"] or 0
    prose = (average >= 3.5 or length >= 50) and unique >= 0.25 or bool(words & TEXT_NAMES) and average >= 2
    code = f["code"] >= 0.9 * n
    identifier = (unique >= 0.9 and p.distinct >= 20 and average <= 2.5) or (words & ID_NAMES and unique >= 0.6) or (code and unique >= 0.5 and p.distinct >= 20)
    meaning, sure = (None, 0.0) if words & TEXT_NAMES else meaning_of(p.name, STRING_WORDS)
    if prose:
        p.role = "text"
    elif identifier and not (meaning == "customer" and unique < 0.9):
        p.role, p.meaning, p.confidence = "identifier", meaning if meaning == "customer" else "identifier", sure
        p.groupable = meaning == "customer"
    else:
        p.role, p.meaning, p.confidence = "dimension", meaning, sure
        p.groupable = p.distinct <= 100_000
        p.chart = 2 <= p.distinct <= max(2, min(60, rows / 5)) and unique <= 0.5


def _date(p: ColumnProfile, f: dict, rows: int) -> None:
    words = set(name_words(p.name))
    p.role, p.unit, p.stats = "time", "date", {"min": f["min"], "max": f["max"]}
    attribute = bool(words & ATTRIBUTE_NAMES)
    p.meaning = "attribute_date" if attribute else "event_date"
    by_name = -40 if attribute else 40 * bool(words & EVENT_NAMES) + 25 * bool(words & DATE_NAMES)
    p.score = by_name + min(30, log10(1 + p.count / max(1, p.distinct)) * 22) - 0.4 * p.missing_pct


def profile(df: DataFrame, meta: dict[str, ColumnMeta] | None = None) -> Profile:
    """The profile of a typed table; ROW_ID is not a column of it.

    Distinct counts of the profile are estimates within about two percent, but for
    columns near a share that decides their role (queries count exactly).
    """
    names = [c for c in df.columns if c != ROW_ID]
    kinds = {c: kind_of(df, c) for c in names}
    figures = _figures(df, names, kinds)
    rows = figures[""]["rows"]
    columns: dict[str, ColumnProfile] = {}
    for c in names:
        f = figures[c]
        p = ColumnProfile(c, kinds[c], count=f["n"], distinct=min(f["d"], f["n"]), missing_pct=(rows - f["n"]) / rows * 100 if rows else 0.0)
        if kinds[c] == "number":
            _number(p, f, rows, (meta or {}).get(c))
        elif kinds[c] == "string":
            _string(p, f, rows)
        elif kinds[c] == "date":
            _date(p, f, rows)
        else:
            p.role, p.groupable, p.chart, p.stats = "boolean", True, p.distinct == 2, {"true": f["true"]}
        columns[c] = p
    measures = [c.name for c in columns.values() if c.role == "measure"]
    found = relations(df, measures) if 3 <= len(measures) and rows >= 20 else []
    _apply_relations(columns, found)
    codes = Counter(m.currency for m in (meta or {}).values() if m.currency)
    out = Profile(rows, columns, lambda: repeated_rows(df, names) if names and rows else 0, found, lambda: beyond_fences(df, measures))
    events = [c for c in columns.values() if c.role == "time" and c.meaning == "event_date" and c.count]
    if events:
        best = max(events, key=lambda c: c.score)
        out.date, out.span = best.name, (best.stats["min"], best.stats["max"])
        out.grain = cal.pick_grain(*out.span)
    out.lead = _lead(out)
    out.currency = min(codes, key=lambda c: (-codes[c], c)) if codes else None  # of most columns, of equals the first by name
    return out


def repeated_rows(df: DataFrame, names: Sequence[str]) -> int:
    """How many rows repeat another one: 128 bits a row are counted, and only rows whose bits repeat are compared in full."""
    cells = [quoted(c) for c in names]
    prints = (F.xxhash64(*cells).alias("__a"), F.xxhash64(F.lit(1), *cells).alias("__b"))
    again = df.select(*prints).groupBy("__a", "__b").agg(F.count("*").alias("n")).where("n > 1").select("__a", "__b")
    held = df.select(*cells, *prints).join(again, ["__a", "__b"], "left_semi").groupBy(*cells).agg(F.count("*").alias("n"))
    return held.agg(F.sum(F.col("n") - 1)).first()[0] or 0


def beyond_fences(df: DataFrame, measures: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    """By measure: how many values lie more than 1.5 quartile ranges beyond the quartiles, and these fences; one pass for the quartiles of all, one for the counts."""
    if not measures:
        return {}
    quartiles = df.agg(*[F.percentile_approx(typed(df, c), [0.25, 0.75], 10_000).alias(f"q{i}") for i, c in enumerate(measures)]).first()
    fences = {c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) for c, q in zip(measures, quartiles, strict=True) if q}
    if not fences:
        return {}
    counts = df.agg(*[F.count_if((typed(df, c) < low) | (typed(df, c) > high)).alias(f"n{i}") for i, (c, (low, high)) in enumerate(fences.items())]).first()
    return {c: (n, *fence) for (c, fence), n in zip(fences.items(), counts, strict=True)}


def _apply_relations(columns: dict[str, ColumnProfile], found: list[dict]) -> None:
    """Name what an identity reveals: profit = revenue - cost, revenue = quantity * price; sure names stand."""
    for r in found:
        target, left, right = (columns[r[k]] for k in ("target", "left", "right"))
        wanted: tuple = ()
        if r["form"] == "-" and left.meaning == "revenue" and right.meaning == "cost":
            wanted = ((target, "profit"),)
        elif r["form"] == "-" and left.meaning == "revenue" and target.meaning == "profit":
            wanted = ((right, "cost"),)
        elif r["form"] == "*" and {left.meaning, right.meaning} == {"quantity", "price"}:
            wanted = ((target, "revenue"),)
        for column, meaning in wanted:
            if column.meaning is None or column.confidence < 0.8:
                column.meaning, column.confidence, column.additive, column.agg = meaning, 0.8, True, "sum"
                column.unit = "currency" if meaning in MONEY else column.unit
                column.notes.append(f'{r["target"]} = {r["left"]} {r["form"]} {r["right"]}')


def _lead(p: Profile) -> str | None:
    """The metric that matters most: revenue, else the largest unnamed sum, profit, quantity, marketing, cost, the first."""
    measures = p.with_role("measure")
    additive = [c for c in measures if c.additive]
    if c := p.meaning("revenue", role="measure"):
        if c.additive:
            return c.name
    unnamed = [c for c in additive if c.meaning is None]
    if unnamed:
        return max(unnamed, key=lambda c: c.stats.get("sum") or 0).name
    if c := p.meaning("profit", "quantity", "marketing", "cost", role="measure"):
        return c.name
    return measures[0].name if measures else None


def capabilities(p: Profile, n_periods: int = 0) -> dict[str, str | None]:
    """By analysis: None if it is possible, else why not."""
    measures, dims = p.with_role("measure"), [c for c in p.columns.values() if c.groupable]
    revenue, profit = p.meaning("revenue", role="measure"), p.meaning("profit", role="measure")
    season = {"day": 56, "week": 104, "month": 24, "quarter": 8}.get(p.grain, 8)
    no_date = None if p.date else "There is no column that says when things happened."
    customer = p.meaning("customer")

    def periods(least: int) -> str | None:
        return no_date or (None if n_periods >= least else f"It takes {least} complete periods; there are {n_periods}.")

    return {
        "aggregate": None if p.n_rows else "There are no rows.",
        "group": None if dims else "There is no column to group by.",
        "time": no_date,
        "trend": periods(4),
        "forecast": periods(6),
        "seasonality": periods(season),
        "margin": None if revenue and profit and profit.additive else "It takes a revenue and an additive profit column.",
        "correlation": None if len(measures) >= 2 else "It takes two numeric measures.",
        "customers": None if customer else "There is no customer column.",
        "cohort": (None if customer else "There is no customer column.") or no_date,
        "funnel": None if p.meaning("stage") else "There is no stage column.",
        "outliers": None if measures else "There is no numeric measure.",
    }

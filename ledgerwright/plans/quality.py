"""How far a dataset can be trusted: issues of twelve kinds and a score that they explain."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from .clean import ColumnMeta
from .profile import ColumnProfile, Profile

# What an issue takes off the score, and what should not be negative, by meaning or by a word of the name.
WEIGHTS = {"high": 9, "medium": 4, "low": 1.2}
NOT_NEGATIVE = frozenset({"quantity", "price", "revenue"})
NOT_NEGATIVE_WORDS = frozenset("qty quantity unit units price sales revenue".split())


@dataclass(frozen=True)
class Issue:
    kind: str
    severity: str
    column: str | None
    affected: int
    message: str
    fix: str


def _above(share: float, high: float | None, medium: float) -> str:
    return "high" if high is not None and share > high else "medium" if share > medium else "low"


def _of_column(p: Profile, c: ColumnProfile, today: date | None) -> Iterator[Issue]:
    if not c.count:
        yield Issue("empty_column", "low", c.name, p.n_rows, f'"{c.name}" has no values.', "Leave it out of analyses.")
        return
    if c.distinct <= 1 and c.count > 1 and c.role != "time":
        yield Issue("constant_column", "low", c.name, c.count, f'"{c.name}" has one value only.', "It explains no differences; insights leave it out.")
    if c.missing_pct > 2:
        yield Issue("missing_values", _above(c.missing_pct, 25, 8), c.name, p.n_rows - c.count, f'{c.missing_pct:.1f}% of "{c.name}" is blank.', "Blanks are left out of calculations and shown as (blank) in groups; none is filled in.")
    if c.role == "measure" and c.count >= 12:
        n, low, high = p.outliers.get(c.name, (0, None, None))
        if n > 0.01 * c.count:
            yield Issue("outliers", _above(n / c.count * 100, None, 5), c.name, n, f'{n:,} value(s) of "{c.name}" lie beyond {low:,.2f} to {high:,.2f}.', "They are kept; look at them before leaving any out.")
    negatives = c.stats.get("negatives") if c.kind == "number" else 0
    meant = c.meaning in NOT_NEGATIVE or c.meaning not in ("profit", "margin") and not NOT_NEGATIVE_WORDS.isdisjoint(re.split(r"[^a-z]+", c.name.lower()))
    if negatives and meant:
        yield Issue("implausible_values", "medium", c.name, negatives, f'"{c.name}" has {negatives:,} negative value(s).', "They stay in all totals; find out whether they are returns or mistakes.")
    if c.kind == "string" and c.role == "dimension" and not c.chart and c.count >= 20 and c.distinct > 200 and c.distinct > 0.5 * c.count:
        yield Issue("high_cardinality_text", "low", c.name, c.distinct, f'"{c.name}" has {c.distinct:,} different values, too many for a chart.', "It serves for rankings only.")
    if today and c.role == "time" and c.meaning == "event_date" and c.stats.get("max") and c.stats["max"] > today:
        yield Issue("future_dates", "medium", c.name, 1, f'"{c.name}" goes on after today, to {c.stats["max"]}.', "Find out whether these rows are plans or mistakes.")


def _of_cleaning(suggestions: Sequence[dict], meta: Mapping[str, ColumnMeta]) -> Iterator[Issue]:
    for m in meta.values():
        if m.unparsed and m.kind != "string":
            share = m.unparsed / m.present * 100 if m.present else 0.0
            yield Issue("invalid_values", _above(share, None, 5), m.name, m.unparsed, f'{m.unparsed:,} value(s) of "{m.name}" are no {m.kind}s and became blank.', "The log of the cleaning lists the column; the file is as it was.")
        if m.ambiguous_order:
            order = "the day" if m.date_order == "dmy" else "the month"
            yield Issue("ambiguous_dates", "medium", m.name, m.present, f'Dates of "{m.name}" fit both orders; {order} was taken to come first.', "Confirm the order.")
    for s in suggestions:
        if s["kind"] == "normalize_labels":
            yield Issue("inconsistent_labels", "medium", s.get("column"), s.get("labels", 0), s["message"], "Merge the spellings.")
        elif s["kind"] == "review_mixed_type":
            yield Issue("mixed_types", "medium", s.get("column"), s.get("cells", 0), s["message"], "Split the column or correct its values.")


def quality(p: Profile, suggestions: Sequence[dict] = (), meta: Mapping[str, ColumnMeta] | None = None, today: date | None = None) -> dict:
    """score (12 to 100), label, completeness, issues (worst first) and how many of each severity.

    100 less 1.6 for each percent of missing cells (30 at most), 4 for each percent of
    repeated rows (20 at most) and the weights of the issues (35 at most).
    suggestions and meta are what cleaning found; with today dates after it are an
    issue. Outliers are counted beyond fences from quartiles with a rank error of
    at most one in ten thousand.
    """
    issues = [i for c in p.columns.values() for i in _of_column(p, c, today)]
    cells = p.n_rows * len(p.columns)
    missing = sum(p.n_rows - c.count for c in p.columns.values()) / cells * 100 if cells else 0.0
    duplicate = p.duplicates / p.n_rows * 100 if p.n_rows else 0.0
    if p.duplicates:
        issues.append(Issue("duplicate_rows", _above(duplicate, 5, 0.1), None, p.duplicates, f"{p.duplicates:,} row(s) repeat an earlier one.", "They are kept; remove them if they are no transactions of their own."))
    issues += _of_cleaning(suggestions, meta or {})
    issues.sort(key=lambda i: (-WEIGHTS[i.severity], -i.affected, i.kind, i.column or ""))
    score = 100 - min(30, 1.6 * missing) - min(20, 4 * duplicate) - min(35, sum(WEIGHTS[i.severity] for i in issues))
    score = math.floor(min(100, max(12, score)) + 0.5)
    label = "Excellent" if score >= 90 else "Good" if score >= 75 else "Fair" if score >= 60 else "Needs attention"
    counts = {s: sum(i.severity == s for i in issues) for s in WEIGHTS}
    return {"score": score, "label": label, "completeness": max(0.0, 100 - missing), "missing_pct": missing, "duplicate_pct": duplicate, "issues": [vars(i) for i in issues], "counts": counts}

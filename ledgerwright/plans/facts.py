"""Facts, display forms and results: every figure shown has an id and an exact value."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

UNITS = ("currency", "percent", "count", "ratio", "number", "days", "text", "date")
_SYMBOL = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "JPY": "¥"}


@dataclass(frozen=True)
class Fact:
    id: str
    label: str
    value: object
    unit: str
    display: str


@dataclass
class Result:
    """What a tool found: data (plain values), facts, a summary made of the facts' displays, and how it was done."""

    tool: str
    data: dict
    facts: list[Fact] = field(default_factory=list)
    summary: str = ""
    caveats: list[str] = field(default_factory=list)
    chart: dict | None = None
    provenance: dict = field(default_factory=dict)
    ok: bool = True


@dataclass
class Failure:
    tool: str
    code: str
    message: str
    hint: str | None = None
    ok: bool = False


def clean_number(v: object) -> object:
    """No NaN and no infinity leaves a result."""
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, dict):
        return {k: clean_number(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [clean_number(x) for x in v]
    return v


def compact(v: float) -> str:
    """Grouped digits; from ten thousand on K, M, B or T."""
    size = abs(v)
    for limit, letter in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e4, "K")):
        if size >= limit:
            return f"{v / {'T': 1e12, 'B': 1e9, 'M': 1e6, 'K': 1e3}[letter]:.1f}{letter}"
    return f"{v:,.0f}" if float(v).is_integer() else f"{v:,.2f}"


def display(value: object, unit: str = "number", currency: str | None = None) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "—"
    if isinstance(value, str) or unit in ("text", "date"):
        return str(value)
    v = float(value)
    if unit == "percent":
        return f"{v:.1f}%"
    if unit == "currency":
        return ("-" if v < 0 else "") + _SYMBOL.get(currency or "", "") + compact(abs(v))
    if unit == "ratio":
        return f"{v:.2f}"
    if unit == "days":
        return f"{v:,.0f} days"
    return f"{v:,.0f}" if unit == "count" else compact(v)


class Builder:
    """Collects the facts of one tool call."""

    def __init__(self, tool: str, currency: str | None = None) -> None:
        self.tool, self.currency = tool, currency
        self.facts: list[Fact] = []
        self.caveats: list[str] = []

    def fact(self, label: str, value: object, unit: str = "number") -> str:
        """Record a figure and return how it is shown."""
        value = clean_number(value)
        shown = display(value, unit, self.currency)
        self.facts.append(Fact(f"{self.tool}.{len(self.facts) + 1}", label, value, unit, shown))
        return shown

    def done(self, data: dict, summary: str, provenance: dict, chart: dict | None = None) -> Result:
        return Result(self.tool, clean_number(data), self.facts, summary, self.caveats, clean_number(chart), provenance)

"""Typed predicates, combined by AND, as sargable column expressions.

Blank values satisfy no predicate but is_null - not even neq and not_in. Text is
compared without regard to case. Dates are compared with period keys, each of
which stands for its whole range: gt 2025 is after 2025-12-31.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError
from ..functions.calendar import range_of_key
from ..functions.expressions import quoted
from ..functions.values import FALSE_TOKENS, TRUE_TOKENS, number_of
from .labels import Labels

OPS = ("eq", "neq", "in", "not_in", "contains", "gt", "gte", "lt", "lte", "between", "is_null", "not_null")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object = None
    values: tuple = ()

    def all_values(self) -> list:
        return [v for v in (*((self.value,) if self.value is not None else ()), *self.values)]


def kind_of(df: DataFrame, name: str) -> str:
    """number, date, boolean or string."""
    field = next((f for f in df.schema.fields if f.name == name), None)
    if field is None:
        raise AnalysisError("unknown_column", f'There is no column "{name}".', "Columns: " + ", ".join(df.columns[:20]))
    if isinstance(field.dataType, T.NumericType):
        return "number"
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "boolean" if isinstance(field.dataType, T.BooleanType) else "string"


def typed(df: DataFrame, name: str) -> Column:
    """The column as the engine reads it: numbers without NaN, dates without time."""
    c, kind = quoted(name), kind_of(df, name)
    if kind == "number":
        is_float = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
        return F.nanvl(c.cast("double"), F.lit(None).cast("double")) if is_float else c.cast("double")
    if kind == "date":
        return c if isinstance(df.schema[name].dataType, T.DateType) else c.cast("date")
    return c if kind == "boolean" or isinstance(df.schema[name].dataType, T.StringType) else c.cast("string")


def _text(c: Column, f: Filter, labels: Labels | None = None) -> Column:
    """With a dictionary of the column's labels a comparison with the spellings that occur, else with lower(column)."""
    values = [str(v).strip().lower() for v in f.all_values()]
    if not values:
        raise AnalysisError("invalid_filter", f'The filter on "{f.column}" needs a value.')
    if f.op not in ("contains", "eq", "in", "neq", "not_in"):
        raise AnalysisError("invalid_filter", f'"{f.column}" holds text; {f.op} does not apply.', "Use eq, neq, in, not_in or contains.")
    known = None
    if labels and labels.knows(f.column):
        known = labels.containing(f.column, values) if f.op == "contains" else labels.spellings(f.column, values)
    if known is not None:
        if f.op in ("neq", "not_in"):
            return ~c.isin(*known) if known else c.isNotNull()
        return c.isin(*known) if known else F.lit(False)
    low = F.lower(c)
    if f.op == "contains":
        return reduce(lambda a, b: a | b, (low.contains(v) for v in values))
    return low.isin(*values) if f.op in ("eq", "in") else ~low.isin(*values)


def _number(c: Column, f: Filter) -> Column:
    values = [number_of(v) for v in f.all_values()]
    if not values or None in values:
        raise AnalysisError("invalid_filter", f'The filter on "{f.column}" needs a number.')
    first = values[0]
    simple = {"eq": lambda: c == first, "neq": lambda: c != first, "gt": lambda: c > first, "gte": lambda: c >= first, "lt": lambda: c < first, "lte": lambda: c <= first}
    if f.op in simple:
        return simple[f.op]()
    if f.op == "in":
        return c.isin(*values)
    if f.op == "not_in":
        return ~c.isin(*values)
    if f.op == "between":
        if len(values) < 2:
            raise AnalysisError("invalid_filter", f'between on "{f.column}" needs two numbers.')
        return c.between(min(values[:2]), max(values[:2]))
    raise AnalysisError("invalid_filter", f'"{f.column}" holds numbers; {f.op} does not apply.')


def _date(c: Column, f: Filter) -> Column:
    spans = [range_of_key(str(v)) for v in f.all_values()]
    if not spans or None in spans:
        raise AnalysisError("invalid_filter", f'The filter on "{f.column}" needs a date or period.', "For example 2025-03-31, 2025-03, 2025-Q1 or 2025.")
    (lo, hi), inside = spans[0], [c.between(a, b) for a, b in spans]
    simple = {"eq": lambda: inside[0], "neq": lambda: ~inside[0], "gt": lambda: c > F.lit(hi), "gte": lambda: c >= F.lit(lo), "lt": lambda: c < F.lit(lo), "lte": lambda: c <= F.lit(hi)}
    if f.op in simple:
        return simple[f.op]()
    anywhere = reduce(lambda a, b: a | b, inside)
    if f.op == "in":
        return anywhere
    if f.op == "not_in":
        return ~anywhere
    if f.op == "between":
        if len(spans) < 2:
            raise AnalysisError("invalid_filter", f'between on "{f.column}" needs two periods.')
        return c.between(min(a for a, _ in spans[:2]), max(b for _, b in spans[:2]))
    raise AnalysisError("invalid_filter", f'"{f.column}" holds dates; {f.op} does not apply.')


def _boolean(c: Column, f: Filter) -> Column:
    first = str(next(iter(f.all_values()), "")).strip().lower()
    if first not in TRUE_TOKENS + FALSE_TOKENS or f.op not in ("eq", "neq", "in", "not_in"):
        raise AnalysisError("invalid_filter", f'"{f.column}" is yes or no; use eq or neq with one of them.')
    wanted = first in TRUE_TOKENS
    return c == F.lit(wanted if f.op in ("eq", "in") else not wanted)


def condition(df: DataFrame, f: Filter, labels: Labels | None = None) -> Column:
    """The predicate of one filter; a combination that makes no sense raises invalid_filter."""
    if f.op not in OPS:
        raise AnalysisError("invalid_filter", f"There is no filter operation {f.op!r}.", "One of " + ", ".join(OPS))
    c, kind = typed(df, f.column), kind_of(df, f.column)
    if f.op == "is_null":
        return c.isNull()
    if f.op == "not_null":
        return c.isNotNull()
    if kind == "string":
        return _text(c, f, labels)
    return {"number": _number, "date": _date, "boolean": _boolean}[kind](c, f)


def apply_filters(df: DataFrame, filters: Sequence[Filter], labels: Labels | None = None) -> DataFrame:
    """Rows that satisfy all filters; predicates reach the scan where their types allow, those on text where labels lists the column's values."""
    return reduce(lambda out, f: out.where(condition(df, f, labels)), filters, df)


def closest_values(df: DataFrame, column: str, value: str, k: int = 5) -> DataFrame:
    """Values of a text column that may have been meant: value, score (0: contains it, else edits, 3 at most)."""
    if kind_of(df, column) != "string":
        raise AnalysisError("wrong_type", f'"{column}" does not hold text.')
    wanted = value.strip().lower()
    low = F.lower("value")
    edits = F.levenshtein(low, F.lit(wanted), 3)
    score = F.when(low.contains(wanted) | F.lit(wanted).contains(low), 0).when(edits >= 0, edits)
    distinct = df.select(typed(df, column).alias("value")).where("value is not null").distinct()
    return distinct.withColumn("score", score.cast("bigint")).where("score is not null").orderBy("score", "value").limit(k)


def describe(f: Filter) -> str:
    """The filter in words, for provenance."""
    words = {"eq": "is", "neq": "is not", "in": "is one of", "not_in": "is none of", "contains": "contains", "gt": "is above", "gte": "is at least", "lt": "is below", "lte": "is at most"}
    values = [str(v) for v in f.all_values()]
    if f.op == "is_null":
        return f"{f.column} is blank"
    if f.op == "not_null":
        return f"{f.column} is not blank"
    if f.op == "between" and len(values) >= 2:
        return f"{f.column} is between {values[0]} and {values[1]}"
    return f"{f.column} {words.get(f.op, f.op)} {', '.join(values)}"

"""From text cells to a typed table: inference, parsing, and a log of what was done.

All evidence about all columns comes from one aggregation over the rows. Cells, the parts
of cells that parsers look at, and what parses are projections of their own, one on the
other, so each regular expression runs once a cell; nothing is materialised on the way.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as val
from ..operators.filters import quoted

ROW_ID = "__row_id"
_BOOL_WORDS = (*val.TRUE_TOKENS, *val.FALSE_TOKENS)
_CURRENCIES = sorted({*val.CURRENCY_SYMBOLS.values(), *(c for c in val.CURRENCY_CODES if c.isalpha() and c != "RS")})


@dataclass
class ColumnMeta:
    """How a column was read."""

    name: str
    kind: str  # number, date, string, boolean
    currency: str | None = None
    percent: bool = False
    locale: str = "us"
    date_order: str = "mdy"
    ambiguous_order: bool = False
    has_time: bool = False
    mixed: bool = False
    unparsed: int = 0
    present: int = 0
    text: bool = False  # whether it came as text
    trimmed: int = 0
    null_tokens: int = 0
    numeric_dates: int = 0
    examples: tuple[str, ...] = ()


@dataclass
class Cleaned:
    df: DataFrame
    meta: dict[str, ColumnMeta]
    n_rows: int
    log: list[dict] = field(default_factory=list)
    suggestions: list[dict] = field(default_factory=list)


def _parts(x: Column) -> dict[str, Column]:
    """What the parsers need of a cell, by name: columns of their own, so each is computed once."""
    t, negative, percent = val.bare(x)
    text, day = val.date_texts(x)
    return {"t": t, "negative": negative, "percent": percent, "text": text, "day": day}


_GROUPINGS = ("commas", "thousands", "points", "others")


def _deeper(at: Callable[[str], Column], kinds: Sequence[str] = ("number", "date")) -> dict[str, Column]:
    """What both locales, both orders and the votes share, from the parts of a cell; a stage of its own for the same reason."""
    return (val.groupings(at("t")) if "number" in kinds else {}) | ({"runs": val.runs_of_date(at("text"), at("day"))} if "date" in kinds else {})


def _evidence(raw: DataFrame, texts: Sequence[str]) -> dict:
    """Figures about every text column, from one pass: cells, then their parts, then what parses, then counts.

    The cells of all columns stand below each other with the number of their column, so the
    expressions are as long for many columns as for one: beyond a few columns side by side
    Spark can no longer compile them and interprets each. Equal cells of a column are parsed
    once and count as often as they occur.
    """
    side = [F.struct(F.lit(i).alias("i"), quoted(c).alias("raw")) for i, c in enumerate(texts)]
    long = raw.select(F.inline(F.array(*side))).groupBy("i", "raw").agg(F.count(F.lit(1)).alias("times"))
    cells = long.select("i", "times", val.cell(F.col("raw")).alias("x"), F.col("raw").isNotNull().alias("given"), (F.col("raw") != F.trim("raw")).alias("tr"))
    parts = cells.select("*", *[v.alias(k) for k, v in _parts(F.col("x")).items()])
    parts = parts.select("*", *[v.alias(k) for k, v in _deeper(F.col).items()])
    at = F.col
    number, known = (at("t"), at("negative"), at("percent")), {k: at(k) for k in _GROUPINGS}
    eu, us = val.votes_from(at("t"), known)
    dmy, mdy, numeric = val.order_votes_of_runs(at("runs"))
    truth = val.parse_bool(at("x"))
    found = [
        at("i"), at("times"), at("x"), at("given"), at("tr"), val.number_from(*number, known=known).isNotNull().alias("us"), val.number_from(*number, "eu", known).isNotNull().alias("eu"), eu.alias("ve"), us.alias("vu"),
        val.date_of_runs(at("runs"), "dmy").isNotNull().alias("dd"), val.date_of_runs(at("runs"), "mdy").isNotNull().alias("md"), dmy.alias("vd"), mdy.alias("vm"), numeric.alias("nu"),
        val.has_time_from(at("text"), at("day")).alias("ht"), F.when(truth.isNotNull(), F.lower(at("x"))).alias("bo"), at("x").endswith("%").alias("pc"), val.currency_of(at("x")).alias("cu"),
    ]
    often = lambda if_so: F.coalesce(F.sum(F.when(if_so, at("times"))), F.lit(0))
    bools = [often(at("bo") == word).alias(f"b{k}") for k, word in enumerate(_BOOL_WORDS)]
    money = [often(at("cu") == code).alias(f"c{k}") for k, code in enumerate(_CURRENCIES)]
    aggs = [F.sum("times").alias("rows"), often(at("x").isNotNull()).alias("n"), often(at("given") & at("x").isNull()).alias("nt"), *bools, *money]
    aggs += [often(at(k)).alias(k) for k in ("us", "eu", "dd", "md", "ht", "pc", "tr")] + [F.sum(at(k) * at("times")).alias(k) for k in ("ve", "vu", "vd", "vm", "nu")]
    rows = {r["i"]: r.asDict() for r in parts.select(*found).groupBy("i").agg(*aggs).collect()}  # a row a column
    names = ("n", "nt", "us", "eu", "dd", "md", "ht", "pc", "tr")
    out = {"rows": rows[0]["rows"] if rows else 0}
    for i in range(len(texts)):
        row = rows.get(i) or dict.fromkeys(names, 0) | dict.fromkeys(("ve", "vu", "vd", "vm", "nu"))
        words = [row.get(f"b{k}", 0) for k in range(len(_BOOL_WORDS))]
        codes = [row.get(f"c{k}", 0) for k in range(len(_CURRENCIES))]
        out |= {f"{k}{i}": row[k] for k in (*names, "ve", "vu", "vd", "vm", "nu")}
        out |= {f"bo{i}": sum(words), f"bd{i}": sum(w > 0 for w in words), f"cu{i}": sum(codes), f"cc{i}": _CURRENCIES[codes.index(max(codes))] if max(codes) else None}
    return out


def clean(raw: DataFrame, threshold: float = 0.9, date_orders: dict[str, str] | None = None) -> Cleaned:
    """A typed table of raw's columns.

    A column is boolean if nine in ten values are yes/no words of at most four
    spellings, else a number or a date if threshold of them parse, else text (with
    a hint where half of them were numbers or dates). Decimal and date orders are
    decided per column. Rows without any value go. Text keeps its case.
    """
    typed_in = {f.name: f.dataType for f in raw.schema.fields if f.name != ROW_ID}
    texts = [c for c, t in typed_in.items() if isinstance(t, T.StringType)]
    row = _evidence(raw, texts) if texts else raw.agg(F.count(F.lit(1)).alias("rows")).first().asDict()
    meta, columns, log, hints = {}, [], [], []
    for name, kind in typed_in.items():
        if name not in texts:
            if isinstance(kind, T.NumericType):
                c = quoted(name).cast("double")
                columns.append(F.nanvl(c, F.lit(None).cast("double")).alias(name))
                meta[name] = ColumnMeta(name, "number")
            elif isinstance(kind, T.BooleanType):
                columns.append(quoted(name))
                meta[name] = ColumnMeta(name, "boolean")
            elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                columns.append(quoted(name).cast("date").alias(name))
                meta[name] = ColumnMeta(name, "date", has_time=not isinstance(kind, T.DateType))
            else:
                columns.append(quoted(name).cast("string").alias(name))
                meta[name] = ColumnMeta(name, "string")
            continue
        i = texts.index(name)
        e = {k: row[f"{k}{i}"] for k in ("n", "us", "eu", "ve", "vu", "dd", "md", "vd", "vm", "nu", "ht", "bo", "bd", "pc", "cu", "cc", "nt", "tr")}
        n, at = e["n"], lambda k, i=i: F.col(f"__{k}{i}")
        locale = "eu" if (e["ve"] or 0) > (e["vu"] or 0) else "us"
        order = (date_orders or {}).get(name) or ("dmy" if (e["vd"] or 0) > (e["vm"] or 0) else "mdy")
        numbers, dates = e[locale], e["dd" if order == "dmy" else "md"]
        m = ColumnMeta(name, "string", locale=locale, date_order=order, present=n, text=True, trimmed=e["tr"], null_tokens=e["nt"])
        if e["nt"]:
            log.append({"kind": "null_tokens", "column": name, "cells": e["nt"]})
        if n and e["bo"] >= 0.9 * n and e["bd"] <= 4:
            m.kind, c, parsed = "boolean", val.parse_bool(at("x")), e["bo"]
        elif n and numbers >= threshold * n and numbers >= dates:
            m.kind, c, parsed = "number", val.number_from(at("t"), at("negative"), at("percent"), locale), numbers
            m.percent = e["pc"] >= 0.5 * numbers
            m.currency = e["cc"] if e["cu"] >= 0.3 * numbers else None
        elif n and dates >= threshold * n:
            m.kind, c, parsed = "date", val.date_from(at("text"), at("day"), order), dates
            m.has_time, m.numeric_dates = bool(e["ht"]), e["nu"] or 0
            m.ambiguous_order = bool(e["nu"]) and not e["vd"] and not e["vm"] and name not in (date_orders or {})
            if m.ambiguous_order:
                hints.append({"kind": "confirm_date_order", "column": name, "message": f'Dates in "{name}" fit both orders; month first was assumed.'})
        else:
            c, parsed = at("x"), n
            m.mixed = bool(n) and max(numbers, dates) >= 0.5 * n
            if m.mixed:
                hints.append({"kind": "review_mixed_type", "column": name, "cells": n, "message": f'"{name}" mixes text with {"numbers" if numbers >= dates else "dates"}.'})
        m.unparsed = n - parsed
        if m.unparsed:
            log.append({"kind": "unparsed_values", "column": name, "cells": m.unparsed, "type": m.kind})
        if m.kind != "string":
            log.append({"kind": "typed", "column": name, "type": m.kind})
        meta[name] = m
        columns.append(c.alias(name))
    keep = [ROW_ID] if ROW_ID in raw.columns else []
    cells = raw.select("*", *[val.cell(quoted(c)).alias(f"__x{i}") for i, c in enumerate(texts)])
    needed = [(i, {"number": ("t", "negative", "percent"), "date": ("text", "day")}.get(meta[c].kind, ())) for i, c in enumerate(texts)]
    held = cells.select("*", *[v.alias(f"__{k}{i}") for i, names in needed for k, v in _parts(F.col(f"__x{i}")).items() if k in names])
    typed_rows = held.select(*columns, *keep) if typed_in else raw
    out = typed_rows.dropna(how="all", subset=list(typed_in)) if typed_in else raw
    n_rows = _counted(held, columns, texts, meta) if typed_in else raw.count()
    if n_rows < row["rows"]:
        log.append({"kind": "empty_rows", "rows": row["rows"] - n_rows})
    hints += label_clashes(typed_rows, [c for c, m in meta.items() if m.kind == "string"])
    return Cleaned(out, meta, n_rows, log, hints)


def _counted(held: DataFrame, columns: Sequence[Column], texts: Sequence[str], meta: dict[str, ColumnMeta]) -> int:
    """Rows with any value; in the same pass the first and the last of the texts that became blank, as examples of their columns.

    Where each cell of a column was read, its cells say what is blank; only other columns are parsed here.
    """
    place = {c: i for i, c in enumerate(texts)}
    unread = [c for c in texts if meta[c].unparsed and meta[c].kind != "string"]
    typed_cells = held.select(*[c if name not in place or name in unread else F.col(f"__x{place[name]}").alias(name) for name, c in zip(meta, columns, strict=True)], *[F.col(f"__x{place[c]}").alias(f"__was{k}") for k, c in enumerate(unread)])
    present = [quoted(c).isNotNull() for c in meta]
    lost = [F.when(quoted(c).isNull(), F.col(f"__was{k}")) for k, c in enumerate(unread)]
    row = typed_cells.agg(F.count_if(reduce(lambda a, b: a | b, present)).alias("n"), *[f(x).alias(f"{f.__name__}{k}") for k, x in enumerate(lost) for f in (F.min, F.max)]).first()
    for k, c in enumerate(unread):
        meta[c].examples = tuple(dict.fromkeys(x[:80] for x in (row[f"min{k}"], row[f"max{k}"]) if x is not None))
    return row["n"]


def label_clashes(df: DataFrame, columns: Sequence[str], most: int = 5000) -> list[dict]:
    """Text columns whose labels differ in case or spacing only: one pass over all of them."""
    if not columns:
        return []
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in columns])).alias("p")).select("p.*").where("value is not null").distinct()
    folded = pairs.withColumn("label", F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))))
    per = folded.groupBy("column", "label").agg(F.count("*").alias("n")).groupBy("column").agg(F.sum("n").alias("values"), F.count_if(F.col("n") > 1).alias("clashes"))
    return [
        {"kind": "normalize_labels", "column": r["column"], "labels": r["clashes"], "message": f'{r["clashes"]} label(s) of "{r["column"]}" are spelt in several ways.'}
        for r in per.where(f"clashes > 0 and values between 2 and {most}").orderBy("column").collect()
    ]


def normalize_labels(df: DataFrame, column: str, order: str = ROW_ID) -> DataFrame:
    """Labels equal but for case, spacing and compatibility forms take the most frequent spelling, of equals the earliest.

    Only the distinct labels are folded in Python; the mapping is joined back.
    """
    counts = df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("label")).agg(F.count("*").alias("n"), F.min(quoted(order)).alias("first"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [" ".join(unicodedata.normalize("NFKC", t).split()).lower() for t in batch.column("label").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded)], names=["label", "n", "first", "folded"])

    labels = counts.select("label", "n", F.col("first").cast("long").alias("first")).mapInArrow(fold, "label string, n long, first long, folded string")
    best = F.first("label").over(Window.partitionBy("folded").orderBy(F.desc("n"), "first"))
    mapping = labels.select(F.col("label").alias("__from"), best.alias("__to")).where("__from <> __to")
    joined = df.join(mapping, quoted(column) == F.col("__from"), "left")
    return joined.select(*[F.coalesce("__to", quoted(c)).alias(c) if c == column else quoted(c) for c in df.columns])

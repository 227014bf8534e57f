"""What preparing a dataset did to it, step by step, and what is left for its owner to decide."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from .clean import Cleaned, ColumnMeta

#: Issues of the quality report that a version with other options would settle, and what it would do.
DECISIONS = {"duplicate_rows": "remove_duplicates", "outliers": "review_outliers", "empty_column": "drop_empty_column", "implausible_values": "review_negative_values"}


def _step(kind: str, affected: int, detail: str, column: str | None = None, severity: str = "info", examples: Sequence[str] = ()) -> dict:
    return {"kind": kind, "column": column, "affected": affected, "severity": severity, "detail": detail, "examples": list(examples)}


def _of_column(m: ColumnMeta) -> Iterator[dict]:
    if m.trimmed:
        yield _step("trim_whitespace", m.trimmed, f'White space around {m.trimmed:,} value(s) of "{m.name}" was taken off.', m.name)
    if m.null_tokens:
        yield _step("null_tokens", m.null_tokens, f'{m.null_tokens:,} value(s) of "{m.name}" such as "N/A" or "-" are blank.', m.name)
    if not m.text:
        return
    parsed = m.present - m.unparsed
    if m.kind == "number":
        if m.locale == "eu":
            yield _step("detect_locale", m.present, f'Numbers of "{m.name}" have decimal commas.', m.name, "notice")
        how = f" in {m.currency}" if m.currency else " as shares" if m.percent else ""
        yield _step("parse_numbers", parsed, f'"{m.name}" was read as numbers{how}.', m.name)
    elif m.kind == "date":
        if m.numeric_dates:
            first = "the day" if m.date_order == "dmy" else "the month"
            yield _step("date_order", m.numeric_dates, f'Dates of "{m.name}" have {first} first{", which no value proves" if m.ambiguous_order else ""}.', m.name, "warning" if m.ambiguous_order else "notice")
        yield _step("parse_dates", parsed, f'"{m.name}" was read as dates{"; times of day were dropped" if m.has_time else ""}.', m.name)
    elif m.kind == "boolean":
        yield _step("parse_booleans", parsed, f'"{m.name}" was read as yes or no.', m.name)
    if m.unparsed and m.kind != "string":
        yield _step("coerce_invalid", m.unparsed, f'{m.unparsed:,} value(s) of "{m.name}" are no {m.kind}s and became blank.', m.name, "warning", m.examples)


def transformations(cleaned: Cleaned, *, renamed: Iterable[tuple[str, str]] = (), merged: Iterable[tuple[str, int]] = (), duplicates: int = 0, dropped: Sequence[str] = ()) -> list[dict]:
    """The steps from a file to a version: kind, column, affected cells, rows or columns, severity, detail, examples.

    renamed: (header, name) pairs; merged: (column, labels) whose spellings were made
    one; duplicates: repeated rows removed; dropped: columns left out.
    """
    out = [_step("rename_column", 1, f'The column "{old}" is called "{new}".', new) for old, new in renamed if old != new]
    for m in cleaned.meta.values():
        out += _of_column(m)
    empty = sum(x["rows"] for x in cleaned.log if x["kind"] == "empty_rows")
    if empty:
        out.append(_step("drop_empty_rows", empty, f"{empty:,} row(s) without any value were left out."))
    if dropped:
        out.append(_step("drop_columns", len(dropped), "Left out as asked: " + ", ".join(dropped) + "."))
    out += [_step("normalize_labels", labels, f'{labels:,} label(s) of "{column}" take their most frequent spelling.', column, "notice") for column, labels in merged]
    if duplicates:
        out.append(_step("remove_duplicates", duplicates, f"{duplicates:,} row(s) that repeat an earlier one were removed.", None, "notice"))
    return out


def decisions(cleaned: Cleaned, report: dict) -> list[dict]:
    """Suggestions of all seven kinds: those of cleaning, then those that the quality report's issues ask for."""
    asked = [{"kind": DECISIONS[i["kind"]], "column": i["column"], "affected": i["affected"], "message": i["message"]} for i in report["issues"] if i["kind"] in DECISIONS]
    return [*cleaned.suggestions, *asked]

"""Numbers in prose, and whether a computed fact stands behind each."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .facts import Fact, Result

_SCALE = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "trillion": 1e12}
_CLAIM = re.compile(r"(?<![\w.])(?P<sign>[-−+]?)(?P<symbol>(?:[ACSR]|MX)?\$|[€£¥₹₩₽₺₫฿₦₴₪]|)\s?(?P<digits>\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?P<scale>\s?(?:[KMBTkmbt]n?\b|thousand\b|million\b|billion\b|trillion\b))?(?P<percent>\s?(?:%|percent\b|pct\b))?")
_MASKED = re.compile(
    r"`[^`\n]*`|\b(?:https?://|www\.)\S+|\b\d{1,2}:\d{2}(?::\d{2})?(?:\s?[ap]\.?m\b)?|\b\d+(?:st|nd|rd|th)\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{4}-\d{2}\b|\b\d{4}-?Q[1-4]\b|\bQ[1-4](?:\s+\d{4})?\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?:\d{1,2},?\s+)?\d{4}\b|\b(?:19|20)\d{2}\b(?!\s?%)|\b[A-Za-z]+[-_#]?\d[\w-]*\b|^\s*\d+[.)]\s",
    re.I | re.M,
)


# Small numbers in words ("one" is no count as a rule), words after which they are no count, and hedges.
_SPELT = {w: n for n, w in enumerate("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), 2)}
_NOT_COUNTED = frozenset("of or and to in at on for the a is are was were by as than".split())
_HEDGES = frozenset("about around roughly approximately approx nearly almost circa over under".split())
#: A hedged number may be off by so many times what its last digit allows.
HEDGE = 2.0


@dataclass(frozen=True)
class Claim:
    text: str
    value: float
    tolerance: float
    percent: bool
    currency: str | None


def claims_of(sentence: str, labels: Iterable[str] = ()) -> list[Claim]:
    """Numeric claims; dates, times, ordinals, periods, codes, list numbers, addresses, inline code and the given labels are no claims.

    Numbers in words count before a noun ("three regions"). A number after a hedge
    ("about", "~") has HEDGE times the tolerance.
    """
    for label in sorted(labels, key=len, reverse=True):
        if any(ch.isdigit() for ch in label):
            sentence = sentence.replace(label, " ")
    out = []
    words = [(w[0].lower(), w.start()) for w in re.finditer(r"[A-Za-z]+", sentence)]
    for (word, at), (after, _) in zip(words, words[1:], strict=False):
        if word in _SPELT and after not in _NOT_COUNTED and re.match(r"\s+\w", sentence[at + len(word) :]):
            out.append(Claim(sentence[at : at + len(word)], float(_SPELT[word]), 0.5, False, None))
    for m in _CLAIM.finditer(_MASKED.sub(lambda m: " " * len(m[0]), sentence)):
        digits = m["digits"].replace(",", "")
        scale = _SCALE[m["scale"].strip().lower()] if m["scale"] else 1.0
        step = 10.0 ** -len(digits.partition(".")[2]) * scale
        value = float(digits) * scale * (-1 if m["sign"] in "-−" and m["sign"] else 1)
        before = re.findall(r"[a-z]+|~", sentence[: m.start()].lower())[-1:]
        wide = HEDGE if before and (before[0] in _HEDGES or before[0] == "~") else 1.0
        out.append(Claim(m[0].strip(), value, step / 2 * 1.0000001 * wide, bool(m["percent"]), m["symbol"] or None))
    return out


@dataclass
class Ledger:
    """What may be said: facts, labels, and numbers that the user gave."""

    facts: list[Fact] = field(default_factory=list)
    labels: set[str] = field(default_factory=set)
    given: list[float] = field(default_factory=list)

    def add(self, result: Result) -> None:
        self.facts += result.facts
        self.labels |= {f.label for f in result.facts}

    def user(self, text: str) -> None:
        self.given += [c.value for c in claims_of(text)]

    def supports(self, claim: Claim, sentence: str = "") -> bool:
        """Whether a fact rounds to the claim, in its unit and direction; small counts of things listed pass."""
        if any(abs(abs(claim.value) - abs(g)) <= claim.tolerance for g in self.given):
            return True
        falls = re.search(r"\b(fell|fall|drop|dropped|declin|decreas|down|lower|less|loss)", sentence, re.I)
        rises = re.search(r"\b(rose|rise|grew|growth|increas|up|higher|more|gain)", sentence, re.I)
        for f in self.facts:
            if not isinstance(f.value, (int, float)) or isinstance(f.value, bool):
                continue
            if claim.percent != (f.unit == "percent") or (claim.currency and f.unit != "currency"):
                continue
            if abs(f.value - claim.value) <= claim.tolerance:
                return not (claim.percent and f.label.startswith("change") and ((f.value > 0 and falls and not rises) or (f.value < 0 and rises and not falls)))
            if f.value < 0 <= claim.value and abs(-f.value - claim.value) <= claim.tolerance and falls:
                return True
        return False


_SENTENCE = re.compile(r"(?<=[.!?])(?<!\d\.)\s+|\n+")


@dataclass
class SentenceGate:
    """Lets text through sentence by sentence; those with a number that nothing supports are dropped."""

    ledger: Ledger
    held: str = ""
    sentences: int = 0
    numeric: int = 0
    dropped: list[str] = field(default_factory=list)
    judged: list[tuple[str, bool]] = field(default_factory=list)

    def _judge(self, sentence: str) -> str:
        if not sentence.strip():
            return sentence
        self.sentences += 1
        claims = claims_of(sentence, self.ledger.labels)
        self.numeric += bool(claims)
        kept = all(self.ledger.supports(c, sentence) for c in claims)
        self.judged.append((sentence.strip(), kept))
        if kept:
            return sentence
        self.dropped.append(sentence.strip())
        return ""

    def push(self, piece: str) -> str:
        """What may be shown after this piece of the stream."""
        self.held += piece
        out, at = [], 0
        for m in _SENTENCE.finditer(self.held):
            if m.end() == len(self.held):
                break  # the next piece may go on
            kept = self._judge(self.held[at : m.start()])
            out.append(kept + m[0] if kept else "")
            at = m.end()
        self.held = self.held[at:]
        return "".join(out)

    def flush(self) -> str:
        out, self.held = self._judge(self.held), ""
        return out

    @property
    def dropped_ratio(self) -> float:
        return len(self.dropped) / self.numeric if self.numeric else 0.0


def sanitize(text: str, ledger: Ledger) -> tuple[str, SentenceGate]:
    """The text without unsupported sentences, and the gate's account."""
    gate = SentenceGate(ledger)
    out = gate.push(text) + gate.flush()
    return re.sub(r"[ \t]{2,}", " ", out).strip(), gate


def count_claims(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_claims, the numeric claims of a text column (null: none)."""
    schema = T.StructType([*df.schema.fields, T.StructField("n_claims", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(claims_of(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_claims"])

    return df.mapInArrow(run, schema)

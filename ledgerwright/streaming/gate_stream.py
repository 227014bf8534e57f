"""The sentence gate as a stateful stream: pieces of text in, finished and supported sentences out.

Each conversation has state of its own: the facts said to it so far, the text that is
not yet a whole sentence, and counters. A timer lets out what a conversation that has
gone quiet still holds and forgets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.facts import Fact
from ..plans.grounding import Ledger, SentenceGate

#: What a piece may be: a figure that may be said from now on, text, or the end of an answer.
FACT, TEXT, END = "fact", "text", "end"
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and lists of state need, for queries started inside."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


class _Gate(StatefulProcessor):
    """Runs a SentenceGate for each conversation from batch to batch."""

    def __init__(self, key: str, idle_ms: int | None) -> None:
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held string, sentences long, numeric long, dropped long")
        self.facts = handle.getListState("facts", "label string, value double, unit string")

    def _gate(self) -> SentenceGate:
        facts = [Fact("", label or "", value, unit or "number", "") for label, value, unit in self.facts.get()]
        text, sentences, numeric, dropped = self.held.get() if self.held.exists() else ("", 0, 0, 0)
        return SentenceGate(Ledger(facts, {f.label for f in facts if f.label}), text, sentences, numeric, [""] * dropped)

    def _rows(self, key: tuple, gate: SentenceGate) -> Iterator[Row]:
        first = gate.sentences - len(gate.judged)
        for i, (sentence, kept) in enumerate(gate.judged):
            yield Row(**{self.key: key[0], "n": first + i + 1, "sentence": sentence, "kept": kept})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        gate, last = self._gate(), None
        for r in sorted(rows, key=lambda r: r["seq"]):
            if self.idle_ms is not None and r["__at"] is not None:
                last = max(r["__at"], last or r["__at"])
            if r["kind"] == FACT and r["value"] is not None:
                self.facts.appendValue((r["text"], r["value"], r["unit"]))
                gate.ledger.facts.append(Fact("", r["text"] or "", r["value"], r["unit"] or "number", ""))
                gate.ledger.labels |= {r["text"]} if r["text"] else set()
            elif r["kind"] == TEXT:
                gate.push(r["text"] or "")
            elif r["kind"] == END:
                gate.flush()
        self.held.update((gate.held, gate.sentences, gate.numeric, len(gate.dropped)))
        if last is not None:  # one timer a conversation, moved on with each piece
            for at in list(self.handle.listTimers()):
                last = max(last, at - self.idle_ms)
                self.handle.deleteTimer(at)
            self.handle.registerTimer(last + self.idle_ms)
        yield from self._rows(key, gate)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        gate = self._gate()
        gate.flush()
        self.held.clear()
        self.facts.clear()
        yield from self._rows(key, gate)

    def close(self) -> None:
        pass


def gated(pieces: DataFrame, key: str, time: str | None = None, idle_ms: int = 600_000) -> DataFrame:
    """key, n, sentence, kept of each finished sentence of a stream of pieces, for append mode.

    pieces: key, seq (long), kind (fact, text or end), text, value (double), unit. A
    fact's text is its label. A conversation's pieces are taken in the order of seq
    within a micro-batch, and batch by batch. A sentence is judged when the next one
    begins or at an end; kept says whether facts sent before it support all its
    numbers. With a time column (a timestamp) a conversation that had nothing for
    idle_ms of event time is judged to its end and forgotten, and pieces later than
    that are dropped, as by any watermark; without one its state stays. Null texts
    are empty, facts without a value are none, other kinds and columns are ignored.

    Start the query within state_store(): state lives in RocksDB and in the query's
    checkpoint, so a restart neither loses nor repeats sentences.
    """
    schema = T.StructType([
        T.StructField(key, pieces.schema[key].dataType), T.StructField("n", T.LongType()),
        T.StructField("sentence", T.StringType()), T.StructField("kept", T.BooleanType()),
    ])
    columns = [key, "seq", "kind", "text", "value", "unit"]
    if time is None:
        return pieces.select(*columns).groupBy(key).transformWithState(_Gate(key, None), schema, "Append", "None")
    stamped = pieces.withWatermark(time, f"{idle_ms} milliseconds").select(*columns, time, F.unix_millis(time).alias("__at"))
    return stamped.groupBy(key).transformWithState(_Gate(key, idle_ms), schema, "Append", "EventTime")


def gated_at_once(pieces: DataFrame, key: str) -> DataFrame:
    """gated of a table: the same rows, from the pieces of each conversation in the order of seq."""
    kind = pieces.schema[key].dataType.simpleString()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        gate = SentenceGate(Ledger())
        for piece, text, value, unit in frame.sort_values("seq", kind="stable")[["kind", "text", "value", "unit"]].itertuples(index=False):
            if piece == FACT and not pd.isna(value):
                gate.ledger.facts.append(Fact("", text or "", value, unit or "number", ""))
                gate.ledger.labels |= {text} if text else set()
            elif piece == TEXT:
                gate.push(text or "")
            elif piece == END:
                gate.flush()
        gate.flush()
        return pd.DataFrame({key: [frame[key].iloc[0]] * len(gate.judged), "n": range(1, len(gate.judged) + 1), "sentence": [s for s, _ in gate.judged], "kept": [k for _, k in gate.judged]})

    return pieces.select(key, "seq", "kind", "text", "value", "unit").groupBy(key).applyInPandas(one, f"`{key}` {kind}, n long, sentence string, kept boolean")

"""Vector code compression: product codes by Lloyd's rounds that keep their bounds in heaps.

Vectors of whole numbers are cut into parts, and each part position has a codebook.
Rows are laid out in blocks that stay as they are from round to round. A block knows
of each part its code and how much nearer its entry was than the second one (lower
bound minus upper bound, the slack). Entries move after a round; what an entry's own
move and the largest move of the others can take off a slack is added to the entry's
drift. In each block there is a heap for each entry, keyed by slack plus the drift at
the time, so the parts whose bounds the drift of the entry may have violated since are
at its top: only these are popped, compared with all entries exactly and put back.

A round is one pass over the blocks, written to the shared folder. What a round hands
on is the change of sums and counts per entry, of a size that the codebooks fix, so
neither a round's work nor the driver's grows with skew: copies of a vector are rows
like any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix_of, whole_vectors

#: Bytes of a block's vectors (as 64-bit numbers).
BLOCK_BYTES = 1 << 20
#: Scaled components must be below this in size: squared distances then fit a long for some 100,000 dimensions.
LARGEST = 1 << 22
#: Bounds are widened by this share, far above the rounding of doubles.
_EDGE = 1e-12


@dataclass(frozen=True)
class Codebooks:
    """entries: position x entry x component; drift: position x entry, how much slack each entry's parts may have lost so far."""

    entries: np.ndarray
    drift: np.ndarray

    def moved(self, entries: np.ndarray) -> Codebooks:
        """These codebooks with entries in their place and their moves added to the drift."""
        move = np.sqrt(((entries - self.entries) ** 2).sum(axis=2).astype(float))
        others = np.zeros_like(move)  # the largest move of any other entry of the position
        if move.shape[1] > 1:
            first = move.argmax(axis=1)
            row = np.arange(len(move))
            rest = move.copy()
            rest[row, first] = -1
            others[:] = move[row, first][:, None]
            others[row, first] = rest.max(axis=1)
        return Codebooks(entries, self.drift + (move + others) * (1 + _EDGE))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, ties to the lower; slack) of each part, by exact distances to all entries.

    Below LARGEST all terms are whole numbers; where they might pass 2**53 the sums
    are done in 64-bit integers instead of doubles.
    """
    most = max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(most) ** 2 * parts.shape[1] < 1 << 53:
        p, c = parts.astype(float), entries.astype(float)
        d = (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)
    else:
        d = np.stack([((parts - e) ** 2).sum(axis=1) for e in entries], axis=1)
    code = d.argmin(axis=1)
    row = np.arange(len(d))
    upper = np.sqrt(d[row, code].astype(float))
    d = d.astype(float)
    d[row, code] = np.inf
    return code, np.sqrt(d.min(axis=1)) * (1 - _EDGE) - upper * (1 + _EDGE)


def heaps_of(group: np.ndarray, keys: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(items, starts): the heap of group g is items[starts[g]:starts[g + 1]], the children of place i at 2i + 1 and 2i + 2 (ascending keys are such a heap)."""
    items = np.lexsort((keys, group)).astype(np.int32)
    return items, np.searchsorted(group[items], np.arange(n_groups + 1)).astype(np.int32)


def popped(items: np.ndarray, starts: np.ndarray, keys: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Items of all heaps whose key is at most the limit of their heap: from the tops down, never below an item that stays."""
    size = np.diff(starts)
    heap = np.flatnonzero(size > 0)
    place = np.zeros(len(heap), np.int64)
    found = [np.zeros(0, np.int64)]
    while len(heap):
        item = items[starts[heap] + place]
        out = keys[item] <= limit[heap]
        found.append(item[out])
        heap, place = np.tile(heap[out], 2), np.concatenate([2 * place[out] + 1, 2 * place[out] + 2])
        inside = place < size[heap]
        heap, place = heap[inside], place[inside]
    return np.concatenate(found)


def _sums(parts: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """Count and sums of components of each group's parts: n_groups x (1 + width)."""
    out = np.zeros((n_groups, 1 + parts.shape[1]), np.int64)
    out[:, 0] = np.bincount(group, minlength=n_groups)
    order = np.argsort(group, kind="stable")
    some, first = np.unique(group[order], return_index=True)
    if len(some):
        out[some, 1:] = np.add.reduceat(parts[order], first, axis=0)
    return out


class Block:
    """The vectors of a block, the code and key of each part (row-major: vector, position), and the heaps."""

    def __init__(self, x: np.ndarray, books: Codebooks) -> None:
        self.n_parts, self.n_entries, self.width = books.entries.shape
        self.parts = x.reshape(-1, self.width)
        self.place = np.tile(np.arange(self.n_parts), len(x))  # position of each part
        self.codes = np.zeros(len(self.parts), np.int64)
        self.keys = np.zeros(len(self.parts))

    def scan(self, which: np.ndarray, books: Codebooks) -> None:
        """Code and key of some parts anew."""
        for p in range(self.n_parts):
            own = which[self.place[which] == p]
            if len(own):
                self.codes[own], slack = nearest(self.parts[own], books.entries[p])
                self.keys[own] = slack + books.drift[p, self.codes[own]]

    @property
    def group(self) -> np.ndarray:
        return self.place * self.n_entries + self.codes

    def first(self, books: Codebooks) -> np.ndarray:
        """Assigns all parts; returns sums and counts per entry."""
        self.scan(np.arange(len(self.parts)), books)
        self.items, self.starts = heaps_of(self.group, self.keys, self.n_parts * self.n_entries)
        return _sums(self.parts, self.group, self.n_parts * self.n_entries)

    def again(self, books: Codebooks) -> np.ndarray:
        """Assigns the parts whose bounds are violated; returns the change of sums and counts."""
        n = self.n_parts * self.n_entries
        which = popped(self.items, self.starts, self.keys, books.drift.ravel() * (1 + _EDGE))
        before = self.group[which]
        self.scan(which, books)
        if len(which):
            self.items, self.starts = heaps_of(self.group, self.keys, n)
        other = before != self.group[which]
        return _sums(self.parts[which[other]], self.group[which[other]], n) - _sums(self.parts[which[other]], before[other], n)

    def errors(self, books: Codebooks) -> np.ndarray:
        """Squared distance of each vector to its entries."""
        return ((self.parts - books.entries[self.place, self.codes]) ** 2).sum(axis=1).reshape(-1, self.n_parts).sum(axis=1)

    def columns(self) -> dict[str, bytes]:
        return {"x": self.parts.astype("<i4").tobytes(), "codes": self.codes.astype("u1").tobytes(), "slack": self.keys.astype("<f8").tobytes(), "heap": self.items.astype("<i4").tobytes(), "starts": self.starts.astype("<i4").tobytes()}

    @classmethod
    def read(cls, row: dict[str, bytes], books: Codebooks) -> Block:
        x = np.frombuffer(row["x"], "<i4").astype(np.int64)
        block = cls(x.reshape(-1, books.entries.shape[0] * books.entries.shape[2]), books)
        block.codes, block.keys = np.frombuffer(row["codes"], "u1").astype(np.int64), np.frombuffer(row["slack"], "<f8").copy()
        block.items, block.starts = np.frombuffer(row["heap"], "<i4"), np.frombuffer(row["starts"], "<i4")
        return block


_STATE = ("x", "codes", "slack", "heap", "starts")


def _summed(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The blocks' sums, added up: in each task, then by place over all tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1] * (1 + shape[2]), np.int64)
        for batch in batches:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_py(), "<i8")
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total])})

    each = state.select("sums").mapInArrow(add, "sums array<long>").select(F.posexplode("sums").alias("at", "v"))
    out = np.zeros(shape[0] * shape[1] * (1 + shape[2]), np.int64)
    for r in each.groupBy("at").agg(F.sum("v").alias("v")).collect():  # as many rows as the codebooks have numbers
        out[r["at"]] = r["v"]
    return out.reshape(shape[0], shape[1], 1 + shape[2])


def compress_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per kept vector: key, label, code (two hex digits a part), error, label_error, codebooks_sha256.

    Vectors that are null, empty, hold null or non-finite components or have
    another length than most are dropped (vectors.whole_vectors); components become
    floor(scale * x). Codebooks begin with the parts of the first `entries` vectors
    by key (ties by value, null keys last; fewer vectors: fewer entries). Each round
    assigns the parts and moves every used entry to floor(sum / count). error is
    the vector's squared distance to its entries, label_error its sum over equal
    labels (nulls are one label). Repeated rows and keys count and return each.
    An empty table returns no rows; other columns of df are ignored. A length that
    `parts` does not divide is a ValueError, and so are components that reach
    LARGEST after scaling, as exact squared distances could pass a long.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    names = {"__key": df.schema[key].dataType.simpleString(), "__label": df.schema[label].dataType.simpleString()}
    rows, n, length = whole_vectors(df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").alias("__label"), F.col(f"`{vector}`").alias("__v")), "__v", scale)
    rows = rows.drop("__v")
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    seeds = rows.orderBy(F.col("__key").asc_nulls_last(), "__x").select("__x").limit(entries).collect()
    spark = df.sparkSession
    if not n:
        empty = f"__key {names['__key']}, __label {names['__label']}, code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], empty).withColumnsRenamed({"__key": key, "__label": label})
    width = length // parts
    start = np.array([r["__x"] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    if np.abs(start).max() >= LARGEST:
        raise ValueError(f"components must stay below {LARGEST} in size after scaling")
    shape = start.shape
    per_block = max(1, BLOCK_BYTES // (8 * length))

    def begin(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, per_block):
                part = batch.slice(at, per_block)
                x = matrix_of(part.column("__x"))
                if np.abs(x).max() >= LARGEST:
                    raise ValueError(f"components must stay below {LARGEST} in size after scaling")
                block = Block(x, books)
                sums = block.first(books)
                own = {c: pa.array([part.column(c).to_pylist()], pa.list_(part.column(c).type)) for c in names}
                yield pa.RecordBatch.from_pydict(own | {c: pa.array([v], pa.binary()) for c, v in (block.columns() | {"sums": sums.astype("<i8").tobytes()}).items()})

    def resume(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                block = Block.read({c: one.column(c)[0].as_py() for c in _STATE}, books)
                sums = block.again(books)
                own = {c: one.column(c) for c in names}
                yield pa.RecordBatch.from_pydict(own | {c: pa.array([v], pa.binary()) for c, v in (block.columns() | {"sums": sums.astype("<i8").tobytes()}).items()})

    def finish(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                block = Block.read({c: one.column(c)[0].as_py() for c in _STATE}, books)
                block.again(books)
                text = block.codes.astype("u1").tobytes().hex()
                codes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_pydict({c: one.column(c).flatten() for c in names} | {"code": pa.array(codes, pa.string()), "error": pa.array(block.errors(books), pa.int64())})

    def step(source: DataFrame, work, books: Codebooks, schema: str, label_: str) -> DataFrame:
        return stored(source.mapInArrow(lambda batches: work(batches, books), schema), label_)

    state_schema = ", ".join(f"{c} array<{t}>" for c, t in names.items()) + "".join(f", {c} binary" for c in (*_STATE, "sums"))
    books, state, total = Codebooks(start, np.zeros(shape[:2])), rows, 0
    for r in range(rounds):
        state = step(state, resume if r else begin, books, state_schema, f"codes-{r}")
        total = total + _summed(state, shape)
        used = total[:, :, :1] > 0
        books = books.moved(np.where(used, total[:, :, 1:] // np.maximum(total[:, :, :1], 1), books.entries))
    if not rounds:
        state = step(state, begin, books, state_schema, "codes-0")
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    coded = step(state, finish, books, f"__key {names['__key']}, __label {names['__label']}, code string, error long", "codes")
    # labels may be many: their sums are written, so that Spark can choose between broadcasting them and splitting a hot label
    sums = stored(coded.groupBy(F.col("__label").alias("__of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = coded.join(sums, coded["__label"].eqNullSafe(sums["__of"])).drop("__of").withColumn("codebooks_sha256", F.lit(digest))
    return joined.withColumnsRenamed({"__key": key, "__label": label})

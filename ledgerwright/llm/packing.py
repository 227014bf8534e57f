"""Packing documents into token sequences by linear grouping and best fit.

Only the count of pieces of each length reaches the driver (capacity numbers at
most, whatever the corpus). The plan is made on these counts:

1. Pieces as long as a sequence take one each. Lengths above capacity / d are put in descending order and cut into groups of equal cardinality; each length
   counts as its group's largest.
2. For those few sizes the best mix of configurations (multisets of sizes that fit
   a sequence) is found by column generation: a linear programme over
   configurations, priced by a knapsack table; its solution is rounded down.
3. The actual lengths take the places of their groups, largest first, as runs of
   equal sequences. Large pieces left over by rounding are placed by best fit.
4. Small pieces are placed by best fit, longest first, into what is left; new
   sequences are opened only when nothing fits.

The plan is a table of ranges (length, ranks from..to -> sequence, offset) whose
size depends on the capacity alone. Pieces get their rank within their length by
salted window counts and look their place up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, stored
from .tokens import default_tokenizer, tokenizer

#: (d, g): lengths above capacity / d are put in g groups. Each is planned, the plan with the fewest sequences is used.
GROUPINGS = ((8, 24), (6, 24), (4, 24), (3, 12), (2, 12), (8, 100))
#: Pieces of one length and salt that a window orders at once, about.
SALT_ROWS = 50_000


def best_configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], float]]:
    """(how many of each size, how often) of a linear programme that covers counts with the fewest sequences.

    Column generation: start with sequences of one size, price configurations by
    a knapsack over the dual values, exchange until none pays.
    """
    k = len(sizes)
    if not k:
        return []
    basis = [tuple(capacity // sizes[i] if i == j else 0 for j in range(k)) for i in range(k)]
    need = np.array(counts, float)
    most = capacity // min(sizes)
    for _ in range(rounds):
        matrix = np.array(basis, float).T
        dual = np.linalg.solve(matrix.T, np.ones(k))
        amount = np.linalg.solve(matrix, need)
        # value[n][w]: best dual value of n sizes that sum to w at most
        value, choice = np.zeros(capacity + 1), []
        for _n in range(most):
            best, pick = value.copy(), np.full(capacity + 1, -1, np.int64)
            for i, s in enumerate(sizes):
                if dual[i] > 1e-12:
                    more = value[: capacity + 1 - s] + dual[i]
                    better = more > best[s:] + 1e-12
                    best[s:][better] = more[better]
                    pick[s:][better] = i
            if (pick < 0).all():
                break
            value = best
            choice.append(pick)
        if value[capacity] <= 1 + 1e-7:
            break
        column, w = [0] * k, capacity
        for pick in reversed(choice):
            if pick[w] >= 0:
                column[pick[w]] += 1
                w -= sizes[pick[w]]
        step = np.linalg.solve(matrix, np.array(column, float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(amount, 0) / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[out] = tuple(column)
    amount = np.linalg.solve(np.array(basis, float).T, need)
    return [(b, float(a)) for b, a in zip(basis, amount, strict=True) if a > 1e-9]


class _Plan:
    """Runs of equal sequences by what is left in them, and the ranges placed so far."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, rank from, rank to, first sequence, offset
        self.ranked: dict[int, int] = {}
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
        self.rooms: list[int] = []

    def _put(self, first: int, n: int, room: int) -> None:
        if n and room:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first, n))

    def _range(self, length: int, n: int, first: int, offset: int) -> None:
        at = self.ranked.get(length, 0)
        self.ranked[length] = at + n
        self.rows.append((length, at, at + n, first, offset))

    def new(self, lengths: list[int], n: int) -> None:
        """n new sequences that hold lengths each."""
        offset = 0
        for length in lengths:
            self._range(length, n, self.sequences, offset)
            offset += length
        self._put(self.sequences, n, self.capacity - offset)
        self.sequences += n

    def fit(self, length: int, n: int) -> None:
        """Place n pieces, each where the least room is left; new sequences if nothing fits."""
        while n:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.capacity // length
                if n >= each:
                    self.new([length] * each, n // each)
                if n % each:
                    self.new([length] * (n % each), 1)
                return
            room = self.rooms[i]
            first, m = self.open[room].pop()
            take = min(n, m)
            self._range(length, take, first, self.capacity - room)
            self._put(first + take, m - take, room)
            self._put(first, take, room - length)
            if not self.open[room]:
                del self.open[room]
                self.rooms.remove(room)
            n -= take


def _take(group: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The first n pieces of a group's list of [length, how many], taken out."""
    out = []
    while n:
        m = min(n, group[0][1])
        out.append((group[0][0], m))
        group[0][1] -= m
        n -= m
        if not group[0][1]:
            group.pop(0)
    return out


def _at(taken: list[tuple[int, int]], place: int) -> int:
    for length, m in taken:
        if place < m:
            return length
        place -= m
    raise IndexError(place)


def plan_ranges(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, rank from, rank to, first sequence, offset) for counts of pieces by length; the number of sequences."""
    return min((_planned(counts, capacity, d, g) for d, g in GROUPINGS), key=lambda found: found[1])


def _planned(counts: dict[int, int], capacity: int, divisor: int, n_groups: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    plan = _Plan(capacity)
    if counts.get(capacity):
        plan.new([capacity], counts[capacity])
    large = sorted((x for x in counts if capacity // divisor < x < capacity and counts[x]), reverse=True)
    total = sum(counts[x] for x in large)
    groups: list[list[list[int]]] = []  # of [length, how many are left], longest first
    seen = 0
    for x in large:
        left = counts[x]
        while left:
            g = seen * n_groups // total
            take = min(left, -(-(g + 1) * total // n_groups) - seen)
            while len(groups) <= g:
                groups.append([])
            groups[g].append([x, take])
            seen += take
            left -= take
    groups = [g for g in groups if g]
    sizes = [g[0][0] for g in groups]
    merged: dict[int, list[list[int]]] = {}
    for size, g in zip(sizes, groups, strict=True):  # groups cut inside one length share its size
        merged.setdefault(size, []).extend(g)
    sizes = list(merged)
    configurations = best_configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity)
    for config, amount in sorted(configurations, key=lambda c: -sum(a * s for a, s in zip(c[0], sizes, strict=True))):
        slots = [s for s, times in zip(sizes, config, strict=True) for _ in range(times)]
        have = {s: sum(n for _, n in merged[s]) for s in set(slots)}
        n = min([int(amount + 1e-6), *(sum(m for _, m in merged[s]) // slots.count(s) for s in set(slots))])
        if n:  # each slot takes n neighbours of its group's list; where any length changes, a new run begins
            taken = [_take(merged[s], n) for s in slots]
            edges = sorted({0, n, *(e for t in taken for e in np.cumsum([m for _, m in t]).tolist())})
            for a, b in zip(edges, edges[1:], strict=False):
                plan.new([_at(t, a) for t in taken], b - a)
    rest: dict[int, int] = {x: n for x, n in counts.items() if x <= capacity // divisor}
    for g in merged.values():
        for x, n in g:
            rest[x] = rest.get(x, 0) + n
    for x in sorted(rest, reverse=True):
        plan.fit(x, rest[x])
    return plan.rows, plan.sequences


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of at most capacity ids: key, piece, start, length, ids_crc32 (and ids)."""
    kind = docs.schema[key].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def rows(batch: pa.RecordBatch, texts: list) -> dict:
        owner, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, raw in enumerate(tokenizer(path).encode(texts)):
            raw += end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw if len(raw) <= 4 * capacity else raw[at : at + 4 * capacity]
                owner.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part)
        out = {key: batch.column(key).take(pa.array(owner, pa.int64())), "piece": pa.array(piece, pa.int32())}
        out |= {"start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        return out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {})

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return map_texts(docs.select(key, text), text, rows, schema, limit=4 << 20)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece with its place: key, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is its end id alone. Documents of more than capacity ids
    are cut; no other is. Every sequence is filled from 0 without gaps. Ranks among
    pieces of one length follow (key, piece, checksum), so a repeated run gives the
    same layout; repeated rows and null keys are packed like any other. No rows
    give no rows.
    """
    pieces = stored(token_pieces(docs, path or default_tokenizer(), capacity, end_id, key, text, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows, _ = plan_ranges(counts, capacity)
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    salts = max(1, sum(counts.values()) // SALT_ROWS)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = before.withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "__salt").orderBy(key, "piece", "ids_crc32")
    ranked = salted.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.row_number().over(own) - 1)
    columns = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.int64(1) << 40
        starts = table[:, 0] * scale + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            at = np.searchsorted(starts, length * scale + rank, side="right") - 1
            row = table[at]
            out = {c: batch.column(c) for c in columns}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(row[:, 3] + rank - row[:, 1]), "offset": pa.array(row[:, 4])})

    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*columns, "__rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the little-endian ids of each sequence, from pack_documents(..., with_ids=True)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))

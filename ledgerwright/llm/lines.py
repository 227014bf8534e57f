"""Line dedup with a sharded minimal perfect hash.

Index: every document batch sends each distinct line hash once, with the (at most
min_docs) largest ids of documents holding it, to the shard that the hash names; on large
inputs what a few hundred batches sent is merged first, so a line that all batches hold
reaches its shard in a few rows. A shard merges them and builds a minimal perfect hash over
its distinct line hashes; it numbers compact arrays of 32-bit fingerprints, counts (up to
min_docs) and largest document ids. The arrays are stored as one row per shard.

Probe: documents do not join lines. Each document batch asks the shards' arrays for its
distinct hashes, with the rows that hold them, and gets answers only for lines to be
dropped; rows take their answers by a hash of key and text, so neither null keys nor keys
with many rows meet in one task. Lines held by more than one in HEAVY documents would make
one shard's queries grow with the corpus; they are handed to every task instead, as two
arrays. There are at most HEAVY times as many of them as a document has lines on average,
16 bytes each, and never more than MAX_HEAVY: the most frequent ones, the rest are asked for
like any other line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, map_texts, mixed, runs_of, shards_for, slices, stored

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NONE = np.iinfo(np.int64).min
#: A line is heavy if more than one document in so many holds it; at most MAX_HEAVY lines are.
HEAVY, MAX_HEAVY = 2000, 1_000_000
#: ... or if it has more rows than this, however large the corpus: so many row names at most go to one shard for a line.
MOST_ROWS = 100_000
#: Shards (of about 32 MiB of text) whose batches are merged before they go to the shards.
MERGE_SHARDS = 256


class MinimalPerfectHash:
    """Numbers n distinct 64-bit keys 0..n-1: levels of bit arrays, each taking the keys that fall alone on a bit.

    A key's number is the count of bits set before its own. Keys that were not
    given get any number or -1; a fingerprint tells them apart.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.ranks, base = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(base + np.concatenate([[0], np.cumsum(ones)]))
            base = int(self.ranks[-1][-1])
        self.base = base

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.5, most: int = 24) -> MinimalPerfectHash:
        levels: list[np.ndarray] = []
        while len(keys) and len(levels) < most:
            size = max(64, -(-int(len(keys) * room) // 64) * 64)
            at = cls._bit(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                return out
            at = self._bit(keys[left], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (ranks[at >> 6] + np.bitwise_count(below))[hit]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.base + at[hit]
        return out

    def to_bytes(self) -> tuple[list[bytes], bytes]:
        return [x.tobytes() for x in self.levels], self.rest.tobytes()

    @classmethod
    def from_bytes(cls, levels: list[bytes], rest: bytes) -> MinimalPerfectHash:
        return cls([np.frombuffer(x, np.uint64) for x in levels], np.frombuffer(rest, np.uint64))


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def key_of(line: bytes) -> bytes:
    return line.strip(ASCII_SPACE).translate(_LOWER)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key) - sum(0x80 <= c < 0xC0 for c in key) >= min_chars)


def _hashes(texts: list[str | None], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check, text number) of the distinct long lines of each text."""
    digests, owner = [], []
    for i, text in enumerate(texts):
        if text and len(text) >= min_chars:
            keys = {k for x in lines_of(text) if len(x) >= min_chars and _long_enough(k := key_of(x), min_chars)}
            digests += [xxhash.xxh3_128_digest(k) for k in keys]
            owner += [i] * len(keys)
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy(), np.array(owner, np.int64)


def _ids(batch: pa.RecordBatch, key: str) -> np.ndarray:
    return np.asarray(batch.column(key).cast(pa.int64()).fill_null(_NONE))


def _largest(h: np.ndarray, check: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct (h, check) and the largest distinct ids of each, at most `most`, largest first."""
    order = np.lexsort((ids, check, h))[::-1]
    h, check, ids = h[order], check[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1]) | (ids[1:] != ids[:-1])
    h, check, ids = h[new], check[new], ids[new]
    line = np.ones(len(h), bool)
    line[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    starts = np.flatnonzero(line)
    ends = np.append(starts[1:], len(h))
    return h[starts], check[starts], [ids[a:b] for a, b in zip(starts.tolist(), np.minimum(ends, starts + most).tolist(), strict=True)]


def count_type(min_docs: int) -> np.dtype:
    """The smallest type that counts to min_docs: a byte a line as a rule."""
    return np.min_scalar_type(min_docs)


def line_index(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, shards: int | None = None, merge_shards: int = MERGE_SHARDS) -> DataFrame:
    """One row per shard: the perfect hash and its arrays over the distinct line hashes of docs.

    counts hold the number of documents up to min_docs; n_rows counts occurrences
    (one per document row), which marks heavy lines.
    """
    shards = shards or shards_for(docs, text)
    groups = -(-shards // merge_shards)

    def send(batch: pa.RecordBatch, texts: list) -> dict | None:
        h, check, owner = _hashes(texts, min_chars)
        if not len(h):
            return None
        times = dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True))
        h, check, ids = _largest(h, check, _ids(batch, key)[owner], min_docs)
        rows = pa.array([times[x] for x in h.tolist()], pa.int64())
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        packed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids)))
        return {"shard": pa.array((h % np.uint64(shards)).astype(np.int32)), "h": pa.array(h.view(np.int64)), "c": pa.array(check.view(np.int64)), "rows": rows, "ids": packed}

    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(h, check, largest ids, rows) of the distinct hashes of sent rows, h ascending."""
        ids = table.column("ids").combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy())
        h0, c0 = (table.column(c).to_numpy().view(np.uint64) for c in ("h", "c"))
        h, check, held = _largest(np.repeat(h0, sizes), np.repeat(c0, sizes), ids.flatten().to_numpy(), min_docs)
        # h ascends after the flip; a hash that two lines share counts as one line (one chance in 2**64)
        h, check, held = h[::-1], check[::-1], held[::-1]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        h, check = h[first], check[first]
        held = [x for x, f in zip(held, first.tolist(), strict=True) if f]
        rows = np.zeros(len(h), np.int64)
        np.add.at(rows, np.searchsorted(h, h0), table.column("rows").to_numpy())
        return h, check, held, rows

    def merge(_key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts)).combine_chunks()
        h, check, held, rows = merged(table)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.fromiter(map(len, held), np.int32, len(held)))]), pa.int32())
        packed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held)))
        shard = pa.array(np.full(len(h), table.column("shard")[0].as_py(), np.int32))
        yield pa.RecordBatch.from_pydict({"shard": shard, "h": pa.array(h.view(np.int64)), "c": pa.array(check.view(np.int64)), "rows": pa.array(rows), "ids": packed})

    def build(_key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts)).combine_chunks()
        h, check, held, rows = merged(table)
        mph = MinimalPerfectHash.build(h)
        at = mph.lookup(h)
        prints, counts, largest, times = np.zeros(len(h), np.uint32), np.zeros(len(h), count_type(min_docs)), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        prints[at] = (check & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        counts[at] = np.fromiter(map(len, held), counts.dtype, len(held))
        largest[at] = np.fromiter((x[0] for x in held), np.int64, len(held))
        times[at] = rows
        levels, rest = mph.to_bytes()
        heavy = np.flatnonzero((rows > 64) & (counts[at] >= min_docs))  # candidates; the threshold follows from the corpus
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                "levels": pa.array([levels], pa.list_(pa.binary())),
                "rest": pa.array([rest], pa.binary()),
                "prints": pa.array([prints.tobytes()], pa.binary()),
                "counts": pa.array([counts.tobytes()], pa.binary()),
                "largest": pa.array([largest.tobytes()], pa.binary()),
                "frequent": pa.array([[{"h": int(h[i].view(np.int64)), "rows": int(rows[i]), "largest": int(largest[at[i]])} for i in heavy]], pa.list_(pa.struct([("h", pa.int64()), ("rows", pa.int64()), ("largest", pa.int64())]))),
            }
        )

    fields = "shard int, h long, c long, rows long, ids array<long>"
    sent = map_texts(docs.select(key, text), text, send, fields, limit=8 << 20)
    if groups > 1:
        sent = sent.withColumn("merge", F.pmod(F.spark_partition_id(), F.lit(groups))).groupBy("shard", "merge").applyInArrow(merge, fields)
    schema = "shard int, levels array<binary>, rest binary, prints binary, counts binary, largest binary, frequent array<struct<h: long, rows: long, largest: long>>"
    return sent.groupBy("shard").applyInArrow(build, schema)


def row_id(key: str, text: str):
    """A row's name in the exchange with the shards; rows of equal key and text have the same answers."""
    return F.xxhash64(F.col(f"`{key}`").isNull(), F.col(f"`{key}`"), F.col(f"`{text}`"))


def dropped_lines(docs: DataFrame, index: DataFrame, shards: int, heavy: np.ndarray, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(row, hashes array<long>, last array<long>): the lines, other than heavy ones (sorted hashes), that the index drops but for the document `last`; see row_id."""

    def send(batch: pa.RecordBatch, texts: list) -> dict | None:
        h, check, owner = _hashes(texts, min_chars)
        if len(heavy):
            light = heavy[np.minimum(np.searchsorted(heavy, h.view(np.int64)), len(heavy) - 1)] != h.view(np.int64)
            h, check, owner = h[light], check[light], owner[light]
        if not len(h):
            return None
        order = np.lexsort((check, h))
        h, check, owner = h[order], check[order], owner[order]
        starts, _ = runs_of(h)
        offsets = pa.array(np.append(starts, len(h)), pa.int32())
        holders = pa.ListArray.from_arrays(offsets, pa.array(batch.column("__row").to_numpy()[owner]))
        h, check = h[starts], check[starts]
        return {"shard": pa.array((h % np.uint64(shards)).astype(np.int32)), "h": pa.array(h.view(np.int64)), "p": pa.array((check & np.uint64(0xFFFFFFFF)).astype(np.int64)), "holders": holders}

    def probe(queries: pa.Table, arrays: pa.Table) -> pa.Table:
        none = pa.table({"row": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "last": pa.array([], pa.int64())})
        if not arrays.num_rows or not queries.num_rows:
            return none
        row = arrays.to_pylist()[0]
        mph = MinimalPerfectHash.from_bytes(row["levels"], row["rest"])
        prints, counts, largest = (np.frombuffer(row[c], t) for c, t in (("prints", np.uint32), ("counts", count_type(min_docs)), ("largest", np.int64)))
        h = queries.column("h").to_numpy()
        at = mph.lookup(h.view(np.uint64))
        hit = (at >= 0) & (prints[at] == queries.column("p").to_numpy()) & (counts[at] >= min_docs)
        if not hit.any():
            return none
        holders = queries.column("holders").combine_chunks()
        own, flat = np.repeat(np.arange(len(h)), np.diff(holders.offsets.to_numpy())), holders.flatten().to_numpy()
        own, flat = own[hit[own]], flat[hit[own]]
        return pa.table({"row": flat, "h": h[own], "last": largest[at[own]]})

    sent = map_texts(docs.select(text, row_id(key, text).alias("__row")), text, send, "shard int, h long, p long, holders array<long>", limit=8 << 20)
    answers = sent.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, "row long, h long, last long")
    lists = answers.groupBy("row").agg(F.collect_set(F.struct("h", "last")).alias("x"))
    return lists.select("row", F.col("x.h").alias("hashes"), F.col("x.last").alias("last"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, keep_text: bool = True, measures: bool = True) -> DataFrame:
    """docs with repeated lines gone from text, and n_lines, n_dropped, kept_sha256.

    A null or empty text is one empty line and becomes (stays) empty. A line that
    at least min_docs documents hold keeps all its places in the one with the
    largest key only. Rows with the same key are one document here; a null key
    is a document below all others. Keys are whole numbers above -2**63 (others: TypeError). Of docs' columns, those
    named like a result (in any case) are replaced; without measures only the text changes. No rows give no rows.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must hold whole numbers: the largest key of a line keeps it")
    shards = shards_for(docs, text)
    index = stored(line_index(docs, key, text, min_chars, min_docs, shards), "lines")
    n_docs = docs.count()
    often = index.select(F.explode("frequent").alias("f")).where(F.col("f.rows") > max(64, min(n_docs // HEAVY, MOST_ROWS)))
    often = often.orderBy(F.col("f.rows").desc(), "f.h").limit(MAX_HEAVY).select("f.h", "f.largest").toPandas().sort_values("h")
    heavy, heavy_last = often["h"].to_numpy(np.int64), often["largest"].to_numpy(np.int64)
    lost = dropped_lines(docs, index, shards, heavy, key, text, min_chars, min_docs)
    added = {"n_lines", "n_dropped", "kept_sha256"} if measures else set()
    rest = [c for c in docs.columns if c.lower() not in added and (keep_text or c == key)]
    needed = list(dict.fromkeys([*rest, key, text]))
    own = docs.select(*[F.col(f"`{c}`") for c in needed], row_id(key, text).alias("__row"))
    joined = own.join(lost.select(F.col("row").alias("__row"), F.col("hashes").alias("__hashes"), F.col("last").alias("__last")), "__row", "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in needed], "__hashes", "__last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widely = dict(zip(heavy.tolist(), heavy_last.tolist(), strict=True))
        for batch in slices(batches, text):
            out: list[list] = [[], [], [], []]
            rows = zip(_ids(batch, key).tolist(), *(batch.column(c).to_pylist() for c in (text, "__hashes", "__last")), strict=True)
            for me, value, hashes, last in rows:
                lines = lines_of(value)
                kept = lines
                keeper = dict(zip(hashes or (), last or (), strict=True))  # the document that keeps a line, by the line's hash
                if keeper or widely:
                    kept = []
                    for x in lines:
                        if len(x) >= min_chars and _long_enough(k := key_of(x), min_chars):
                            h = int.from_bytes(xxhash.xxh3_128_digest(k)[:8], "little", signed=True)
                            if keeper.get(h, widely.get(h, me)) != me:
                                continue
                        kept.append(x)
                left = b"\n".join(kept)
                for column, v in zip(out, (left.decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept), hashlib.sha256(left).hexdigest()), strict=True):
                    column.append(v)
            columns = {c: batch.column(c) for c in rest}
            if keep_text:
                columns[text] = pa.array(out[0], batch.column(text).type)
            if measures:
                columns |= {"n_lines": pa.array(out[1], pa.int64()), "n_dropped": pa.array(out[2], pa.int64()), "kept_sha256": pa.array(out[3])}
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return joined.mapInArrow(run, schema + (", n_lines long, n_dropped long, kept_sha256 string" if measures else ""))

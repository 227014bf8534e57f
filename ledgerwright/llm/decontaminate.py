"""Benchmark decontamination: which documents contain which test items.

An item is contained in a document if at least `share` of its distinct five-word
shingles occur there. Of an item with q shingles, at most q - ceil(share * q) may be
missing, so one of its k smallest shingle hashes, k one more than that, must be in
any document that contains it: a bottom-k MinHash sketch whose size follows the
item's size loses nothing, however long the document. Items are partitioned by size
(powers of two); a partition's sketches lie below a threshold of their own, and
documents look their shingles up, class by class, below its threshold only.

The sketches of a class go to the tasks as a Bloom filter of PROBES bits a hash; all together have
at most 2 * MAX_BITS bits. A document's shingles that hit it are joined with the sketches to candidate
pairs, and each pair is verified on the shingles themselves. Only hits are kept and shuffled, so what
a document costs there follows what it shares with the items, not its length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices, stored

MAX_BITS = 1 << 27
#: Bits set for each hash of a filter, and bits of room for each, as far as MAX_BITS allows.
PROBES, ROOM = 3, 64
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


def shingle_hashes(lists: list[list[str]], n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, list number, position) of every n-word shingle; a shorter list is one shingle, an empty one none."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = dict.fromkeys(chain.from_iterable(lists))
    number = dict(zip(number, range(len(number)), strict=True))
    value = np.fromiter((xxhash.xxh64_intdigest(w) for w in map(lambda w: w.encode("utf-8", "surrogatepass"), number)), np.uint64, len(number))
    word = np.append(value[np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, total)], np.zeros(n, np.uint64))
    begin = np.cumsum(counts) - counts
    own = np.minimum(counts, n)
    shingles = np.where(counts > 0, counts - own + 1, 0)
    owner = np.repeat(np.arange(len(lists)), shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    place, size = begin[owner] + at, own[owner]
    h = size.astype(np.uint64)
    for k in range(n):
        h = h * _BASE + np.where(k < size, word[place + k], np.uint64(0))
    return mixed(h), owner, at


def sketch_size(q: int, share: float) -> int:
    """How many of the q smallest hashes a sketch needs so that none of a contained item's can all be missing."""
    return q - math.ceil(share * q - 1e-9) + 1


def item_sketches(items: DataFrame, key: str = "item_id", text: str = "text", n: int = 5, share: float = 0.8) -> DataFrame:
    """(key, shingles array<string>, size class int, sketch array<long>) of items with a word."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            lists = [words_of(t) for t in batch.column(text).to_pylist()]
            h, owner, at = shingle_hashes(lists, n)
            rows: list[list] = [[], [], [], []]
            cuts = np.searchsorted(owner, np.arange(len(lists) + 1))
            for i, words in enumerate(lists):
                if words:
                    a, b = cuts[i], cuts[i + 1]
                    names = {int(x): " ".join(words[p : p + n]) for x, p in zip(h[a:b], at[a:b].tolist(), strict=True)}
                    q = len(names)
                    sketch = np.array(sorted(names)[: sketch_size(q, share)], np.uint64).view(np.int64)
                    for column, v in zip(rows, (i, list(names.values()), q.bit_length(), sketch.tolist()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_pydict(
                {
                    key: batch.column(key).take(pa.array(rows[0], pa.int64())),
                    "shingles": pa.array(rows[1], pa.list_(pa.string())),
                    "class": pa.array(rows[2], pa.int32()),
                    "sketch": pa.array(rows[3], pa.list_(pa.int64())),
                }
            )

    return items.select(key, text).mapInArrow(run, f"`{key}` {kind}, shingles array<string>, class int, sketch array<long>")


def _shift(bits: int, probes: int) -> int:
    """How far apart the windows of a hash stand that give its places in a filter of so many bits."""
    return (64 - (bits - 1).bit_length()) // max(1, probes - 1)


def _bitmap(hashes: DataFrame, bits: int, probes: int = 1) -> np.ndarray:
    """A bitmap over `probes` windows, the low bits first, of hashes(h long): at most bits / 64 rows reach the driver."""
    windows = F.array(*(F.shiftrightunsigned("h", i * _shift(bits, probes)) for i in range(probes)))
    places = hashes.select(F.explode(windows).alias("h"))
    low = F.col("h").bitwiseAND(bits - 1)
    words = places.select(F.shiftright(low, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[row["w"]] = row["b"]
    return out.view(np.uint64)


def _bits_for(n: int, room: int = 16) -> int:
    return min(MAX_BITS, 1 << max(16, (room * max(1, n)).bit_length()))


def _hits(h: np.ndarray, table: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Places in h of the hashes all of whose bits are set in a table of _bitmap."""
    size = 64 * len(table)
    left = np.arange(len(h))
    for i in range(probes):
        low = (h[left] >> np.uint64(i * _shift(size, probes))) & np.uint64(size - 1)
        left = left[(table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1]
    return left


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 5, share: float = 0.8) -> DataFrame:
    """One row per (document, item) pair: key, item, n_shared, n_shingles, containment (double).

    Words are lower-case runs of letters and digits. A text of fewer than n words
    is one shingle, so such an item is found in equal texts only; texts without a
    word contain nothing and are contained nowhere. Null keys pair like any other
    value; repeated rows with the same key are one document (or item) whose
    shingles are united. If both key columns have one name, the item's comes back
    as <name>_item. No rows on either side give no rows.
    """
    if item == key:
        items, item = items.withColumnRenamed(item, f"{item}_item"), f"{item}_item"
    sketches = stored(item_sketches(items, item, item_text, n, share).withColumnRenamed(item, "__item"), "sketches")
    minima = sketches.select("__item", "class", F.explode("sketch").alias("h"))
    every = sketches.select(F.explode("shingles").alias("s")).distinct()
    count = minima.count()
    if not count:
        return docs.sparkSession.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}, n_shared long, n_shingles long, containment double")
    # the largest sketch hash of each size class: shingles above it need no lookup for that class; unsigned order is signed order with the top bit turned
    top = F.max(F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).alias("top")
    classes = []
    for r in minima.groupBy("class").agg(F.count("*").alias("n"), top).collect():  # one row per class: 64 at most
        size = min(_bits_for(r["n"], ROOM), 1 << max(16, (2 * MAX_BITS * r["n"] // count).bit_length() - 1))
        classes.append((np.uint64(r["top"] + (1 << 63)), _bitmap(minima.where(F.col("class") == r["class"]).select("h"), size, PROBES)))
    known = _bitmap(item_hashes(every, n), _bits_for(every.count(), ROOM), PROBES)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            lists = [words_of(t) for t in batch.column(text).to_pylist()]
            h, owner, at = shingle_hashes(lists, n)
            looked = []
            for limit, bitmap in classes:
                below = np.flatnonzero(h <= limit)
                looked.append(below[_hits(h[below], bitmap)])
            maybe = np.unique(np.concatenate(looked))
            if not len(maybe):
                continue
            found = np.unique(owner[maybe])
            mine = np.flatnonzero(np.isin(owner, found))
            mine = mine[_hits(h[mine], known)]
            sketch: dict[int, set] = {i: set() for i in found.tolist()}
            shingles: dict[int, set] = {i: set() for i in found.tolist()}
            for i, x in zip(owner[maybe].tolist(), h[maybe].view(np.int64).tolist(), strict=True):
                sketch[i].add(x)
            for i, p in zip(owner[mine].tolist(), at[mine].tolist(), strict=True):
                shingles[i].add(" ".join(lists[i][p : p + n]))
            yield pa.RecordBatch.from_pydict(
                {
                    "__doc": batch.column(key).take(pa.array(found)),
                    "hits": pa.array([sorted(sketch[i]) for i in found.tolist()], pa.list_(pa.int64())),
                    "have": pa.array([sorted(shingles[i]) for i in found.tolist()], pa.list_(pa.string())),
                }
            )

    held = stored(docs.select(key, text).mapInArrow(run, f"__doc {kind}, hits array<long>, have array<string>"), "hits")
    pairs = held.select("__doc", F.explode("hits").alias("h")).distinct().join(minima.select("__item", "h"), "h").select("__doc", "__item").distinct()
    have = held.select("__doc", F.explode("have").alias("s")).groupBy("__doc").agg(F.collect_set("s").alias("have"))
    want = sketches.select("__item", F.explode("shingles").alias("s")).groupBy("__item").agg(F.collect_set("s").alias("want"))
    p, d, i = pairs.alias("p"), have.alias("d"), want.alias("i")
    both = p.join(d, F.col("p.__doc").eqNullSafe(F.col("d.__doc"))).join(i, F.col("p.__item").eqNullSafe(F.col("i.__item")))
    counted = both.select(F.col("p.__doc").alias(key), F.col("p.__item").alias(item), F.size(F.array_intersect("have", "want")).cast("long").alias("n_shared"), F.size("want").cast("long").alias("n_shingles"))
    return counted.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.col("n_shingles") * share - 1e-9)


def item_hashes(shingles: DataFrame, n: int = 5) -> DataFrame:
    """h long of each shingle s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [s.split(" ") for s in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_pydict({"h": pa.array(shingle_hashes(lists, n)[0].view(np.int64))})

    return shingles.select("s").mapInArrow(run, "h long")


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", n: int = 5, share: float = 0.8) -> DataFrame:
    """docs without the documents that contain an item; see contained_items."""
    bad = contained_items(docs, items, key, text, item, n=n, share=share).select(F.col(key).alias("__bad")).distinct()
    return docs.join(bad, F.col(key).eqNullSafe(F.col("__bad")), "left_anti")

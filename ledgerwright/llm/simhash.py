"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made in numpy from the XXH64 of each shingle. Equal fingerprints
become one row first, so copies cost nothing further. To find those within a small
radius r, the 64 bits are cut into r + 2 blocks: two fingerprints that differ in at
most r bits agree on two blocks at least, so every pair of blocks gives a bucket
key (26 bits for r = 3) and no link is missed. A bucket is compared bit-sliced: its
fingerprints stand as 64 vertical bit planes, one machine word holding a bit of 64
fingerprints; the planes that differ from the query are added, three at a time, into
carry-save counters, and a word is given up once each of its counters has passed r (pairs
that need no comparison count as passed). Buckets
larger than a tile are dealt out as pairs of tiles, so no task gets a whole hot
bucket. A tile pair returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, runs_of, stored
from .components import connected_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints_of(texts: list[str | None], words: int = 3, seed: int = 42) -> np.ndarray:
    """The SimHash of each text as uint64; no word gives 0."""
    digest, counts, hashes = xxhash.xxh64_intdigest, np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not found:
            continue
        flat = b" ".join(found)
        if len(found) <= words:
            hashes.append(digest(flat, seed))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        n = len(found) - words + 1
        starts = (ends - np.fromiter(map(len, found), np.int64, len(found)) - 1)[:n]
        hashes.extend(digest(flat[a:b], seed) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True))
        counts[i] = n
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(counts[some])[:-1]]), axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1).view(">u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp long): the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batch: pa.RecordBatch, texts: list) -> dict:
        return {key: batch.column(key), "fp": pa.array(fingerprints_of(texts, words, seed).view(np.int64))}

    return map_texts(docs.select(key, text), text, rows, f"`{key}` {kind}, fp long", limit=2 << 20)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word (padding bits are 0)."""
    full = -(-len(fps) // 64) * 64
    bits = np.zeros((full, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(fps, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64).reshape(64, -1)


def within(differs, skip: np.ndarray, radius: int) -> np.ndarray:
    """Which bits of skip's words stand for pairs that differ in at most radius of the 64 planes.

    differs(b, at) gives plane b's differences at the word numbers `at` (of skip,
    flat). Pairs whose bit is set in skip are not compared. Counters stand
    bit-sliced, a word per binary digit; three planes enter at once through a
    full adder, carries are saved into the next digit. Every six planes the words
    all of whose pairs have passed the radius are given up, and only the others
    are read on.
    """
    over_all = skip.reshape(-1).copy()
    at = np.flatnonzero(~over_all)
    over = over_all[at]
    width = max(2, (radius + 1).bit_length())
    counter = np.zeros((width, len(at)), np.uint64)
    for b in range(0, 66, 3):
        if not len(at):
            break
        x = differs(b, at)
        if b < 63:
            y, z = differs(b + 1, at), differs(b + 2, at)
            half = x ^ y
            one, two = half ^ z, (x & y) | (half & z)
        else:  # 64 planes are 21 threes and one
            one, two = x, np.zeros_like(x)
        carry = counter[0] & one
        counter[0] ^= one
        half = counter[1] ^ two
        counter[1], carry = half ^ carry, (counter[1] & two) | (half & carry)
        for k in range(2, width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 6 == 3 or b == 63:
            above, equal = np.zeros(len(at), np.uint64), ~np.zeros(len(at), np.uint64)
            for k in reversed(range(width)):
                if radius >> k & 1:
                    equal &= counter[k]
                else:
                    above |= equal & counter[k]
                    equal &= ~counter[k]
            over |= above
            alive = ~over != 0
            if not alive.all():
                over_all[at] = over
                at, over, counter = at[alive], over[alive], counter[:, alive]
    over_all[at] = over
    return ~over_all.reshape(skip.shape)


def _bits(words: np.ndarray, n: int) -> np.ndarray:
    """The n bits of each row of words as booleans."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(*words.shape[:-1], -1), axis=-1, bitorder="little")[..., :n].astype(bool)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as words, set beyond the last one."""
    full = np.ones((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 64), bool)
    full[..., : bits.shape[-1]] = bits
    return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)


def near_rows(part: np.ndarray, planes: np.ndarray, n: int, radius: int, skip: np.ndarray) -> np.ndarray:
    """near[i, j]: part[i] and the j-th of the n fingerprints in planes differ in at most radius bits, and skip[i, j] is not set."""
    ones = np.where((part[:, None] >> np.arange(63, -1, -1, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
    width = planes.shape[1]
    near = within(lambda b, at: planes[b][at % width] ^ ones[at // width, b], _words(skip), radius)
    return _bits(near, n)


class _Forest:
    """Union-find over positions; keeps the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def forest_links(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions (i, j) in left + right that span what links within radius join, left against right.

    left is right (the same array): all against all.
    """
    same = left is right
    planes, shift = planes_of(right), 0 if same else len(left)
    forest, column = _Forest(len(left) + (0 if same else len(right))), np.arange(len(right))
    for at in range(0, len(left), 64):
        part = left[at : at + 64]
        row = np.arange(at, at + len(part))
        skip = column[None, :] <= row[:, None] if same else np.zeros((len(part), len(right)), bool)
        for i, j in zip(*(x.tolist() for x in np.nonzero(near_rows(part, planes, len(right), radius, skip))), strict=True):
            forest.link(at + i, j + shift)
    return forest.links


def small_links(fps: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links inside every group of neighbours with equal group, all groups at once.

    Row i is compared with row i + d for d = 1, 2, ... while any group is that
    long; the pairs of one d stand in the bit planes.
    """
    forest = _Forest(len(fps))
    at, d = np.arange(len(fps)), 0
    while True:
        d += 1
        at = at[at + d < len(fps)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            return forest.links
        for a in range(0, len(at), 1 << 16):
            own = at[a : a + (1 << 16)]
            planes = planes_of(fps[own] ^ fps[own + d])
            near = within(lambda b, at: planes[b][at], _words(np.zeros(len(own), bool)), radius)
            for i in own[_bits(near, len(own))].tolist():
                forest.link(i, i + d)


def _keys(fp, radius: int) -> list:
    """One long per pair of the radius + 2 blocks: the pair's number above the bits of both blocks."""
    k = radius + 2
    cuts = [round(64 * i / k) for i in range(k + 1)]
    out = []
    for n, (a, b) in enumerate(combinations(range(k), 2)):
        parts = [F.shiftrightunsigned(fp, cuts[x]).bitwiseAND(F.lit((1 << (cuts[x + 1] - cuts[x])) - 1)) for x in (a, b)]
        out.append(F.lit(n << 56).cast("long").bitwiseOR(F.shiftleft(parts[0], cuts[b + 1] - cuts[b])).bitwiseOR(parts[1]))
    return out


def near_links(fps: DataFrame, radius: int = 3, tile: int = 4096, small: int = 48) -> DataFrame:
    """Links (u, v) that join the distinct fingerprints fps(fp long) as all pairs within radius would.

    Every pair within radius is looked at; of the links of a tile pair, those that
    close a ring are left out.
    """
    spread = fps.select("fp", F.explode(F.array(*_keys(F.col("fp"), radius))).alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = spread.join(sizes, "key").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    # tile t meets every tile o: the pair (min, max) is one unit of work
    units = rows.select("fp", "key", "tiles", mine.alias("t"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    units = units.select("fp", "key", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), (F.col("t") <= F.col("o")).alias("left"))
    dealt = units.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "left")

    def links(table: pa.Table) -> pa.RecordBatch | None:
        fp = table.column("fp").to_numpy().view(np.uint64)
        key, a, b = (table.column(c).to_numpy() for c in ("key", "a", "b"))
        left = table.column("left").to_numpy(zero_copy_only=False)
        change = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.concatenate([[0], np.cumsum(change)])
        starts, ends = runs_of(group)
        big = (ends - starts > small) | (a[starts] != b[starts])
        found: list[tuple[int, int]] = []
        rest = np.flatnonzero(~np.repeat(big, ends - starts))
        found += [(int(rest[i]), int(rest[j])) for i, j in small_links(fp[rest], group[rest], radius)]
        for s, e in zip(starts[big].tolist(), ends[big].tolist(), strict=True):
            if a[s] == b[s]:
                own = fp[s:e]
                found += [(s + i, s + j) for i, j in forest_links(own, own, radius)]
            else:
                cut = s + int((~left[s:e]).sum())  # the right tile's rows come first: false sorts before true
                if s < cut < e:
                    found += [(s + i, s + j) for i, j in forest_links(fp[s:cut], fp[cut:e], radius)]
        if not found:
            return None
        i, j = np.array(found).T
        return pa.RecordBatch.from_pydict({"u": fp[i].view(np.int64), "v": fp[j].view(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups at a time: what follows the last change of group waits for the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 1 << 15:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = {c: table.column(c)[-1].as_py() for c in ("key", "a", "b")}
            same = np.ones(table.num_rows, bool)
            for c, v in last.items():
                same &= table.column(c).to_numpy() == v
            cut = table.num_rows - int(same.sum())
            if cut and (out := links(table.slice(0, cut).combine_chunks())) is not None:
                yield out
            held = table.slice(cut).combine_chunks().to_batches()
        if held and (out := links(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return dealt.mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: key, fp long, component_id (the smallest key its links reach).

    A null text counts as empty; texts without a word have fingerprint 0 and are
    linked like any other. Equal fingerprints are always linked. A null key never
    becomes a component's id unless the component has no other key (then it is
    null). Repeated rows are returned as often as they come. No rows give no rows.
    """
    fps = stored(with_fingerprint(docs, key, text, words, seed), "fingerprints")
    first = fps.groupBy("fp").agg(F.min(key).alias("first_id"))
    groups = connected_components(near_links(first.select("fp"), radius))
    named = first.join(groups.withColumnRenamed("node", "fp"), "fp")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # only fingerprints with a neighbour are listed; the others are their own component
    linked = named.join(smallest, "component").select("fp", "component_id")
    owners = first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    # written first: both sides of the join are then dealt out for it alone, and a fingerprint with very many rows can be split
    return fps.join(stored(owners, "owners"), "fp").select(key, "fp", "component_id")


def hex_fingerprint(fp):
    """A long column's 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

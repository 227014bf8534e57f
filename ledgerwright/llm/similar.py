"""Near-duplicates by word-shingle similarity, on top of bit-sliced SimHash comparison.

A similarity of 0.8 puts SimHash fingerprints some ten bits apart, more than any
exact block scheme can search at scale. So MinHash bands make the buckets here
(bands x rows, 0.9996 of the pairs at 0.8 meet in one), and every pair that meets in
a bucket is accounted for, in two steps. First bit-sliced comparison of the SimHash
fingerprints names for each text its nearest neighbour and the bucket's first text,
and each such link is verified on the whole shingle sets; that joins most of what
belongs together. Then the buckets whose texts still lie in several groups are
compared in full on the shingle sets, but for pairs already in one group; set sizes
and shared rare shingles rule out most pairs exactly, and a spanning forest of the
links is returned, never all pairs. Large buckets are dealt out as pairs of tiles, so
that no task gets a whole one and no pair is left out. Equal texts are one node
throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, batches_of, map_texts, mixed, runs_of, stored
from .components import connected_components
from .decontaminate import _bitmap, _bits_for, shingle_hashes
from .simhash import _LOWER, near_rows, planes_of

BANDS, ROWS = 20, 5
#: SimHash bits that candidates may differ in: four deviations above the mean at similarity 0.8.
RADIUS = 22
#: Nodes of a tile. The first step compares fingerprints inside single tiles, the full comparison all pairs of tiles.
TILE = 2048
#: Bytes of shingle sets of one tile where buckets are compared in full.
TILE_BYTES = 3 << 20


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _hashed(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node of each text (a hash of its words), shingle hashes, and the text each belongs to."""
    lists = [_words(t) for t in texts]
    node = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w)) for w in lists), np.uint64, len(lists))
    h, owner, _ = shingle_hashes([[w.decode("utf-8", "surrogatepass") for w in x] for x in lists], n)
    return node, h, owner


def _signatures(h: np.ndarray, owner: np.ndarray, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash and the band keys (n x bands) of n texts from the hashes of their shingles."""
    fp, keys = np.zeros(n, np.uint64), np.zeros((n, bands), np.uint64)
    some, starts = np.unique(owner, return_index=True)
    if len(some):
        ends = np.append(starts[1:], len(h))
        for a in range(0, len(some), 256):
            b = min(a + 256, len(some))
            bits = np.unpackbits(np.ascontiguousarray(h[starts[a] : ends[b - 1]], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, starts[a:b] - starts[a], axis=0, dtype=np.int32)
            fp[some[a:b]] = np.packbits(2 * ones > (ends[a:b] - starts[a:b])[:, None], axis=1).view(">u8").ravel()
        seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for band in range(bands):
            key = np.full(len(some), band + 1, np.uint64)
            for seed in seeds[band * rows : (band + 1) * rows]:
                x = h * seed
                x ^= x >> np.uint64(32)
                key = mixed(key * np.uint64(31) + np.minimum.reduceat(x, starts))
            keys[some, band] = key
    return fp, keys


def _bucket_links(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links of one bucket: each text with the first one and with its nearest one."""
    n = len(fp)
    if n == 2:
        return [(0, 1)] if int(fp[0] ^ fp[1]).bit_count() <= RADIUS else []
    planes = planes_of(fp)
    links: set[tuple[int, int]] = set()
    for at in range(0, n, 64):
        part = fp[at : at + 64]
        itself = np.arange(n)[None, :] == np.arange(at, at + len(part))[:, None]
        left = np.ones(len(part), bool)
        for radius in (0, 3, 7, 12, 17, RADIUS):
            near = near_rows(part, planes, n, radius, itself)
            if radius == RADIUS:
                links |= {(0, at + i) for i in np.flatnonzero(near[:, 0]).tolist()}
            fresh = left & near.any(axis=1)
            links |= {(min(at + i, j), max(at + i, j)) for i, j in zip(np.flatnonzero(fresh).tolist(), near[fresh].argmax(axis=1).tolist(), strict=True)}
            left &= ~fresh
    return sorted(links)


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """(band, key, node, fp, n) of the buckets of nodes(node, fp, keys) that hold n nodes, two at least."""
    spread = nodes.select("node", "fp", F.posexplode("keys").alias("band", "key"))
    sizes = spread.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    return spread.join(sizes, ["band", "key"])


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], links: Callable[[pa.Table], pa.RecordBatch | None], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """links of whole groups of equal columns at a time, of about limit bytes; the last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.nbytes for x in held) < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for c in columns:
            own = table.column(c).to_numpy()
            same &= own == own[-1]
        cut = table.num_rows - int(same.sum())
        if cut and (out := links(table.slice(0, cut).combine_chunks())) is not None:
            yield out
        held = table.slice(cut).combine_chunks().to_batches()
    if held and (out := links(pa.Table.from_batches(held).combine_chunks())) is not None:
        yield out


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    u, v = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
    return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})


def _candidates(shared: DataFrame) -> DataFrame:
    """Distinct (u, v) that are verified first: the pair of a bucket of two, two for each text of a larger one."""
    rows = shared.withColumn("tile", F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / TILE)).cast("int"))
    dealt = rows.select("band", "key", "tile", "node", "fp", "n").repartition("band", "key", "tile").sortWithinPartitions("band", "key", "tile", "node")

    def links(table: pa.Table) -> pa.RecordBatch | None:
        band, key, tile, node, n = (table.column(c).to_numpy() for c in ("band", "key", "tile", "node", "n"))
        fp = table.column("fp").to_numpy().view(np.uint64)
        group = np.concatenate([[0], np.cumsum((band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))])
        starts, ends = runs_of(group)
        pairs = starts[ends - starts == 2]  # most buckets: one pair, all at once
        pairs = pairs[(n[pairs] == 2) | (np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= RADIUS)]
        found = list(zip(pairs.tolist(), (pairs + 1).tolist(), strict=True))
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            found += [(a + i, a + j) for i, j in _bucket_links(fp[a:b])]
        if not found:
            return None
        i, j = np.array(found).T
        return _edges(node[i], node[j])

    return dealt.mapInArrow(lambda batches: _whole_groups(batches, ("band", "key", "tile"), links), "u long, v long").distinct()


def _shingle_sets(needed: DataFrame, docs: DataFrame, text: str, words: int) -> DataFrame:
    """(node, set binary) of needed(node): the sorted distinct shingle hashes."""
    needed = needed.select(F.col("node").alias("h"))
    bits = _bits_for(needed.count())
    bitmap = _bitmap(needed, bits)

    def sets(batch: pa.RecordBatch, texts: list) -> dict | None:
        node = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(_words(t))) for t in texts), np.uint64, len(texts))
        low = node & np.uint64(bits - 1)
        hit = (bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
        some = np.unique(np.where(hit, node, node[0]), return_index=True)[1]  # a text of each node
        some = some[hit[some]]
        if not len(some):
            return None
        _, h, owner = _hashed([texts[i] for i in some.tolist()], words)
        cuts = np.searchsorted(owner, np.arange(len(some) + 1))
        packed = [np.unique(h[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return {"node": pa.array(node[some].view(np.int64)), "set": pa.array(packed, pa.binary())}

    held = map_texts(docs.select(text), text, sets, "node long, set binary", limit=2 << 20)
    return held.join(needed.withColumnRenamed("h", "node"), "node", "left_semi").groupBy("node").agg(F.max("set").alias("set"))


def _verified(edges: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The edges whose ends' whole shingle sets held(node, set) are similar enough."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            good = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    both = edges.join(held.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(judge, "u long, v long")


def _set_links(sets: list[np.ndarray], part: np.ndarray, similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions (i, j) that span what pairs of at least similarity join beyond the groups in part.

    Every pair in different groups counts, or every pair on different sides, if side is given. Similar sets share one of their first
    size - ceil(similarity * size) + 1 shingles in any common order (here: the rarest
    first), and their sizes differ by the factor similarity at most; the others are
    counted out. Sets of common shingles come first, as they join most.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner, starts = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes) - sizes
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    heard = often[number]
    number = number[np.lexsort((number, heard, owner))]
    label = np.unique(part, return_inverse=True)[1]
    heads = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    first = np.flatnonzero(np.arange(len(number)) - starts[owner] < heads[owner])
    first = first[np.argsort(number[first], kind="stable")]
    begins = np.searchsorted(number[first], np.arange(len(often) + 1))
    holder = owner[first]
    mark, done = np.zeros(len(often), bool), np.zeros(len(sets), bool)
    links: list[tuple[int, int]] = []
    for i in np.argsort(-np.bincount(owner, weights=heard, minlength=len(sets)) / np.maximum(sizes, 1), kind="stable").tolist():
        done[i] = True
        others = (label != label[i]) & ~done
        if side is not None:
            others &= side != side[i]
        if not others.any():
            continue
        own = number[starts[i] : starts[i] + sizes[i]]
        near = np.zeros(len(sets), bool)
        for x in own[: heads[i]].tolist():
            near[holder[begins[x] : begins[x + 1]]] = True
        at = np.flatnonzero(near & others & (sizes >= similarity * sizes[i] - 1e-9) & (similarity * sizes <= sizes[i] + 1e-9))
        if not len(at):
            continue
        mark[own] = True
        ends = np.cumsum(sizes[at])
        shared = np.add.reduceat(mark[number[np.arange(ends[-1]) + np.repeat(starts[at] - ends + sizes[at], sizes[at])]], ends - sizes[at], dtype=np.int64)
        mark[own] = False
        for j in at[shared >= similarity * (sizes[i] + sizes[at] - shared) - 1e-9].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _missing_links(shared: DataFrame, groups: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between groups(node, component) that pairs within buckets of three nodes or more still make.

    A node that is in no group is its own. Buckets within one group need nothing, and
    buckets of the same nodes are compared once.
    """
    rows = shared.where("n > 2").join(groups, "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("part"))
    marks = (F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), *marks).where("low < high")
    once = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key")
    rows = rows.join(once, ["band", "key"])
    sizes = rows.join(held.select("node", F.octet_length("set").alias("size")), "node").groupBy("band", "key").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_BYTES)).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    # tile t meets every tile o: the pair (min, max) is one unit of work
    units = rows.join(sizes, ["band", "key"]).select("band", "key", "node", "part", mine.alias("t"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    units = units.select("band", "key", "node", "part", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), (F.col("t") <= F.col("o")).alias("left"))
    dealt = units.join(held, "node").repartition("band", "key", "a", "b").sortWithinPartitions("band", "key", "a", "b")

    def links(table: pa.Table) -> pa.RecordBatch | None:
        band, key, a, b, part = (table.column(c).to_numpy() for c in ("band", "key", "a", "b", "part"))
        left = table.column("left").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        group = np.concatenate([[0], np.cumsum((band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        found: list[tuple[int, int]] = []
        for s, e in zip(*(x.tolist() for x in runs_of(group)), strict=True):
            found += [(s + i, s + j) for i, j in _set_links(sets[s:e], part[s:e], similarity, left[s:e] if a[s] != b[s] else None)]
        if not found:
            return None
        i, j = np.array(found).T
        return _edges(part[i], part[j])

    columns = ("band", "key", "a", "b")
    return dealt.select(*columns, "left", "part", "set").mapInArrow(lambda batches: _whole_groups(batches, columns, links), "u long, v long")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: key, node long, component_id (the smallest key in its group).

    Texts are linked if the Jaccard similarity of their sets of word shingles
    (A-Z lower-cased, ASCII white space between words) is at least similarity;
    groups are what links join. Texts with the same words are always one group, so
    all texts without a word are. A text of fewer words is one shingle. A null key
    names a group only if it has no other. No rows give no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def sign(batch: pa.RecordBatch, texts: list) -> dict:
        node, h, owner = _hashed(texts, words)
        fp, keys = _signatures(h, owner, len(texts), bands, rows)
        packed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.view(np.int64).ravel()))
        return {key: batch.column(key), "node": pa.array(node.view(np.int64)), "fp": pa.array(fp.view(np.int64)), "keys": packed}

    with batches_of(docs.sparkSession, BATCH_BYTES):
        signed = stored(map_texts(docs.select(key, text), text, sign, f"`{key}` {kind}, node long, fp long, keys array<long>", limit=2 << 20), "signatures")
        first = signed.groupBy("node").agg(F.min(key).alias("first_id"), F.min(F.struct("fp", "keys")).alias("s"))
        nodes = first.select("node", F.col("s.fp").alias("fp"), F.col("s.keys").alias("keys"))
        shared = stored(_shared_buckets(nodes), "buckets")
        held = stored(_shingle_sets(shared.select("node").distinct(), docs, text, words), "sets")
        groups = connected_components(_verified(_candidates(shared), held, similarity))
        joined = connected_components(_missing_links(shared, groups, held, similarity)).select(F.col("node").alias("part"), F.col("component").alias("whole"))
        alone = joined.select(F.col("part").alias("node"), F.col("part").alias("component")).join(groups.select("node"), "node", "left_anti")
        groups = groups.unionByName(alone).join(joined, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component"))
        named = first.select("node", "first_id").join(groups, "node")
        smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
        linked = named.join(smallest, "component").select("node", "component_id")
        owners = first.join(linked, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
        owners = stored(owners, "owners")  # written: a text with very many copies can then be split in the join
    return signed.select(key, "node").join(owners, "node").select(key, "node", "component_id")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs less those whose group has a smaller key; rows with a null key, and repeats of a kept row, stay."""
    gone = similar_components(docs, key, text, words, similarity).where(F.col(key) > F.col("component_id")).select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, docs[key] == F.col("__gone"), "left_anti")

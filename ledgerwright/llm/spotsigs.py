"""Document fingerprints: chains of content words that follow common words.

A signature begins at an anchor, a word so common that running prose has it
everywhere and boilerplate seldom, and is the chain of the next content words,
skipping common ones. A fingerprint is the sorted multiset of a text's signatures,
32 bits each, as hexadecimal text: it needs nothing but the text, equal texts have
equal ones, and an edit changes only the signatures around it.

Fingerprints are compared by Jaccard similarity of the multisets. Pairs are dealt out
by set length, and most are pruned there: two sets are never more alike than the
shorter one's share of the longer. The rest meet value range by value range, and a
pair is given up as soon as what is left cannot lift it to the least similarity asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Words whose followers make signatures: articles, forms of be and have, a few links.
ANCHORS = (
    "the a is was are be have that with for "  # English
    "der die das ist ein eine mit und "  # German
    "le la les est une des pour que "  # French and Spanish
    "el los las es una por con "  # Spanish
    "il lo gli che non "  # Italian
    "o os um uma para"  # Portuguese
).split()

#: Further common words that are no content.
COMMON = (
    "of and to in it on as by this at from an or not but they his her which you were been has had will can "
    "von zu den dem sich auf für nicht im als auch es an werden aus er hat dass sie nach bei "
    "de et en du un qui dans par sur pas au avec ce il se plus ne "
    "y del no su al lo como más pero sus "
    "di e per della sono del da "
    "do em não na no dos mais"
).split()

#: Content words of a chain.
CHAIN = 2

# What a signature is made of: the remainder of a weighted sum of its words' hashes, by the largest prime below 2**32.
_PRIME, _WEIGHTS = 4294967291, (1, 402653189, 201326611)
#: Hash of the start of a text, which is an anchor too.
_START = 1
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.md5(word).digest()[:4], "big")


class Signer:
    """Signatures of texts for one choice of words."""

    def __init__(self, anchors: tuple[str, ...] | list[str] = ANCHORS, common: tuple[str, ...] | list[str] = COMMON) -> None:
        self.anchors = {w.encode() for w in anchors}
        self.common = self.anchors | {w.encode() for w in common}

    def signatures(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted signatures of each text, repeats included.

        Each anchor and the start of the text have one: itself and the next CHAIN
        content words, fewer where the text ends. In a text without any anchor
        every word is an anchor and content.
        """
        lists = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        number: dict[bytes, int] = {}
        word = np.fromiter((number.setdefault(w, len(number)) for own in lists for w in own), np.int64, int(sizes.sum()))
        hashes = np.fromiter(map(_hash, number), np.int64, len(number))
        anchor = np.fromiter((w in self.anchors for w in number), bool, len(number))[word]
        content = ~np.fromiter((w in self.common for w in number), bool, len(number))[word]
        doc = np.repeat(np.arange(len(lists)), sizes)
        bare = (np.bincount(doc[anchor], minlength=len(lists)) == 0)[doc]
        anchor, content = anchor | bare, content | bare
        value = hashes[word]
        chain = value[content]
        ends = np.cumsum(np.bincount(doc[content], minlength=len(lists)))  # where each text's content words end
        after = np.cumsum(content)  # content words up to and with each word
        some = np.flatnonzero(sizes > 0)
        first = np.concatenate([[0], ends[:-1]])[some] if len(some) else some
        owner = np.concatenate([some, doc[anchor]])
        place = np.concatenate([first, after[anchor]])
        total = np.concatenate([np.full(len(some), _START, np.int64), value[anchor]]) * _WEIGHTS[0]
        padded = np.append(chain, np.zeros(CHAIN, np.int64))
        for k in range(CHAIN):
            total = total + np.where(place + k < ends[owner], padded[np.minimum(place + k, len(chain))], 0) * _WEIGHTS[k + 1]
        total %= _PRIME
        order = np.lexsort((total, owner))
        return np.split(total[order], np.cumsum(np.bincount(owner, minlength=len(lists)))[:-1]) if len(lists) else []


def text_form(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: list[np.ndarray], b: list[np.ndarray], least: float = 0.0, ranges: int = 8) -> np.ndarray:
    """Jaccard similarity of each pair of sorted multisets; 0 where it is below least. Two empty sets are equal: 1.

    Pairs go by classes of the longer set's length, so that those compared together
    are of one size.
    """
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a))
    short, long = np.minimum(n, m), np.maximum(n, m)
    out[long == 0] = 1.0
    alive = (short > 0) & (short >= least * long)
    length_class = np.where(alive, np.ceil(np.log2(np.maximum(long, 1))), -1).astype(np.int64)
    for c in np.unique(length_class[alive]):
        pairs = np.flatnonzero(length_class == c)
        for at in range(0, len(pairs), max(1, (1 << 20) >> int(c))):
            part = pairs[at : at + max(1, (1 << 20) >> int(c))]
            out[part] = _compared([a[i] for i in part], [b[i] for i in part], least, ranges if least else 1)
    return out


def _compared(a: list[np.ndarray], b: list[np.ndarray], least: float, ranges: int) -> np.ndarray:
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    # all values of all pairs in one array, equal ones of a pair next to each other, first set before second
    pair = np.concatenate([np.repeat(np.arange(len(a)), n), np.repeat(np.arange(len(a)), m)])
    value = np.concatenate([*a, *b])
    side = np.repeat([0, 1], [n.sum(), m.sum()])
    slot = value * ranges // (1 << 32)
    shared, seen_a, seen_b = (np.zeros(len(a), np.int64) for _ in range(3))
    alive = np.ones(len(a), bool)
    for r in range(ranges):
        now = alive[pair] & (slot == r)
        key = (pair[now] << 32) | value[now]
        keys, at = np.unique(key, return_inverse=True)
        left, right = (np.bincount(at, weights=side[now] == s, minlength=len(keys)).astype(np.int64) for s in (0, 1))
        of = keys >> 32
        for into, what in ((shared, np.minimum(left, right)), (seen_a, left), (seen_b, right)):
            into += np.bincount(of, weights=what, minlength=len(a)).astype(np.int64)
        reach = shared + np.minimum(n - seen_a, m - seen_b)  # the most that they can still share
        alive &= reach >= least * (n + m - reach)
    return np.where(alive, shared / (n + m - shared), 0.0)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: list[str] = ANCHORS, common: list[str] = COMMON) -> DataFrame:
    """(key, n_signatures, fingerprint) of each row; a null or empty text, or one without letters and digits, has none and an empty fingerprint.

    Rows are judged one by one, so repeated rows and null keys return as they are;
    other columns of docs are ignored.
    """
    signer = Signer(anchors, common)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = signer.signatures(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_pydict({"__key": batch.column("__key"), "n_signatures": pa.array(list(map(len, found)), pa.int64()), "fingerprint": pa.array(list(map(text_form, found)), pa.string())})

    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(run, f"__key {kind}, n_signatures long, fingerprint string").withColumnRenamed("__key", key)


def _parts_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (__key long, __text, __next boolean) dealt out by ranges of the key, sorted in each, and after the rows of a range the first row of the next one (of the first range after the last), marked __next.

    Bounds are quantiles of the keys; one key a range reaches the driver. Null keys
    come last, equal keys in the order of their texts.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(f"`{key}`").cast("long").alias("__key"))
    n = _parts_of(spark)
    cuts = ids.approxQuantile("__key", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = np.array(sorted({int(x) for x in cuts}), np.int64)
    last = np.iinfo(np.int64).max

    def ranged(keys: pd.Series) -> np.ndarray:
        return np.searchsorted(bounds, keys.fillna(last).astype("int64").to_numpy(), side="right").astype(np.int32)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(ranged(keys))

    whole = F.struct(F.col("__key").isNull().alias("absent"), "__key")
    heads = sorted((r["part"], r["head"]["__key"]) for r in ids.groupBy(range_of("__key").alias("part")).agg(F.min(whole).alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    @F.pandas_udf("array<struct<part: int, next: boolean>>")
    def places(keys: pd.Series) -> pd.Series:
        own = ranged(keys)
        values = [None if pd.isna(k) else int(k) for k in keys]
        return pd.Series([[{"part": p, "next": False}] + ([{"part": before[k], "next": True}] if k in before else []) for p, k in zip(own.tolist(), values, strict=True)])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{text}`").alias("__text"))
    dealt = rows.select("__key", "__text", F.explode(places("__key")).alias("at")).select("__key", "__text", "at.part", F.col("at.next").alias("__next"))
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("__next", F.col("__key").asc_nulls_last(), "__text").drop("part")


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of following (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited form and of the next text by key: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    The last floor(n_chars / 2) code points give way to the first ones of the next
    text, the first after the last (a single text follows itself). A null text is
    empty. Keys are whole numbers; null keys come last, equal keys in the order of
    their texts, and each row returns. Other columns of docs are ignored; no rows
    give no rows. Texts move once, sorted into ranges of the key, and a task
    reads its range from the beginning to the end, some megabytes at a time.
    """
    signer = Signer()
    names = "__key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"

    def judge(keys: list, texts: list[str], following: list[str], own: list[np.ndarray], others: list[np.ndarray]) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        signed = signer.signatures(changed)
        columns = {
            "__key": pa.array(keys, pa.int64()), "n_chars": pa.array(list(map(len, texts)), pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            "fingerprint": pa.array(list(map(text_form, own)), pa.string()), "edited_fingerprint": pa.array(list(map(text_form, signed)), pa.string()),
            "near_edited": pa.array(likeness(own, signed)), "near_next": pa.array(likeness(own, others)), "n_signatures": pa.array(list(map(len, own)), pa.int64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next one is not here yet: key, text, signatures
        closed = False
        for batch in slices(batches, "__text", 1 << 20):
            if closed:
                continue
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            keys, ends = batch.column("__key").to_pylist(), batch.column("__next").to_pylist()
            if True in ends:  # one row follows the range; its equals add nothing
                closed = True
                cut = ends.index(True) + 1
                texts, keys = texts[:cut], keys[:cut]
            signed = signer.signatures(texts)
            if held:
                keys, texts, signed = [held[0], *keys], [held[1], *texts], [held[2], *signed]
            if len(texts) > 1:
                yield judge(keys[:-1], texts[:-1], texts[1:], signed[:-1], signed[1:])
            held = (keys[-1], texts[-1], signed[-1])

    return in_order(docs, key, text).mapInArrow(run, names).withColumnRenamed("__key", key)

"""Language identification by prediction by partial matching.

Each language gets a tree of byte contexts up to ORDER bytes with frozen counts.
A byte costs -log2 of its share in the longest context that has seen it, plus the
escapes (method C: distinct / (distinct + total)) of the longer contexts that have
not; a context that a language never saw costs nothing to leave. Below order 0 all
256 bytes are alike. A text is given the language under which its code is shortest.

All costs follow from the counts, so they are tabulated once: for every string of
k + 1 bytes that any language saw, a row of final costs per language; for every
context, a row of escape costs. Texts are scored in numpy, a hash lookup per byte
and further ones only where the longest string is unknown.

Before coding, A-Z is lower-cased and every run of other ASCII non-letters is one
space, so digits, punctuation and layout say nothing about the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices

ORDER = 4
#: Rows and bytes that a language's model learns from, at most, about: rows are taken by a hash of their key.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 16 << 20

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def plain(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def _grams(raw: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the order + 1 bytes that end at each byte of each text (spaces stand before it), and each text's number of bytes."""
    pad = b" " * order
    flat = np.frombuffer(b"".join(x for r in raw for x in (pad, r)), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    if not len(flat):
        return np.zeros(0, np.uint64), sizes
    key = flat.copy()
    for k in range(1, order + 1):
        key[k:] |= flat[:-k] << np.uint64(8 * k)
    real = np.ones(len(flat), bool)
    begin = np.cumsum(sizes + order) - sizes - order
    for k in range(order):
        real[begin + k] = False
    return key[real], sizes


class _Table:
    """uint64 keys to row numbers, open addressing; unknown keys give -1."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.rows = np.full(size, ~np.uint64(0)), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        self.most = 1
        while len(left):
            free = self.rows[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at[free], return_index=True)[1] if free.all() else np.flatnonzero(free)[np.unique(at[free], return_index=True)[1]]] = True
            self.keys[at[first]], self.rows[at[first]] = keys[left[first]], left[first]
            left, at = left[~first], (at[~first] + 1) & (size - 1)
            self.most += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.rows[at], -1)
        left = np.flatnonzero((out < 0) & (self.rows[at] >= 0))
        for _ in range(self.most):
            if not len(left):
                break
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            slot = at[left]
            same = (self.keys[slot] == keys[left]) & (self.rows[slot] >= 0)
            out[left[same]] = self.rows[slot[same]]
            left = left[~same & (self.rows[slot] >= 0)]
        return out


class Model:
    """Tabulated code lengths of all languages; made from counts of the longest strings."""

    def __init__(self, languages: list[str], language: np.ndarray, grams: np.ndarray, counts: np.ndarray, order: int = ORDER) -> None:
        self.languages, self.order = languages, order
        n = len(languages)
        self.costs: list[np.ndarray] = []  # by order k: rows for known strings of k + 1 bytes
        self.strings: list[_Table] = []
        self.escapes: list[np.ndarray] = []  # rows for known contexts of k bytes
        self.contexts: list[_Table] = []
        below = np.full((256, n), 8.0)  # cost of each byte under order -1
        lower_keys = np.arange(256, dtype=np.uint64)
        for k in range(order + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            keys, at = np.unique(grams & mask, return_inverse=True)
            count = np.zeros((len(keys), n))
            np.add.at(count, (at, language), counts)
            contexts, mine = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, mine, count)
            np.add.at(kinds, mine, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (kinds + total)), 0.0)
                own = -np.log2(count / (total + kinds)[mine])
            shorter = keys & np.uint64((1 << 8 * k) - 1) if k else keys
            under = below[np.searchsorted(lower_keys, shorter)]
            cost = np.where(count > 0, own, escape[mine] + under)
            if k == 0:  # every byte has a row at order 0
                full = np.repeat(escape, 256, axis=0) + 8.0 if len(escape) else np.full((256, n), 8.0)
                full[keys.astype(np.int64)] = cost
                keys, cost = np.arange(256, dtype=np.uint64), full
            self.strings.append(_Table(keys))
            self.costs.append(cost.astype(np.float32))
            self.contexts.append(_Table(contexts))
            self.escapes.append(escape.astype(np.float32))
            below, lower_keys = cost, keys

    def bits(self, raw: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        key, sizes = _grams(raw, self.order)
        out = np.zeros((len(raw), len(self.languages)))
        if not len(key):
            return out
        each = np.zeros((len(key), len(self.languages)), np.float32)
        left = np.arange(len(key))
        for k in range(self.order, 0, -1):
            own = key[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            row = self.strings[k].find(own)
            known = row >= 0
            if k == self.order and known.all():
                each = self.costs[k][row]
                left = left[:0]
                break
            each[left[known]] += self.costs[k][row[known]]
            left, own = left[~known], own[~known]
            if not len(left):
                break
            context = self.contexts[k].find(own >> np.uint64(8))
            seen = context >= 0
            each[left[seen]] += self.escapes[k][context[seen]]
        if len(left):
            each[left] += self.costs[0][(key[left] & np.uint64(255)).astype(np.int64)]
        some = np.flatnonzero(sizes)
        begin = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(each, begin, axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, order: int = ORDER) -> Model | None:
    """A model from about `rows` rows of each language among those that may be learnt from; None if there are none.

    Null and empty texts teach nothing. The counts that reach the driver are those
    of the sample's strings, so the bounds on a language's rows and bytes bound them.
    """
    usable = docs.where(may_learn & F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(key, text, F.col(lang).cast("string").alias("lang"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes"))
    share = usable.join(F.broadcast(sizes), "lang") if _few(sizes) else usable.join(sizes, "lang")
    spot = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) / float(1 << 20)
    sample = share.where(spot < F.least(rows / F.col("n"), SAMPLE_BYTES / F.col("bytes"))).select("lang", text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            names = batch.column("lang").to_pylist()
            texts = batch.column(text).to_pylist()
            for name in sorted(set(names)):
                keys, _ = _grams([plain(t) for t, x in zip(texts, names, strict=True) if x == name], order)
                grams, counts = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(grams), pa.string()), "gram": pa.array(grams.view(np.int64)), "n": pa.array(counts.astype(np.int64))})

    found = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    languages = sorted(found["lang"].unique())
    number = {x: i for i, x in enumerate(languages)}
    found = found.sort_values(["lang", "gram"])
    return Model(languages, found["lang"].map(number).to_numpy(np.int64), found["gram"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64), order)


def _few(sizes: DataFrame, most: int = 10_000) -> bool:
    return len(sizes.limit(most + 1).collect()) <= most


def predict_language(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs' columns but text, with lang_pred and score (the share of the language's likelihood, 0 to 1).

    A null text, or one without a letter, is `und` with score 0; so is every text
    without a model. Equal code lengths go to the language first in order. The
    prediction sees the text alone. Columns named like a result (in any case) are left out.
    """
    rest = [c for c in docs.columns if c != text and c.lower() not in ("lang_pred", "score")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was learnt from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, text, 2 << 20):
            texts = batch.column(text).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if known and t and _LETTER.search(t)]
            if some:
                bits = known.bits([plain(texts[i]) for i in some])
                best = bits.argmin(axis=1)
                weight = np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000.0))
                score[some] = 1 / weight.sum(axis=1)
                for i, b in zip(some, best.tolist(), strict=True):
                    lang[i] = known.languages[b]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in rest} | {"lang_pred": pa.array(lang), "score": pa.array(score)})

    return docs.select(*rest, text).mapInArrow(run, f"{schema}, lang_pred string, score double")

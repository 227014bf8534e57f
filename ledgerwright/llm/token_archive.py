"""Token ids in files of independently reset, checksummed, arithmetic-coded blocks.

What is coded are symbols. A symbol is a run of ids that the file's header lists: a word that
the file has a few times, or one id; words that it has fewer times are spelled by symbols of one id.

Three orders predict each symbol, and one mixture of them drives a range coder:

* order 0: frozen frequencies in the file's header, one table for each of a few classes
  of documents (found by a short k-means over how well a table codes a document);
* order 1: the symbol that followed the one before;
* order 2: the symbol that followed the two before, both with counts.

Orders 1 and 2 learn inside a block and start empty in each. The weight of a named symbol is an
adaptive hit rate, kept by order, by its count, and by whether order 2 has anything to say;
what the named ones leave goes to order 0, so a symbol's price is the sum of all that name it.
The cumulative price of a symbol is order 0's plus the weights of named ones below it, so a
decoder finds the symbol with one division and one look into the inverse of order 0.

All coding arithmetic is on integers, so any machine decodes alike. Blocks share nothing but
the header, so all blocks of a few files are coded side by side: a step codes the next symbol of every
block with numpy operations over blocks. The coder keeps 48 bits and emits 16-bit words;
carries are added to the words at the end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored, write_file
from .tokens import WordTokenizer, default_tokenizer, gathered, tokenizer

#: Symbols of a block, at most.
BLOCK = 2048
#: Ids of one file, about.
FILE_IDS = 8 << 20
#: Symbols of the files, about, whose blocks are coded side by side: numpy's price of a call is shared by more blocks.
SIDE_SYMBOLS = 4 << 20
#: Order-0 tables of a file, at most, and the ids that another table must serve.
CLASSES, CLASS_IDS = 6, 200_000
#: A word is a symbol where a file has it so many times, if it has no more ids than that.
WORD_TIMES, WORD_IDS = 3, 255
MAGIC = b"IDARC003"

_ONE, _TWO = 10, 11  # bits of the order-1 and order-2 context tables, by hash
_PRICE = 26  # bits of the total that prices are scaled to
_RATE = 5  # a hit rate moves by 1 / 2**_RATE
_BUCKETS = 16  # counts end below this
_U = np.uint64
_SMALL = _U(1 << 32)
_FIRST_RATES = np.concatenate([[0], np.linspace(3000, 40000, _BUCKETS - 1).astype(np.int32)]).astype(np.int32)


@dataclass(frozen=True)
class Statistics:
    """The frozen part of the model: ids (ascending) and, by class, their cumulative frequencies up to 2**bits."""

    ids: np.ndarray
    cumulative: np.ndarray
    bits: int

    def to_bytes(self) -> bytes:
        steps = np.diff(self.ids, prepend=0).astype("<u4")
        # bytes of one place together: nearly all are runs, which need no search
        return _run_length(_planes(steps) + _planes(np.diff(self.cumulative, axis=1).astype("<u4").ravel()))

    @classmethod
    def from_bytes(cls, data: bytes, kinds: int, classes: int, bits: int) -> Statistics:
        raw = zlib.decompress(data)
        cumulative = np.zeros((classes, kinds + 1), np.int64)
        np.cumsum(_from_planes(raw[4 * kinds :]).reshape(classes, kinds), axis=1, out=cumulative[:, 1:])
        return cls(np.cumsum(_from_planes(raw[: 4 * kinds]), dtype=np.int64), cumulative, bits)


def _planes(values: np.ndarray) -> bytes:
    """The lowest bytes of unsigned 32-bit values, then the next ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _run_length(data: bytes) -> bytes:
    coder = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return coder.compress(data) + coder.flush()


def _classes(symbols: np.ndarray, sizes: np.ndarray, kinds: int, most: int, head: int = 64, rounds: int = 3) -> np.ndarray:
    """A class for each document, so that a class's table codes the heads of its documents in few bits.

    Any answer can be decoded; a bad one costs size only.
    """
    if most < 2:
        return np.zeros(len(sizes), np.int64)
    take = np.minimum(sizes, head)
    own = np.repeat(np.arange(len(sizes)), take)
    at = np.repeat(np.cumsum(sizes) - sizes, take) + np.arange(len(own)) - np.repeat(np.cumsum(take) - take, take)
    part = symbols[at]
    share = np.bincount(part, minlength=kinds) / len(part)

    def cost(chosen: np.ndarray) -> np.ndarray:
        counts = np.bincount(part[chosen], minlength=kinds)
        p = counts + 0.2 * counts.sum() * share
        price = -np.log2(np.maximum(p / p.sum(), 2.0**-30))
        return np.bincount(own, weights=price[part], minlength=len(sizes))

    whole = np.flatnonzero(take == take.max())
    common, costs = cost(np.ones(len(own), bool)), [cost(own == whole[0])]
    while len(costs) < most:  # the next table begins with a document that the ones so far serve worse than a common one would
        worst = whole[np.argsort((np.min(costs, axis=0) - common)[whole], kind="stable")]
        costs.append(cost(own == worst[int(0.9 * (len(worst) - 1))]))
    for _ in range(rounds):
        label = np.argmin(costs, axis=0)
        costs = [cost(label[own] == c) for c in np.unique(label)]
    return np.unique(np.argmin(costs, axis=0), return_inverse=True)[1]


def learn(ids: np.ndarray, sizes: np.ndarray) -> tuple[Statistics, np.ndarray, np.ndarray]:
    """The statistics of a file, each id's place in them, and the class of each document."""
    if len(ids) and ids.max() < 1 << 24:
        known = np.flatnonzero(np.bincount(ids))
        place = np.zeros(int(ids.max()) + 1, np.int32)
        place[known] = np.arange(len(known))
        symbols = place[ids] if len(known) < len(place) else ids.astype(np.int32, copy=False)
    else:
        known, symbols = np.unique(ids, return_inverse=True)
    kinds = len(known)
    bits = max(16, kinds.bit_length() + 2)
    if bits > 24:
        raise ValueError("a file holds at most four million different ids")
    label = _classes(symbols, sizes, kinds, min(CLASSES, 1 + len(ids) // CLASS_IDS)) if len(ids) else np.zeros(len(sizes), np.int64)
    used = np.unique(label[sizes > 0])  # documents without ids need no table
    label = np.minimum(np.searchsorted(used, label), max(0, len(used) - 1)).astype(np.int32)
    every = np.repeat(label, sizes)
    cumulative = np.zeros((len(used), kinds + 1), np.int64)
    by_class = np.bincount(every.astype(np.int64) * kinds + symbols, minlength=len(used) * kinds).reshape(len(used), kinds)
    for c, counts in enumerate(by_class):
        seen = counts > 0
        share = np.where(seen, 1 + counts * ((1 << bits) - int(seen.sum())) // int(counts.sum()), 0)
        share[share.argmax()] += (1 << bits) - share.sum()
        np.cumsum(share, out=cumulative[c, 1:])
    return Statistics(known, cumulative, bits), symbols, label


def block_sizes(n: int) -> np.ndarray:
    """Lengths of the blocks of n ids: as few as BLOCK allows, longer ones first, one id apart at most."""
    blocks = -(-n // BLOCK)
    return np.full(blocks, n // max(1, blocks)) + (np.arange(blocks) < n % max(1, blocks))


@dataclass(frozen=True)
class Blocked:
    """What is to be coded of one file: the class (uint8) of each id, its statistics, and its symbols or its blocks."""

    classes: np.ndarray
    known: Statistics
    symbols: np.ndarray | None = None
    blocks: list[bytes] | None = None


class _Side:
    """The blocks of several files side by side, longer ones first; the files have one number of bits.

    tables holds the cumulative frequencies and frequencies of all files and classes in a row.
    """

    def __init__(self, files: list[Blocked]) -> None:
        sizes = [block_sizes(len(f.classes)) for f in files]
        counts = [len(x) for x in sizes]
        lengths = np.concatenate(sizes)
        self.order = np.argsort(-lengths, kind="stable")
        self.begins = np.cumsum(lengths)[self.order] - lengths[self.order]
        self.lengths = lengths[self.order]
        self.cuts = np.cumsum(counts).tolist()
        self.classes = np.concatenate([f.classes for f in files])
        shapes = [f.known.cumulative.shape for f in files]
        below = np.concatenate([f.known.cumulative.ravel() for f in files]).astype(np.int32)
        # cumulative frequency and frequency side by side, as one number; the last of each table is never asked for
        self.tables = np.stack([below, np.append(np.diff(below), 0).astype(np.int32)], 1).view(np.int64).ravel()
        self.width = np.repeat(np.array([w for _, w in shapes], np.int32), counts)[self.order]
        ends = np.cumsum([c * w for c, w in shapes])
        self.base = np.repeat((ends - [c * w for c, w in shapes]).astype(np.int32), counts)[self.order]
        ends = np.cumsum([c for c, _ in shapes])
        self.first_class = np.repeat((ends - [c for c, _ in shapes]).astype(np.int32), counts)[self.order]
        self.bits = files[0].known.bits

    def prices(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative frequency below and frequency at places in tables."""
        pair = self.tables.take(place, mode="clip").view(np.int32).reshape(*place.shape, 2)
        return pair[..., 0], pair[..., 1]

    def chunks(self, steps: int = 64) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
        """(first step, live blocks of each step, places of the ids, their classes), some steps at a time, a row per step.

        Blocks that have ended repeat an id.
        """
        longest = int(self.lengths[0])
        for t in range(0, longest, steps):
            step = np.arange(t, min(t + steps, longest))
            live = np.searchsorted(-self.lengths, -step, "left")
            at = np.minimum(self.begins[: live[0]] + step[:, None], len(self.classes) - 1)
            yield t, live.tolist(), at, self.classes.take(at, mode="clip").astype(np.int32)

    def apart(self, blocks: list) -> list[list]:
        """A list for each file of what belongs to the blocks."""
        out: list = [None] * len(blocks)
        for i, b in zip(self.order.tolist(), blocks, strict=True):
            out[i] = b
        return [out[a:b] for a, b in zip([0, *self.cuts], self.cuts, strict=False)]


def _by_bits(files: list[Blocked], code) -> list:
    """code(files) over the files that hold ids and have one number of bits; None for files without ids."""
    found: list = [None] * len(files)
    for bits in {f.known.bits for f in files if len(f.classes)}:
        mine = [i for i, f in enumerate(files) if len(f.classes) and f.known.bits == bits]
        for i, x in zip(mine, code([files[i] for i in mine]), strict=True):
            found[i] = x
    return found


def _less(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """-1 where a < b, else 0, for int32 less than 2**31 apart: masks of one width keep numpy from casting."""
    out = a - b
    out >>= 31
    return out


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1 where the int32 a and b differ, else 0."""
    out = a ^ b
    out |= -out
    out >>= 31
    return out


def _pick(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a where mask is -1, b where it is 0."""
    out = a ^ b
    out &= mask
    out ^= b
    return out


class _Contexts:
    """Orders 2 and 1 of n blocks, a row each. A named symbol is stored as (symbol + 1) << 8 | count, 0: nothing."""

    def __init__(self, n: int, bits: int) -> None:
        row = np.arange(n)
        self.named = np.zeros((n << _TWO) + (n << _ONE), np.int32)
        self.at = np.stack([row << _TWO, (n << _TWO) + (row << _ONE)])
        self.rates = np.tile(_FIRST_RATES, 4 * n)
        self.at_rate = row * (4 * _BUCKETS) + np.array([[0], [_BUCKETS]])
        # order 0 keeps at least this share, so that each of its frequencies is worth a unit
        self.most = min(64_500 << _PRICE - 16, (1 << _PRICE) - (2 << bits))
        self.shift = bits

    def predict(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Sets who (symbol + 1) and weight of the two named symbols of the first len(last) blocks; gives order 0's multiplier.

        last and before are uint32; all else is int32, as prices have at most 26 bits.
        """
        k = len(last)
        mixed = last * np.uint32(0x9E3779B1)
        h = np.empty((2, k), np.uint32)
        two = np.multiply(before, np.uint32(0x85EBCA77), out=h[0])
        two += np.uint32(0x1234567)
        two ^= mixed
        two *= np.uint32(0x2545F491)
        two >>= np.uint32(32 - _TWO)
        np.right_shift(mixed, np.uint32(32 - _ONE), out=h[1])
        place = h + self.at[:, :k]
        entry = self.named.take(place, mode="clip")
        who, count = entry >> 8, entry & 255
        at = self.at_rate[:, :k] + count
        at += (-entry[0] >> 31) & (2 * _BUCKETS)
        rate = self.rates.take(at, mode="clip")
        weight = rate << (_PRICE - 16)
        weight[1] &= _differ(who[1], who[0])  # what order 2 names already has its weight
        total = weight[0] + weight[1]
        if total.max() > self.most:
            i = np.flatnonzero(total > self.most)
            weight[:, i] = weight[:, i].astype(np.int64) * self.most // total[i]
            total[i] = weight[0, i] + weight[1, i]
        self.place, self.entry, self.count, self.at_rates, self.rate = place, entry, count, at, rate
        self.who, self.weight = who, weight
        np.subtract(1 << _PRICE, total, out=total)
        total >>= self.shift
        return total

    def price(self, own: np.ndarray, below: np.ndarray, frequency: np.ndarray, multiplier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the interval of symbol + 1 = own, from its place in order 0; learns it."""
        hit = _differ(self.who, own)
        np.invert(hit, out=hit)
        part = _less(self.who, own)
        part &= self.weight
        start = multiplier * below
        start += part[0]
        start += part[1]
        np.bitwise_and(self.weight, hit, out=part)
        size = multiplier * frequency
        size += part[0]
        size += part[1]
        self._learn(own, hit)
        return start, size

    def _learn(self, own: np.ndarray, hit: np.ndarray) -> None:
        goal = hit & 65535
        goal -= self.rate
        goal >>= _RATE
        goal += self.rate
        self.rates[self.at_rates] = goal
        # a hit counts one more; a miss halves the count and at last takes the place
        more = self.entry - _less(self.count, _BUCKETS - 1)
        new = own << 8
        new |= 1
        miss = _pick(_less(1 - self.count, 0), self.entry - (self.count >> 1), new)
        self.named[self.place] = _pick(hit, more, miss)


def encode_blocks(symbols: np.ndarray, classes: np.ndarray, known: Statistics) -> list[bytes]:
    """The coded words of each block of symbols (places in known.ids); classes has the class of each."""
    return encode_files([Blocked(classes, known, symbols=symbols)])[0]


def encode_files(files: list[Blocked]) -> list[list[bytes]]:
    """The coded words of each block of each file, all coded side by side; a file's do not depend on the others."""
    return [x or [] for x in _by_bits(files, _encode_side)]


def _encode_side(files: list[Blocked]) -> list[list[bytes]]:
    side = _Side(files)
    symbols = np.concatenate([f.symbols.astype(np.int32, copy=False) for f in files])
    n = len(side.lengths)
    model = _Contexts(n, side.bits)
    low, span = np.zeros(n, _U), np.full(n, 1 << 48, _U)
    width = 2 * int(side.lengths[0]) + 64  # an id takes two words at most, as prices have fewer than 32 bits
    out, begin = np.zeros(n * width, np.int32), np.arange(n) * width
    end = begin.copy()
    prev = prev2 = np.zeros(n, np.uint32)
    for _, k, own, below, frequency in _with_prices(side, symbols):
        prev, prev2 = prev[:k], prev2[:k]
        multiplier = model.predict(prev, prev2)
        start, size = model.price(own, below, frequency, multiplier)
        prev, prev2 = own.view(np.uint32), prev
        unit = span[:k] >> _U(_PRICE)
        low[:k] += unit * start.astype(_U)
        span[:k] = unit * size.astype(_U)
        # every block writes its next word; those that need it move on
        out[end[:k]] = low[:k] >> _U(32)  # with the carry, if there is one
        small = span[:k] < _SMALL
        end[:k] += small
        shift = small.astype(_U)
        low[:k] &= (shift - _U(1)) | (_SMALL - _U(1))
        shift <<= _U(4)
        low[:k] <<= shift
        span[:k] <<= shift
        go = np.flatnonzero(span[:k] < _SMALL)
        while len(go):
            value, where = low.take(go), end.take(go)
            out[where] = value >> _U(32)  # with the carry, if there is one
            end[go] = where + 1
            value &= _SMALL - _U(1)
            low[go] = value << _U(16)
            rest = span.take(go) << _U(16)
            span[go] = rest
            go = go[rest < _SMALL]
    for shift, mask in ((32, 0x1FFFF), (16, 0xFFFF), (0, 0xFFFF)):
        out[end] = (low >> _U(shift)) & _U(mask)
        end += 1
    carry = np.flatnonzero(out > 0xFFFF)
    while len(carry):
        out[carry] &= 0xFFFF
        carry -= 1
        out[carry] += 1
        carry = carry[out[carry] > 0xFFFF]
    return side.apart([out[a:b].astype("<u2").tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])


def _with_prices(side: _Side, symbols: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(step, live blocks, their symbol + 1, cumulative frequency below it, frequency) of every step."""
    for first, live, at, classes in side.chunks():
        own = symbols.take(at, mode="clip")
        classes *= side.width[: live[0]]
        classes += side.base[: live[0]]
        classes += own
        below, frequency = side.prices(classes)
        own += 1
        for i, k in enumerate(live):
            yield first + i, k, own[i, :k], below[i, :k], frequency[i, :k]


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b as int32 for 0 <= a < 2**48 and 0 < b <= 2**26, at most 2**26; a damaged block may give any.

    Double division is correctly rounded everywhere, and a quotient below 2**27 is at least 2**-26 below
    the next whole number, which is more than its rounding.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.fmin(np.true_divide(a, b), 1 << _PRICE).astype(np.int32)


def decode_blocks(blocks: list[bytes], classes: np.ndarray, known: Statistics) -> np.ndarray:
    """The symbols of all blocks in a row; classes has the class of each."""
    return decode_files([Blocked(classes, known, blocks=blocks)])[0]


def decode_files(files: list[Blocked]) -> list[np.ndarray]:
    """The symbols of each file, all blocks of all files decoded side by side."""
    return [np.zeros(0, np.int32) if x is None else x for x in _by_bits(files, _decode_side)]


def _decode_side(files: list[Blocked]) -> list[np.ndarray]:
    side = _Side(files)
    bits = side.bits
    every = [b for f in files for b in f.blocks]
    blocks, n = [every[i] for i in side.order.tolist()], len(side.lengths)
    inverse = np.concatenate([np.repeat(np.arange(1, len(row), dtype=np.int32), np.diff(row)) for f in files for row in f.known.cumulative])
    room = max(map(len, blocks)) // 2 + 3
    words = np.zeros((n, room), np.uint16)
    for i, b in enumerate(blocks):
        words[i, : len(b) // 2] = np.frombuffer(b, "<u2")
    code = (words[:, 0].astype(_U) << _U(32)) | (words[:, 1].astype(_U) << _U(16)) | words[:, 2]  # less the coder's low end throughout
    words, next_word = words.ravel(), np.arange(n) * room + 3
    model = _Contexts(n, bits)
    span = np.full(n, 1 << 48, _U)
    symbols = np.zeros(len(side.classes), np.int32)
    prev = prev2 = np.zeros(n, np.uint32)
    for first, live, at, classes in side.chunks():
        tables = classes * side.width[: live[0]]
        tables += side.base[: live[0]]
        classes += side.first_class[: live[0]]
        classes <<= bits
        found = np.ones(at.shape, np.int32)
        for i, k in enumerate(live):
            prev, prev2, code, span = prev[:k], prev2[:k], code[:k], span[:k]
            _decode_step(model, side, inverse, classes[i, :k], tables[i, :k], prev, prev2, code, span, words, next_word[:k], found[i, :k])
            prev, prev2 = found[i, :k].view(np.uint32), prev
        real = np.arange(first, first + len(live))[:, None] < side.lengths[None, : live[0]]
        symbols[at[real]] = found[real] - 1
    ends = np.cumsum([len(f.classes) for f in files]).tolist()
    return [symbols[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _decode_step(model, side, inverse, kind, table, prev, prev2, code, span, words, next_word, found) -> None:
    """Decodes the next id of each live block into found; moves code, span and next_word on."""
    multiplier = model.predict(prev, prev2)
    who, weight = model.who, model.weight
    unit = span >> _U(_PRICE)
    value = _quotient(code, unit)
    place = who - 1
    np.maximum(place, 0, out=place)
    place += table
    below, frequency = side.prices(place)
    low, size = below * multiplier, frequency * multiplier
    size += weight
    less, differ = _less(who[0], who[1]), _differ(who[0], who[1])
    low[1] += weight[0] & less
    low[0] += weight[1] & (differ ^ less)
    size[1] += weight[0] & ~differ  # order 1 has no weight of its own then
    np.subtract(value, low, out=low)  # from here on the place inside each named id's interval
    inside = _less(low, size)
    past = weight & ~inside
    value -= past[0]
    value -= past[1]
    zero = _quotient(value, multiplier)
    np.maximum(zero, 0, out=zero)
    np.minimum(zero, (1 << side.bits) - 1, out=zero)
    zero += kind
    own = inverse.take(zero, mode="clip")
    inside &= ~low >> 31
    inside &= -who >> 31
    for i in range(2):
        own = _pick(inside[i], who[i], own)
    place = table + own
    place -= 1
    start, size = model.price(own, *side.prices(place), multiplier)
    found[:] = own
    code -= unit * start.astype(_U)
    np.multiply(unit, size.astype(_U), out=span)
    small = span < _SMALL
    shift = small.astype(_U)
    more = words.take(next_word, mode="clip") * shift
    next_word += small
    shift <<= _U(4)
    code <<= shift
    code |= more
    span <<= shift
    go = np.flatnonzero((span < _SMALL) & (span > 0))
    while len(go):
        where = next_word.take(go)
        code[go] = (code.take(go) << _U(16)) | words.take(where, mode="clip")
        next_word[go] = where + 1
        rest = span.take(go) << _U(16)
        span[go] = rest
        go = go[(rest < _SMALL) & (rest > 0)]


@dataclass(frozen=True)
class Runs:
    """Symbols of documents in a row, how many each document has, and the ids that each kind of symbol stands for."""

    symbols: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of_ids(cls, sizes: list[int], ids: np.ndarray) -> Runs:
        """A symbol for each id."""
        kinds, symbols = np.unique(ids, return_inverse=True)
        return cls(symbols, np.array(sizes, np.int64), kinds.astype("<u4"), np.ones(len(kinds), np.int64))

    @classmethod
    def of_words(cls, numbers: np.ndarray, counts: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> Runs:
        """Of documents of so many words each; word i's ids are ids[bounds[i] : bounds[i + 1]]."""
        times = np.bincount(numbers, minlength=len(bounds) - 1)
        used = np.flatnonzero(times)
        begins, lengths = bounds[used], bounds[used + 1] - bounds[used]
        keep = (times[used] >= WORD_TIMES) & (lengths > 1) & (lengths <= WORD_IDS)
        spelled = gathered(ids, begins[~keep], lengths[~keep])
        if len(spelled) and spelled.max() < 1 << 24:
            singles = np.flatnonzero(np.bincount(spelled)).astype(np.uint32)
            place = np.zeros(int(spelled.max()) + 1, np.int32)
            place[singles] = np.arange(len(singles))
            spelled = place[spelled]
        else:
            singles, spelled = np.unique(spelled, return_inverse=True)
        # what stands for each word: its own symbol, or those of its ids
        amount = np.where(keep, 1, lengths)
        ends = np.cumsum(amount)
        written = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        own = np.repeat(keep, amount)
        written[own] = np.arange(len(singles), len(singles) + int(keep.sum()))
        written[~own] = spelled
        begin, size = np.zeros((2, len(times)), np.int64)
        begin[used], size[used] = ends - amount, amount
        sizes = size[numbers]
        symbols = gathered(written, begin[numbers], sizes)
        of_docs = np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))])
        table = np.concatenate([singles, gathered(ids, begins[keep], lengths[keep])]).astype("<u4")
        return cls(symbols, of_docs, table, np.append(np.ones(len(singles), np.int64), lengths[keep]))

    @cached_property
    def n_ids(self) -> int:
        return int(np.bincount(self.symbols, minlength=len(self.lengths)) @ self.lengths)

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all symbols in a row, and where the symbols' ids end, 0 first."""
        if not len(self.symbols):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        sizes = self.lengths[self.symbols]
        return gathered(self.ids, (np.cumsum(self.lengths) - self.lengths)[self.symbols], sizes), np.append(0, np.cumsum(sizes))


def file_bytes(keys: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """One archive of ids without words: header, table of symbols, document table, statistics, block table and blocks, each under a CRC-32."""
    return archives([(keys, sizes, ids)])[0]


def archives(files: list[tuple[list[int | None], list[int], np.ndarray]]) -> list[bytes]:
    """The bytes of each file's archive; see file_bytes."""
    return run_archives([(keys, Runs.of_ids(sizes, ids)) for keys, sizes, ids in files])


def run_archives(files: list[tuple[list[int | None], Runs]]) -> list[bytes]:
    """The bytes of each file's archive, from the documents' keys and symbols."""
    learnt = [learn(runs.symbols, runs.sizes) for _, runs in files]
    blocks = encode_files([Blocked(np.repeat(label.astype(np.uint8), runs.sizes), known, symbols=symbols) for (_, runs), (known, symbols, label) in zip(files, learnt, strict=True)])
    return [_archive(*f, known, label, b) for f, (known, _, label), b in zip(files, learnt, blocks, strict=True)]


def _archive(keys: list[int | None], runs: Runs, known: Statistics, label: np.ndarray, blocks: list[bytes]) -> bytes:
    present = np.array([k is not None for k in keys], np.uint8)
    names = np.array([0 if k is None else k for k in keys], "<i8")
    docs = zlib.compress(present.tobytes() + names.tobytes() + runs.sizes.astype("<u4").tobytes() + label.astype(np.uint8).tobytes(), 1)
    width = 2 if not len(runs.ids) or runs.ids.max() < 1 << 16 else 4
    words = zlib.compress(runs.lengths.astype(np.uint8).tobytes() + runs.ids.astype(f"<u{width}").tobytes(), 3)
    frozen = known.to_bytes()
    crcs = _crcs(runs.symbols)
    table = np.array([[len(b) for b in blocks], crcs], "<u4").tobytes() if blocks else b""
    counts = (len(keys), runs.n_ids, len(runs.symbols), len(blocks), len(runs.lengths), len(runs.ids), width, len(known.ids), len(known.cumulative), known.bits, len(docs), len(words), len(frozen))
    head = MAGIC + struct.pack(_HEAD, *counts, zlib.crc32(docs + words + frozen + table))
    return head + docs + words + frozen + table + b"".join(blocks)


def _crcs(symbols: np.ndarray) -> list[int]:
    """The CRC-32 of each block's symbols; what they stand for has its own."""
    raw, ends = memoryview(symbols.astype("<u4").tobytes()), np.cumsum(4 * block_sizes(len(symbols))).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


_HEAD = "<IQQIIIIIIIIIII"


def parse_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, sizes, ids) of an archive; a wrong checksum raises ValueError."""
    return next(parse_files([data]))


def parse_files(files: list[bytes]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """parse_file of each, their blocks decoded side by side."""
    heads = [_tables_of(data) for data in files]
    for (keys, n_ids, crcs, runs, coded), symbols in zip(heads, decode_files([h[-1] for h in heads]), strict=True):
        if len(symbols):
            symbols = coded.known.ids.astype(np.int32).take(symbols, mode="clip")
        if _crcs(symbols) != crcs.tolist():
            raise ValueError("a block's checksum differs")
        ids, at = Runs(symbols, runs.sizes, runs.ids, runs.lengths).spelled()
        if len(ids) != n_ids:
            raise ValueError("the archive's counts differ")
        yield keys, np.diff(at[np.append(0, np.cumsum(runs.sizes))]), ids


def symbols_in(data: bytes) -> int:
    """How many symbols an archive says that it holds."""
    return struct.unpack_from(_HEAD, data, 8)[2] if data[:8] == MAGIC else 0


def _tables_of(data: bytes) -> tuple[list[int | None], int, np.ndarray, Runs, Blocked]:
    """(keys, ids, CRC-32 of each block, documents and kinds without symbols, what is to be decoded) of an archive."""
    if data[:8] != MAGIC:
        raise ValueError("not an id archive")
    n_docs, n_ids, n_symbols, n_blocks, n_words, n_word_ids, width, kinds, n_classes, bits, n_table, n_list, n_frozen, crc = struct.unpack_from(_HEAD, data, 8)
    at = 8 + struct.calcsize(_HEAD)
    parts = []
    for size in (n_table, n_list, n_frozen, 8 * n_blocks):
        parts.append(data[at : at + size])
        at += size
    if zlib.crc32(b"".join(parts)) != crc:
        raise ValueError("the tables' checksum differs")
    raw = zlib.decompress(parts[0])
    present, names = np.frombuffer(raw, np.uint8, n_docs), np.frombuffer(raw, "<i8", n_docs, n_docs)
    sizes = np.frombuffer(raw, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    label = np.frombuffer(raw, np.uint8, n_docs, 13 * n_docs)
    raw = zlib.decompress(parts[1])
    runs = Runs(np.zeros(0, np.int32), sizes, np.frombuffer(raw, f"<u{width}", n_word_ids, n_words).astype("<u4"), np.frombuffer(raw, np.uint8, n_words).astype(np.int64))
    known = Statistics.from_bytes(parts[2], kinds, n_classes, bits)
    spans, crcs = np.frombuffer(parts[3], "<u4").reshape(2, -1).astype(np.int64) if n_blocks else (np.zeros(0, np.int64),) * 2
    lengths = block_sizes(n_symbols)
    if sizes.sum() != n_symbols or len(lengths) != n_blocks or runs.lengths.sum() != n_word_ids or (kinds and known.ids[-1] >= n_words):
        raise ValueError("the archive's counts differ")
    blocks = []
    for s in spans.tolist():
        blocks.append(data[at : at + s])
        at += s
    return [int(x) if k else None for x, k in zip(names, present, strict=True)], n_ids, crcs, runs, Blocked(np.repeat(label, sizes), known, blocks=blocks)


def words_ended(words: WordTokenizer, held: list[tuple[np.ndarray, np.ndarray]], end_id: int) -> Runs:
    """The symbols of texts that words has numbered, batch by batch, with end_id after each text."""
    numbers, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    table = words.table
    end = table.add(np.array([end_id], np.uint32), np.ones(1, np.int64))
    numbers = np.insert(numbers, np.cumsum(counts), end[0])
    return Runs.of_words(numbers, counts + 1, table.flat[: table.size], table.bounds[: table.n + 1])


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode texts (null: empty), end each with end_id, write files into folder in ascending key order.

    One row per file: file, n_docs, n_ids; names ascend as keys do. A null key
    comes first; rows with the same key are ordered by text, and dealt out by how
    it begins. A repeated task replaces its own files. Keys are integers.
    """
    path = path or default_tokenizer()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("key", F.substring("text", 1, 16)).sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, n_docs, n_ids = TaskContext.get().partitionId(), [], [], []
        keys: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        full: list[tuple[list, Runs]] = []
        words = tokenizer(path)
        words.trim()

        def close() -> None:
            nonlocal keys, held, size
            full.append((keys, words_ended(words, held, end_id)))
            keys, held, size = [], [], 0
            words.trim()
            if sum(len(runs.symbols) for _, runs in full) >= SIDE_SYMBOLS:
                write()

        def write() -> None:
            for (docs, runs), content in zip(full, run_archives(full), strict=True):
                names.append(write_file(folder, f"part-{part:06d}-{len(names):05d}.ids", content))
                n_docs.append(len(docs))
                n_ids.append(runs.n_ids)
            full.clear()

        for batch in slices(batches, "text", 12 << 20):
            held.append(words.numbered(batch.column("text").to_pylist()))
            keys += batch.column("key").to_pylist()
            size += words.ids_in(held[-1][0]) + batch.num_rows
            if size >= FILE_IDS or words.is_full():
                close()
        if keys:
            close()
        write()
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "n_docs": pa.array(n_docs, pa.int64()), "n_ids": pa.array(n_ids, pa.int64())})

    return dealt.mapInArrow(run, "file string, n_docs long, n_ids long")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[int | None], np.ndarray, np.ndarray]]:
    """(file, keys, sizes, ids) of rows (file, content), files of some SIDE_SYMBOLS symbols decoded together."""
    names: list[str] = []
    held: list[bytes] = []
    for batch in batches:
        for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            if held and sum(map(symbols_in, held)) + symbols_in(data) > SIDE_SYMBOLS:
                yield from ((x, *y) for x, y in zip(names, parse_files(held), strict=True))
                names, held = [], []
            names.append(name)
            held.append(data)
    yield from ((x, *y) for x, y in zip(names, parse_files(held), strict=True))


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the *.ids files in folder: key, start, n_tokens, ids_crc32 (and ids, packed).

    start counts the ids of all documents before, over all files in name order.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    files = read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = "file string, key long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, keys, sizes, ids in _parsed(batches):
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
            cuts = list(zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True))
            out = {"file": pa.array([name] * len(keys)), "key": pa.array(keys, pa.int64()), "at": pa.array(ends - sizes), "n_tokens": pa.array(sizes)}
            out["ids_crc32"] = pa.array([zlib.crc32(raw[a:b]) for a, b in cuts], pa.int64())
            if with_ids:
                out["ids"] = pa.array([raw[a:b] for a, b in cuts], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    rows = stored(files.mapInArrow(run, schema), "ids")
    # names are part-<task>-<number>: a running sum over tasks, one row each, and one inside each task's files
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.substring_index("file", "-", 2))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("file")) - F.col("n")
    bases = totals.withColumn("inside", inside).join(before, "part").select("file", (F.col("before") + F.col("inside")).alias("base"))
    return rows.join(bases, "file").select("key", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def id_round_trip(docs: DataFrame, path: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' ids written to files in the shared folder and read again; see write_ids and read_ids. No rows give no rows."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "id-archive")
    if not write_ids(docs, folder, path, end_id, key, text).agg(F.sum("n_docs")).first()[0]:
        return spark.createDataFrame([], f"`{key}` long, start long, n_tokens long, ids_crc32 long")
    return read_ids(spark, folder).withColumnRenamed("key", key)

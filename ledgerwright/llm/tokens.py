"""Token ids of whole texts, through a table of words.

The tokenizer splits at white space before anything else, so the ids of a text are
the ids of its words in a row. Each Python worker keeps a table of words' ids and a memo of
their numbers in it; Arrow finds a batch's different words, and only pieces of words that the memo
lacks go to the tokenizers library, in one call a batch. When the memo holds over MEMO_WORDS
words, those that no second batch had are dropped between batches, or all of them if that frees too little.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_WORDS = 650_000
#: Ids that the table of words holds before it is looked through.
TABLE_IDS = 8 << 20
#: ASCII letters and marks, between which any word may be cut: no piece holds both, and neither changes what the other becomes.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True
#: A word of lower-case Latin-1 letters and the marks after it: two pieces, which nothing normalises.
_SIMPLE = "^(?P<core>[a-z\u00df-\u00f6\u00f8-\u00ff]+)(?P<tail>[.,;:!?]*)$"


def default_tokenizer() -> str:
    """The path of the 49k word tokenizer that the box offers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _is_latin_1(text: str) -> bool:
    """Whether all characters are below U+0100, where nothing combines and case is one to one."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Table:
    """Ids of numbered words in a row, the number of batches that had each, and how the next are added."""

    def __init__(self) -> None:
        self.n = 0
        self.flat, self.bounds, self.batches = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    @property
    def size(self) -> int:
        """Ids in the table."""
        return int(self.bounds[self.n])

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of new words of so many ids each."""
        begin, n = self.size, self.n
        if begin + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(begin + 2 * len(ids), np.uint32)])
        if n + len(sizes) >= len(self.bounds):
            more = n + 2 * len(sizes)
            self.bounds, self.batches = np.concatenate([self.bounds, np.zeros(more, np.int64)]), np.concatenate([self.batches, np.zeros(more, np.int32)])
        self.flat[begin : begin + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(sizes)] = begin + np.cumsum(sizes)
        self.n += len(sizes)
        return np.arange(n, self.n)

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words in a row, and how many each has."""
        begins = self.bounds[numbers]
        sizes = self.bounds[numbers + 1]
        sizes -= begins
        return gathered(self.flat, begins, sizes), sizes


def gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """sizes[0] of values from begins[0] on, then sizes[1] from begins[1] on and so on, in a row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    for a in range(0, len(ends), step):  # what a step holds stays in the processor's cache
        part, end = sizes[a : a + step], ends[a : a + step]
        first, last = int(end[0] - part[0]), int(end[-1])
        at = np.repeat(begins[a : a + step] - end + part, part)
        at += np.arange(first, last)
        values.take(at, out=out[first:last], mode="clip")
    return out


def _marks_apart(split: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, bounds) of lists of words, a last mark after an ASCII letter as a word of its own; list i is words[bounds[i] : bounds[i + 1]]."""
    words, bounds = split.flatten(), split.offsets.to_numpy()
    _, offsets, data = words.buffers()
    ends, raw = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset), np.frombuffer(data or b"", np.uint8)
    if not len(raw):
        return words, bounds
    last = ends[1:] - 1
    cut = _MARK[raw.take(last, mode="clip")] & _LETTER[raw.take(last - 1, mode="clip")] & (last > ends[:-1])
    at = np.flatnonzero(cut) + 1
    made = np.insert(ends, at, ends[at] - 1)
    return pa.LargeStringArray.from_buffers(len(made) - 1, pa.py_buffer(made), data), bounds + np.append(0, np.cumsum(cut))[bounds]


class WordTokenizer:
    """encode(texts): each text's ids as little-endian unsigned 32-bit bytes. numbered(texts): its words' numbers in table.

    Numbers hold until the next call of trim or encode.

    Words are kept apart where the tokenizer's own rules allow it (white space is
    dropped, every piece ends with an end-of-word mark); a tokenizer of another
    kind encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.end = rules["model"].get("end_of_word_suffix")
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = bool(self.end) and split[0].get("behavior") == "Removed" and split[0].get("invert") is True and not rules.get("post_processor")
        self.special = [x["content"] for x in rules.get("added_tokens", ())]
        if self.by_word:
            size = self.library.get_vocab_size(with_added_tokens=True)
            ends = [self.library.id_to_token(i) or "" for i in range(size)]
            self.closes = np.array([t.endswith(self.end) for t in ends])
            import regex

            self.pattern = regex.compile(split[0]["pattern"]["Regex"])
            self.by_piece = self._for_pieces(Tokenizer, rules)
        # a piece stands under itself in pieces, or in memo where it is a simple word
        self.table, self.memo, self.pieces = _Table(), {}, {}

    def _for_pieces(self, kind: type, rules: dict) -> list:
        """The library's tokenizer with the same model for pieces that are normalised and split already, white space between two.

        One for pieces of printable ASCII, which stand for their own bytes, and one for others.
        """
        from tokenizers.pre_tokenizers import Sequence, WhitespaceSplit

        last = rules["pre_tokenizer"]["pretokenizers"][1:]
        if [x["type"] for x in rules.get("normalizer", {}).get("normalizers", ())] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in last] != ["ByteLevel"]:
            return [self.library, self.library]
        made = []
        for steps in ([], [self.library.pre_tokenizer[1]]):
            made.append(kind(self.library.model))
            made[-1].pre_tokenizer = Sequence([WhitespaceSplit(), *steps])
        return made

    def _split(self, word: str) -> list[str]:
        """The pieces of a word of characters below U+0250."""
        if word.isalpha():
            return [word.lower()]
        core = word.rstrip(".,;:!?")
        if core.isalpha():
            return [core.lower(), word[len(core) :]]
        return self.pattern.findall(word.lower())

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _add(self, raw: list[bytes]) -> list[int]:
        """Numbers of new words of these ids."""
        return self.table.add(np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4).tolist()

    def _coded(self, pieces: Iterable[str]) -> Iterator[tuple[str, int]]:
        """(piece, number) of new pieces, which are coded in two calls; neighbours in order share the model's steps."""
        ordered = sorted(pieces)
        own_bytes = [p for p in ordered if p.isascii() and p.isprintable()]
        for light, own in zip(self.by_piece, (own_bytes, sorted(set(ordered).difference(own_bytes)) if len(own_bytes) < len(ordered) else []), strict=True):
            if not own:
                continue
            ids = np.array(light.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(own):
                yield from zip(own, self.table.add(ids, np.diff(ends, prepend=0)).tolist(), strict=True)
            else:  # a piece without a closing token: no splitting by marks
                yield from zip(own, self._add(self._whole(own)), strict=True)

    def _joined(self, parts: np.ndarray, counts: np.ndarray) -> list[int]:
        """Numbers of new words made of so many numbered parts each."""
        ids, sizes = self.table.ids_of(parts)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return self.table.add(ids, np.diff(ends)).tolist()

    def _learn(self, new: pa.Array) -> None:
        """Puts new words into the memo: words of Latin letters by their pieces, others one by one."""
        parts = pc.extract_regex(new, pattern=_SIMPLE)
        simple = parts.is_valid().to_numpy(zero_copy_only=False)
        if simple.any():
            word = new.filter(pa.array(simple)).to_numpy(zero_copy_only=False)
            core, tail = (x.to_numpy(zero_copy_only=False) for x in parts.filter(pa.array(simple)).flatten())
            two = tail != ""
            need = {*core, *tail[two]}.difference(self.memo)
            self.memo.update(self._coded(need))
            if two.any():  # marks alone are no simple words, but may be new words of this batch: the number is the same
                get = self.memo.__getitem__
                both = np.stack([np.fromiter(map(get, x[two]), np.int64, int(two.sum())) for x in (core, tail)], 1).ravel()
                self.memo.update(zip(word[two].tolist(), self._joined(both, np.full(int(two.sum()), 2)), strict=True))
        plain, odd = [], []
        for w in new.filter(pa.array(~simple)).to_pylist():  # below U+0250 nothing combines, so pieces can be found before the library normalises
            (plain if w.isascii() or (max(w) < "\u0250" and "\u0130" not in w) else odd).append(w)
        if plain:
            split = list(map(self._split, plain))
            need = set(chain.from_iterable(split)).difference(self.pieces)
            self.pieces.update(self._coded(need))
            flat = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(split)), np.int64)
            self.memo.update(zip(plain, self._joined(flat, np.fromiter(map(len, split), np.int64, len(split))), strict=True))
        if odd:
            self.memo.update(zip(odd, self._add(self._whole(odd)), strict=True))

    def ids_in(self, numbers: np.ndarray) -> int:
        """How many ids the numbered words have."""
        return int(np.bincount(numbers, minlength=self.table.n) @ np.diff(self.table.bounds[: self.table.n + 1]))

    def is_full(self) -> bool:
        """Whether trim would drop words."""
        return len(self.memo) + len(self.pieces) > MEMO_WORDS or self.table.size > TABLE_IDS

    def trim(self) -> None:
        """Drops words that no second batch had if there are many, all if most were had again; other numbers change too."""
        if not self.is_full():
            return
        old, held = self.table, list(self.memo.items())
        number = np.fromiter((i for _, i in held), np.int64, len(held))
        keep = old.batches[number] > 1
        self.table, self.memo, self.pieces = _Table(), {}, {}
        ids, sizes = old.ids_of(number[keep])
        if len(sizes) > MEMO_WORDS // 2 or len(ids) > TABLE_IDS // 2:
            return
        made = self.table.add(ids, sizes)
        self.table.batches[made] = 1  # to be had again before the next time
        self.memo = dict(zip((held[i][0] for i in np.flatnonzero(keep).tolist()), made.tolist(), strict=True))

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts): the table's numbers of all texts' words in a row, and how many words each text has."""
        if not self.by_word:
            return np.array(self._add(self._whole([t or "" for t in texts])), np.int64), np.ones(len(texts), np.int64)
        # regex takes U+001C..1F as white space, the library as text
        whole = [i for i, t in enumerate(texts) if t and any(s in t for s in (*self.special, "\x1c", "\x1d", "\x1e", "\x1f"))]
        apart = set(whole)
        # other than Latin-1 letters keep their case here: the library normalises before it lower-cases
        plain = pa.array(("" if i in apart or not t else t.lower() if _is_latin_1(t) else t for i, t in enumerate(texts)), pa.large_string())
        split = pc.ascii_split_whitespace(plain)  # words may hold other white space, which _learn and the library drop
        words, bounds = _marks_apart(split)
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        known = np.fromiter(map(self.memo.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(known < 0)
        if len(new):
            self._learn(coded.dictionary.take(pa.array(new)))
            known[new] = np.fromiter(map(self.memo.__getitem__, names[new]), np.int64, len(new))
        self.table.batches[known] += 1
        numbers = known[coded.indices.to_numpy()]
        counts = np.diff(bounds)
        if whole:
            numbers = np.insert(numbers, bounds[whole], self._add(self._whole([texts[i] for i in whole])))
            counts[whole] += 1  # an empty text is split into one empty word
        return numbers, counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        self.trim()
        numbers, counts = self.numbered(texts)
        ids, sizes = self.table.ids_of(numbers)
        raw, ends = ids.astype("<u4", copy=False).tobytes(), np.append(0, np.cumsum(sizes))
        cuts = (4 * ends[np.append(0, np.cumsum(counts))]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker for path."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]

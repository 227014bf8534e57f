"""Main text of web pages: what markup says of blocks, and what a host's pages repeat.

A page is cut into blocks by its markup, and two judges look at them.

Markup names the page's one article (<article>, <main>): the largest one that is not a
comment or teaser by its names or place; a page is never emptied by the names of its only
article. It also says whether a block is furniture: surely (navigation, header, footer,
aside, form and the like, or a class, id or role that is such a word, or has comments,
adverts or notices of consent in a part of it), perhaps (a class or id that only contains
another such word, as grid-notice does), or not. Headings are never dropped for a name.

The array looks at the token streams of all pages of a host, but for the plain blocks of
articles. In each task the streams are concatenated, with a separator after each page, and
suffixes are sorted to a suffix array; neighbours that share MIN_RUN tokens are one class.
Classes are merged over all tasks by host and hash of those tokens (min and max of page
numbers, so nothing grows with a class), and a token is repeated if a run of at least
MIN_RUN tokens around it stands on two pages of the host, wherever these pages were. That
is what one array over the whole host would find, and no task holds a whole host.

On a page with an article the text is the article's blocks that are no furniture; where
markup says "perhaps", blocks repeated to half or more go. On a page without one, sure
furniture and all repeated runs go and unique runs stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .decontaminate import shingle_hashes

MIN_RUN = 6

_RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|xmp|select"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav header footer aside form menu dialog button head title fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names of furniture. A whole name of any of these lists is sure furniture; as a part of a name (ad-slot) those of the first two are, the others perhaps.
_READERS = frozenset("comment comments disqus reply replies related recommended teaser teasers".split())
_NOTICES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent newsletter breadcrumb breadcrumbs".split())
_WORDS = _READERS | _NOTICES | frozenset("promo promotion banner nav navbar navigation menu header masthead footer sidebar aside complementary notice notices alert popup modal overlay share sharing social subscribe signup login search".split())
_ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")

NO, PERHAPS, SURE = 0, 1, 2


def _names(attributes: str) -> Iterator[tuple[str, str, list[str]]]:
    """(attribute, name, its parts in lower case) of each class, id and role."""
    for m in _ATTRIBUTE.finditer(attributes):
        attribute = m[1].lower()
        if attribute in ("class", "id", "role"):
            for word in (m[2] or m[3] or m[4] or "").split():
                yield attribute, word.lower(), [x.lower() for x in _PARTS.split(word)]


def furniture_of(name: str, attributes: str) -> int:
    """What an element's name and its class, id and role say of it: NO, PERHAPS or SURE furniture. Headings have no furniture names."""
    if name in _FURNITURE:
        return SURE
    if not attributes or name in ("html", "body") or name in _HEADINGS:
        return NO
    found = NO
    for attribute, word, parts in _names(attributes):
        if word in _WORDS or attribute != "role" and not _READERS.union(_NOTICES).isdisjoint(parts):
            return SURE
        if attribute != "role" and not _WORDS.isdisjoint(parts):
            found = PERHAPS
    return found


def of_readers(attributes: str) -> bool:
    """Whether a part of an element's names says that readers or links to other pages speak in it."""
    return bool(attributes) and any(not _READERS.isdisjoint(parts) for _, _, parts in _names(attributes))


@dataclass
class _Region:
    """An <article>, <main> or element of role main. doubt: 0, or why it may be no article (its name, where it stands)."""

    parent: int
    is_main: bool
    doubt: int
    words: int = 0


NAMED, ENCLOSED, OF_READERS = 1, 2, 3  # like a comment by name or after comments; inside furniture; inside comments


def main_region(regions: list[_Region], outside: int) -> set[int]:
    """The regions that are the page's one article: the largest without doubt - with the largest article in it, if it is a <main>.

    If all are in doubt the largest that is not inside comments, unless there are
    more words outside of all regions, which then are the text. None: no words.
    """
    children: dict[int, list[int]] = {}
    for i, r in enumerate(regions):
        children.setdefault(r.parent, []).append(i)

    def best(those: list[int], most: int) -> int | None:
        found = [i for i in those if total(i) and regions[i].doubt <= most]
        return min(found, key=lambda i: (-total(i), i)) if found else None

    def total(i: int) -> int:
        inner = [k for k in children.get(i, ()) if regions[i].is_main and not regions[k].doubt]
        return regions[i].words + max(map(total, inner), default=0)

    top = children.get(-1, [])
    chosen = best(top, 0)
    if chosen is None:
        chosen = best(top, ENCLOSED)
        if chosen is not None and total(chosen) <= outside:
            chosen = None
    if chosen is None and regions and not outside:  # a <main> that only holds articles in doubt
        chosen = next((i for i in top if best(children.get(i, []), NAMED) is not None), None)
    out: set[int] = set()
    while chosen is not None:
        out.add(chosen)
        inner = children.get(chosen, []) if regions[chosen].is_main else []
        nested = best(inner, 0)
        if nested is None and not regions[chosen].words:
            nested = best(inner, NAMED)
        chosen = nested
    return out


def _closed(tags: list[re.Match]) -> set[int]:
    """Which start tags have an end tag of their own."""
    stack: list[tuple[str, int]] = []
    closed = set()
    for i, m in enumerate(tags):
        name = m[3]
        if not name or name.lower() in _VOID or (not m[2] and m[4].endswith("/")):
            continue
        name = name.lower()
        if not m[2]:
            stack.append((name, i))
        elif any(x == name for x, _ in stack):
            while stack[-1][0] != name:
                stack.pop()
            closed.add(stack.pop()[1])
    return closed


def blocks_of(page: str | None) -> list[tuple[str, bool, int]]:
    """(text, inside the article, furniture: NO, PERHAPS or SURE) of each block with text, in page order.

    Character references are decoded and white space is one space. main_region says
    which element is the article; its own names do not count, and furniture is judged
    inside it. Other articles - readers' comments, teasers, articles inside the
    article - are sure furniture. An element without an end tag ends with its
    parent, the page, or - sure furniture outside an article - where an article begins.
    """
    if not page:
        return []
    found: list[tuple[str, int, int]] = []  # text, region, furniture
    regions: list[_Region] = []
    held: list[str] = []
    stack: list[str] = []
    around: list[tuple[int, int, int, bool, bool]] = []  # depth of each open region, and what held outside it: sure, perhaps, open_ended, readers
    sure = perhaps = 0  # depths at which each began, 0: not inside
    open_ended = readers = False  # whether the sure furniture has no end tag, and whether it is comments
    inside = -1  # the innermost open region
    after_readers = False

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                kind = SURE if sure else PERHAPS if perhaps else NO
                found.append((text, inside, kind))
                if inside >= 0 and kind != SURE:
                    regions[inside].words += text.count(" ") + 1

    tags = list(_TAG.finditer(page))
    closed = _closed(tags)
    at = 0
    for i, m in enumerate(tags):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            if name not in _INLINE:
                flush()
            if name in stack:
                while stack.pop() != name:
                    pass
                depth = len(stack)
                if depth < max(sure, perhaps, around[-1][0] if around else 0):
                    flush()
                while around and depth < around[-1][0]:
                    _, sure, perhaps, open_ended, readers = around.pop()
                    inside = regions[inside].parent
                sure, perhaps = (x if x <= depth else 0 for x in (sure, perhaps))
            continue
        attributes = m[4]
        kind = furniture_of(name, attributes)
        is_main = name == "main" or ("role" in attributes and re.search(r"(?<![\w-])role\s*=\s*[\"']?main\b", attributes) is not None)
        starts = (name == "article" or is_main) and name not in _FURNITURE
        to_readers = of_readers(attributes)
        begins = starts or (kind == SURE and not sure) or (kind == PERHAPS and not perhaps)
        if name not in _INLINE or begins:
            flush()
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1] == name and len(stack) not in (sure, perhaps):
            stack.pop()  # the end tag may be left out
        stack.append(name)
        if starts:
            if sure and open_ended and inside < 0:
                sure = 0
            doubt = OF_READERS if sure and readers else ENCLOSED if sure else NAMED if to_readers or after_readers else 0
            around.append((len(stack), sure, perhaps, open_ended, readers))
            regions.append(_Region(inside, is_main, doubt))
            inside, sure, perhaps, open_ended, readers = len(regions) - 1, 0, 0, False, False
            continue
        after_readers |= to_readers
        if kind == SURE and not sure:
            sure, open_ended, readers = len(stack), i not in closed, to_readers
        elif kind == PERHAPS and not perhaps:
            perhaps = len(stack)
    if at < len(page):
        held.append(page[at:])
    flush()
    chosen = main_region(regions, sum(t.count(" ") + 1 for t, region, kind in found if region < 0 and kind == NO))
    return [(t, region in chosen, kind if region < 0 or region in chosen else SURE) for t, region, kind in found]


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions of the suffixes of tokens in lexicographic order - of their first depth tokens at least - by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, k = new, 2 * k
        if n == 0 or rank[order[-1]] == n - 1 or k >= min(n, depth or n):
            return order


def window_classes(tokens: np.ndarray, page: np.ndarray, least: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """(position, class) of every window of `least` tokens inside a page; equal windows have one class.

    tokens are numbers, at least 0; page numbers ascend and say whose each token is.
    """
    n = len(tokens)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a token of its own after each page keeps windows inside pages
    last = np.flatnonzero(np.append(page[1:] != page[:-1], True))
    shift = np.searchsorted(last, np.arange(n), side="left")
    stream = np.empty(n + len(last), np.int64)
    stream[np.arange(n) + shift] = tokens
    stream[last + 1 + np.arange(len(last))] = tokens.max() + 1 + np.arange(len(last))
    order = suffix_array(stream, least)
    a, b = order[:-1], order[1:]
    common = (a + least <= len(stream)) & (b + least <= len(stream))
    for t in range(least):
        common[common] = stream[a[common] + t] == stream[b[common] + t]
    group = np.concatenate([[0], np.cumsum(~common)])  # neighbours that share at least `least` tokens
    klass = np.empty(len(stream), np.int64)
    klass[order] = group
    at = np.flatnonzero(page[: n - least + 1] == page[least - 1 :])
    return at, klass[at + shift[at]]


def _covered(starts: np.ndarray, n: int, least: int) -> np.ndarray:
    """Which of n tokens lie in a window that begins at one of starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    return np.cumsum(edge)[:-1] > 0


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, least: int = MIN_RUN) -> np.ndarray:
    """Which tokens lie in a substring of at least `least` tokens that two different pages have, by one array."""
    at, klass = window_classes(tokens, page, least)
    if not len(at):
        return np.zeros(len(tokens), bool)
    low, high = np.full(klass.max() + 1, len(tokens)), np.full(klass.max() + 1, -1)
    np.minimum.at(low, klass, page[at])
    np.maximum.at(high, klass, page[at])
    return _covered(at[(low < high)[klass]], len(tokens), least)


def _windows(streams: list[list[str]]) -> list[np.ndarray]:
    """Hashes of the MIN_RUN-token windows of each stream, by position."""
    long = [i for i, tokens in enumerate(streams) if len(tokens) >= MIN_RUN]
    h, owner, _ = shingle_hashes([streams[i] for i in long], MIN_RUN)
    cuts = np.searchsorted(owner, np.arange(len(long) + 1))
    out = [np.zeros(0, np.uint64)] * len(streams)
    for k, i in enumerate(long):
        out[i] = h[cuts[k] : cuts[k + 1]]
    return out


def _tokens(blocks: list[dict]) -> list[str]:
    """The stream that the array sees: all but the plain blocks of articles."""
    return [w for b in blocks if not b["article"] or b["furniture"] != NO for w in b["text"].split(" ")]


def text_of(blocks: list[dict], windows: np.ndarray, repeated: list[int] | None) -> str:
    """A page's text, given the hashes of its stream's windows and which of them are repeated."""
    marked = any(b["article"] for b in blocks)
    n = sum(b["text"].count(" ") + 1 for b in blocks if not b["article"] or b["furniture"] != NO)
    covered = _covered(np.flatnonzero(np.isin(windows.view(np.int64), np.array(repeated or [], np.int64))), n, MIN_RUN)
    kept: list[str] = []
    begin = 0
    for b in blocks:
        if b["article"] and b["furniture"] == NO:
            kept.append(b["text"])
            continue
        tokens = b["text"].split(" ")
        own = covered[begin : begin + len(tokens)]
        begin += len(tokens)
        if b["furniture"] == SURE or b["article"] != marked:
            continue
        if not marked:
            kept += [w for w, c in zip(tokens, own.tolist(), strict=True) if not c]
        elif 2 * own.sum() < len(tokens):
            kept.append(b["text"])
    return " ".join(kept)


_BLOCKS = "array<struct<text: string, article: boolean, furniture: int>>"


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty html gives an empty text; a null or odd url counts as a host
    of its own name. Rows are judged by row: repeated rows and null keys stay as
    they are (repeats of a page count as two pages). No rows
    give no rows. Other columns of pages are ignored.
    """
    kind = pages.schema[key].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").alias("html"), F.xxhash64(host).alias("host"))
    out_schema = f"page_id {kind}, url string, text string, n_chars long"
    tokens_most = 1 << 19  # of one array
    block = pa.list_(pa.struct([("text", pa.string()), ("article", pa.bool_()), ("furniture", pa.int32())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [blocks_of(page) for page in batch.column("html").to_pylist()]
            asks = [not any(a for _, a, _ in blocks) or any(a and f == PERHAPS for _, a, f in blocks) for blocks in found]
            columns = {c: batch.column(c) for c in ("page_id", "url", "host")}
            blocks = pa.array([[{"text": t, "article": a, "furniture": f} for t, a, f in own] for own in found], block)
            n_tokens = pa.array([sum(t.count(" ") + 1 for t, _, _ in own) for own in found], pa.int64())
            yield pa.RecordBatch.from_pydict(columns | {"asks": pa.array(asks), "blocks": blocks, "n_tokens": n_tokens})

    def parts(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
        """The batches cut to about so many tokens each, one page at least."""
        for batch in batches:
            cut = np.cumsum(batch.column("n_tokens").to_numpy()) // tokens
            starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                if b > a:
                    yield batch.slice(a, b - a)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes of windows, by host, with the least and the greatest page that has them."""
        for part in parts(batches, tokens_most):
            streams = [_tokens(own) for own in part.column("blocks").to_pylist()]
            number: dict[str, int] = {}
            tokens = np.array([number.setdefault(w, len(number)) for own in streams for w in own], np.int64)
            sizes = np.fromiter(map(len, streams), np.int64, len(streams))
            page = np.repeat(np.arange(len(streams)), sizes)
            at, klass = window_classes(tokens, page)
            if not len(at):
                continue
            # window hashes stand in the order of at: pages with at least MIN_RUN tokens, by position
            hashes = np.concatenate(_windows(streams)).view(np.int64)
            rows, hosts = part.column("row").to_numpy()[page[at]], part.column("host").to_numpy()[page[at]]
            order = np.lexsort((rows, klass, hosts))
            first = np.flatnonzero(np.append(True, (hosts[order][1:] != hosts[order][:-1]) | (klass[order][1:] != klass[order][:-1])))
            last = np.append(first[1:], len(order)) - 1
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts[order[first]]), "hash": pa.array(hashes[order[first]]), "low": pa.array(rows[order[first]]), "high": pa.array(rows[order[last]])})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct windows of each page."""
        for part in parts(batches, tokens_most >> 3):
            found = [np.unique(w) for w in _windows([_tokens(own) for own in part.column("blocks").to_pylist()])]
            of = pa.array(np.repeat(np.arange(len(found)), [len(w) for w in found]))
            hashes = pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_pydict({"host": part.column("host").take(of), "row": part.column("row").take(of), "hash": hashes})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, tokens_most >> 3):
            blocks, repeated = part.column("blocks").to_pylist(), part.column("repeated").to_pylist()
            texts = [text_of(*x) for x in zip(blocks, _windows([_tokens(own) for own in blocks]), repeated, strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    parsed = rows.mapInArrow(parse, f"page_id {kind}, url string, host long, asks boolean, blocks {_BLOCKS}, n_tokens long")
    held = stored(parsed.withColumn("row", F.monotonically_increasing_id()), "blocks")
    found = held.select("host", "row", "blocks", "n_tokens").mapInArrow(classes, "host long, hash long, low long, high long")
    often = found.groupBy("host", "hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("host", "hash")
    asking = held.where("asks")
    own = asking.select("host", "row", "blocks", "n_tokens").mapInArrow(windows, "host long, row long, hash long").join(often, ["host", "hash"]).groupBy("row").agg(F.collect_list("hash").alias("repeated"))
    answered = asking.join(own, "row", "left").select("page_id", "url", "blocks", "n_tokens", "repeated").mapInArrow(decide, out_schema)
    plain = F.array_join(F.transform(F.filter("blocks", lambda b: b["article"] & (b["furniture"] == NO)), lambda b: b["text"]), " ")
    marked = held.where("not asks").select("page_id", "url", plain.alias("text"))
    return marked.withColumn("n_chars", F.length("text").cast("long")).unionByName(answered)

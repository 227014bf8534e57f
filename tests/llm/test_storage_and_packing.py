"""Tokens, packing, WARC and id archives: exact round trips and plain Python."""

import gzip
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from ledgerwright.llm.common import shared_dir
from ledgerwright.llm.packing import best_configurations, pack_documents, packed_sequences, plan_ranges
from ledgerwright.llm.token_archive import BLOCK, block_sizes, decode_blocks, encode_blocks, file_bytes, id_round_trip, learn, parse_file
from ledgerwright.llm.tokens import WordTokenizer, default_tokenizer
from ledgerwright.llm.warc import WarcError, archive_round_trip, page_record, record_bytes, records

SCHEMA = "doc_id long, text string"
ODD = [
    "", None, " ", "It's ΑΣ ΑΣ. x", "<|endoftext|> hello<|startoftext|>", "é ́a İstanbul ǅ K", "don't WE'LL I'd 've ''s", "a b c\x1cd\x85e​f", "日本語 テスト 123 45.6",
    "\x00\x01 a\x00b", "ﬁn ½ ²", "a᠎b ﻿c", "🙂🙂 x_y __ --", "J̌ĮĴj⁚ Ṩ̌", "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return WordTokenizer(default_tokenizer())


def ids_of(library, text):
    return library.library.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts(library):
    rng = np.random.default_rng(1)
    letters = [chr(c) for c in [*range(32, 400), *range(0x300, 0x340), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x0D, 0x0A, 0x09, 0x0B, 0x0C, 0x1C, 0x1F, 0x85]] + [" "] * 80
    texts = ODD + ["".join(rng.choice(letters, 150)) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in library.encode(texts)] == [ids_of(library, t) for t in texts]


@pytest.mark.parametrize("counts", [{}, {4096: 3}, {1: 10}, {2049: 7, 2047: 3}, {700: 1, 699: 100, 5: 3}, dict(Counter(np.minimum(4096, np.random.default_rng(0).lognormal(6.5, 1, 4000).astype(int) + 1).tolist()))])
def test_plans_place_every_piece_once_without_gaps(counts):
    rows, n = plan_ranges(counts, 4096)
    placed, fill = Counter(), {}
    for length, a, b, first, offset in rows:
        placed[length] += b - a
        for k in range(b - a):
            fill.setdefault(first + k, []).append((offset, length))
    assert dict(placed) == counts
    assert sorted(fill) == list(range(n))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    if len(counts) > 100:  # enough lengths to fill sequences up
        assert n <= -(-sum(x * c for x, c in counts.items()) // 4096) + 1


def test_configurations_cover_the_counts():
    sizes, counts = [2000, 1300, 700], [100, 300, 500]
    found = best_configurations(sizes, counts, 4096)
    for i, need in enumerate(counts):
        assert sum(c[i] * amount for c, amount in found) >= need - 1e-6
    assert all(sum(s * k for s, k in zip(sizes, c, strict=True)) <= 4096 for c, _ in found)


def test_packed_pieces_are_the_documents(spark, library):
    rows = [*enumerate(ODD), (3, "again"), (3, "again"), (None, "no key"), (77, "x y z " * 4000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "5 as length", "'a' as piece")
    packed = pack_documents(df, capacity=256, with_ids=True)
    got = sorted((tuple(r) for r in packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr)
    want = []
    for i, t in rows:
        ids = [*ids_of(library, t), 1]
        for k in range(0, len(ids), 256):
            part = np.array(ids[k : k + 256], "<u4").tobytes()
            want.append((i, k // 256, k, len(part) // 4, zlib.crc32(part)))
    assert got == sorted(want, key=repr)
    sequences = packed_sequences(packed).collect()
    assert sum(len(r["ids"]) for r in sequences) == 4 * sum(r[3] for r in want) and max(len(r["ids"]) for r in sequences) <= 4 * 256
    layout = {(r["sequence_id"], r["offset"]) for r in packed.collect()}
    assert len(layout) == len(want)


def test_packing_no_rows(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert id_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 5])
@pytest.mark.parametrize("kind", ["same", "random", "skewed", "wide", "cycle"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"same": np.full(n, 7), "random": rng.integers(0, 65536, n), "skewed": rng.zipf(1.3, n) % 49408, "wide": rng.integers(0, 1 << 32, n), "cycle": np.arange(n) % 97}[kind].astype(np.int64)
    sizes = np.array([n // 3, 0, n - n // 3])
    known, symbols, label = learn(ids, sizes)
    assert known.ids[symbols].tolist() == ids.tolist()
    classes = np.repeat(label, sizes)
    blocks = encode_blocks(symbols, classes, known)
    assert len(blocks) == len(block_sizes(n)) and block_sizes(n).sum() == n and (block_sizes(n) <= BLOCK).all()
    assert decode_blocks(blocks, classes, known).tolist() == symbols.tolist()
    if kind in ("same", "cycle") and n >= BLOCK:
        assert sum(map(len, blocks)) < n / 4


def test_blocks_are_independent():
    """A block decodes alike whatever stands in the others."""
    rng = np.random.default_rng(4)
    a, b = rng.zipf(1.5, BLOCK) % 500, rng.zipf(1.2, BLOCK) % 500
    ids = np.concatenate([a, b])
    known, symbols, _ = learn(ids, np.array([len(ids)]))
    classes = np.zeros(len(ids), np.int64)
    both = encode_blocks(symbols, classes, known)
    swapped = encode_blocks(np.concatenate([symbols[BLOCK:], symbols[:BLOCK]]), classes, known)
    assert both == swapped[::-1]
    assert decode_blocks(both[1:], classes[:BLOCK], known).tolist() == symbols[BLOCK:].tolist()


def test_files_side_by_side_are_as_alone():
    """Blocks of several files coded in one pass, of other lengths and bits, give each file's own bytes."""
    from ledgerwright.llm.token_archive import archives, parse_files

    rng = np.random.default_rng(6)
    files = []
    for n, kinds in ((3 * BLOCK + 9, 300), (0, 1), (40_000, 30_000), (700, 90), (BLOCK, 2)):
        ids = (rng.zipf(1.2, n) % kinds).astype("<u4")
        files.append(([5, None, 7], [n // 2, 0, n - n // 2], ids))
    alone = [file_bytes(*f) for f in files]
    assert archives(files) == alone
    for (keys, sizes, ids), (k, s, x) in zip(files, parse_files(alone), strict=True):
        assert (keys, sizes, ids.tolist()) == (k, s.tolist(), x.tolist())


def test_mixing_beats_deflate_and_order_0(library):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    parts = [np.frombuffer(x + b"\x02\0\0\0", "<u4") for x in library.encode(texts)]
    ids, sizes = np.concatenate(parts).astype(np.int64), [len(x) for x in parts]
    data = file_bytes(list(range(len(parts))), sizes, ids)
    assert parse_file(data)[2].tolist() == ids.tolist()
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() / 8
    assert len(data) < 0.9 * entropy * len(ids)
    assert len(data) < 0.8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_words_are_symbols_of_an_archive(library):
    """Words that a file has several times are coded as one symbol each, and every id comes back."""
    from ledgerwright.llm.token_archive import parse_files, run_archives, symbols_in, words_ended

    words = WordTokenizer(default_tokenizer())
    parts = [["thonering anblewh, sttible anblewh. " * 400, None, *ODD], ["thonering onceonly anblewh", "", "thonering!"]]
    runs = words_ended(words, [words.numbered(p) for p in parts], 2)
    (data,) = run_archives([(list(range(len(ODD) + 5)), runs)])
    ((keys, sizes, ids),) = parse_files([data])
    want = [[*ids_of(library, t), 2] for p in parts for t in p]
    assert keys == list(range(len(want))) and sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x] and runs.n_ids == len(ids)
    assert symbols_in(data) == len(runs.symbols) < 0.75 * len(ids)


def test_words_are_the_same_before_and_after_the_memo_is_thinned(library, monkeypatch):
    monkeypatch.setattr("ledgerwright.llm.tokens.MEMO_WORDS", 60)
    words = WordTokenizer(default_tokenizer())
    rng = np.random.default_rng(8)
    for k in range(12):
        texts = [" ".join(f"{a}z{b}" + ("", ",", "...", "'s")[b % 4] for a, b in rng.integers(k, k + 9, (30, 2))), "É, «à», x.y, A. B", None]
        assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [ids_of(library, t) for t in texts]
        assert len(words.memo) < 400


def test_archive_checksums():
    ids = np.arange(3000) % 50
    data = file_bytes([None, 5], [1000, 2000], ids)
    keys, sizes, back = parse_file(data)
    assert keys == [None, 5] and sizes.tolist() == [1000, 2000] and back.tolist() == ids.tolist()
    for at in (30, len(data) // 2, len(data) - 20):
        with pytest.raises(Exception):
            parse_file(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])


def test_id_round_trip(spark, library):
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD)] + [(None, "no key"), (5, "b"), (5, "a")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as start", "2 as key").repartition(5)
    got = [tuple(r) for r in id_round_trip(df).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = np.array([*ids_of(library, t), 2], "<u4")
        want.append((i, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    assert got == want


def test_warc_round_trip(spark):
    long = "<p>é same page</p>" * 20
    rows = [(5, "http://a/", long), (2, "http://b/\r\nX: y", long), (9, None, long), (2, "u", long), (3, "u", None), (4, "u", None), (6, "u", "short"), (7, "u", "short"), (None, "u", long), (8, "u", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as digest", "3 as id")
    got = archive_round_trip(df).collect()
    assert len(got) == len(rows)
    seen = Counter()
    for r in got:
        seen[(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"])] += 1
        if r["record_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    want = Counter()
    for i, _, t in rows:
        raw = (t or "").encode()
        again = t == long and i is not None and i > 2
        want[(i, "revisit" if again else "response", 2 if again else None, len(raw), hashlib.sha256(raw).hexdigest())] += 1
    assert seen == want
    assert archive_round_trip(df.limit(0)).count() == 0


def test_broken_archives_are_refused():
    one = page_record(0, 1, "http://a/", b"payload" * 50, None, "2024-01-01T00:00:00Z")
    two = page_record(1, 2, "http://b/", b"other" * 50, None, "2024-01-01T00:00:00Z")
    for step in (1, 7, 1 << 16):
        found = list(records(one + two, step))
        assert [f["x-page-id"] for f, _ in found] == ["1", "2"] and found[1][1].endswith(b"other" * 50)
    raw = [zlib.decompress(x, 31) for x in (one, two)]
    together = list(records(gzip.compress(raw[0] + raw[1])))  # a member may hold two records
    assert [f["x-page-id"] for f, _ in together] == ["1", "2"]
    for broken in (
        (one + two)[:-3], gzip.compress(raw[0].replace(b"payloadpayload", b"payloadPayload")), gzip.compress(raw[0][:-5] + raw[0][-4:]), gzip.compress(raw[0][:-4]) + two,
        gzip.compress(raw[0] + b"x"), one[:40] + b"\0\0" + one[42:], gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    ):
        with pytest.raises(WarcError):
            list(records(broken))
    assert list(records(b"")) == []
    large = record_bytes("response", {}, b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 3_000_000)
    assert [len(b) for _, b in records(large)] == [3_000_019]


class _Session:
    """As much of a session as shared_dir reads."""

    def __init__(self, root):
        self.conf = {"spark.checkpoint.dir": root} if root else {}


def test_shared_dir_is_the_configured_one():
    assert shared_dir(_Session("hdfs://x/checkpoints/"), "a").startswith("hdfs://x/checkpoints/a-")
    one, two = shared_dir(_Session(None), "a"), shared_dir(_Session(None), "a")
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0] and one.startswith("file:///")

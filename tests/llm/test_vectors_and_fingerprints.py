"""Vector codes, whitening and fingerprints against plain versions of their definitions."""

import hashlib
import math
from collections import Counter
from itertools import islice

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerwright.llm import heap_lloyd as hl
from ledgerwright.llm import spotsigs as ss
from ledgerwright.llm.whitening import deviations, whiten
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, x string"


def vector_rows(n, dims=32, seed=1, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.5, (centres, dims))
    rows = [(i, [float(np.float32(v)) for v in middle[rng.integers(centres)] + rng.normal(0, 0.1, dims)], int(rng.integers(5)) if i % 7 else None, "x") for i in range(n)]
    return rows + [(n + i, rows[3][1], 9, "copy") for i in range(n // 3)]  # a hot vector


def plain_codes(rows, parts, entries, rounds, scale=256):
    """Every part against every entry, in Python's whole numbers."""
    kept = sorted(((i, [math.floor(scale * v) for v in x], label) for i, x, label in rows), key=lambda r: r[0])
    width = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    apart = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]
    for r in range(rounds + 1):
        codes = [[min(range(len(b)), key=lambda e: (apart(cut(x, p), b[e]), e)) for p, b in enumerate(books)] for _, x, _ in kept]
        if r < rounds:
            for p, b in enumerate(books):
                for e in range(len(b)):
                    own = [cut(x, p) for (_, x, _), c in zip(kept, codes) if c[p] == e]
                    if own:
                        b[e] = [sum(v) // len(own) for v in zip(*own)]
    errors = [sum(apart(cut(x, p), books[p][c]) for p, c in enumerate(code)) for (_, x, _), code in zip(kept, codes)]
    by_label = Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c in code), error, by_label[label], digest) for (i, _, label), code, error in zip(kept, codes, errors))


@pytest.mark.parametrize("n, entries, rounds, block", [(300, 64, 2, 1 << 20), (300, 64, 2, 2000), (40, 64, 2, 1 << 20), (200, 7, 5, 4000), (60, 1, 2, 4000), (60, 16, 0, 1 << 20)])
def test_codes_equal_full_comparison(spark, monkeypatch, n, entries, rounds, block):
    monkeypatch.setattr(hl, "BLOCK_BYTES", block)
    rows = vector_rows(n, seed=n + entries)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in hl.compress_vectors(df, entries=entries, rounds=rounds).collect())
    assert got == plain_codes([r[:3] for r in rows], 16, entries, rounds)


def test_codes_of_odd_tables(spark):
    good = vector_rows(20)[:20]
    odd = [(100, None, 1, ""), (101, [], 1, ""), (102, [None] * 32, 1, ""), (103, [float("nan")] * 32, 1, ""), (104, [float("inf"), *[0.0] * 31], 1, ""), (105, [0.0] * 16, 1, "")]
    again = [(None, good[0][1], None, "null key"), (5, good[5][1], 2, "same key")]
    df = spark.createDataFrame(good + odd + again, VECTORS).withColumnRenamed("x", "code")  # a clashing name
    got = hl.compress_vectors(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted([(False, r[0]) for r in good] + [(True, 0), (False, 5)])
    assert len({r["code"] for r in got if r["vec_id"] == 5}) == 1
    assert hl.compress_vectors(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        hl.compress_vectors(spark.createDataFrame([(1, [1.0] * 10, 1, "")], VECTORS))
    with pytest.raises(ValueError):
        hl.compress_vectors(spark.createDataFrame([(1, [1e30] * 16, 1, "")], VECTORS))


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), max_size=60), st.lists(st.integers(-60, 60), min_size=4, max_size=4))
def test_heaps_give_up_what_is_at_most_the_limit(items, limits):
    group, keys = np.array([g for g, _ in items], np.int64), np.array([float(k) for _, k in items])
    order, starts = hl.heaps_of(group, keys, 4)
    got = hl.popped(order, starts, keys, np.array(limits, float))
    assert sorted(got.tolist()) == [i for i, (g, k) in enumerate(items) if k <= limits[g]]


def test_only_violated_parts_are_compared_again():
    rng = np.random.default_rng(5)
    x = (np.repeat(np.eye(8, dtype=np.int64) * 1000, 50, axis=0) + rng.integers(-20, 20, (400, 8)))
    books = hl.Codebooks(np.stack([x[::50]]), np.zeros((1, 8)))
    block = hl.Block(x, books)
    total = block.first(books)
    books = books.moved((total[:, 1:] // total[:, :1])[None])
    seen = []
    scan = block.scan
    block.scan = lambda which, b: (seen.append(len(which)), scan(which, b))
    assert not block.again(books).any() and seen == [0]  # far clusters: no bound is violated
    books = books.moved(books.entries[:, ::-1].copy())
    block.again(books)
    assert seen[1] == 400 and (block.codes == 7 - np.repeat(np.arange(8), 50)).all()


def test_large_components_use_whole_numbers():
    parts = np.array([[hl.LARGEST - 1, -hl.LARGEST + 1]] * 2, np.int64)
    entries = np.array([[hl.LARGEST - 2, -hl.LARGEST + 1], [hl.LARGEST - 1, -hl.LARGEST + 1]], np.int64)
    assert hl.nearest(parts, entries)[0].tolist() == [1, 1]


def test_whitening_against_a_dense_decomposition(spark):
    rng = np.random.default_rng(2)
    values = (rng.normal(0, 1, (500, 40)) @ np.diag(np.linspace(3, 0.5, 40)) + rng.normal(0, 5, 40)).astype(np.float32)
    rows = [(i, [float(v) for v in x], 1, "") for i, x in enumerate(values)]
    got = whiten(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    x = np.floor(64 * values.astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:32], v[:, ::-1][:, :32]
    want = centred @ v / np.sqrt(e)
    assert len(got) == 500 * 32
    table = np.zeros((500, 32))
    for r in got:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(centred.T @ centred / n), rel=1e-9)
        assert int(r["deviation"]) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], sums))
    table *= np.sign((table * want).sum(axis=0))
    assert np.allclose(table, want, atol=1e-7)
    assert 0 <= got[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in got}) == 1


def test_deviations_beyond_64_bits():
    x, n = np.array([[3 << 40, 1], [1, 5]], np.int64), 1 << 30
    sums = [7 << 60, 11]
    assert deviations(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


def test_whitening_of_odd_tables(spark):
    flat = [(i, [float(i), 2.0 * i, 1.0], 1, "") for i in range(10)]  # one direction, a constant, a repeat
    odd = [(50, None, 1, ""), (51, [1.0, None, 1.0], 1, ""), (52, [1.0, float("nan"), 1.0], 1, ""), (53, [], 1, ""), (54, [1.0], 1, ""), (None, [3.0, 6.0, 1.0], None, ""), (3, [3.0, 6.0, 1.0], None, "")]
    df = spark.createDataFrame(flat + odd, VECTORS).withColumnRenamed("x", "component")
    got = whiten(df).collect()
    assert len(got) == 12 and {r["component"] for r in got} == {1} and {r["n"] for r in got} == {12}
    assert np.var([r["whitened"] for r in got]) == pytest.approx(1) and got[0]["explained"] == pytest.approx(1)
    for empty in (df.limit(0), df.where("vec_id = 4"), df.where("vec_id = 3")):
        assert whiten(empty).collect() == []


def plain_signatures(text):
    words, run = [], ""
    for ch in (text or "") + " ":
        low = ch.lower() if "A" <= ch <= "Z" else ch
        if ord(ch) > 127 or (low.isascii() and low.isalnum()):
            run += low
        elif run:
            words.append(run)
            run = ""
    bare = not any(w in ss.ANCHORS for w in words)
    number = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
    out, common = [], {*ss.ANCHORS, *ss.COMMON}
    for i in range(-1, len(words)):
        if i < 0 and words or i >= 0 and (bare or words[i] in ss.ANCHORS):
            chain = list(islice((number(w) for w in words[i + 1 :] if bare or w not in common), 2))
            out.append((sum(a * b for a, b in zip([number(words[i]) if i >= 0 else 1, *chain], (1, 402653189, 201326611)))) % 4294967291)
    return Counter(out)


def plain_likeness(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


WORDS = st.lists(st.sampled_from("the a of and Is WAS der die río café x1 stone water bright light. run, (home) l'été — 　 \n".split(" ")), max_size=40).map(" ".join)


@settings(max_examples=60)
@given(st.lists(WORDS, max_size=6))
def test_signatures(texts):
    signer = ss.Signer()
    for text, found in zip(texts, signer.signatures(texts), strict=True):
        assert found.tolist() == sorted(plain_signatures(text).elements())


@settings(max_examples=60)
@given(st.lists(st.tuples(st.lists(st.integers(0, 12), max_size=30), st.lists(st.integers(0, 12), max_size=30)), max_size=8), st.sampled_from([0.0, 0.3, 0.8]))
def test_pruned_likeness(pairs, least):
    spread = lambda v: np.sort(np.array(v, np.int64) * 357_000_000 % (1 << 32))
    got = ss.likeness([spread(a) for a, _ in pairs], [spread(b) for _, b in pairs], least)
    for (a, b), found in zip(pairs, got.tolist(), strict=True):
        want = plain_likeness(Counter(spread(a).tolist()), Counter(spread(b).tolist()))
        assert found == (pytest.approx(want) if want >= least else 0.0)


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_edits_and_next_documents(spark, n):
    rng = np.random.default_rng(n)
    vocabulary = "the a is of and stone water light home river tree bright cold über naïve 東京 one two three four five six".split()
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(n)]
    if n > 10:
        texts[7], texts[8], texts[9], texts[10] = None, "", "the the the", "word"
        texts[21] = texts[20]
        texts[30] = texts[30] + " " + " ".join(rng.choice(vocabulary, 30_000))
    ids = [int(v) for v in rng.permutation(10 * n)[:n]]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(sorted(ids), texts)], "doc_id long, text string, n_chars string").repartition(3)
    got = {r["doc_id"]: r for r in ss.fingerprint_edits(df).collect()}
    assert len(got) == n
    rows = list(zip(sorted(ids), texts))
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % n][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        own, other, after = plain_signatures(t), plain_signatures(changed), plain_signatures(following)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{v:08x}" for v in sorted(x.elements())) for x in (own, other))
        assert (r["near_edited"], r["near_next"], r["n_signatures"]) == (pytest.approx(plain_likeness(own, other)), pytest.approx(plain_likeness(own, after)), sum(own.values()))


def test_fingerprints_of_null_and_repeated_keys(spark):
    rows = [(None, "the last one"), (4, "the b text"), (4, "the a text"), (4, "the b text"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ss.fingerprint_edits(df)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, 2), (False, 4), (False, 4), (False, 4), (True, 0)]
    near = {(r["doc_id"], r["near_next"]) for r in got.where("n_chars = 10 and near_next = 1").collect()}
    assert near == {(4, 1.0)}  # the two equal texts follow each other
    plain = {r["doc_id"]: r["fingerprint"] for r in ss.fingerprints(df.where("doc_id is null or doc_id = 2")).collect()}
    assert plain[2] == "" and plain[None] == got.where("doc_id is null").first()["fingerprint"]


def test_every_document_keeps_its_place_over_many_ranges(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word"), F.col("id") % 7, F.lit(" text"), F.col("id")).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        many = sorted(map(tuple, ss.fingerprint_edits(df.repartition(3)).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert many == sorted(map(tuple, ss.fingerprint_edits(df).collect())) and len(many) == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

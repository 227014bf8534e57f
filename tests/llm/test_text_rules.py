"""Repetition rules, SimHash groups and line dedup against plain Python."""

import functools
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from ledgerwright.llm.components import connected_components
from ledgerwright.llm.lines import MinimalPerfectHash, drop_repeated_lines
from ledgerwright.llm.repetition import LENGTHS, Rules, with_repetition
from ledgerwright.llm.simhash import fingerprints_of, forest_links, simhash_components, small_links
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"
ODD = [None, "", " \n\t ", "one", "two words", "ÉCOLE été x", "a b a b a b a b", "same line here\nsame line here\nother", "x" * 5000, "the # $ <b> \n\n x"]


def texts(n=60, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(150)]
    out = list(ODD)
    for i in range(n):
        words = rng.choice(vocabulary, int(rng.integers(1, 300))).tolist()
        if i % 5 == 0:
            words += words[: len(words) // 2] * int(rng.integers(1, 4))
        out.append("".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(words)))
        if i % 4 == 0:
            out.append(out[-1].replace(words[0], "changed", 1))
        if i % 6 == 0:
            out.append(out[-1])
    return out


def brute_repetition(text, rules):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count, dup_chars, seen = 0, 0, set()
    for x in lines:
        if x in seen:
            count += 1
            dup_chars += sum(map(len, WORD.findall(x)))
        seen.add(x)
    covered = {}
    for n in (3, *LENGTHS):
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times = Counter(windows)
        covered[n] = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(n)}
    failed = len(words) < rules.min_words or 100 * len(covered[3]) > rules.max_repeat_word_pct * len(words)
    of = {n: sum(len(words[i]) for i in covered[n]) for n in LENGTHS}
    most = dict(zip(LENGTHS, (rules.max_dup_5_pct, rules.max_dup_7_pct, rules.max_dup_10_pct), strict=True))
    kept = not failed and 100 * dup_chars <= rules.max_dup_line_pct * chars and all(100 * of[n] <= most[n] * chars for n in LENGTHS)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), count, len(covered[3]), failed, kept, dup_chars, *of.values())


@pytest.mark.parametrize("rules", [Rules(), Rules(min_words=5, max_dup_line_pct=5, max_dup_5_pct=10, max_dup_7_pct=10, max_dup_10_pct=5)])
def test_repetition_matches_brute_force(spark, rules):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as kept", "'x' as source")
    got = {r["doc_id"]: tuple(r)[2:] for r in with_repetition(df, rules=rules).select("doc_id", "source", *(
        "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept dup_line_chars dup_5_chars dup_7_chars dup_10_chars".split())).collect()}
    assert got == {i: brute_repetition(t, rules) for i, t in rows}


def test_texts_that_pass_the_base_rule_fail_each_limit(spark):
    """Only the limit named is exceeded; words are eight characters, so shares of words are shares of characters."""

    def text(n, times, count, line=False):
        """100 words, of which count runs of n words occur `times` times each."""
        runs = [" ".join(f"run{r}x{k:03d}".ljust(8, "z") for k in range(n)) for r in range(count)]
        own = iter(f"word{i:04d}" for i in range(100 - n * times * count))
        parts = [x for _ in range(times) for run in runs for x in (run, next(own))]
        return ("\n" if line else " ").join([*parts, " ".join(own)])

    rows = [(0, text(5, 2, 3)), (1, text(6, 2, 3)), (2, text(7, 2, 2)), (3, text(10, 2, 1)), (4, text(4, 7, 1, True)), (5, text(6, 2, 2))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in with_repetition(df).collect()}
    rules = Rules()
    limits = {"dup_5_chars": rules.max_dup_5_pct, "dup_7_chars": rules.max_dup_7_pct, "dup_10_chars": rules.max_dup_10_pct, "dup_line_chars": rules.max_dup_line_pct}
    over = {i: {c for c, most in limits.items() if 100 * r[c] > most * r["word_chars"]} for i, r in got.items()}
    assert over == {0: set(), 1: {"dup_5_chars"}, 2: {"dup_7_chars"}, 3: {"dup_10_chars"}, 4: {"dup_line_chars"}, 5: set()}
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if r["kept"]} == {0, 5}


def test_repetition_of_no_rows_and_repeated_rows(spark):
    assert with_repetition(spark.createDataFrame([], SCHEMA)).count() == 0
    assert with_repetition(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], SCHEMA)).count() == 3


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints(spark):
    t = texts()
    assert [int(x) for x in fingerprints_of(t)] == [brute_fingerprint(x) for x in t]
    hashed = spark.sql("select xxhash64('a b c') as h").first()["h"]
    assert hashed % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.fixture(scope="module")
def clouds():
    """Fingerprints around common centres, as distinct long values."""
    rng, out = np.random.default_rng(5), set()
    for _ in range(60):
        centre = int(rng.integers(0, 2**63)) * 2
        for _ in range(int(rng.integers(1, 12))):
            out.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)))
    return np.array(sorted(out, key=lambda x: x * 7919 % 1009), np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_links(clouds, radius):
    n = len(clouds)
    links = [(i, j) for i in range(n) for j in range(i) if (int(clouds[i]) ^ int(clouds[j])).bit_count() <= radius]
    assert components_of(n, forest_links(clouds, clouds, radius)) == components_of(n, links)
    assert components_of(n, small_links(clouds, np.zeros(n, int), radius)) == components_of(n, links)
    half = n // 2
    cross = [(i, j) for i, j in links if (i < half) != (j < half)]
    assert components_of(n, forest_links(clouds[:half].copy(), clouds[half:].copy(), radius)) == components_of(n, cross)


def test_near_links_over_small_tiles(spark, clouds):
    from ledgerwright.llm.simhash import near_links

    values = clouds.view(np.int64).tolist()
    n = len(values)
    links = [(i, j) for i in range(n) for j in range(i) if (int(clouds[i]) ^ int(clouds[j])).bit_count() <= 3]
    place = {v: i for i, v in enumerate(values)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for tile, small in ((4096, 48), (3, 2)):
        got = [(place[r["u"]], place[r["v"]]) for r in near_links(df, 3, tile, small).collect()]
        assert components_of(n, got) == components_of(n, links)


def test_simhash_components_match_brute_force(spark):
    t = texts()
    rows = [(i * 3, x) for i, x in enumerate(t)]
    fp = [brute_fingerprint(x) for x in t]
    links = [(i, j) for i in range(len(t)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    want = {(rows[i][0], rows[c][0]) for i, c in enumerate(components_of(len(t), links))}
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as fp", "2 as component_id", "3 as u")
    assert {(r["doc_id"], r["component_id"]) for r in simhash_components(df).collect()} == want


def test_simhash_edges(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    got = simhash_components(spark.createDataFrame([(7, None), (7, None), (None, ""), (9, "a b c d")], SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 7), (7, 7), (7, 7), (9, 9)]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(5, i) for i in range(1000, 1200)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 401)}, **{i: 5 for i in [5, *range(1000, 1200)]}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20000).astype(np.uint64))
    mph = MinimalPerfectHash.build(keys)
    again = MinimalPerfectHash.from_bytes(*mph.to_bytes())
    assert sorted(again.lookup(keys).tolist()) == list(range(len(keys)))
    few = MinimalPerfectHash.build(keys[:500], most=2)
    assert sorted(few.lookup(keys[:500]).tolist()) == list(range(500))
    assert len(MinimalPerfectHash.build(keys[:0]).lookup(keys[:5])) == 5


def brute_lines(rows):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, set()).add(i if i is not None else -(2**63))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        me = i if i is not None else -(2**63)
        kept = [x for x in lines if not (len(k := key(x)) >= 20 and len(held[k]) >= 3 and me != max(held[k]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy, most, merge", [(2000, 10**6, 256), (10**9, 10**6, 256), (2000, 3, 256), (2000, 10**6, 1)])
def test_line_dedup_matches_brute_force(spark, heavy, most, merge, monkeypatch):
    """Whether lines are heavy, how many may be, and whether batches are merged first changes no result."""
    from ledgerwright.llm import lines

    monkeypatch.setattr(lines, "HEAVY", heavy)
    monkeypatch.setattr(lines, "MAX_HEAVY", most)
    if merge == 1:
        monkeypatch.setattr(lines, "shards_for", lambda docs, text: 3)
        monkeypatch.setattr(lines, "line_index", functools.partial(lines.line_index, merge_shards=1))
    rng = np.random.default_rng(2)
    pool = [f"A shared Line number {i} of text" for i in range(12)] + ["éééééééééééééééééééé", "short", "é" * 19]
    rows = [(None, "x"), (3, None), (4, ""), (5, "\n\n"), (None, "  a shared line number 1 OF text\nb")]
    for i in range(10, 300):
        picks = rng.choice(pool, int(rng.integers(0, 6))).tolist()
        rows.append((i, "\n".join(f"  {x.upper()}\t" if rng.random() < 0.3 else x for x in [*picks, f"own line of the document {i}", *picks[:1]])))
    rows += [rows[20], rows[20]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as h", "'z' as n_lines", "0 as shard")
    got = drop_repeated_lines(df)
    assert "h" in got.columns and dict(got.dtypes)["n_lines"] == "bigint"
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr) == brute_lines(rows)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_line_dedup_of_no_rows(spark):
    assert drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("min_docs", [255, 256, 300, 400, 401])
def test_lines_are_counted_beyond_a_byte(spark, min_docs):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one line that all documents have").alias("text")).repartition(7)
    got = drop_repeated_lines(df, min_docs=min_docs)
    assert got.agg(F.sum("n_dropped")).first()[0] == (399 if min_docs <= 400 else 0)


def test_keys_that_are_no_numbers_are_refused_before_the_job(spark):
    with pytest.raises(TypeError):
        drop_repeated_lines(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_columns_that_clash_in_another_case_give_way(spark):
    df = spark.createDataFrame([(1, "word " * 60, 5, 6)], "doc_id long, text string, N_WORDS int, N_Lines int")
    assert with_repetition(df).select("n_words").first()[0] == 60
    assert drop_repeated_lines(df).select("n_lines").first()[0] == 1

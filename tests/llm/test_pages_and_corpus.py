"""Main texts, licences, decontamination, languages, similarity groups and the pipeline."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from ledgerwright.llm import ppm, similar
from ledgerwright.llm.decontaminate import contained_items, drop_contaminated, sketch_size, words_of
from ledgerwright.llm.licenses import KNOWN, known_digests, license_scan
from ledgerwright.llm.pages import NO, PERHAPS, SURE, blocks_of, furniture_of, main_text, repeated_tokens, suffix_array
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


def test_blocks():
    page = (
        "<!DOCTYPE html><head><title>t</title><style>p{}</style></head><nav><a href='/x>y'>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one<b>two</b>\n\t three<br>four"
        "<script>if (a<b) '</p>'</script><aside>side</aside><form>f<input></form><div class=\"comments\"><p>nice</p></div><p>&eacute;&#233;&lt;x&gt; &am</article><footer>&copy; foot"
    )
    found = blocks_of(page)
    assert [t for t, inside, dropped in found if inside and not dropped] == ["A & B", "onetwo three", "four", "éé<x> &am"]
    assert not any(not inside and not dropped for _, inside, dropped in found)
    assert blocks_of(None) == blocks_of("") == []
    assert [t for t, inside, dropped in blocks_of("<nav>menu<article><p>a<p>b</article>") if inside and not dropped] == ["a", "b"]
    assert [t for t, _, dropped in blocks_of("plain < text") if not dropped] == ["plain < text"]


def article_of(page):
    return " ".join(t for t, inside, furniture in blocks_of(page) if inside and furniture == NO)


def test_articles_inside_furniture_are_furniture():
    assert article_of('<article><p>story</p></article><section class="comments"><article>reader says hi</article></section>') == "story"
    assert article_of('<aside><article class="teaser">read this</article></aside><main><p>story</p></main>') == "story"
    assert article_of('<article><p>story</p><article class="comment"><p>hi</p></article><p>more</p></article>') == "story more"
    assert article_of('<div role="search"><article>x</article></div><div role="main"><p>story</p></div>') == "story"
    assert article_of("<nav>menu <ul><li>one<article><p>story</article>") == "story"  # the nav has no end tag


def test_names_are_whole_words_of_class_id_and_role():
    assert article_of('<article><h1 class="entry-title">A</h1><p data-id="search-index">b</p><p title="class=ad">c</p><p class="ad">d</p></article>') == "A b c"
    kinds = {'class="ad"': SURE, "id=comments": SURE, 'class="post ad-slot"': SURE, 'class="comments-area"': SURE, 'class="cookie-banner"': SURE, "class='siteHeader'": PERHAPS, 'class="grid-notice"': PERHAPS, 'data-role="search"': NO, 'class="headers"': NO, 'class="reading"': NO, 'role="main"': NO}
    assert {x: furniture_of("div", " " + x) for x in kinds} == kinds
    assert furniture_of("footer", "") == SURE and furniture_of("h1", ' id="header"') == NO


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>story one two</p></article><div id="comments-area"><article class="comment-body"><p>a long long long reply of a reader</p></article></div>', "story one two"),
        ('<article><p>story one two</p></article><h3 id="comments">3 comments</h3><article><p>a long long long reply of a reader</p></article>', "story one two"),
        ('<main><h1>Title</h1><article><p>story one two</p></article><article class="comment"><p>a long long reply of a reader</p></article></main>', "Title story one two"),
        ('<article class="social"><p>story</p></article>', "story"),
        ('<main class="search"><p>story</p></main>', "story"),
        ('<article class="comment"><p>the only article</p></article>', "the only article"),
        ('<main><article class="reply"><p>the only article</p></article></main>', "the only article"),
        ('<article><h1 id="header">Title</h1><p>story</p><h2 id="comments">On comments</h2><p>more</p></article>', "Title story On comments more"),
        ('<article><p>story</p><div class="ad-slot">buy this now</div><p>more</p></article>', "story more"),
        ('<main><div class="cookie-banner">we use cookies</div><p>story</p></main>', "story"),
        ('<form id="aspnetForm"><nav>menu</nav><main><p>story</p></main></form>', "story"),
        ('<div class="ad-free"><article><p>story</p><aside>side</aside></article></div>', "story"),
        ('<article><p>the story is long</p></article><article><p>a teaser</p></article>', "the story is long"),
        ('<article><p>story</p><section><article><p>an inner one</p></article></section><p>more</p></article>', "story more"),
        ('<div role="main"><p>story</p></div><footer>foot</footer>', "story"),
        ('<main><main><p>story</p></main></main>', "story"),
        ('<article class="teaser"><p>read me</p></article><article><p>story</p></article>', "story"),
        ("<article><p>story</article><p>left over", "story"),
    ],
)
def test_the_article_is_the_one_a_reader_would_name(page, text):
    assert " ".join(t for t, inside, furniture in blocks_of(page) if inside and furniture == NO) == text


def test_comments_do_not_stand_in_for_a_story_without_marks(spark):
    page = '<div class="post"><p>the story of this page has no article element</p></div><div class="comments-list"><article><p>a reader</p></article></div>'
    df = spark.createDataFrame([(1, "http://h/1", page)], "page_id long, url string, html string")
    assert main_text(df).first()["text"] == "the story of this page has no article element"


def test_what_unmarked_pages_repeat_goes_and_only_that(spark):
    menu = "home news sport weather travel culture"
    own = [" ".join(f"w{i}x{k}" for k in range(9)) for i in range(4)]
    rows = [(i, f"http://{'h' if i < 3 else 'other'}/{i}", f"<p>{menu}</p><p>{own[i]}</p>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in main_text(df).collect()} == {0: own[0], 1: own[1], 2: own[2], 3: f"{menu} {own[3]}"}



def test_the_array_settles_what_names_leave_open(spark):
    """Blocks of an article whose names only contain a word of the list go where other pages of the host have them."""
    share = '<div class="share-tools">tell your friends about this story right now</div>'
    notice = {i: " ".join(f"page{i}word{k}" for k in range(8)) for i in range(3)}
    rows = [(i, f"http://host/{i}", f'<article><p class="grid-notice">{notice[i]}</p><p>story {i}</p>{share}</article>') for i in range(3)]
    rows += [(9, "http://other/1", f"<article><p>alone</p>{share}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert got == {i: f"{notice[i]} story {i}" for i in range(3)} | {9: "alone tell your friends about this story right now"}


def brute_texts(pages, least=6):
    """All runs of `least` tokens in a dictionary, over pages of (id, host, blocks)."""
    def stream(blocks):
        return [w for t, a, f in blocks if not a or f != NO for w in t.split()]

    holders = {}
    for n, (_, host, blocks) in enumerate(pages):
        own = stream(blocks)
        for k in range(len(own) - least + 1):
            holders.setdefault((host, *own[k : k + least]), set()).add(n)
    out = {}
    for i, host, blocks in pages:
        own = stream(blocks)
        gone = {k + d for k in range(len(own) - least + 1) if len(holders[(host, *own[k : k + least])]) > 1 for d in range(least)}
        marked, at, kept = any(a for _, a, _ in blocks), 0, []
        for t, a, f in blocks:
            words = t.split()
            if a and f == NO:
                kept += words
                continue
            mine = [k in gone for k in range(at, at + len(words))]
            at += len(words)
            if f == SURE or a != marked:
                continue
            kept += [w for w, g in zip(words, mine) if not g] if not marked else words if 2 * sum(mine) < len(words) else []
        out[i] = " ".join(kept)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_whole_query_matches_brute_force_on_generated_hosts(spark, seed):
    rng = np.random.default_rng(seed)
    words = lambda n, k=40: " ".join(f"w{x}" for x in rng.integers(0, k, n))
    shared = [words(int(rng.integers(3, 14))) for _ in range(15)]
    opens = ["<nav>", "<div>", "<p>", '<div class="ad">', '<div class="share-box">', '<p class="entry-note">', "<footer>", "<section>"]
    pages, rows = [], []
    for i in range(60):
        parts = []
        for _ in range(int(rng.integers(2, 8))):
            tag = opens[int(rng.integers(0, len(opens)))]
            text = shared[int(rng.integers(0, len(shared)))] if rng.random() < 0.6 else words(int(rng.integers(1, 25)), 400)
            parts.append(f"{tag}{text}</{tag[1:].split()[0].rstrip('>')}>")
        if i % 3:
            a, b = sorted(rng.integers(0, len(parts) + 1, 2).tolist())
            parts[a:b] = ["<article>", *parts[a:b], f"<p>story {i}</p></article>"]
        html = "<html><body>" + "".join(parts) + "</body></html>"
        rows.append((i, f"https://host{i % 4}/x/{i}", html))
        pages.append((i, i % 4, blocks_of(html)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert got == brute_texts(pages)


def test_suffix_array_and_repeats():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 200):
        x = rng.integers(0, 3, n)
        assert suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
    for _ in range(20):
        page = np.sort(rng.integers(0, 4, 120))
        x = rng.integers(0, 2, 120)
        want = np.zeros(120, bool)
        windows = {}
        for i in range(120 - 5):
            if page[i] == page[i + 5]:
                windows.setdefault(tuple(x[i : i + 6]), []).append(i)
        for places in windows.values():
            if len({page[i] for i in places}) > 1:
                for i in places:
                    want[i : i + 6] = True
        assert (repeated_tokens(x, page) == want).all()


def test_runs_on_two_pages_of_a_large_host_are_removed(spark):
    rows, want = [], {}
    for i in range(60):
        notice = " ".join(f"notice{i % 30}word{k}" for k in range(8))
        own = " ".join(f"page{i}word{k}" for k in range(4000))
        rows.append((i, f"http://large/{i}", f"<p>{own}</p><div>{notice}</div>"))
        want[i] = own
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in main_text(df).collect()} == want


def test_pages_without_articles_match_brute_force(spark):
    """Runs of six tokens that another page of the host has go, others stay."""
    pick = np.random.default_rng(4)
    pieces = [" ".join(f"w{x}" for x in pick.integers(0, 40, n)) for n in pick.integers(3, 12, 12)]
    pages = [(i, f"h{i % 3}", [pieces[k] for k in pick.integers(0, 12, 3)] + [" ".join(f"w{x}" for x in pick.integers(0, 40, 15))]) for i in range(24)]
    tokens = {i: " ".join(parts).split() for i, _, parts in pages}
    holders = {}
    for i, host, _ in pages:
        for k in range(len(tokens[i]) - 5):
            holders.setdefault((host, *tokens[i][k : k + 6]), set()).add(i)
    want = {}
    for i, host, _ in pages:
        gone = {k + d for k in range(len(tokens[i]) - 5) if len(holders[(host, *tokens[i][k : k + 6])]) > 1 for d in range(6)}
        want[i] = " ".join(w for k, w in enumerate(tokens[i]) if k not in gone)
    assert 0 < sum(len(t.split()) for t in want.values()) < sum(map(len, tokens.values()))
    df = spark.createDataFrame([(i, f"http://{host}/{i}", "".join(f"<p>{x}</p>" for x in parts)) for i, host, parts in pages], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in main_text(df).collect()} == want


def test_main_text(spark):
    foot = "<div>terms of use apply to all visitors of this site</div>"
    rows = [
        (1, "http://a/1", f"<article><p>first &amp;\n text</p></article>{foot}"), (2, "http://a/2", f"<p>no article here at all</p>{foot}"), (3, "http://A/3", f"<nav>menu</nav><p>another one</p>{foot}"),
        (4, "http://b/1", f"<p>lonely</p>{foot}"), (5, None, None), (6, "odd", ""), (None, "http://a/9", "<main>x</main>"), (1, "http://a/1", "<article></article>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as grp", "3 as text")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in main_text(df).collect()), key=repr)
    want = [(1, "first & text"), (2, "no article here at all"), (3, "another one"), (4, "lonely terms of use apply to all visitors of this site"), (5, ""), (6, ""), (None, "x"), (1, "")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=repr)
    assert main_text(df.limit(0)).count() == 0


def test_license_scan(spark):
    mit = KNOWN[0][1]
    rows = [
        (1, mit), (2, "MIT LICENCE\n\nCopyright (c) 2020 Some One\n\n" + mit.upper().replace(".", " . ")), (3, mit + " and more"), (4, "text\nReleased under the MIT Licence\nLicensed under the Apache License, Version 2.0!"),
        (5, None), (6, ""), (None, "SPDX-License-Identifier: MIT"), (7, "Licensed under CC BY 4.0. But not alone"), (4, "Licensed under CC BY 4.0."),
    ]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as digest", "'x' as license")
    got = {r["doc_id"]: (r["whole_license"], r["n_license_lines"], r["licenses"]) for r in license_scan(df).collect()}
    assert got == {
        1: ("MIT", 1, "MIT"), 2: ("MIT", 1, "MIT"), 3: (None, 0, ""), 4: ("CC-BY-4.0", 3, "Apache-2.0,CC-BY-4.0,MIT"), 5: (None, 0, ""), 6: (None, 0, ""), None: ("MIT", 1, "MIT"), 7: (None, 0, ""),
    }
    own = known_digests(spark, spark.createDataFrame([("House", "Our own terms")], "license string, text string"))
    assert license_scan(spark.createDataFrame([(1, "our OWN terms.")], DOCS), known=own).first()["whole_license"] == "House"
    assert license_scan(df.limit(0)).count() == 0


def brute_contained(docs, items, n=5, share=0.8):
    def shingles(rows):
        out = {}
        for i, t in rows:
            w = words_of(t)
            if w:
                out.setdefault(i, set()).update({" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))})
        return out

    return {(d, i, len(x & y), len(y)) for d, x in shingles(docs).items() for i, y in shingles(items).items() if len(x & y) >= share * len(y) - 1e-9}


def test_contained_items_match_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve"]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 60))))) for i in range(40)] + [(None, "one two three four five six"), (90, None), (91, "..."), (92, "just three words")]
    docs = [(None, "One, two; three four-five six seven"), (1, None), (2, ""), (3, "JUST three words!"), (4, "just three words more")]
    for d in range(10, 120):
        words = rng.choice(vocabulary, int(rng.integers(1, 400))).tolist()
        if d % 2:
            part = (items[int(rng.integers(0, 40))][1]).split()
            if d % 4 == 1 and len(part) > 10:
                part[int(rng.integers(0, len(part)))] = "changed"
            at = int(rng.integers(0, len(words)))
            words[at:at] = part
        docs.append((d, " ".join(words)))
    docs += [docs[-1], docs[-1]]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as h", "2 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in contained_items(df, bench).collect()}
    want = brute_contained(docs, items)
    assert got == want and len(want) > 40
    bad = {d for d, *_ in want}
    assert sorted(r["doc_id"] for r in drop_contaminated(df, bench).collect()) == sorted(d for d, _ in docs if d not in bad)
    assert contained_items(df, bench.limit(0)).count() == 0 and contained_items(df.limit(0), bench).count() == 0


def test_documents_that_share_nothing_are_not_kept(spark, monkeypatch):
    """What is stored and shuffled follows what documents share with items, not their length."""
    from ledgerwright.llm import decontaminate

    rng, kept = np.random.default_rng(5), {}
    words = [f"w{i}" for i in range(5000)]

    def texts(n, size):
        return [" ".join(rng.choice(words, size)) for _ in range(n)]

    items, docs = texts(400, 12) + texts(100, 200), texts(500, 2000)
    docs[7] = f"{docs[7]} {items[450]} tail"
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    stored = decontaminate.stored

    def noted(frame, label):
        kept[label] = stored(frame, label)
        return kept[label]

    monkeypatch.setattr(decontaminate, "stored", noted)
    assert [(r["doc_id"], r["item_id"]) for r in contained_items(df, bench).collect()] == [(7, 450)]
    rows = kept["hits"].collect()
    assert len(rows) < 150 and sum(len(r["have"]) for r in rows if r[0] != 7) < 200


@pytest.mark.parametrize("q", range(1, 60))
def test_sketches_lose_nothing(q):
    assert q - sketch_size(q, 0.8) < 0.8 * q <= q - sketch_size(q, 0.8) + 1 + 1e-9


def brute_bits(text, model_counts, order):
    """Code length of text by the definition, from counts {string of order + 1 bytes: n} of one language."""
    raw = ppm.plain(text)
    padded = b" " * order + raw
    total = 0.0
    for i in range(order, len(padded)):
        cost, done = 0.0, False
        for k in range(order, -1, -1):
            context, symbol = padded[i - k : i], padded[i : i + 1]
            seen = {}
            for g, n in model_counts.items():
                if g[order - k : order] == context:
                    seen[g[order:]] = seen.get(g[order:], 0) + n
            n, d = sum(seen.values()), len(seen)
            if symbol in seen:
                cost -= np.log2(seen[symbol] / (n + d))
                done = True
                break
            if n:
                cost -= np.log2(d / (n + d))
        total += cost if done else cost + 8
    return total


def test_code_lengths_follow_the_definition():
    order, texts = 2, [("en", "the cat and the hat"), ("de", "der kater und der hut für alle")]
    languages = ["de", "en"]
    lang, grams, counts, by = [], [], [], {}
    for name, t in texts:
        keys, _ = ppm._grams([ppm.plain(t)], order)
        for g, n in zip(*np.unique(keys, return_counts=True), strict=True):
            lang.append(languages.index(name))
            grams.append(g)
            counts.append(n)
            by.setdefault(name, {})[int(g).to_bytes(order + 1, "big")] = int(n)
    model = ppm.Model(languages, np.array(lang), np.array(grams, np.uint64), np.array(counts), order)
    tests = ["the hut", "für", "xyz 123", "", "THE Cat&&hat"]
    got = model.bits([ppm.plain(t) for t in tests])
    want = [[brute_bits(t, by[name], order) for name in languages] for t in tests]
    assert np.allclose(got, want, atol=1e-3)


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    assert docs.where(held).first()["doc_id"] in [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 == 2]
    model = ppm.learn(docs, ~held)
    got = ppm.predict_language(docs.where(held).selectExpr("*", "1 as score"), model)
    right, n = got.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "the"), (4, "日本")], DOCS)
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in ppm.predict_language(odd, model).collect()}
    assert [rows[i][0] for i in (1, 2, 3)] == ["und"] * 3 and rows[None][0] in model.languages and 0 <= rows[4][1] <= 1
    assert ppm.learn(docs.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in ppm.predict_language(odd, None).collect()} == {"und"}


def brute_groups(rows, n=5, share=0.8):
    sets = []
    for _, t in rows:
        w = [x.decode() for x in similar._words(t)]
        sets.append((" ".join(w), {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (a, x), (b, y) = sets[i], sets[j]
            both = len(x & y)
            if a == b or (both and both >= share * (len(x) + len(y) - both) - 1e-9):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    best = {}
    for i, (key, _) in enumerate(rows):
        best.setdefault(find(i), []).append(key)
    return [min((k for k in best[find(i)] if k is not None), default=None) for i in range(len(rows))]


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = [(900, None), (901, " "), (902, "a b"), (903, "A  b"), (904, "a b c")]
    for i in range(60):
        words = rng.choice(vocabulary, int(rng.integers(20, 200))).tolist()
        rows.append((i * 10, " ".join(words)))
        for c in range(int(rng.integers(0, 4))):
            other = list(words)
            for _ in range(int(rng.integers(0, 1 + len(words) // 40))):
                other[int(rng.integers(0, len(words)))] = "new"
            rows.append((i * 10 + c + 1, " ".join(other)))
    rows += [rows[10], rows[10]]
    return rows


def test_similar_components_match_brute_force(spark, copies):
    df = spark.createDataFrame(copies, DOCS).selectExpr("*", "1 as node", "2 as band", "3 as u")
    got = sorted((r["doc_id"], r["component_id"]) for r in similar.similar_components(df).collect())
    assert got == sorted(zip((k for k, _ in copies), brute_groups(copies), strict=True))
    kept = sorted(r["doc_id"] for r in similar.keep_one_of_each(df).collect())
    assert kept == sorted(k for (k, _), g in zip(copies, brute_groups(copies), strict=True) if k == g)
    assert similar.similar_components(df.limit(0)).count() == 0


def test_large_buckets_are_dealt_out(spark, copies, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(100)]
    assert {r["component_id"] for r in similar.similar_components(spark.createDataFrame(rows, DOCS)).collect()} == {0}
    monkeypatch.setattr(similar, "TILE", 16)
    assert {r["component_id"] for r in similar.similar_components(spark.createDataFrame(rows, DOCS)).collect()} == {0}


def star(n, length=300, edits=5):
    """An original and n copies of it, each near the original (0.846) but not near another."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(length + 4)]
    rows = [(n, " ".join(base))]
    for c in range(n):
        other = list(base)
        for k in range(edits):
            other[int(rng.integers(0, length // edits - 5)) + k * (length // edits) + 4] = f"x{c}_{k}"
        rows.append((c, " ".join(other)))
    return rows


def test_copies_of_one_original_are_one_group(spark):
    rows = star(250)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    near = lambda x, y: len(x & y) / len(x | y)
    assert all(near(sets[0], x) >= 0.8 for x in sets[1:])
    assert np.mean([near(x, y) >= 0.8 for x in sets[1:40] for y in sets[1:40] if x is not y]) < 0.05
    assert {r["component_id"] for r in similar.similar_components(spark.createDataFrame(rows, DOCS)).collect()} == {0}


def test_links_across_tiles_are_found(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 8)
    monkeypatch.setattr(similar, "TILE_BYTES", 1 << 15)
    assert {r["component_id"] for r in similar.similar_components(spark.createDataFrame(star(120), DOCS)).collect()} == {0}
    rng, at = np.random.default_rng(2), np.arange(40)
    for _ in range(20):
        sets = [np.unique(np.append(rng.choice(20, 17, replace=False), 100 + i // 8)).astype(np.uint64) for i in at]
        side = rng.integers(0, 2, 40) == 1
        links = similar._set_links(sets, at, 0.8, side)
        near = [[len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) - 1e-9 for y in sets] for x in sets]
        want, got = at.copy(), at.copy()
        for i in at:
            for j in at[(side != side[i]) & np.array(near[i])]:
                want[want == want[j]] = want[i]
        for i, j in links:
            assert side[i] != side[j]
            got[got == got[j]] = got[i]
        assert ((got[:, None] == got) == (want[:, None] == want)).all()


def test_set_links_match_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(40):
        n = int(rng.integers(2, 30))
        base = rng.choice(60, 30, replace=False)
        sets = [np.unique(np.append(rng.choice(base, int(rng.integers(18, 31)), replace=False), rng.integers(60, 90, int(rng.integers(0, 4))))).astype(np.uint64) for _ in range(n)]
        part = rng.integers(0, n, n)
        whole, label = part.copy(), part.copy()
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    whole[whole == whole[j]] = whole[i]
        links = similar._set_links(sets, part, 0.8)
        for i, j in links:
            assert label[i] != label[j]
            label[label == label[j]] = label[i]
        assert ((label[:, None] == label) == (whole[:, None] == whole)).all()


def test_pipeline_stages_match_brute_force(spark):
    import corpus_pipeline

    from .test_text_rules import Rules, brute_lines, brute_repetition

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, bench = docs.columns, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "stage")
        results.append(docs)
    before = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [[(r["doc_id"], r["text"]) for r in x.collect()] for x in results[:4]]
    assert all(x.columns == columns for x in results[:4])
    assert sorted(rows[0]) == sorted((i, t) for i, t in before if brute_repetition(t, Rules())[6])
    import hashlib

    assert sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows[1]) == sorted((r[0], r[3]) for r in brute_lines(rows[0]))
    assert sorted(rows[2]) == sorted(r for r, g in zip(rows[1], brute_groups(rows[1]), strict=True) if r[0] == g)
    bad = {d for d, *_ in brute_contained(rows[2], bench)}
    assert sorted(rows[3]) == sorted(r for r in rows[2] if r[0] not in bad)
    pieces = results[4].collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in rows[3]}
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(tuple(r) for r in pieces)


def test_stages_leave_other_columns_alone(spark):
    """Columns named like a stage's own measures, and tables without n_chars, pass through."""
    import corpus_pipeline

    names = ["n_words", "kept", "n_lines", "n_dropped", "hashes", "component_id", "node", "u", "h", "item_id"]
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"{good} own{i}\n" + " ".join(f"x{i}y{k}" for k in range(60)), *[f"{n}{i}" for n in names]) for i in range(4)] + [(9, None, *names), (None, "short", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.stored(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)
        docs = out
    assert {r["doc_id"] for r in docs.collect()} == {0, 1, 2, 3}


def test_batches_are_bounded_inside_only(spark):
    from ledgerwright.llm.common import batches_of

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    counted = rows.mapInArrow(sizes, "n long")
    with batches_of(spark, 1 << 20):
        assert max(r["n"] for r in counted.collect()) <= 12
    assert spark.conf.get(name) == before and sum(r["n"] for r in counted.collect()) == 64

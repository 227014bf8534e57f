"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contained_items
from .heap_lloyd import compress_vectors
from .licenses import COPYRIGHT, KNOWN, SPELLINGS, license_scan
from .lines import drop_repeated_lines
from .packing import pack_documents
from .pages import main_text
from .ppm import learn, predict_language
from .repetition import LENGTHS, Rules, with_repetition
from .simhash import hex_fingerprint, simhash_components
from .spotsigs import ANCHORS, COMMON, fingerprint_edits
from .token_archive import id_round_trip
from .warc import archive_round_trip
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage of every document."""
    return with_repetition(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents, three-word shingles, radius 3."""
    found = simhash_components(_table(spark, sf_dir, "documents"), words=3, radius=3, seed=42)
    return found.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters in at least three documents go, but for the last document."""
    return drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that are a whole document or a whole line of it."""
    return license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a WARC archive and back."""
    read = archive_round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that it contains to four fifths."""
    return contained_items(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), n=5, share=0.8)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, each ended by id 1."""
    return pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), capacity=4096, end_id=1)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose id has a checksum not 2 modulo 4; a null id is held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    model = learn(docs, ~held_out)
    return predict_language(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op10_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, ended by id 2, through the archive files and back."""
    return id_round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), end_id=2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all whole embeddings: 16 parts, 64 entries each, two rounds."""
    found = compress_vectors(_table(spark, sf_dir, "embeddings"), scale=256, parts=16, entries=64, rounds=2)
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole embeddings on their first 32 principal components, whitened; a deviation beyond a long is null."""
    found = whiten(_table(spark, sf_dir, "embeddings"), scale=64, offset=1_000_000, components=32)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited forms, and how alike they and the next documents are."""
    return fingerprint_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_license_scan": op5_license_scan,
    "op6_warc": op6_warc,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_language_id": op9_language_id,
    "op10_token_archive": op10_token_archive,
    "op11_vector_codes": op11_vector_codes,
    "op12_whitening": op12_whitening,
    "op13_fingerprints": op13_fingerprints,
}


def _op1_sql() -> str:
    r, space = Rules(), "[\\x20\\x09-\\x0D]"
    cover = "".join(
        f""",
windows{n} AS (SELECT doc_id, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g FROM pos QUALIFY i + {n - 1} <= n_words),
starts{n} AS (SELECT doc_id, i FROM windows{n} QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover{n} AS (SELECT doc_id, count(*) AS words, sum(length(w)) AS chars FROM (SELECT DISTINCT s.doc_id, s.i + k.k AS j FROM starts{n} s, (SELECT unnest(range({n})) AS k) k) c
  JOIN pos USING (doc_id) WHERE pos.i = c.j GROUP BY doc_id)"""
        for n in (3, *LENGTHS)
    )
    joins = " ".join(f"LEFT JOIN cover{n} USING (doc_id)" for n in (3, *LENGTHS))
    dups = ", ".join(f"CAST(coalesce(cover{n}.chars, 0) AS BIGINT) AS dup_{n}_chars" for n in LENGTHS)
    rules = " AND ".join(f"100 * dup_{n}_chars <= {most} * word_chars" for n, most in zip(LENGTHS, (r.max_dup_5_pct, r.max_dup_7_pct, r.max_dup_10_pct), strict=True))
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS ws FROM base),
doc AS (SELECT doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM split),
pos AS (SELECT doc_id, n_words, unnest(range(1, n_words + 1)) AS i, unnest(ws) AS w FROM doc),
line AS (SELECT doc_id, l, length(regexp_replace(l, '{space}', '', 'g')) AS chars FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base)),
dup AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum((n - 1) * chars) AS BIGINT) AS dup_line_chars
  FROM (SELECT doc_id, l, chars, count(*) AS n FROM line WHERE chars > 0 GROUP BY ALL) GROUP BY doc_id){cover},
found AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(cover3.words, 0) AS BIGINT) AS n_repeat_words,
  coalesce(dup_line_chars, 0) AS dup_line_chars, {dups} FROM doc LEFT JOIN dup USING (doc_id) {joins}),
judged AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_word_pct} * n_words AS base_failed FROM found)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {r.max_dup_line_pct} * word_chars AND {rules} AS kept FROM judged"""


_OP3_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM split),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(l, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
often AS (SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT x.doc_id, x.l, x.i, o.k IS NOT NULL AND x.doc_id <> o.last_id AS gone FROM keyed x LEFT JOIN often o ON x.k = o.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

_OP6_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM p),
r AS (SELECT *, payload_bytes >= 100 AND page_id > first_id AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r"""


def _op5_sql() -> str:
    def form(t: str) -> str:
        low = f"regexp_replace(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{COPYRIGHT}', ' ', 'g')"
        words = f"' ' || trim(regexp_replace({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' '"
        for old, new in SPELLINGS:
            words = f"replace({words}, ' {old} ', ' {new} ')"
        return f"trim({words})"

    values = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in KNOWN)
    return f"""
WITH known AS (SELECT f, min(license) AS license FROM (SELECT license, {form("t")} AS f FROM (VALUES {values}) AS v(license, t)) GROUP BY f),
units AS (SELECT doc_id, TRUE AS whole, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT doc_id, FALSE, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
forms AS (SELECT doc_id, whole, {form("t")} AS f FROM units),
found AS (SELECT doc_id, min(license) FILTER (whole) AS whole_license, count(*) FILTER (NOT whole) AS n_license_lines,
  array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses FROM forms JOIN known USING (f) GROUP BY doc_id)
SELECT doc_id, whole_license, CAST(coalesce(n_license_lines, 0) AS BIGINT) AS n_license_lines, coalesce(licenses, '') AS licenses
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN found USING (doc_id)"""


def _shingle_sql(table: str, key: str, n: int = 5) -> str:
    return f"""(SELECT DISTINCT {key}, CASE WHEN len(ws) < {n} THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + {n - 1}), ' ') END AS s
  FROM (SELECT {key}, ws, unnest(range(1, greatest(len(ws) - {n - 2}, 2))) AS i
    FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {table}) WHERE len(ws) > 0))"""


_OP7_SQL = f"""
WITH want AS {_shingle_sql("benchmark", "item_id")}, have AS {_shingle_sql("documents", "doc_id")},
size AS (SELECT item_id, count(*) AS n_shingles FROM want GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM have JOIN want USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_shingles AS BIGINT) AS n_shingles, n_shared / n_shingles AS containment
FROM hits JOIN size USING (item_id) WHERE n_shared >= n_shingles * 0.8 - 1e-9"""



def _op11_sql() -> str:
    """Full comparison with every entry in every round."""

    def assign(k: int) -> str:
        apart = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))"
        return f"""
near{k} AS MATERIALIZED (SELECT r, place, any_value(v) AS v, min(d) AS d, arg_min(e, d * 64 + e) AS e FROM (SELECT p.r, p.place, p.v, b.e, CAST({apart} AS BIGINT) AS d FROM part p JOIN book{k} b USING (place)) GROUP BY r, place)"""

    def update(k: int) -> str:
        return f"""
sums{k} AS (SELECT place, e, j, sum(x) AS s, count(*) AS c FROM (SELECT place, e, unnest(v) AS x, unnest(range(len(v))) AS j FROM near{k}) GROUP BY ALL),
moved{k} AS (SELECT place, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY j) AS v FROM sums{k} GROUP BY place, e),
book{k + 1} AS MATERIALIZED (SELECT b.place, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN moved{k} m ON b.place = m.place AND b.e = m.e)"""

    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
part AS MATERIALIZED (SELECT r, place, x[place * (len(x) // 16) + 1 : (place + 1) * (len(x) // 16)] AS v FROM kept, (SELECT unnest(range(16)) AS place)),
book0 AS MATERIALIZED (SELECT place, r - 1 AS e, v FROM part WHERE r <= 64),{assign(0)},{update(0)},{assign(1)},{update(1)},{assign(2)},
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place, e, j)) AS codebooks_sha256 FROM (SELECT place, e, unnest(v) AS x, unnest(range(len(v))) AS j FROM book2)),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY place) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), digest"""


def _op13_sql() -> str:
    quoted = lambda words: ", ".join(f"'{w}'" for w in dict.fromkeys(words))
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first(coalesce(text, '')) OVER (ORDER BY doc_id)) AS f, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM documents),
duo AS (SELECT doc_id, next_id, t, left(t, length(t) - length(t) // 2) || left(f, length(t) // 2) AS e FROM base),
texts AS (SELECT doc_id, 0 AS kind, t FROM duo UNION ALL SELECT doc_id, 1, e FROM duo),
split AS (SELECT doc_id, kind, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
plain AS MATERIALIZED (SELECT doc_id, kind, ws, NOT list_has_any(ws, [{quoted(ANCHORS)}]) AS bare FROM split),
pos AS (SELECT doc_id, kind, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, bare FROM plain),
marked AS (SELECT doc_id, kind, i, CAST('0x' || left(md5(w), 8) AS BIGINT) AS h, bare OR w IN ({quoted(ANCHORS)}) AS anchor, bare OR w NOT IN ({quoted(ANCHORS + COMMON)}) AS content FROM pos),
ranked AS MATERIALIZED (SELECT *, count(*) FILTER (content) OVER (PARTITION BY doc_id, kind ORDER BY i) AS k FROM marked),
chain AS MATERIALIZED (SELECT doc_id, kind, k, h FROM ranked WHERE content),
spots AS (SELECT doc_id, kind, k, h FROM ranked WHERE anchor UNION ALL SELECT doc_id, kind, 0, 1 FROM plain WHERE len(ws) > 0),
sigs AS MATERIALIZED (SELECT s.doc_id, s.kind, (s.h + coalesce(a.h, 0) * 402653189 + coalesce(b.h, 0) * 201326611) % 4294967291 AS sig FROM spots s
  LEFT JOIN chain a ON a.doc_id = s.doc_id AND a.kind = s.kind AND a.k = s.k + 1 LEFT JOIN chain b ON b.doc_id = s.doc_id AND b.kind = s.kind AND b.k = s.k + 2),
prints AS (SELECT doc_id, kind, string_agg(printf('%08x', sig), '' ORDER BY sig) AS fp, count(*) AS n FROM sigs GROUP BY ALL),
counted AS MATERIALIZED (SELECT doc_id, kind, sig, count(*) AS c FROM sigs GROUP BY ALL),
pairs AS (SELECT doc_id, 1 AS kind, doc_id AS other FROM duo UNION ALL SELECT doc_id, 0, next_id FROM duo),
shared AS (SELECT p.doc_id, p.kind, sum(least(a.c, b.c)) AS m FROM pairs p JOIN counted a ON a.doc_id = p.doc_id AND a.kind = 0 JOIN counted b ON b.doc_id = p.other AND b.kind = p.kind AND b.sig = a.sig GROUP BY ALL),
near AS (SELECT p.doc_id, p.kind, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 1.0 ELSE CAST(coalesce(m, 0) AS DOUBLE) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(m, 0)) END AS likeness FROM pairs p
  LEFT JOIN shared s ON s.doc_id = p.doc_id AND s.kind = p.kind LEFT JOIN prints x ON x.doc_id = p.doc_id AND x.kind = 0 LEFT JOIN prints y ON y.doc_id = p.other AND y.kind = p.kind)
SELECT d.doc_id, CAST(length(d.t) AS BIGINT) AS n_chars, sha256(d.e) AS edited_sha256, coalesce(x.fp, '') AS fingerprint, coalesce(y.fp, '') AS edited_fingerprint, u.likeness AS near_edited, v.likeness AS near_next, CAST(coalesce(x.n, 0) AS BIGINT) AS n_signatures
FROM duo d LEFT JOIN prints x ON x.doc_id = d.doc_id AND x.kind = 0 LEFT JOIN prints y ON y.doc_id = d.doc_id AND y.kind = 1
  JOIN near u ON u.doc_id = d.doc_id AND u.kind = 1 JOIN near v ON v.doc_id = d.doc_id AND v.kind = 0"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _op1_sql(),
    "op3_line_dedup": _OP3_SQL,
    "op5_license_scan": _op5_sql(),
    "op6_warc": _OP6_SQL,
    "op7_benchmark_decontamination": _OP7_SQL,
    "op11_vector_codes": _op11_sql(),
    "op13_fingerprints": _op13_sql(),
}

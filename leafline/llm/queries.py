"""The registered queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import bpe, conversations, decontaminate, hard_negatives, host_rules, language, line_dedup, minhash, pii, spread, substring, suffixes, token_files, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
c AS (
  SELECT doc_id, host, text, w, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) AS win FROM d),
p AS (SELECT doc_id, u.i, u.v FROM c, (SELECT unnest(range(1, len(win) + 1)) AS i, unnest(win) AS v) u),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1),
k AS (SELECT doc_id, count(DISTINCT i + s.s) AS n FROM r, range(5) s(s) GROUP BY doc_id),
j AS (
  SELECT c.doc_id, host, n_words, coalesce(chars, 0) AS word_chars, n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words,
    n_words < 10 OR 100 * coalesce(k.n, 0) > 20 * n_words AS base_failed FROM c LEFT JOIN k USING (doc_id)),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS failed FROM j),
h AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS f FROM f WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT sum(f) / sum(n) AS mean, sum(f / n * f) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 0 THEN greatest(1.0, least(1e6, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS weight FROM m),
b AS (SELECT host FROM h, q WHERE (f + mean * weight) / (n + weight) >= 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM b)) AS kept FROM f
"""


@_query("op2_host_rules", OP2_SQL)
def op2_host_rules(spark, sf_dir):
    found = host_rules.host_quality(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op8_language")
def op8_language(spark, sf_dir):
    docs = language.held_out(_documents(spark, sf_dir))
    codes = language.fit(docs.filter("NOT held_out"))
    # the fold follows from the id, which the prediction carries
    return language.held_out(language.predict(docs, codes)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@_query("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    coded = bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT rowid AS r, doc_id, u.i, u.line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS rowid, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
    (SELECT unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line) u),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id < k.last AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY r, doc_id
"""


@_query("op3_line_dedup", OP3_SQL)
def op3_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT r, doc_id, u.i, md5(array_to_string(w[u.i : u.i + 49], ' ')) AS v FROM d, (SELECT unnest(range(1, len(w) - 48)) AS i) u),
m AS (SELECT v, min(doc_id) AS first FROM p GROUP BY v),
b AS (SELECT r, p.i FROM p JOIN m USING (v) WHERE doc_id > first),
g AS (SELECT DISTINCT r, i + s.s AS i FROM b, range(50) s(s)),
x AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda y, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""


@_query("op5_substring", OP5_SQL)
def op5_substring(spark, sf_dir):
    kept = substring.dedup_substrings(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id * 4294967296 + i AS place, i, v FROM (
  SELECT r, doc_id, unnest(range(0, length(h) // 2 - 99)) AS i, unnest(list_transform(range(0, length(h) // 2 - 99), lambda i: hash(substr(h, 2 * i + 1, 200)))) AS v FROM d)),
m AS (SELECT v, min(place) AS first FROM p GROUP BY v HAVING count(*) > 1),
b AS (SELECT r, p.i FROM p JOIN m USING (v) WHERE place > first),
s AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 100, true) AS new FROM b),
n AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM s),
g AS (SELECT r, k, min(i) AS a, max(i) + 100 AS e FROM n GROUP BY r, k),
x AS (SELECT d.r, g.a, g.e, substr(h, 2 * lag(g.e, 1, 0) OVER (PARTITION BY d.r ORDER BY g.a) + 1, 2 * (g.a - lag(g.e, 1, 0) OVER (PARTITION BY d.r ORDER BY g.a))) AS piece FROM d JOIN g USING (r)),
y AS (SELECT r, sum(e - a) AS gone, count(*) AS spans, max(e) AS last, string_agg(piece, '' ORDER BY a) AS kept FROM x GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN y USING (r)
"""


@_query("op10_suffix_array", OP10_SQL)
def op10_suffix_array(spark, sf_dir):
    kept = suffixes.dedup_bytes(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM t),
n AS (SELECT doc_id, len(s) AS n, s FROM s),
u AS (SELECT doc_id, n, unnest(s) AS x FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS d, doc_id AS k FROM n UNION SELECT e.b, c.k FROM c JOIN e ON e.a = c.d WHERE c.k < e.b)
SELECT doc_id, n::BIGINT AS n_shingles, k AS component_id, doc_id = k AS kept FROM n JOIN (SELECT d, min(k) AS k FROM c GROUP BY d) ON d = doc_id
"""


@_query("op4_minhash", OP4_SQL)
def op4_minhash(spark, sf_dir):
    return minhash.near_duplicates(_documents(spark, sf_dir), shingle=4)


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

_HOST = "coalesce(translate(regexp_extract({a}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({a}, '^[^/?#]*([^?#]*)', 1), '')"
_ADDRESS = "CASE WHEN host != '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract({a}, '^[^?#]*(\\?[^#]*)?', 1) END"
_AFTER = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) END"

OP6_SQL = rf"""
WITH RECURSIVE r(verdict, rule) AS (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')),
a AS (SELECT page_id, html, {_AFTER.format(u='url')} AS a FROM pages),
h AS (SELECT page_id, html, a, {_HOST.format(a='a')} AS host, {_PATH.format(a='a')} AS path FROM a),
p AS (SELECT *, {_ADDRESS.format(a='a')} AS address FROM h),
k AS (
  SELECT address, host, path, replace(unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\s[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\s[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*[''"]?([^"''\s>]+)', 1)]), '&amp;', '&') AS link
  FROM p WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
l AS (
  SELECT address, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '/') THEN 'http://' || host || link
    WHEN link = '' OR regexp_matches(link, '^([#?]|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL
    ELSE 'http://' || host || CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || link END AS url FROM k WHERE link != ''),
la AS (SELECT address, {_AFTER.format(u='url')} AS a FROM l),
lh AS (SELECT address, a, {_HOST.format(a='a')} AS host, {_PATH.format(a='a')} AS path FROM la),
t AS (SELECT address AS u, {_ADDRESS.format(a='a')} AS v FROM lh),
e AS (SELECT u, v FROM t WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM t WHERE u IS NOT NULL AND v IS NOT NULL),
c AS (SELECT u AS n, u AS m FROM e UNION SELECT c.n, e.v FROM c JOIN e ON e.u = c.m),
q AS (SELECT n, m, split_part(split_part(m, '/', 1), '?', 1) AS host, regexp_extract(m, '^[^/?#]*([^?#]*)', 1) AS path FROM c),
f AS (SELECT n, m, first(verdict ORDER BY length(rule) DESC) AS verdict FROM q JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY n, m),
b AS (SELECT n FROM f GROUP BY n HAVING count(*) FILTER (verdict = 'allow') = 0),
o AS (SELECT DISTINCT host, path FROM p),
w AS (SELECT o.host, o.path, first(rule ORDER BY length(rule) DESC) AS rule, first(verdict ORDER BY length(rule) DESC) AS verdict FROM o JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY o.host, o.path)
SELECT page_id, p.host, p.path, w.rule, coalesce(w.verdict, CASE WHEN p.address IN (SELECT n FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN w ON p.host = w.host AND p.path = w.path
"""


@_query("op6_redirects", OP6_SQL)
def op6_redirects(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.filter_urls(pages, urls.rule_table(spark, URL_RULES))


@_query("op7_personal")
def op7_personal(spark, sf_dir):
    found = pii.find_personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@_query("op1_templates")
def op1_templates(spark, sf_dir):
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS other, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.r != b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT r, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS FIRST, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.r, p.other ORDER BY score DESC, vec_id NULLS FIRST, s.other))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.r, p.other ORDER BY score DESC, vec_id NULLS FIRST, s.other) <= 3
"""


@_query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor"))
    return hard_negatives.hard_negatives(vectors)


@_query("op12_token_files")
def op12_token_files(spark, sf_dir):
    folder = spread.new_folder(spark, "tokens")
    token_files.write_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.checksums(spark, folder)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the damage that the repair is shown on; nulls are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", one("conv_id"), one("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


_RAGGED = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_EDITS = "list_min([{{'c': x[{s}].c + 4, 'a': 'D' || x[{s}].a}}, CASE WHEN free AND {k} THEN {{'c': x[{t}].c + cut, 'a': 'K' || x[{t}].a}} ELSE far END, CASE WHEN free THEN {{'c': x[{n}].c + cut + 3, 'a': 'R' || x[{n}].a}} ELSE far END])"
_STATES = [
    _EDITS.format(s=1, k="initial IN ('s', 'u')", t="CASE WHEN initial = 's' THEN 2 ELSE 3 END", n=3), _EDITS.format(s=2, k="initial = 'u'", t=3, n=3),
    _EDITS.format(s=3, k="initial = 'a'", t=4, n=4), _EDITS.format(s=4, k="initial = 'u'", t=3, n=3),
]
_INSERTS = "[list_min([{x}[1], {{'c': {x}[3].c + 3, 'a': 'I' || {x}[3].a}}]), list_min([{x}[2], {{'c': {x}[3].c + 3, 'a': 'I' || {x}[3].a}}]), list_min([{x}[3], {{'c': {x}[4].c + 3, 'a': 'I' || {x}[4].a}}]), list_min([{x}[4], {{'c': {x}[3].c + 3, 'a': 'I' || {x}[3].a}}])]"

OP13_SQL = rf"""
WITH RECURSIVE t8 AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
q AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT q.* EXCLUDE k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM q, t8),
w AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE d != 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {_RAGGED}) AS body FROM w),
f AS (
  SELECT *, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS earlier,
    CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT {{'c': 1000000000000, 'a': ''}} AS far),
r AS (
  SELECT conv_id, n AS i, {_INSERTS.format(x="x")} AS x FROM n, (SELECT [{{'c': 0, 'a': ''}}, far, far, {{'c': 0, 'a': ''}}] AS x FROM z)
  UNION ALL
  SELECT conv_id, i - 1, {_INSERTS.format(x="y")} FROM (
    SELECT r.conv_id, r.i, [{', '.join(_STATES)}] AS y FROM (SELECT r.*, f.initial, f.fault NOT IN (1, 2) AS free, CASE WHEN f.fault = 3 THEN 3 ELSE 0 END AS cut, far FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i, z) r)),
a AS (SELECT conv_id, x[1].c AS cost, x[1].a AS audit FROM r WHERE i = 0),
l AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS e FROM a WHERE audit != ''),
m AS (SELECT *, count(*) FILTER (e != 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM l),
g AS (
  SELECT m.conv_id, p, e, f.role, f.text, row_number() OVER (PARTITION BY m.conv_id ORDER BY p) - max(CASE WHEN e = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS k
  FROM m LEFT JOIN f ON e != 'I' AND m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i WHERE e != 'D'),
s AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS v FROM g GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(v, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
"""


@_query("op13_conversations", OP13_SQL)
def op13_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = conversations.report(conversations.repair(damaged(rows))).withColumnRenamed("conv_id", "of")
    every = rows.select("conv_id").distinct()
    joined = every.join(found, every["conv_id"].eqNullSafe(found["of"]), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

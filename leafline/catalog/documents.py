"""Page algebra, library, search, admission and image queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafline.catalog import fixtures as fx
from leafline.catalog.functions import FILES_SQL, MIMED_SQL, files
from leafline.catalog.registry import query, table
from leafline.operators import admission as A
from leafline.operators import images as I
from leafline.operators import library as B
from leafline.operators import pages as P
from leafline.operators import search as S
from leafline.operators.ordering import chunked_position

# ------------------------------------------------------------------ page algebra


@query("a12_page_count", f"WITH {fx.DOC_PAGES_SQL} SELECT d.doc_id, count(p.page_no) AS pages, count(p.page_no) > 0 AS ok FROM documents d LEFT JOIN doc_pages p USING (doc_id) GROUP BY 1")
def a12(spark, sf):
    return P.page_count(table(spark, sf, "documents"), fx.doc_pages(spark, sf))


@query("g1_merge_documents", f"""WITH {fx.DOC_PAGES_SQL}
SELECT doc_id // 10 AS group_id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id DESC, page_no) - 1 AS position, doc_id, page_no FROM doc_pages""")
def g1(spark, sf):
    members = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 10).alias("group_id"), (-F.col("doc_id")).alias("ord"), "doc_id"
    )
    return P.merge_documents(members, fx.doc_pages(spark, sf))


_REQUESTS_SQL = """requests AS (SELECT o_orderkey AS request_id, cast(5 + o_orderkey % 6 AS int) AS page_count,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '3, 1-2, 2' WHEN 2 THEN '4-2' WHEN 3 THEN concat('1-', cast(5 + o_orderkey % 6 AS varchar))
    WHEN 4 THEN '0' WHEN 5 THEN ' 2 - 4 ,5,5,11' ELSE '1,,2' END AS selection FROM orders)"""


def _requests(spark, sf):
    k, n = F.col("o_orderkey"), (5 + F.col("o_orderkey") % 6).cast("int")
    sel = (
        F.when(k % 7 == 0, "").when(k % 7 == 1, "3, 1-2, 2").when(k % 7 == 2, "4-2")
        .when(k % 7 == 3, F.concat(F.lit("1-"), n.cast("string"))).when(k % 7 == 4, "0")
        .when(k % 7 == 5, " 2 - 4 ,5,5,11").otherwise("1,,2")
    )
    return table(spark, sf, "orders").select(k.alias("request_id"), n.alias("page_count"), sel.alias("selection"))


@query("g2_parse_pages", f"""WITH {_REQUESTS_SQL},
tok AS (SELECT request_id, page_count, u.i, trim(u.t) AS t FROM requests, unnest(string_split(selection, ',')) WITH ORDINALITY AS u(t, i) WHERE trim(selection) <> ''),
rng AS (SELECT *, regexp_full_match(t, '\\d+(\\s*-\\s*\\d+)?') AS good, try_cast(regexp_extract(t, '^(\\d+)', 1) AS int) AS lo,
  coalesce(try_cast(nullif(regexp_extract(t, '-\\s*(\\d+)$', 1), '') AS int), try_cast(regexp_extract(t, '^(\\d+)', 1) AS int)) AS hi FROM tok),
bad AS (SELECT request_id, min_by(CASE WHEN NOT good THEN 'bad_syntax'
   ELSE 'outside_1_to_' || page_count END, i) AS error FROM rng WHERE NOT good OR lo < 1 OR hi > page_count OR lo > hi GROUP BY 1),
pg AS (SELECT request_id, i, p - 1 AS page_index FROM (SELECT *, unnest(range(lo, hi + 1)) AS p FROM rng WHERE request_id NOT IN (SELECT request_id FROM bad))),
fst AS (SELECT request_id, page_index, min(i * 1000 + page_index) AS o FROM pg GROUP BY 1, 2),
alls AS (SELECT request_id, unnest(range(0, page_count)) AS page_index FROM requests WHERE trim(selection) = '')
SELECT request_id, NULL AS error, cast(row_number() OVER (PARTITION BY request_id ORDER BY o) - 1 AS int) AS position, cast(page_index AS int) AS page_index FROM fst
UNION ALL SELECT request_id, NULL, cast(page_index AS int), cast(page_index AS int) FROM alls
UNION ALL SELECT request_id, error, NULL, NULL FROM bad""")
def g2(spark, sf):
    return P.parse_pages(_requests(spark, sf))


@query("g3_split_document", f"""WITH {fx.DOC_PAGES_SQL},
n AS (SELECT doc_id, count(*) AS n FROM doc_pages GROUP BY 1),
req AS (SELECT doc_id AS request_id, doc_id, n, CASE WHEN doc_id % 3 = 0 THEN [0, 0, doc_id % 4] END AS pages, doc_id % 5 - 1 AS a, 3 - doc_id % 4 AS b FROM n),
w AS (SELECT *, coalesce(pages, range(least(least(n, greatest(1, a)), least(n, greatest(1, b))) - 1, greatest(least(n, greatest(1, a)), least(n, greatest(1, b))))) AS want FROM req),
v AS (SELECT *, len(list_filter(want, lambda i: i >= n)) > 0 AS bad FROM w)
SELECT v.request_id, v.doc_id, NULL AS error, cast(u.i - 1 AS int) AS position, cast(u.p AS int) AS page_no, d.width, d.height
FROM v, unnest(want) WITH ORDINALITY AS u(p, i) JOIN doc_pages d ON d.doc_id = v.doc_id AND d.page_no = u.p WHERE NOT bad
UNION ALL SELECT request_id, doc_id, 'bad_pages', NULL, NULL, NULL, NULL FROM v WHERE bad""")
def g3(spark, sf):
    k = F.col("doc_id")
    req = table(spark, sf, "documents").select(
        k.alias("request_id"), "doc_id",
        F.when(k % 3 == 0, F.array(F.lit(0), F.lit(0), (k % 4).cast("int"))).alias("pages"),
        (k % 5 - 1).cast("int").alias("start"), (3 - k % 4).cast("int").alias("end"),
    )
    return P.split_document(req, fx.doc_pages(spark, sf))


_OPS_SQL = fx.ORDER_LINES_SQL + """,
page_ops AS (SELECT doc_id, rn AS op_no, CASE WHEN rn = 7 THEN 'reorder' WHEN rn % 2 = 0 THEN 'remove' ELSE 'rotate' END AS type,
  cast(part % 6 AS int) AS page_index, cast(90 * (1 + supp % 3) AS int) AS degrees, CASE WHEN rn = 7 THEN [4, 0, 1, 4, 9, 2, 3] END AS page_order FROM order_lines),
pg AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS page_no FROM (SELECT DISTINCT doc_id FROM order_lines)),
re AS (SELECT doc_id, max_by(page_order, op_no) AS o FROM page_ops WHERE type = 'reorder' GROUP BY 1),
seq AS (SELECT doc_id, p AS page_no, min(i) AS i FROM (SELECT doc_id, u.p, u.i FROM re, unnest(o) WITH ORDINALITY AS u(p, i)) WHERE p BETWEEN 0 AND 4 GROUP BY 1, 2
  UNION ALL SELECT doc_id, page_no, page_no FROM pg WHERE doc_id NOT IN (SELECT doc_id FROM re)
    AND (doc_id, page_no) NOT IN (SELECT (doc_id, page_index) FROM page_ops WHERE type = 'remove')),
pos AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position FROM seq)"""


def _organized(spark, sf):
    lines = fx.order_lines(spark, sf)
    rn = F.col("rn")
    ops = lines.select(
        "doc_id", rn.alias("op_no"),
        F.when(rn == 7, "reorder").when(rn % 2 == 0, "remove").otherwise("rotate").alias("type"),
        (F.col("part") % 6).cast("int").alias("page_index"), (90 * (1 + F.col("supp") % 3)).cast("int").alias("degrees"),
        F.when(rn == 7, F.array(*[F.lit(i) for i in (4, 0, 1, 4, 9, 2, 3)])).alias("page_order"),
    )
    pages = lines.select("doc_id").distinct().select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("page_no"), F.lit(0).alias("rotation")
    )
    return pages, P.organize_pages(pages, ops)


@query("g4_organize_pages", f"""WITH {_OPS_SQL}
SELECT p.doc_id, p.position, p.page_no, cast(coalesce((SELECT sum(degrees) FROM page_ops r WHERE r.doc_id = p.doc_id AND r.type = 'rotate' AND r.page_index = p.position), 0) % 360 AS int) AS rotation FROM pos p""")
def g4(spark, sf):
    return _organized(spark, sf)[1]


@query("g4_organize_status", f"""WITH {_OPS_SQL}
SELECT g.doc_id, count(p.page_no) AS pages, count(p.page_no) > 0 AS ok, CASE WHEN count(p.page_no) = 0 THEN 'nothing_left' END AS error
FROM (SELECT DISTINCT doc_id FROM pg) g LEFT JOIN pos p USING (doc_id) GROUP BY 1""")
def g4_status(spark, sf):
    return P.organize_status(*_organized(spark, sf))


@query("g5_move_page", f"""WITH {fx.DOC_PAGES_SQL},
mv AS (SELECT doc_id, max(page_no) AS last, doc_id % (max(page_no) + 1) AS f, (doc_id // 7) % (max(page_no) + 1) AS t FROM doc_pages GROUP BY 1),
r AS (SELECT d.doc_id, d.page_no, CASE WHEN d.page_no = f THEN t + CASE WHEN t >= f THEN 0.5 ELSE -0.5 END ELSE d.page_no END AS k FROM doc_pages d JOIN mv USING (doc_id))
SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS position FROM r""")
def g5(spark, sf):
    pages = fx.doc_pages(spark, sf)
    n = F.max("page_no") + 1
    moves = pages.groupBy("doc_id").agg(
        (F.col("doc_id") % n).alias("from"), (F.floor(F.col("doc_id") / 7) % n).alias("to")
    )
    return P.move_page(pages, moves)


@query("g6_number_pages", f"""WITH {fx.DOC_PAGES_SQL}
SELECT doc_id, page_no, (page_no + 3) || ' / ' || (count(*) OVER (PARTITION BY doc_id) + 2) AS label FROM doc_pages""")
def g6(spark, sf):
    return P.number_pages(fx.doc_pages(spark, sf), start=3)


@query("g9_keep_smaller", """SELECT o_orderkey AS doc_id, cast(floor(o_totalprice) AS bigint) AS original_bytes,
  CASE WHEN o_orderkey % 4 <> 0 AND o_orderstatus <> 'F' AND cast(floor(o_totalprice * (0.8 + (o_orderkey % 5) / 10.0)) AS bigint) < floor(o_totalprice)
    THEN cast(floor(o_totalprice * (0.8 + (o_orderkey % 5) / 10.0)) AS bigint) ELSE cast(floor(o_totalprice) AS bigint) END AS output_bytes,
  NOT (o_orderkey % 4 <> 0 AND o_orderstatus <> 'F' AND cast(floor(o_totalprice * (0.8 + (o_orderkey % 5) / 10.0)) AS bigint) < floor(o_totalprice)) AS original_retained FROM orders""")
def g9(spark, sf):
    o = table(spark, sf, "orders").withColumn("doc_id", F.col("o_orderkey"))
    originals = o.select("doc_id", F.floor("o_totalprice").alias("size"), (F.col("o_orderstatus") == "F").alias("signed"))
    new = F.floor(F.col("o_totalprice") * (0.8 + (F.col("o_orderkey") % 5) / 10.0))
    return P.keep_smaller(originals, o.where(F.col("doc_id") % 4 != 0).select("doc_id", new.alias("size")))


@query("ordering_chunked_position", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events")
def chunked(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    day = F.date_trunc("day", F.col("ts"))
    return chunked_position(e, ["user_id"], [F.col("ts"), F.col("event_id")], day, "position").drop("ts")


# ------------------------------------------------------------------ library

_LOG_SQL = """library_log AS (SELECT user_id AS lib_id, event_id AS seq, concat(event_type, '-', event_id, '.pdf') AS name, epoch_us(ts) AS created_at,
  cast(round(value * 100) AS bigint) * 1000 AS size, event_type <> 'error' AS stored FROM events)"""


def micros(ts: str = "ts"):
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def library_log(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("lib_id"), F.col("event_id").alias("seq"),
        F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("name"),
        micros().alias("created_at"), (F.round(F.col("value") * 100).cast("long") * 1000).alias("size"),
        (F.col("event_type") != "error").alias("stored"),
    )


@query("w17_retain_library", f"""WITH {_LOG_SQL},
r AS (SELECT *, row_number() OVER w AS rn, sum(CASE WHEN stored THEN size ELSE 0 END) OVER w AS total FROM library_log WHERE NOT stored OR size <= 50000000
  WINDOW w AS (PARTITION BY lib_id ORDER BY created_at DESC, seq DESC))
SELECT lib_id, seq, name, created_at, size, stored FROM r WHERE rn <= 20 AND total <= 50000000""")
def w17(spark, sf):
    return B.retain_library(library_log(spark, sf), max_items=20, max_bytes=50_000_000)


_OPS_LOG_SQL = """ops AS (SELECT user_id % 10 AS lib_id, event_id AS seq,
  CASE WHEN event_id % 1000 = 999 THEN 'clear' WHEN event_type = 'signup' THEN 'rename' WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS op,
  CASE WHEN event_type IN ('signup', 'error') THEN event_id - 1 - event_id % 3 ELSE event_id END AS item_id,
  concat(event_type, '-', event_id) AS name, epoch_us(ts) AS created_at, cast(round(value * 100) AS bigint) AS size FROM events)"""


def _ops(spark, sf):
    op = (
        F.when(F.col("event_id") % 1000 == 999, "clear").when(F.col("event_type") == "signup", "rename")
        .when(F.col("event_type") == "error", "delete").otherwise("save")
    )
    target = F.when(F.col("event_type").isin("signup", "error"), F.col("event_id") - 1 - F.col("event_id") % 3).otherwise(F.col("event_id"))
    return table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("lib_id"), F.col("event_id").alias("seq"), op.alias("op"), target.alias("item_id"),
        F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("name"), F.lit("application/pdf").alias("mime"),
        F.lit("view").alias("tool"), micros().alias("created_at"), F.round(F.col("value") * 100).cast("long").alias("size"),
    )


_STATE_SQL = _OPS_LOG_SQL + """,
live AS (SELECT s.lib_id, s.item_id, coalesce((SELECT max_by(r.name, r.seq) FROM ops r WHERE r.op = 'rename' AND r.lib_id = s.lib_id AND r.item_id = s.item_id AND r.seq > s.seq), s.name) AS name,
   s.created_at, s.size FROM ops s WHERE s.op = 'save'
   AND NOT EXISTS (SELECT 1 FROM ops d WHERE d.op = 'delete' AND d.lib_id = s.lib_id AND d.item_id = s.item_id AND d.seq > s.seq)
   AND NOT EXISTS (SELECT 1 FROM ops c WHERE c.op = 'clear' AND c.lib_id = s.lib_id AND c.seq > s.seq))"""


@query("w18_library_state", f"WITH {_STATE_SQL} SELECT *, 'application/pdf' AS mime, 'view' AS tool FROM live")
def w18(spark, sf):
    return B.library_state(_ops(spark, sf))


@query("t1_list_recents", f"WITH {_STATE_SQL} SELECT *, 'application/pdf' AS mime, 'view' AS tool FROM live ORDER BY lib_id, created_at DESC, item_id DESC")
def t1(spark, sf):
    return B.list_recents(B.library_state(_ops(spark, sf)))


@query("f2_name_search", f"WITH {_LOG_SQL} SELECT lib_id, seq, name FROM library_log WHERE contains(lower(name), 'click-1')")
def f2(spark, sf):
    return B.name_search(library_log(spark, sf), "CLICK-1").select("lib_id", "seq", "name")


_LEGACY_SQL = """legacy AS (SELECT user_id AS lib_id, CASE WHEN event_id % 17 <> 0 THEN cast(event_id AS varchar) END AS item_id, concat(event_type, CASE WHEN event_id % 2 = 0 THEN '.docx' ELSE '.pdf' END) AS name,
  CASE WHEN event_id % 3 = 0 THEN 'text/plain' WHEN event_id % 3 = 1 THEN '' END AS mime, (['merge', 'split', 'scan', 'fax', 'view'])[event_id % 5 + 1] AS tool, epoch_us(ts) AS created_at,
  event_id AS size, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 <> 1 THEN props END AS content FROM events),
valid AS (SELECT *, coalesce(length(content) > 0, false) AS stored FROM legacy WHERE item_id IS NOT NULL AND tool <> 'fax')"""


def _legacy(spark, sf):
    k = F.col("event_id")
    tools = F.array(*[F.lit(t) for t in ("merge", "split", "scan", "fax", "view")])
    return table(spark, sf, "events").select(
        F.col("user_id").alias("lib_id"), F.when(k % 17 != 0, k.cast("string")).alias("item_id"),
        F.concat("event_type", F.when(k % 2 == 0, ".docx").otherwise(".pdf")).alias("name"),
        F.when(k % 3 == 0, "text/plain").when(k % 3 == 1, "").alias("mime"), F.get(tools, (k % 5).cast("int")).alias("tool"),
        micros().alias("created_at"), k.alias("size"),
        F.when(k % 4 == 0, "").when(k % 4 != 1, F.col("props")).cast("binary").alias("content"),
    )


@query("w19_migrate_library", f"""WITH {_LEGACY_SQL}
SELECT lib_id, item_id, name, CASE WHEN coalesce(mime, '') <> '' THEN mime WHEN ends_with(name, '.docx') THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/pdf' END AS mime,
  tool, created_at, size, stored FROM valid""")
def w19(spark, sf):
    return B.migrate_library(_legacy(spark, sf))[0]


@query("w19_migrate_contents", f"WITH {_LEGACY_SQL} SELECT lib_id, item_id, content FROM valid WHERE stored")
def w19_contents(spark, sf):
    c = B.migrate_library(_legacy(spark, sf))[1]
    return c.withColumn("content", F.col("content").cast("string"))


# ------------------------------------------------------------------ search

PAGE_TEXT_SQL = fx.PROSE_GLYPHS_SQL + """,
page_text AS (SELECT doc_id, page_no, trim(regexp_replace(string_agg(str, ' ' ORDER BY glyph_no), '\\s+', ' ', 'g')) AS text FROM glyphs GROUP BY 1, 2)"""


@query("q1_page_text", f"WITH {PAGE_TEXT_SQL} SELECT * FROM page_text")
def q1(spark, sf):
    return S.page_text(fx.prose_glyphs(spark, sf))


_HITS_SQL = "hits AS (SELECT doc_id, page_no, cast((length(text) - length(replace(lower(text), 'th', ''))) // 2 AS bigint) AS hits FROM page_text WHERE contains(lower(text), 'th'))"


@query("q2_search_pages", f"WITH {PAGE_TEXT_SQL}, {_HITS_SQL} SELECT * FROM hits")
def q2(spark, sf):
    return S.search_pages(S.page_text(fx.prose_glyphs(spark, sf)), " TH ")


@query("q3_search_totals", f"WITH {PAGE_TEXT_SQL}, {_HITS_SQL} SELECT doc_id, cast(sum(hits) AS bigint) AS matches, count(*) AS pages FROM hits GROUP BY 1")
def q3(spark, sf):
    return S.search_totals(S.search_pages(S.page_text(fx.prose_glyphs(spark, sf)), "th"))


@query("q2_search_documents", """SELECT doc_id, 0 AS page_no, (length(text) - length(replace(lower(text), 'the', ''))) // 3 AS hits FROM documents WHERE contains(lower(text), 'the')""")
def q2_docs(spark, sf):
    return S.search_pages(table(spark, sf, "documents").select("doc_id", F.lit(0).alias("page_no"), "text"), "the")


@query("q4_mark_items", f"WITH {fx.PROSE_GLYPHS_SQL} SELECT doc_id, glyph_no, contains(lower(str), 'tion') AS is_hit FROM glyphs")
def q4(spark, sf):
    return S.mark_items(fx.prose_glyphs(spark, sf), "tion").select("doc_id", "glyph_no", "is_hit")


@query("f1_prefix_search", """WITH h AS (SELECT doc_id, list_filter(string_split_regex(lower(text || ' ' || lang), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents)
SELECT doc_id FROM h WHERE len(list_filter(ws, lambda w: starts_with(w, 'the'))) > 0 AND len(list_filter(ws, lambda w: starts_with(w, 'en'))) > 0""")
def f1(spark, sf):
    return S.prefix_search(table(spark, sf, "documents"), ["text", "lang"], "The, en!").select("doc_id")


# ------------------------------------------------------------------ admission

_BIG = 400


@query("f6_input_budget", f"""WITH {FILES_SQL} SELECT batch_id, count(*) AS files, cast(sum(size) AS bigint) AS bytes, NOT (count(*) > 30 OR sum(size) > 130000) AS ok,
  CASE WHEN count(*) > 30 OR sum(size) > 130000 THEN 'over_budget' END AS error FROM files GROUP BY 1""")
def f6(spark, sf):
    return A.input_budget(files(spark, sf), max_files=30, max_bytes=130_000)


@query("f6_scan_budget", f"""WITH {FILES_SQL},
s AS (SELECT file_id // 9 AS batch_id, CASE WHEN file_id % 50 = 0 THEN 0 ELSE size END AS size, CASE WHEN file_id % 2 = 0 THEN size ELSE 0 END AS kept FROM files)
SELECT batch_id, count(*) AS files, cast(sum(size + kept) AS bigint) AS bytes, NOT (count(*) FILTER (size = 0) > 0 OR count(*) > 8 OR sum(size + kept) > 60000) AS ok,
  CASE WHEN count(*) FILTER (size = 0) > 0 THEN 'empty_page' WHEN count(*) > 8 OR sum(size + kept) > 60000
   THEN 'over_budget' END AS error FROM s GROUP BY 1""")
def f6_scan(spark, sf):
    k = F.col("file_id")
    s = files(spark, sf).select(
        F.floor(k / 9).alias("batch_id"), F.when(k % 50 == 0, 0).otherwise(F.col("size")).alias("size"),
        F.col("size").alias("original_size"), (k % 2 == 0).alias("original_distinct"),
    )
    return A.scan_budget(s, max_pages=8, max_bytes=60_000)


@query("f7_input_kind_check", f"""WITH {MIMED_SQL},
b AS (SELECT file_id // 2 AS batch_id, count(*) AS files, count(*) FILTER (mime = 'application/pdf' OR regexp_matches(name, '(?i)\\.pdf$')) AS pdfs, count(*) FILTER (starts_with(kind, 'image/')) AS images FROM mimed GROUP BY 1),
e AS (SELECT *, CASE WHEN pdfs > 0 AND files <> 1 THEN 'mixed_kinds' WHEN pdfs = 0 AND images < files THEN 'unsupported_kind' END AS error FROM b)
SELECT *, error IS NULL AS ok FROM e""")
def f7(spark, sf):
    f = files(spark, sf).withColumn("batch_id", F.floor(F.col("file_id") / 2))
    return A.input_kind_check(f)


_ENTRIES_SQL = "entries AS (SELECT event_type || props AS name, CASE WHEN event_id % 5 = 0 THEN 'file' ELSE 'directory' END AS type, epoch_us(ts) // 1000 AS mtime, event_id FROM events)"


@query("f8_stale_exports", """WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN concat(event_type, '/', event_id) ELSE concat(event_type, '-', event_id) END AS name,
  CASE WHEN event_id % 5 = 0 THEN 'file' ELSE 'directory' END AS type, epoch_us(ts) // 1000 AS mtime FROM events)
SELECT name, mtime FROM e WHERE type = 'directory' AND mtime < 1705312800000 - 3600000 AND regexp_matches(name, '^[a-zA-Z0-9-]+$')""")
def f8(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "/").otherwise("-"), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("event_id") % 5 == 0, "file").otherwise("directory").alias("type"),
        F.floor(micros() / 1000).alias("mtime"),
    )
    return A.stale_exports(e, F.lit(1705312800000)).select("name", "mtime")


_RESULTS_SQL = """results AS (SELECT user_id AS source_id, event_id AS seq, epoch_us(ts) // 1000 AS started, epoch_us(ts) // 1000 + cast(floor(value) AS bigint) AS shown_at,
  event_id % 3 AS generation, user_id % 3 AS current_generation FROM events)"""


def results(spark, sf):
    started = F.floor(micros() / 1000)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), started.alias("started"),
        (started + F.floor("value")).alias("shown_at"), (F.col("event_id") % 3).alias("generation"), (F.col("user_id") % 3).alias("current_generation"),
    )


@query("f9_drop_stale", f"WITH {_RESULTS_SQL} SELECT * FROM results WHERE generation = current_generation AND shown_at - started <= 150")
def f9(spark, sf):
    return A.drop_stale(results(spark, sf))


@query("r5_latest_only", f"""WITH {_RESULTS_SQL}, l AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started DESC, seq DESC) = 1)
SELECT * FROM l WHERE generation = current_generation AND shown_at - started <= 150""")
def r5(spark, sf):
    return A.drop_stale(A.latest_only(results(spark, sf)))


@query("s7_export_manifest", f"""WITH {fx.DOC_PAGES_SQL},
e AS (SELECT d.doc_id, p.page_no AS ord, d.source || ' ' || d.lang || '.final.pdf' AS basename, (['image/png', 'image/jpg', '', 'image/webp'])[(p.page_no + d.doc_id) % 4 + 1] AS mime, d.n_chars * 9000 AS size FROM documents d JOIN doc_pages p USING (doc_id)),
s AS (SELECT *, regexp_replace(basename, '\\.[^.]+$', '') AS stem, count(*) OVER (PARTITION BY doc_id) AS files, sum(size) OVER (PARTITION BY doc_id) AS bytes FROM e)
SELECT doc_id, ord, stem || '-' || CASE WHEN ord < 9 THEN '0' ELSE '' END || (ord + 1) || '.' || CASE mime WHEN 'image/png' THEN 'png' WHEN 'image/webp' THEN 'webp' ELSE 'jpg' END AS filename,
  CASE WHEN files > 1 THEN stem || '.zip' END AS archive, files, cast(bytes AS bigint) AS bytes, NOT (files > 1 AND (files > 200 OR bytes > 67108864)) AS ok,
  CASE WHEN files > 1 AND files > 200 THEN 'too many files' WHEN files > 1 AND bytes > 67108864 THEN 'too large' END AS error FROM s""")
def s7(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("", "source", F.lit(" "), "lang", F.lit(".final.pdf")).alias("basename"), (F.col("n_chars") * 9000).alias("size")
    )
    mimes = F.array(*[F.lit(m) for m in ("image/png", "image/jpg", "", "image/webp")])
    e = fx.doc_pages(spark, sf).select("doc_id", F.col("page_no").alias("ord")).join(d, "doc_id").withColumn(
        "mime", F.get(mimes, ((F.col("ord") + F.col("doc_id")) % 4).cast("int"))
    )
    return A.export_manifest(e, ascii_only=True)


@query("s5_docx_admission", """WITH e AS (SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 19 <> 0 THEN l_linenumber END AS entry_no,
  cast(l_quantity * 800000 AS bigint) AS size, l_orderkey % 13 = 0 AND l_linenumber = 2 AS damaged FROM lineitem),
g AS (SELECT doc_id, count(entry_no) AS parts, max(size) AS m, cast(sum(size) AS bigint) AS expanded, bool_or(damaged) AS d FROM e GROUP BY 1),
r AS (SELECT doc_id, parts, expanded, CASE WHEN parts = 0 THEN 'not_an_archive' WHEN parts > 9 THEN 'too_many_parts'
  WHEN d THEN 'damaged' WHEN m > 33554432 OR expanded > 134217728 THEN 'too_large' END AS error FROM g)
SELECT *, error IS NULL AS ok FROM r""")
def s5(spark, sf):
    k = F.col("l_orderkey")
    e = table(spark, sf, "lineitem").select(
        k.alias("doc_id"), F.when(k % 19 != 0, F.col("l_linenumber")).alias("entry_no"), (F.col("l_quantity") * 800000).cast("long").alias("size"),
        ((k % 13 == 0) & (F.col("l_linenumber") == 2)).alias("damaged"),
    )
    return A.docx_admission(e, max_entries=9)


# ------------------------------------------------------------------ images

_IMAGES_SQL = """images AS (SELECT p_partkey // 40 AS doc_id, p_partkey AS obj_id, p_size * 100 AS width, cast(floor(p_retailprice) AS int) AS height,
  CASE p_partkey % 3 WHEN 0 THEN 'DCT' WHEN 1 THEN 'Flate' ELSE 'JPX' END AS filter, cast(floor(p_size * 100 * floor(p_retailprice) / (1 + p_size % 5)) AS bigint) AS bytes,
  CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END AS components, CASE WHEN p_partkey % 11 = 0 THEN p_partkey - 1 END AS mask_ref,
  p_size % 23 = 0 AS stencil, p_partkey % 7 = 1 AS few_colours FROM part)"""


def _images(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        F.floor(k / 40).alias("doc_id"), k.alias("obj_id"), (s * 100).alias("width"), F.floor("p_retailprice").cast("int").alias("height"),
        F.when(k % 3 == 0, "DCT").when(k % 3 == 1, "Flate").otherwise("JPX").alias("filter"),
        F.floor(s * 100 * F.floor("p_retailprice") / (1 + s % 5)).alias("bytes"), F.when(k % 2 == 0, 3).otherwise(1).alias("components"),
        F.when(k % 11 == 0, k - 1).alias("mask_ref"), (s % 23 == 0).alias("stencil"), (k % 7 == 1).alias("few_colours"),
    )


@query("j5_exclude_masks", f"WITH {_IMAGES_SQL} SELECT doc_id, obj_id FROM images i WHERE NOT EXISTS (SELECT 1 FROM images m WHERE m.doc_id = i.doc_id AND m.mask_ref = i.obj_id)")
def j5(spark, sf):
    return I.exclude_masks(_images(spark, sf)).select("doc_id", "obj_id")


@query("f4_recompress_candidates", f"""WITH {_IMAGES_SQL}, {fx.DOC_PAGES_SQL},
side AS (SELECT doc_id, max(greatest(width, height)) AS side FROM doc_pages GROUP BY 1),
c AS (SELECT i.*, cast(width AS double) * height AS px, greatest(256, floor(greatest(1, coalesce(side, 1)) / 72 * 150 + 0.5)) AS mx FROM images i LEFT JOIN side USING (doc_id)
  WHERE NOT stencil AND filter IN ('DCT', 'Flate') AND NOT EXISTS (SELECT 1 FROM images m WHERE m.doc_id = i.doc_id AND m.mask_ref = i.obj_id)),
s AS (SELECT *, least(1.0, mx / greatest(width, height), sqrt(50000000.0 / px)) AS sc FROM c WHERE px >= 25600 AND px <= CASE WHEN filter = 'DCT' THEN 120000000 ELSE 40000000 END)
SELECT doc_id, obj_id, cast(sc AS double) AS scale, cast(greatest(1, floor(width * sc + 0.5)) AS bigint) AS target_width, cast(greatest(1, floor(height * sc + 0.5)) AS bigint) AS target_height FROM s
WHERE NOT (filter = 'DCT' AND sc > 0.9 AND bytes / px < 0.5) AND NOT (filter = 'Flate' AND few_colours)""")
def f4(spark, sf):
    return I.recompress_candidates(_images(spark, sf), fx.doc_pages(spark, sf), "balanced")


@query("g9_keep_smaller_images", f"WITH {_IMAGES_SQL} SELECT doc_id, obj_id, width * height < bytes * 0.9 AS replaced FROM images")
def g9_images(spark, sf):
    c = _images(spark, sf).withColumn("new_bytes", F.col("width") * F.col("height"))
    return I.keep_smaller_images(c).select("doc_id", "obj_id", "replaced")


@query("a14_compression_report", f"""WITH {_IMAGES_SQL},
d AS (SELECT doc_id, sum(bytes) AS o, sum(CASE WHEN width * height < bytes * 0.9 THEN width * height ELSE bytes END) + 100000 AS n, count(*) FILTER (width * height < bytes * 0.9) AS k FROM images GROUP BY 1)
SELECT doc_id, cast(o AS bigint) AS original_bytes, cast(least(o, n) AS bigint) AS output_bytes, CASE WHEN k > 0 THEN 'images' ELSE 'lossless' END AS mode, n >= o AS original_retained, k AS images_recompressed FROM d""")
def a14(spark, sf):
    c = I.keep_smaller_images(_images(spark, sf).withColumn("new_bytes", (F.col("width") * F.col("height")).cast("long")))
    d = c.groupBy("doc_id").agg(
        F.sum("bytes").alias("original_bytes"),
        (F.sum(F.when(F.col("replaced"), F.col("new_bytes")).otherwise(F.col("bytes"))) + 100000).alias("output_bytes"),
        F.count_if("replaced").alias("images_recompressed"),
    )
    return I.compression_report(d)


@query("a9_otsu_threshold", """WITH h AS (SELECT l_returnflag AS g, cast(floor(l_quantity) AS int) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w AS c, sum(n * v) OVER w AS l, sum(n) OVER (PARTITION BY g) AS a, sum(n * v) OVER (PARTITION BY g) AS s FROM h WINDOW w AS (PARTITION BY g ORDER BY v)),
t AS (SELECT *, cast(c AS double) * (a - c) * power(l / c - (s - l) / (a - c), 2) AS score FROM c WHERE c < a)
SELECT g, v AS threshold FROM t QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, v) = 1""")
def a9(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.floor("l_quantity").cast("int").alias("v"))
    return I.otsu_threshold(v, ["g"], "v")


@query("a10_few_distinct", """WITH ch AS (SELECT doc_id, u.i - 1 AS i, u.c, length(text) AS n FROM documents, unnest(string_split(text, '')) WITH ORDINALITY AS u(c, i))
SELECT doc_id, count(DISTINCT c) < 96 AS few_colours FROM ch WHERE i % greatest(1, n // 40000) = 0 GROUP BY 1""")
def a10(spark, sf):
    ch = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "")).alias("i", "c"))
    return I.few_distinct(ch, ["doc_id"], "c", "i")


_CAND_SQL = fx.ORDER_LINES_SQL + """,
cand AS (SELECT doc_id AS frame_id, rn AS cand_no, qty / 120 AS area, CASE WHEN rn = 3 THEN 5 ELSE 4 END AS points, part % 9 <> 0 AS plausible, 1 - tax * 6 AS support, disc * 5 AS contrast FROM order_lines)"""


@query("t2_best_candidate", f"""WITH {_CAND_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, cand_no) AS rank FROM cand WHERE area BETWEEN 0.12 AND 0.93),
s AS (SELECT *, support * 0.62 + sqrt(area) * 0.18 + contrast * 0.20 AS score FROM r WHERE rank <= 16 AND points = 4 AND plausible AND support >= 0.55)
SELECT frame_id, cand_no, score FROM s QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, rank) = 1""")
def t2(spark, sf):
    c = fx.order_lines(spark, sf).select(
        F.col("doc_id").alias("frame_id"), F.col("rn").alias("cand_no"), (F.col("qty") / 120).alias("area"),
        F.when(F.col("rn") == 3, 5).otherwise(4).alias("points"), (F.col("part") % 9 != 0).alias("plausible"),
        (1 - F.col("tax") * 6).alias("support"), (F.col("disc") * 5).alias("contrast"),
    )
    return I.best_candidate(c)

"""Scalar function queries (P1 to P24) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafline.catalog import fixtures as fx
from leafline.catalog.registry import query, table
from leafline.functions import files as ff
from leafline.functions import geometry as geo
from leafline.functions import text as tx
from leafline.functions import word as wd
from leafline.operators.paragraphs import line_alignment

# Names of every kind, derived from the page addresses.
_EXTENSIONS = ["pdf", "PDF", "docx", "doc", "zip", "png", "jpg", "jpeg", "webp", "avif", "gif", "bmp", "tif", "tiff",
               "heic", "heif", "svg", "txt", "xyz"]
_MIMES = [" Image/JPG ", "application/octet-stream", "", "application/pdf", "application/x-zip-compressed", "image/png"]

FILES_SQL = f"""
files AS (
  SELECT page_id AS file_id, page_id % 10 AS batch_id, url,
    url || '.' || ([{', '.join("'" + e + "'" for e in _EXTENSIONS)}])[page_id % {len(_EXTENSIONS)} + 1] AS name,
    ([{', '.join("'" + m + "'" for m in _MIMES)}])[page_id % {len(_MIMES)} + 1] AS mime,
    length(html) AS size, html
  FROM pages)"""


def files(spark, sf):
    def pick(values):
        return F.get(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % len(values)).cast("int"))

    return table(spark, sf, "pages").select(
        F.col("page_id").alias("file_id"), (F.col("page_id") % 10).alias("batch_id"), "url",
        F.concat("url", F.lit("."), pick(_EXTENSIONS)).alias("name"), pick(_MIMES).alias("mime"),
        F.length("html").cast("long").alias("size"), "html",
    )


_MIME_CASE = """CASE WHEN ext = 'pdf' THEN 'application/pdf' WHEN ext = 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  WHEN ext = 'doc' THEN 'application/msword' WHEN ext = 'zip' THEN 'application/zip' WHEN ext = 'png' THEN 'image/png'
  WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext IN ('webp', 'avif', 'gif', 'bmp', 'heic', 'heif') THEN 'image/' || ext
  WHEN ext IN ('tif', 'tiff') THEN 'image/tiff' WHEN ext = 'svg' THEN 'image/svg+xml' WHEN ext = 'txt' THEN 'text/plain'
  ELSE 'application/octet-stream' END"""

MIMED_SQL = FILES_SQL + f""",
named AS (SELECT *, lower(regexp_extract(name, '\\.([A-Za-z]+)$', 1)) AS ext, lower(trim(mime)) AS supplied FROM files),
mimed AS (SELECT *, CASE WHEN supplied = 'image/jpg' THEN 'image/jpeg' WHEN supplied = 'application/x-zip-compressed' THEN 'application/zip'
  WHEN supplied NOT IN ('', 'application/octet-stream') THEN supplied ELSE {_MIME_CASE} END AS kind FROM named)"""


@query("p1_normalize_mime", f"WITH {MIMED_SQL} SELECT file_id, kind FROM mimed")
def p1(spark, sf):
    return files(spark, sf).select("file_id", ff.normalize_mime(F.col("name"), F.col("mime")).alias("kind"))


@query("p2_extension_for_mime", f"""WITH {MIMED_SQL},
t(kind, extension) AS (VALUES ('application/pdf','pdf'), ('application/vnd.openxmlformats-officedocument.wordprocessingml.document','docx'),
 ('application/msword','doc'), ('application/zip','zip'), ('image/png','png'), ('image/jpeg','jpg'), ('image/webp','webp'), ('image/avif','avif'),
 ('image/gif','gif'), ('image/bmp','bmp'), ('image/tiff','tiff'), ('image/heic','heic'), ('image/heif','heif'), ('image/svg+xml','svg'), ('text/plain','txt'))
SELECT file_id, coalesce(extension, 'bin') AS extension FROM mimed LEFT JOIN t USING (kind)""")
def p2(spark, sf):
    kind = ff.normalize_mime(F.col("name"), F.col("mime"))
    return files(spark, sf).select("file_id", ff.extension_for_mime(kind).alias("extension"))


_SAFE_SQL = """
leafs AS (SELECT id, regexp_extract(raw, '([^/\\\\]*)$', 1) AS leaf FROM raws),
cleaned AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(leaf, '[\\x00-\\x1F\\x7F]+', '_', 'g'), '[<>:"/\\\\|?*]+', '_', 'g'), '[. ]+$', '')) AS c FROM leafs),
safe0 AS (SELECT id, CASE WHEN c IN ('', '.', '..') THEN 'export' ELSE c END AS s FROM cleaned),
safe AS (SELECT id, CASE WHEN length(s) <= 120 THEN s
   WHEN instr(s, '.') = 0 OR strpos(reverse(s), '.') > 16 OR strpos(reverse(s), '.') = length(s) THEN s[1:120]
   ELSE s[1:120 - strpos(reverse(s), '.')] || right(s, strpos(reverse(s), '.')) END AS safe FROM safe0)"""


@query("p3_sanitize_filename", f"""
WITH raws AS (SELECT doc_id AS id, nfc_normalize(text) || CASE WHEN doc_id % 3 = 0 THEN '.pdf' WHEN doc_id % 3 = 1 THEN '. .' ELSE '' END AS raw FROM documents
  UNION ALL SELECT page_id + 1000000000, url || '.pdf' FROM pages), {_SAFE_SQL}
SELECT id, safe, CASE WHEN regexp_replace(safe, '\\.[^.]+$', '') = '' THEN 'export' ELSE regexp_replace(safe, '\\.[^.]+$', '') END AS stem FROM safe""")
def p3(spark, sf):
    suffix = F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ". .").otherwise("")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("text", suffix).alias("raw"))
    urls = table(spark, sf, "pages").select((F.col("page_id") + 1000000000).alias("id"), F.concat("url", F.lit(".pdf")).alias("raw"))
    raw = F.col("raw")
    return texts.unionByName(urls).select(
        "id", ff.sanitize_filename(raw).alias("safe"), ff.filename_stem(raw, "export").alias("stem")
    )


@query("p4_swap_extension", f"""WITH {FILES_SQL},
b AS (SELECT file_id, regexp_extract(name, '([^/\\\\]*)$', 1) AS base FROM files)
SELECT file_id, CASE WHEN trim(regexp_replace(base, '(?i)\\.pdf$', '')) = '' THEN 'document' ELSE trim(regexp_replace(base, '(?i)\\.pdf$', '')) END || '.docx' AS docx_name,
  CASE WHEN trim(regexp_replace(base, '(?i)\\.docx$', '')) = '' THEN 'document' ELSE trim(regexp_replace(base, '(?i)\\.docx$', '')) END || '.pdf' AS pdf_name FROM b""")
def p4(spark, sf):
    return files(spark, sf).select(
        "file_id", ff.swap_extension(F.col("name"), "pdf", "docx").alias("docx_name"),
        ff.swap_extension(F.col("name"), "docx", "pdf").alias("pdf_name"),
    )


@query("p7_clean_text", "SELECT doc_id, trim(regexp_replace(text, '[\\t\\r\\n ]+', ' ', 'g')) AS cleaned FROM documents")
def p7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query("p8_xml_escape", """SELECT page_id, replace(replace(replace(replace(
  regexp_replace(html || chr(1) || chr(31) || chr(9), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def p8(spark, sf):
    dirty = F.concat("html", F.lit("\x01\x1f\t"))
    return table(spark, sf, "pages").select("page_id", tx.xml_escape(dirty).alias("escaped"))


_FONT_NAMES = ["ABCDEF+Helvetica-Bold", "'Times New Roman', serif", "sans-serif", "Courier", '"Georgia", serif', "", "XYZ+Short",
               "QWERTY+Minion-SemiBoldItalic", "monospace", "serif", "Noto Sans Oblique", "BlackAdder"]
_FONTS_SQL = f"""fonts AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 12 THEN p_brand || ' ' || p_type ELSE
  ([{', '.join("'" + n.replace("'", "''") + "'" for n in _FONT_NAMES)}])[p_partkey % 13 + 1] END AS font, p_size % 5 = 0 AS flag FROM part)"""


def _fonts(spark, sf):
    names = F.array(*[F.lit(n) for n in _FONT_NAMES])
    pick = F.when(F.col("p_partkey") % 13 == 12, F.concat_ws(" ", "p_brand", "p_type")).otherwise(
        F.get(names, (F.col("p_partkey") % 13).cast("int"))
    )
    return table(spark, sf, "part").select("p_partkey", pick.alias("font"), (F.col("p_size") % 5 == 0).alias("flag"))


@query("p9_normalize_font", f"""WITH {_FONTS_SQL},
f AS (SELECT p_partkey, regexp_replace(trim(replace(replace(split_part(font, ',', 1), '"', ''), '''', '')), '^[A-Z]{{6}}\\+', '') AS n FROM fonts)
SELECT p_partkey, CASE WHEN n = '' THEN 'Arial' WHEN regexp_matches(n, '(?i)helvetica|sans-serif') THEN 'Arial'
  WHEN regexp_matches(n, '(?i)times|serif') THEN 'Times New Roman' WHEN regexp_matches(n, '(?i)courier|monospace') THEN 'Courier New' ELSE n[1:80] END AS family FROM f""")
def p9(spark, sf):
    return _fonts(spark, sf).select("p_partkey", tx.normalize_font(F.col("font")).alias("family"))


@query("p10_font_flags", f"""WITH {_FONTS_SQL}
SELECT p_partkey, flag OR regexp_matches(font, '(?i)bold|black|heavy|semibold|demi') AS bold, regexp_matches(font, '(?i)italic|oblique') AS italic FROM fonts""")
def p10(spark, sf):
    font = F.col("font")
    return _fonts(spark, sf).select("p_partkey", tx.is_bold(font, F.col("flag")).alias("bold"), tx.is_italic(font).alias("italic"))


@query("p11_list_marker", f"""WITH {fx.LIST_LINES_SQL},
m AS (SELECT doc_id, line_no, regexp_extract(text, '^\\s*(\\d{{1,3}})[.)]\\s+') AS num, regexp_extract(text, '^\\s*[•●◦▪‣–—-]\\s+') AS bul, text FROM lines)
SELECT doc_id, line_no, CASE WHEN num <> '' THEN 'number' WHEN bul <> '' THEN 'bullet' END AS kind,
  CASE WHEN num <> '' THEN length(num) WHEN bul <> '' THEN length(bul) END AS prefix_len,
  CASE WHEN num <> '' THEN cast(regexp_extract(num, '\\d+') AS int) END AS start FROM m""")
def p11(spark, sf):
    return fx.list_lines(spark, sf).select("doc_id", "line_no", tx.list_marker(F.col("text")).alias("m")).select("doc_id", "line_no", "m.*")


@query("p12_is_numeric_cell", """WITH c AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 6 WHEN 0 THEN '(' || cast(l_partkey AS varchar) || ')' WHEN 1 THEN '$ ' || cast(l_suppkey AS varchar) || ',000.50'
    WHEN 2 THEN '-' || cast(l_linenumber AS varchar) || '%' WHEN 3 THEN l_returnflag || cast(l_partkey AS varchar) WHEN 4 THEN cast(l_suppkey AS varchar) || ' kg' ELSE '€12/07-' || cast(l_suppkey AS varchar) END AS cell FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cell, regexp_matches(cell, '^\\(?\\s*[-+]?[$£€¥]?\\s*\\d[\\d\\s,.%/-]*\\)?$') AS numeric FROM c""")
def p12(spark, sf):
    k = F.col("l_partkey") % 6
    part, supp, no = (F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    cell = (
        F.when(k == 0, F.concat(F.lit("("), part, F.lit(")"))).when(k == 1, F.concat(F.lit("$ "), supp, F.lit(",000.50")))
        .when(k == 2, F.concat(F.lit("-"), no, F.lit("%"))).when(k == 3, F.concat("l_returnflag", part))
        .when(k == 4, F.concat(supp, F.lit(" kg"))).otherwise(F.concat(F.lit("€12/07-"), supp))
    )
    c = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cell.alias("cell"))
    return c.withColumn("numeric", tx.is_numeric_cell(F.col("cell")))


_MIXED_SQL = """mixed AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || ' שלום' WHEN 1 THEN chr(160) || text || chr(8203) || chr(9) || chr(8239)
   WHEN 2 THEN text || ' 漢字' || chr(13) || chr(2) WHEN 3 THEN text || ' ‘quoted’ €' ELSE text END AS text FROM documents)"""


def _mixed(spark, sf):
    k = F.col("doc_id") % 5
    text = (
        F.when(k == 0, F.concat("text", F.lit(" שלום")))
        .when(k == 1, F.concat(F.lit(" "), "text", F.lit("​\t ")))
        .when(k == 2, F.concat("text", F.lit(" 漢字\r\x02"))).when(k == 3, F.concat("text", F.lit(" ‘quoted’ €"))).otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


@query("p13_is_rtl_text", f"WITH {_MIXED_SQL} SELECT doc_id, regexp_matches(text, '[\\x{{0590}}-\\x{{08FF}}]') AS rtl FROM mixed")
def p13(spark, sf):
    return _mixed(spark, sf).select("doc_id", tx.is_rtl_text(F.col("text")).alias("rtl"))


_STYLE_NAMES = ["Title", "Heading 1", "heading_2", "Subtitle", "HEADING-3", "Heading 7", "My heading 2 x", "Normal"]
_STYLES_SQL = f"""styles AS (SELECT c_custkey, ([{', '.join("'" + n + "'" for n in _STYLE_NAMES)}])[c_custkey % 8 + 1] AS name, c_mktsegment AS style_id,
  CASE WHEN c_custkey % 3 = 0 THEN c_nationkey % 5 END AS outline, CASE WHEN c_custkey % 4 <> 0 THEN floor(c_acctbal / 200) END AS run_pt FROM customer)"""


@query("p15_heading_level", f"""WITH {_STYLES_SQL},
n AS (SELECT *, regexp_replace(lower(trim(name)), '[_-]+', ' ', 'g') AS v FROM styles),
h AS (SELECT c_custkey, run_pt, coalesce(CASE WHEN v IN ('title', 'heading 1', 'heading1') THEN 1 WHEN v IN ('subtitle', 'heading 2', 'heading2') THEN 2
   WHEN v IN ('heading 3', 'heading3') THEN 3 WHEN regexp_extract(v, 'heading\\s*(\\d)', 1) IN ('1','2','3') THEN cast(regexp_extract(v, 'heading\\s*(\\d)', 1) AS int) END,
   CASE WHEN outline <= 2 THEN outline + 1 END) AS level FROM n)
SELECT c_custkey, level, CASE level WHEN 1 THEN 18.0::double WHEN 2 THEN 14.0::double WHEN 3 THEN 12.0::double END AS heading_pt,
  cast(CASE WHEN level IS NOT NULL THEN CASE WHEN run_pt IS NULL THEN (CASE level WHEN 1 THEN 18 WHEN 2 THEN 14 ELSE 12 END)
     ELSE least(36, greatest(8, greatest(run_pt, CASE level WHEN 1 THEN 18 WHEN 2 THEN 14 ELSE 12 END))) END
   WHEN run_pt IS NULL THEN 11 ELSE least(28, greatest(8, run_pt)) END AS double) AS size_pt FROM h""")
def p15(spark, sf):
    names = F.array(*[F.lit(n) for n in _STYLE_NAMES])
    c = table(spark, sf, "customer").select(
        "c_custkey", F.get(names, (F.col("c_custkey") % 8).cast("int")).alias("name"), F.col("c_mktsegment").alias("style_id"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") % 5).alias("outline"),
        F.when(F.col("c_custkey") % 4 != 0, F.floor(F.col("c_acctbal") / 200).cast("double")).alias("run_pt"),
    ).withColumn("level", wd.heading_level(F.col("name"), F.col("style_id"), F.col("outline")))
    return c.select(
        "c_custkey", "level", wd.heading_size(F.col("level")).alias("heading_pt"),
        wd.resolve_size(F.col("run_pt"), F.lit(11.0), F.col("level")).alias("size_pt"),
    )


_WIN = "\\n\\x20-\\x7E\\x{A0}-\\x{FF}" + tx.CP1252_EXTRA
SPACED_SQL = _MIXED_SQL + """,
spaced AS (SELECT doc_id, text, regexp_replace(replace(regexp_replace(regexp_replace(text, '[\\x{00A0}\\x{2002}\\x{2003}\\x{2009}\\x{202F}]', ' ', 'g'),
  '[\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}\\x{00AD}]', '', 'g'), chr(9), '    '), '[\\x00-\\x09\\x0B-\\x1F]', '', 'g') AS plain FROM mixed)"""


@query("p18_map_text", f"WITH {SPACED_SQL} SELECT doc_id, regexp_replace(plain, '[^{_WIN}]', '?', 'g') AS mapped FROM spaced")
def p18(spark, sf):
    return _mixed(spark, sf).select("doc_id", tx.map_text(F.col("text")).alias("mapped"))


@query("a11_glyph_coverage", f"""WITH {SPACED_SQL}
SELECT doc_id, cast(sum(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) AS bigint) AS letters, cast(sum(length(regexp_replace(plain, '[{_WIN}]', '', 'g'))) AS bigint) AS replaced,
  sum(length(regexp_replace(plain, '[{_WIN}]', '', 'g'))) = 0 AS ok FROM spaced GROUP BY doc_id""")
def a11(spark, sf):
    from leafline.operators.word import glyph_coverage

    return glyph_coverage(_mixed(spark, sf)).select("doc_id", "letters", "replaced", "ok")


# Quads: a skewed square per line item, some outside the unit square, some folded.
_QUADS_SQL = """quads AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  0.1 + l_discount AS x0, 0.1 + l_tax AS y0, 0.5 + l_quantity / 90 AS x1, 0.15 AS y1,
  0.6 + l_discount * 2 AS x2, 0.3 + l_quantity / 70 AS y2, CASE WHEN l_partkey % 7 = 0 THEN 0.9 ELSE 0.12 END AS x3, 0.4 + l_tax * 3 AS y3 FROM lineitem)"""


def _quads(spark, sf):
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")

    def p(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    points = F.array(
        p(0.1 + d, 0.1 + t), p(0.5 + q / 90, F.lit(0.15)), p(0.6 + d * 2, 0.3 + q / 70),
        p(F.when(F.col("l_partkey") % 7 == 0, 0.9).otherwise(0.12), 0.4 + t * 3),
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", points.alias("points"))


def _cross(a, b, c):
    return f"((x{b}-x{a})*(y{c}-y{b})-(y{b}-y{a})*(x{c}-x{b}))"


@query("p20_valid_quad", f"""WITH {_QUADS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(x0,x1,x2,x3,y0,y1,y2,y3) >= 0 AND greatest(x0,x1,x2,x3,y0,y1,y2,y3) <= 1
  AND {_cross(0,1,2)} > 0.0001 AND {_cross(1,2,3)} > 0.0001 AND {_cross(2,3,0)} > 0.0001 AND {_cross(3,0,1)} > 0.0001
  AND abs(x0*y1-x1*y0 + x1*y2-x2*y1 + x2*y3-x3*y2 + x3*y0-x0*y3)/2 > 0.02 AS valid FROM quads""")
def p20(spark, sf):
    return _quads(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geo.valid_quad(F.col("points")).alias("valid"))


def _fits(a, b, c):
    side, nxt = f"sqrt(power(x{b}-x{a},2)+power(y{b}-y{a},2))", f"sqrt(power(x{c}-x{b},2)+power(y{c}-y{b},2))"
    return (
        f"(x{a} >= 3 AND y{a} >= 3 AND x{a} <= 636 AND y{a} <= 476 AND {side} >= 76.8 AND {_cross(a,b,c)} > 0 "
        f"AND abs(((x{b}-x{a})*(x{c}-x{b})+(y{b}-y{a})*(y{c}-y{b}))/({side}*{nxt})) <= 0.82)"
    )


@query("p21_plausible_quad", f"""WITH {_QUADS_SQL}, px AS (SELECT * REPLACE (x0*640 AS x0, x1*640 AS x1, x2*640 AS x2, x3*640 AS x3, y0*480 AS y0, y1*480 AS y1, y2*480 AS y2, y3*480 AS y3) FROM quads)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_fits(0,1,2)} AND {_fits(1,2,3)} AND {_fits(2,3,0)} AND {_fits(3,0,1)} AS plausible FROM px""")
def p21(spark, sf):
    px = F.transform("points", lambda p: F.struct((p["x"] * 640).alias("x"), (p["y"] * 480).alias("y")))
    return _quads(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        geo.plausible_quad(px, F.lit(640), F.lit(480)).alias("plausible"),
    )


@query("p22_order_quad", f"""WITH {_QUADS_SQL},
pts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x0+y0*7+x1*3 AS qk, u.i, [x0,x1,x2,x3][u.i+1] AS x, [y0,y1,y2,y3][u.i+1] AS y,
  (x0+x1+x2+x3)/4 AS cx, (y0+y1+y2+y3)/4 AS cy FROM quads, unnest([0,1,2,3]) AS u(i)),
ang AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, qk ORDER BY atan2(y-cy, x-cx), i) - 1 AS r FROM pts),
st AS (SELECT *, min(struct_pack(s := x+y, r := r)) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, qk) AS f FROM ang)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast((r - f.r + 4) % 4 AS int) AS corner, x, y FROM st""")
def p22(spark, sf):
    q = _quads(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.posexplode_outer(geo.order_quad(F.col("points"))).alias("corner", "p"),
    )
    return q.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "corner", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("p23_route_tool", f"""WITH {FILES_SQL}
SELECT file_id, CASE WHEN starts_with(mime, 'image/') OR regexp_matches(name, '(?i)\\.(png|jpe?g|webp|gif|bmp)$') THEN 'scan'
    WHEN contains(mime, 'wordprocessingml') OR ends_with(lower(name), '.docx') THEN 'docx-pdf' ELSE 'view' END AS tool,
  CASE WHEN mime <> '' THEN mime WHEN ends_with(lower(name), '.docx') THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    WHEN regexp_matches(name, '(?i)\\.(png|jpe?g|webp|gif|bmp)$') THEN 'image/jpeg' ELSE 'application/pdf' END AS mime FROM files""")
def p23(spark, sf):
    n, m = F.col("name"), F.col("mime")
    return files(spark, sf).select("file_id", ff.route_tool(n, m).alias("tool"), ff.default_mime(n, m).alias("mime"))


@query("p24_line_alignment", f"""WITH {fx.PROSE_LINES_SQL}
SELECT doc_id, page_no, line_no, CASE WHEN x_end - x < 612 * 0.82 AND abs((x + x_end) / 2 - 306) <= 612 * 0.035 THEN 'center'
  WHEN x > 612 * 0.35 AND x_end >= 612 * 0.9 THEN 'right' ELSE 'left' END AS alignment FROM lines""")
def p24(spark, sf):
    return fx.prose_lines(spark, sf).select(
        "doc_id", "page_no", "line_no", line_alignment(F.col("x"), F.col("x_end"), F.col("page_width")).alias("alignment")
    )

"""Word corpus and text flow queries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import functions as F

from leafline.catalog import fixtures as fx
from leafline.catalog.registry import query, table
from leafline.operators import flow as W
from leafline.operators import paging
from leafline.operators import word as X
from leafline.operators.admission import docx_admission, docx_warnings
from leafline.sources import docx as S

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _pack(doc_id: int, body: str, notes: str) -> Iterator[tuple]:
    """A minimal Word package around given XML parts."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
        if notes:
            archive.writestr("word/footnotes.xml", f"<w:footnotes {_NS}>{notes}</w:footnotes>")
        if doc_id % 4 == 0:
            archive.writestr("word/header1.xml", f"<w:hdr {_NS}/>")
    yield doc_id, buffer.getvalue()


def packages(spark, sf):
    """A Word file per document: one paragraph per line, a two-cell table, a note on every third."""
    from leafline.functions.text import xml_escape

    def para(text):
        return F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), text, F.lit("</w:t></w:r></w:p>"))

    k = F.col("doc_id")
    lines = F.transform(F.split("text", "\n"), lambda l: para(xml_escape(l)))
    ref = F.when(k % 3 == 0, F.lit('<w:p><w:r><w:t>see</w:t><w:footnoteReference w:id="2"/></w:r></w:p>')).otherwise("")
    moved = F.when(k % 5 == 0, F.lit("<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:t>old</w:t></w:r></w:del></w:p>")).otherwise("")
    grid = F.concat(
        F.lit("<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>"), para(F.col("lang")), F.lit("</w:tc><w:tc>"),
        para(F.col("source")), F.lit("</w:tc></w:tr></w:tbl>"),
    )
    notes = F.when(
        k % 3 == 0,
        F.lit('<w:footnote w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p w:rsid="1"><w:pPr><w:b/></w:pPr><w:r><w:t>A &amp;lt;note&amp;gt; &lt;b&gt;</w:t><w:tab/><w:t xml:space="preserve"> more&#233;</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>End &#x201C;x&quot;</w:t><w:delText>gone</w:delText></w:r></w:p></w:footnote><w:footnote w:id="3"><w:p/></w:footnote>'),
    ).otherwise("")
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.array_join(lines, ""), ref, moved, grid).alias("body"), notes.alias("notes")
    )
    return S.map_rows(d, _pack, "doc_id bigint, content binary")


_PARA_SQL = """
body AS (SELECT doc_id, u.i - 1 AS para_no, u.l AS text FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(l, i)),
counts AS (SELECT doc_id, count(*) AS n FROM body GROUP BY 1),
extra AS (SELECT doc_id, n AS para_no, 'see[F2]' AS text FROM counts WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, n + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, 'new' FROM counts WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, n + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END, lang FROM counts JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, n + 1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END, source FROM counts JOIN documents USING (doc_id)),
paras AS (SELECT * FROM body UNION ALL SELECT * FROM extra)"""


@query("s4_read_docx_corpus", f"""WITH {_PARA_SQL} SELECT doc_id, cast(para_no AS int) AS para_no, text FROM paras""")
def s4(spark, sf):
    t = S.read_docx_corpus(packages(spark, sf))
    parts = F.sort_array(F.collect_list(F.struct("piece_no", "text")))
    return t["pieces"].groupBy("doc_id", "para_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


@query("s4_docx_cells", "SELECT doc_id, 0 AS table_no, 0 AS row_no, u.c AS cell_no, 2 - u.c AS span, false AS v_continue FROM documents, unnest([0, 1]) AS u(c)")
def s4_cells(spark, sf):
    return S.read_docx_corpus(packages(spark, sf))["cells"]


@query("s5_docx_manifest", """SELECT doc_id, 1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS parts, true AS ok FROM documents""")
def s5_manifest(spark, sf):
    return docx_admission(S.docx_manifest(packages(spark, sf))).select("doc_id", "parts", "ok")


@query("f5_docx_warnings", """SELECT doc_id, 'notes' AS warning FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'headers' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'tracked' FROM documents WHERE doc_id % 5 = 0""")
def f5(spark, sf):
    return docx_warnings(S.docx_parts(packages(spark, sf)))


@query("j3_docx_notes", """SELECT doc_id, 0 AS kind_no, 2 AS note_id, u.p AS part, CASE u.p WHEN 0 THEN '[F2]' WHEN 1 THEN 'A &lt;note&gt; <b>' || chr(9) || ' moreé' WHEN 2 THEN '' ELSE 'End “x"' END AS text FROM documents, unnest([0, 1, 2, 3]) AS u(p) WHERE doc_id % 3 = 0""")
def j3(spark, sf):
    return X.docx_notes(*S.docx_notes_rows(S.docx_parts(packages(spark, sf))))


# ------------------------------------------------------------------ relationships

@query("j4_resolve_rels", """WITH t AS (SELECT page_id % 7 AS k, page_id AS doc_id, page_id AS ref_no, 'rId' || page_id AS rel_id FROM pages)
SELECT doc_id, ref_no, rel_id, CASE k WHEN 0 THEN 'Word/media/Image 1.png' WHEN 1 THEN 'Word/media/Image 1.png' WHEN 5 THEN 'custom/a+b.xml' WHEN 6 THEN 'custom/a+b.xml' END AS part_name FROM t""")
def j4(spark, sf):
    k, rel = F.col("page_id") % 7, F.concat(F.lit("rId"), F.col("page_id").cast("string"))
    target = (
        F.when(k == 0, "media/image%201.png").when(k == 1, " .\\MEDIA\\x\\..\\image 1.png").when(k == 2, F.col("url"))
        .when(k == 3, "../../up.xml").when(k == 4, "media/missing.png").when(k == 5, "/custom/a+b.xml").otherwise("../custom/./A+B.xml")
    )
    p = table(spark, sf, "pages")
    rels = p.select(F.col("page_id").alias("doc_id"), rel.alias("rel_id"), target.alias("target"), F.lit(False).alias("external"))
    refs = p.select(F.col("page_id").alias("doc_id"), F.col("page_id").alias("ref_no"), rel.alias("rel_id"))
    parts = p.select(F.col("page_id").alias("doc_id"), F.explode(F.array(F.lit("Word/media/Image 1.png"), F.lit("custom/a+b.xml"))).alias("part_name"))
    return X.resolve_rels(refs, rels, parts)


_STYLE_SQL = """styles AS (SELECT c_nationkey AS doc_id, c_custkey AS style_id, CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey // 50) * 50 + (c_custkey * 7 + 3) % 50 END AS based_on FROM customer),
edges AS (SELECT c_nationkey AS doc_id, c_custkey AS style_id, u.side, CASE WHEN (c_custkey + length(u.side)) % 4 <> 1 THEN c_custkey END AS edge FROM customer, unnest(['top', 'left', 'inside_h']) AS u(side) WHERE (c_custkey * length(u.side)) % 3 = 0)"""


@query("j6_resolve_table_styles", f"""WITH RECURSIVE {_STYLE_SQL.replace('c_nationkey AS doc_id', 'c_custkey // 50 AS doc_id')},
up AS (SELECT doc_id, style_id, style_id AS ancestor, 0 AS depth, [style_id] AS path FROM styles
  UNION ALL SELECT u.doc_id, u.style_id, s.based_on, u.depth + 1, list_append(u.path, s.based_on) FROM up u JOIN styles s ON s.doc_id = u.doc_id AND s.style_id = u.ancestor
  WHERE s.based_on IS NOT NULL AND NOT list_contains(u.path, s.based_on))
SELECT u.doc_id, u.style_id, e.side, arg_min_null(e.edge, u.depth) AS edge FROM up u JOIN edges e ON e.doc_id = u.doc_id AND e.style_id = u.ancestor GROUP BY 1, 2, 3""")
def j6(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    doc = F.floor(k / 50)
    styles = c.select(
        doc.alias("doc_id"), k.alias("style_id"), F.when(k % 10 != 0, doc * 50 + (k * 7 + 3) % 50).alias("based_on")
    )
    edges = c.select(doc.alias("doc_id"), k.alias("style_id"), F.explode(F.array(*[F.lit(s) for s in ("top", "left", "inside_h")])).alias("side"))
    edges = edges.where((F.col("style_id") * F.length("side")) % 3 == 0).withColumn(
        "edge", F.when((F.col("style_id") + F.length("side")) % 4 != 1, F.col("style_id"))
    )
    return X.resolve_table_styles(styles, edges)


# ------------------------------------------------------------------ paragraph properties and lists

def _raw_styles(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    null = F.lit(None).cast("string")
    return s.select(
        (k % 7).alias("doc_id"), F.concat(F.lit("S"), k.cast("string")).alias("style_id"),
        F.when(k % 9 == 0, "heading 2").when(k % 9 == 1, "Title").otherwise("Body").alias("name"), F.lit(None).cast("int").alias("outline"),
        F.when(k % 5 == 0, "4").alias("num_id"), (k % 3).cast("int").alias("ilvl"), (k % 4 == 0).alias("bold_set"), F.when(k % 8 == 0, "0").alias("bold"),
        (k % 6 == 0).alias("italic_set"), null.alias("italic"), F.when(k % 2 == 0, (16 + k % 30).cast("string")).alias("size_half"),
        F.when(k % 4 == 1, "300").alias("line"), F.when(k % 8 == 1, "exact").alias("line_rule"), F.when(k % 3 == 0, "120").alias("before"),
        F.when(k % 3 == 1, "80").alias("after"), null.alias("before_lines"), F.when(k % 3 == 2, "50").alias("after_lines"),
        F.when(k % 6 == 1, "360").alias("left"), F.when(k % 6 == 2, "200").alias("first_line"), F.when(k % 6 == 3, "180").alias("hanging"),
    )


def _raw_paras(spark, sf):
    l = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return l.select(
        (k % 7).alias("doc_id"), k.cast("int").alias("para_no"), F.concat(F.lit("S"), (F.col("o_custkey") % 100).cast("string")).alias("style_id"),
        F.when(k % 29 == 0, 1).alias("outline"), F.when(k % 3 == 0, "Center").when(k % 3 == 1, "end").alias("jc"),
        F.when(k % 11 == 0, "0").when(k % 11 < 4, "9").alias("num_id"), F.when(k % 2 == 0, (k % 4).cast("int")).alias("ilvl"),
        F.when(k % 13 == 0, "720").alias("left"), F.lit(None).cast("string").alias("first_line"), F.when(k % 17 == 0, "90").alias("hanging"),
        (k % 5 < 2).alias("has_spacing"), F.when(k % 5 == 0, "200").alias("line"), F.when(k % 10 == 0, "atLeast").alias("line_rule"),
        F.when(k % 5 == 1, "60").alias("before"), F.lit(None).cast("string").alias("after"), F.when(k % 10 == 0, "100").alias("before_lines"),
        F.lit(None).cast("string").alias("after_lines"), F.when(k % 7 == 0, True).alias("mark_bold"), F.when(k % 19 == 0, True).alias("mark_italic"),
        F.when(k % 23 == 0, 13.0).alias("mark_size"),
    )


@query("j9_inherit_paragraph", """WITH st AS (SELECT s_suppkey % 7 AS doc_id, 'S' || s_suppkey AS style_id, CASE WHEN s_suppkey % 9 = 0 THEN 2 WHEN s_suppkey % 9 = 1 THEN 1 END AS sh,
   CASE WHEN s_suppkey % 5 = 0 THEN '4' END AS sn, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 3 END AS si, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 8 <> 0 END AS sb, CASE WHEN s_suppkey % 6 = 0 THEN true END AS sit,
   CASE WHEN s_suppkey % 2 = 0 THEN (16 + s_suppkey % 30) / 2 END AS ss, CASE WHEN s_suppkey % 4 = 1 THEN CASE WHEN s_suppkey % 8 = 1 THEN 15::double / 11 ELSE 300::double / 240 END ELSE 1.08::double END AS sm,
   CASE WHEN s_suppkey % 3 = 0 THEN 6 ELSE 0 END AS sbf, s_suppkey AS k, CASE WHEN s_suppkey % 6 = 1 THEN 18 ELSE 0 END AS sl, CASE WHEN s_suppkey % 6 = 2 THEN 10 WHEN s_suppkey % 6 = 3 THEN -9 ELSE 0 END AS sf FROM supplier),
st2 AS (SELECT *, CASE WHEN k % 3 = 1 THEN 4::double WHEN k % 3 = 2 THEN 0.5 * 11 * sm ELSE 0 END AS saf FROM st),
p AS (SELECT o_orderkey % 7 AS doc_id, cast(o_orderkey AS int) AS para_no, 'S' || (o_custkey % 100) AS style_id, o_orderkey AS k FROM orders),
j AS (SELECT p.doc_id, p.para_no, p.k, sh, sn, si, sb, sit, ss, sm, sbf, saf, sl, sf, coalesce(sh, CASE WHEN p.k % 29 = 0 THEN 2 END) AS h FROM p LEFT JOIN st2 USING (doc_id, style_id)),
a AS (SELECT *, CASE WHEN h IS NULL THEN CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 < 4 THEN '9' ELSE sn END END AS num, CASE WHEN k % 11 BETWEEN 1 AND 3 THEN CASE WHEN k % 2 = 0 THEN k % 4 ELSE 0 END ELSE coalesce(si, 0) END AS lv,
   CASE h WHEN 1 THEN 18 WHEN 2 THEN 14 ELSE least(28, greatest(8, coalesce(ss, CASE WHEN k % 23 = 0 THEN 13 END, 11))) END AS size FROM j),
m AS (SELECT *, CASE WHEN k % 5 = 0 THEN greatest(0.7, CASE WHEN k % 10 = 0 THEN 10::double / size ELSE 200::double / 240 END) ELSE coalesce(sm, 1.08::double) END AS mult FROM a),
b AS (SELECT *, CASE WHEN k % 5 = 1 THEN 3 WHEN k % 10 = 0 THEN size * mult ELSE coalesce(sbf, 0) END AS bf, h IS NOT NULL AND k % 5 >= 2 AS bare, CASE WHEN k % 13 = 0 THEN 36 ELSE coalesce(sl, 0) END AS lf FROM m)
SELECT doc_id, para_no, h AS heading, CASE k % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'right' ELSE 'left' END AS align, num AS num_id, cast(lv AS int) AS ilvl, num IS NOT NULL AS is_list, cast(size AS double) AS size,
  h IS NOT NULL OR coalesce(sb, k % 7 = 0) AS bold, coalesce(sit, k % 19 = 0) AS italic, cast(CASE WHEN bare AND coalesce(sbf, 0) = 0 THEN CASE h WHEN 1 THEN 12 ELSE 10 END ELSE bf END AS double) AS space_before,
  cast(CASE WHEN bare AND coalesce(saf, 0) = 0 THEN CASE h WHEN 1 THEN 6 ELSE 4 END ELSE coalesce(saf, 0) END AS double) AS space_after, mult AS line_mult,
  cast(lf + CASE WHEN num IS NOT NULL AND lf = 0 THEN 18 + lv * 14 ELSE 0 END AS double) AS indent, cast(CASE WHEN k % 17 = 0 THEN -4.5 ELSE coalesce(sf, 0) END AS double) AS first_indent FROM b""")
def j9(spark, sf):
    return X.inherit_paragraph(_raw_paras(spark, sf), X.resolve_styles(_raw_styles(spark, sf)))


_ITEMS_SQL = fx.ORDER_LINES_SQL + """,
items AS (SELECT doc_id // 20 AS doc_id, cast((doc_id % 20) * 1000000 + rn AS int) AS para_no, cast(supp % 3 AS varchar) AS num_id, cast(part % 4 AS int) AS ilvl FROM order_lines),
marked AS (SELECT *, NOT (num_id = '2' OR (num_id = '1' AND ilvl = 3)) AS numbered FROM items)"""


@query("w11_list_numbers", f"""WITH {_ITEMS_SQL},
low AS (SELECT a.*, (SELECT max(b.para_no) FROM marked b WHERE b.numbered AND b.doc_id = a.doc_id AND b.num_id = a.num_id AND b.ilvl < a.ilvl AND b.para_no < a.para_no) AS since FROM marked a)
SELECT doc_id, para_no, num_id, ilvl, CASE WHEN numbered THEN (SELECT count(*) FROM marked b WHERE b.numbered AND b.doc_id = l.doc_id AND b.num_id = l.num_id AND b.ilvl = l.ilvl AND b.para_no <= l.para_no AND b.para_no > coalesce(l.since, -1)) || '. ' ELSE '• ' END AS prefix FROM low l""")
def w11(spark, sf):
    lines = fx.order_lines(spark, sf)
    items = lines.select(
        F.floor(F.col("doc_id") / 20).alias("doc_id"), ((F.col("doc_id") % 20) * 1_000_000 + F.col("rn")).cast("int").alias("para_no"),
        (F.col("supp") % 3).cast("string").alias("num_id"), (F.col("part") % 4).cast("int").alias("ilvl"),
    )
    docs = lines.select(F.floor(F.col("doc_id") / 20).alias("doc_id")).distinct()
    numbering = docs.select("doc_id", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("num_id")).withColumn(
        "abs_id", F.concat(F.lit("A"), "num_id")
    )
    levels = numbering.select("doc_id", "abs_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ilvl")).withColumn(
        "fmt", F.when((F.col("abs_id") == "A1") & (F.col("ilvl") == 3), "bullet").otherwise("decimalZero")
    )
    return X.list_numbers(items, numbering, levels)


_PIECES_SQL = fx.ORDER_LINES_SQL + """,
pieces AS (SELECT doc_id, 0 AS para_no, rn AS piece_no, CASE part % 9 WHEN 0 THEN 'nl' WHEN 1 THEN 'break' WHEN 2 THEN 'image' ELSE 'text' END AS kind,
  CASE WHEN part % 9 = 3 THEN '' WHEN part % 9 = 4 THEN '  ' ELSE flag || part END AS text, supp % 2 = 0 AS bold, supp % 5 = 0 AS italic, CASE WHEN supp % 3 = 0 THEN 12.0::double ELSE 10.0::double END AS size FROM order_lines),
seg AS (SELECT *, sum(CASE WHEN kind IN ('break', 'image') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY piece_no) AS segment FROM pieces),
flat AS (SELECT doc_id, para_no, segment, piece_no, kind, CASE WHEN kind = 'nl' THEN chr(10) ELSE text END AS text, CASE WHEN kind = 'nl' THEN false ELSE bold END AS bold, CASE WHEN kind = 'nl' THEN false ELSE italic END AS italic,
  CASE WHEN kind = 'nl' THEN 11.0::double ELSE size END AS size FROM seg WHERE kind = 'nl' OR (kind = 'text' AND text <> '')),
flagged AS (SELECT *, CASE WHEN lag(piece_no) OVER w IS NULL THEN 1 WHEN kind = 'nl' THEN 0 WHEN lag(kind) OVER w = 'nl' OR lag(bold) OVER w <> bold OR lag(italic) OVER w <> italic OR lag(size) OVER w <> size THEN 1 ELSE 0 END AS fresh
  FROM flat WINDOW w AS (PARTITION BY doc_id, segment ORDER BY piece_no)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, segment ORDER BY piece_no) - 1 AS run_no, bool_or(trim(text, ' ' || chr(10)) <> '') OVER (PARTITION BY doc_id, segment) AS shown FROM flagged)"""


@query("w12_coalesce_runs", f"""WITH {_PIECES_SQL}
SELECT doc_id, para_no, cast(segment AS int) AS segment, cast(run_no AS int) AS run_no, string_agg(text, '' ORDER BY piece_no) AS text, arg_min(bold, piece_no) AS bold, arg_min(italic, piece_no) AS italic, arg_min(size, piece_no) AS size
FROM numbered WHERE shown GROUP BY doc_id, para_no, segment, run_no""")
def w12(spark, sf):
    part, supp = F.col("part"), F.col("supp")
    kind = F.when(part % 9 == 0, "nl").when(part % 9 == 1, "break").when(part % 9 == 2, "image").otherwise("text")
    text = F.when(part % 9 == 3, "").when(part % 9 == 4, "  ").otherwise(F.concat("flag", part.cast("string")))
    p = fx.order_lines(spark, sf).select(
        "doc_id", F.lit(0).alias("para_no"), F.col("rn").alias("piece_no"), kind.alias("kind"), text.alias("text"), (supp % 2 == 0).alias("bold"),
        (supp % 5 == 0).alias("italic"), F.when(supp % 3 == 0, 12.0).otherwise(10.0).alias("size"), F.lit(False).alias("base_bold"),
        F.lit(False).alias("base_italic"), F.lit(11.0).alias("base_size"),
    )
    return X.coalesce_runs(p)


_SHAPE_SQL = fx.ORDER_LINES_SQL + """,
cells AS (SELECT doc_id, 0 AS table_no, rn // 3 AS row_no, rn % 3 AS cell_no, least(12, greatest(1, supp % 15 - 1)) AS span FROM order_lines)"""


def _cells(spark, sf):
    return fx.order_lines(spark, sf).select(
        "doc_id", F.lit(0).alias("table_no"), F.floor(F.col("rn") / 3).alias("row_no"), (F.col("rn") % 3).alias("cell_no"), (F.col("supp") % 15 - 1).alias("span")
    )


@query("a13_table_shape", f"""WITH {_SHAPE_SQL},
s AS (SELECT doc_id, table_no, count(*) AS rows, max(n) AS columns FROM (SELECT doc_id, table_no, row_no, sum(span) AS n FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT doc_id, table_no, rows, cast(columns AS bigint) AS columns, cast(u.c AS int) AS col, CASE WHEN u.c < 3 AND doc_id % 2 = 0 THEN CASE WHEN u.c = 1 THEN 1.0::double ELSE 40.0::double + u.c END ELSE 1.0::double END AS weight FROM s, unnest(range(0, cast(columns AS bigint))) AS u(c)""")
def a13(spark, sf):
    cells = _cells(spark, sf)
    grid = cells.where(F.col("doc_id") % 2 == 0).select("doc_id", "table_no").distinct().select(
        "doc_id", "table_no", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col")
    ).withColumn("width", F.when(F.col("col") == 1, -5.0).otherwise(40.0 + F.col("col")))
    return X.table_shape(cells, grid)


@query("a13_cell_columns", f"""WITH {_SHAPE_SQL}
SELECT doc_id, table_no, row_no, cell_no, cast(coalesce(sum(span) OVER (PARTITION BY doc_id, row_no ORDER BY cell_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS col, cast(span AS int) AS span FROM cells""")
def a13_columns(spark, sf):
    return X.cell_columns(_cells(spark, sf))


# ------------------------------------------------------------------ flow

_FLOW_SQL = """
paras AS (SELECT doc_id, u.i - 1 AS para_no, u.l AS text FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(l, i)),
tok AS (SELECT doc_id, para_no, u.i, u.t, length(u.t) AS w FROM paras, unnest(regexp_extract_all(text, '( +|[^ ]+)')) WITH ORDINALITY AS u(t, i)),
cut AS (SELECT doc_id, para_no, i, u.k, CASE WHEN w > 20 AND t[1] <> ' ' THEN t[(u.k * 20 + 1):(u.k * 20 + 20)] ELSE t END AS t, w FROM tok, unnest(range(0, CASE WHEN w > 20 AND t[1] <> ' ' THEN (w + 19) // 20 ELSE 1 END)) AS u(k)),
seq AS MATERIALIZED (SELECT doc_id, para_no, row_number() OVER (PARTITION BY doc_id, para_no ORDER BY i, k) AS n, t, w, length(t) AS own, t[1] = ' ' AS blank FROM cut),
walk AS (SELECT doc_id, para_no, n, 0 AS line_no, own AS width, true AS filled, true AS kept FROM seq WHERE n = 1
  UNION ALL SELECT doc_id, para_no, n, line_no + CASE WHEN over_ THEN 1 ELSE 0 END, CASE WHEN over_ AND blank THEN 0 WHEN over_ THEN own ELSE width + own END, NOT (over_ AND blank), NOT (over_ AND blank)
  FROM (SELECT s.doc_id, s.para_no, s.n, s.own, s.blank, w.line_no, w.width, w.filled AND w.width + s.w > 20 AS over_ FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.para_no = w.para_no AND s.n = w.n + 1)),
lines AS (SELECT doc_id, para_no, line_no, string_agg(t, '' ORDER BY n) AS text, cast(sum(own) * 5 AS double) AS width FROM walk JOIN seq USING (doc_id, para_no, n) WHERE kept GROUP BY 1, 2, 3
  UNION ALL SELECT doc_id, para_no, 0, '', 0.0 FROM paras WHERE text = '')"""


@query("w13_flow_lines", f"WITH RECURSIVE {_FLOW_SQL} SELECT doc_id, cast(para_no AS int) AS para_no, cast(line_no AS int) AS line_no, text, width FROM lines")
def w13(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_no", "text")).withColumn("size", F.lit(10.0))
    return W.flow_lines(p, 100.0)


_BOX, _LINE = 697_890_000, 12_960_000  # micropoints: the room of a page, and the height of a line

_PAGE_SQL = f"""
b AS (SELECT doc_id, u.i - 1 AS n, greatest(1, ceil(length(u.l) / 90))::BIGINT AS c, CASE WHEN u.l = '' THEN 'empty' WHEN (u.i - 1) % 37 = 36 THEN 'break' WHEN (u.i - 1) % 11 = 10 THEN 'image' WHEN (u.i - 1) % 7 >= 5 THEN 'row' ELSE 'para' END AS kind
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(l, i)),
s AS (SELECT *, sum(CASE WHEN kind = 'para' THEN {_LINE} WHEN kind = 'image' THEN 8000000 WHEN kind = 'row' AND n % 7 = 5 THEN 16000000 ELSE 0 END) OVER w AS s, count(*) FILTER (kind = 'break') OVER w AS part FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
p AS (SELECT x.doc_id, x.n, list(DISTINCT (y.s - x.s)::BIGINT) AS p FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.part = y.part AND y.n > x.n AND y.s - x.s <= {_BOX} WHERE x.kind IN ('para', 'empty') GROUP BY 1, 2),
o AS (
  SELECT doc_id, n, 0 AS line, 'gap' AS op, CASE WHEN kind = 'para' THEN 6000000 ELSE 14000000 + {_LINE} END AS size, CASE WHEN kind = 'para' THEN {_LINE} ELSE 0 END AS first, 0 AS tail FROM b WHERE kind IN ('para', 'empty') UNION ALL
  SELECT doc_id, n, u.i, 'line', {_LINE}, 0, 0 FROM b, unnest(range(1, c + 1)) AS u(i) WHERE kind = 'para' UNION ALL
  SELECT doc_id, n, c + 1, 'gap', 8000000, 0, 0 FROM b WHERE kind = 'para' UNION ALL
  SELECT doc_id, n, 1, 'line', CASE WHEN kind = 'image' THEN 200000000 ELSE 16000000 + 12000000 * c END, 0, CASE WHEN kind = 'image' THEN 8000000 ELSE 0 END FROM b WHERE kind IN ('image', 'row') UNION ALL
  SELECT doc_id, n, 0, 'break', 0, 0, 0 FROM b WHERE kind = 'break'),
q AS MATERIALIZED (SELECT o.*, p, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.n, line) AS k FROM o LEFT JOIN p ON op = 'gap' AND o.doc_id = p.doc_id AND o.n = p.n),
walk AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS k, -1::BIGINT AS page, 0::BIGINT AS room, NULL::BIGINT AS n, NULL::BIGINT AS line, NULL::BIGINT AS spot FROM b UNION ALL
  SELECT doc_id, k, page, room - CASE WHEN op = 'line' THEN size + tail WHEN op = 'gap' AND page >= 0 AND room - first >= size AND room - first - size >= coalesce(list_max(list_filter(p, lambda x: x <= room - first)), 0) THEN size ELSE 0 END,
    CASE WHEN op = 'line' THEN n END, line - 1, room
  FROM (SELECT q.*, CASE WHEN op = 'line' AND greatest(page, 0) = page AND room >= size THEN page WHEN op = 'line' THEN greatest(page, 0) + CASE WHEN page >= 0 OR size > {_BOX} THEN 1 ELSE 0 END WHEN op = 'break' AND page >= 0 THEN page + 1 ELSE page END AS page,
      CASE WHEN (op = 'line' AND (page < 0 OR room < size)) OR (op = 'break' AND page >= 0) THEN {_BOX} ELSE room END AS room
    FROM walk JOIN q ON q.doc_id = walk.doc_id AND q.k = walk.k + 1))"""


@query("w14_paginate", f"""WITH RECURSIVE {_PAGE_SQL}
SELECT doc_id, n::INTEGER AS block_no, line::INTEGER AS line_no, page::INTEGER AS page_no, (spot + 72000000) / 1e6::DOUBLE AS y, NULL::INTEGER AS page_count FROM walk WHERE n IS NOT NULL UNION ALL
SELECT doc_id, NULL, NULL, NULL, NULL, (greatest(0, coalesce(max(page) FILTER (n IS NOT NULL), 0)) + 1)::INTEGER FROM walk GROUP BY doc_id""")
def w14(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    count = F.greatest(F.lit(1), F.ceil(F.length("text") / 90)).cast("int")
    n = F.col("block_no")
    b = p.select(
        "doc_id", "block_no",
        F.when(F.col("text") == "", "empty").when(n % 37 == 36, "break").when(n % 11 == 10, "image").when(n % 7 >= 5, "row").otherwise("para").alias("kind"),
        F.when(n % 11 == 10, F.array(F.lit(200.0))).when(n % 7 >= 5, F.array(16.0 + count * 12.0)).otherwise(F.array_repeat(F.lit(12.96), count)).alias("heights"),
        F.lit(12.0).alias("size"), F.lit(1.08).alias("line_mult"), F.lit(6.0).alias("space_before"), F.lit(8.0).alias("space_after"), (n % 7 == 5).alias("opens_table"),
    )
    return paging.paginate(b)

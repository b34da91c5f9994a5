"""Layout completion: paragraphs, columns, grids, draw ops, blocks and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafline.catalog import fixtures as fx
from leafline.catalog.functions import FILES_SQL, files
from leafline.catalog.registry import query, table
from leafline.operators import blocks as K
from leafline.operators import columns as C
from leafline.operators import draws as D
from leafline.operators import paragraphs as G
from leafline.operators import tables as T
from leafline.sources import items as N

# ------------------------------------------------------------------ paragraphs

_WALK_SQL = """,
stats AS (SELECT doc_id, page_no, min(x) AS base_x, list_sort(list(font_size))[cast(floor((count(*) - 1) * 0.35) AS int) + 1] AS typical FROM lines GROUP BY 1, 2),
steps AS (SELECT l.*, s.base_x, s.typical, row_number() OVER w AS i, lag(y) OVER w - y AS step FROM lines l JOIN stats s USING (doc_id, page_no)
  WINDOW w AS (PARTITION BY l.doc_id, l.page_no ORDER BY y DESC, x, line_no)),
lead AS (SELECT doc_id, page_no, coalesce(nullif(median(step) FILTER (step > typical * 0.75 AND step < typical * 2.1), 0), any_value(typical) * 1.2) AS lead_pt FROM steps GROUP BY 1, 2),
marks AS (SELECT s.*, lead_pt, regexp_extract(text, '^\\s*(\\d{1,3})[.)]\\s+') AS num, regexp_extract(text, '^\\s*[•●◦▪‣–—-]\\s+') AS bul FROM steps s JOIN lead USING (doc_id, page_no)),
roles AS MATERIALIZED (SELECT *, CASE WHEN num <> '' THEN 'number' WHEN bul <> '' THEN 'bullet' END AS kind, CASE WHEN num <> '' THEN cast(regexp_extract(num, '\\d+') AS int) END AS start,
  num = '' AND bul = '' AND length(text) < 120 AND (font_size >= greatest(typical * 1.28, typical + 2.2) OR (bold AND font_size >= typical * 1.16)) AS heading,
  CASE WHEN x_end - x < page_width * 0.82 AND abs((x + x_end) / 2 - page_width / 2) <= greatest(14, page_width * 0.035) THEN 'center'
    WHEN x > page_width * 0.35 AND x_end >= page_width * 0.9 THEN 'right' ELSE 'left' END AS align FROM marks),
walk AS (
  SELECT doc_id, page_no, line_no, i, 0 AS para_no, CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS seq, x AS gx, heading AS gh, align AS ga, rtl AS gr, kind AS gk, 1 AS gn, y AS gy FROM roles WHERE i = 1
  UNION ALL
  SELECT doc_id, page_no, line_no, i, para_no + CASE WHEN joins THEN 0 ELSE 1 END, seq + CASE WHEN kind IS NOT NULL AND restart THEN 1 ELSE 0 END,
    CASE WHEN joins THEN gx ELSE x END, CASE WHEN joins THEN gh ELSE heading END, CASE WHEN joins THEN ga ELSE align END, CASE WHEN joins THEN gr ELSE rtl END,
    CASE WHEN joins THEN gk ELSE kind END, CASE WHEN joins THEN gn + 1 ELSE 1 END, y
  FROM (SELECT *, coalesce(CASE WHEN gk IS NOT NULL THEN kind IS NULL AND near AND x >= gx - 2 AND x - gx <= greatest(42, font_size * 3.8)
       ELSE kind IS NULL AND gh = heading AND NOT heading AND ga = align AND gr = rtl AND near
         AND (abs(gx - x) < greatest(5, font_size * 0.75) OR (gn = 1 AND gx > x AND abs(gx - x) <= greatest(28, font_size * 2.8))) END, false) AS joins,
     gk IS NULL OR gk IS DISTINCT FROM kind OR coalesce(start = 1, false) OR gap > greatest(lead_pt * 1.8, height * 2.1) AS restart
   FROM (SELECT r.*, w.para_no, w.seq, w.gx, w.gh, w.ga, w.gr, w.gk, w.gn, w.gy - r.y AS gap, w.gy - r.y > 0 AND w.gy - r.y <= greatest(r.lead_pt * 1.42, r.height * 1.65) AS near
     FROM walk w JOIN roles r ON r.doc_id = w.doc_id AND r.page_no = w.page_no AND r.i = w.i + 1) a) b),
placed AS (SELECT r.*, w.para_no, w.seq, row_number() OVER p AS k, lag(r.y) OVER p - r.y AS inner_gap FROM roles r JOIN walk w USING (doc_id, page_no, i)
  WINDOW p AS (PARTITION BY r.doc_id, r.page_no, w.para_no ORDER BY r.i)),
paras AS (SELECT doc_id, page_no, para_no, bool_or(heading AND k = 1) AS heading,
  CASE WHEN max(kind) FILTER (k = 1) IS NULL THEN min(x) ELSE max(x) FILTER (k = 1) END AS x, max(x_end) AS x_end,
  cast(max(y + height * 0.82) FILTER (k = 1) AS double) AS top, cast(min(y - height * 0.25) AS double) AS bottom,
  CASE WHEN max(kind) FILTER (k = 1) IS NULL AND count(*) >= 2 THEN coalesce(nullif(median(inner_gap) FILTER (inner_gap > 0), 0), any_value(lead_pt)) ELSE any_value(lead_pt) END AS line_spacing,
  CASE WHEN max(kind) FILTER (k = 1) IS NULL AND count(*) >= 2 AND abs(max(x) FILTER (k = 1) - min(x)) >= 2 THEN max(x) FILTER (k = 1) - min(x) END AS first_indent,
  max(align) FILTER (k = 1) AS alignment, bool_or(rtl AND k = 1) AS rtl, max(kind) FILTER (k = 1) AS list_kind,
  CASE WHEN max(kind) FILTER (k = 1) IS NOT NULL THEN cast(greatest(0, least(8, floor((max(x) FILTER (k = 1) - any_value(base_x)) / 24 + 0.5))) AS int) END AS list_level,
  CASE WHEN max(kind) FILTER (k = 1) IS NOT NULL THEN max(seq) FILTER (k = 1) END AS list_seq, max(start) FILTER (k = 1) AS list_start, count(*) AS line_count,
  string_agg(CASE WHEN k = 1 THEN ltrim(text[length(num) + length(bul) + 1:]) ELSE text END, chr(10) ORDER BY i) AS text
  FROM placed GROUP BY 1, 2, 3)"""


@query("w4_paragraphs", f"WITH RECURSIVE {fx.PROSE_LINES_SQL}{_WALK_SQL} SELECT * FROM paras")
def w4(spark, sf):
    return G.paragraphs(fx.prose_lines(spark, sf))


@query("w5_list_sequences", f"WITH RECURSIVE {fx.LIST_LINES_SQL}{_WALK_SQL} SELECT * FROM paras")
def w5(spark, sf):
    return G.paragraphs(fx.list_lines(spark, sf))


@query("w5_list_ids", f"""WITH RECURSIVE {fx.LIST_LINES_SQL}{_WALK_SQL},
firsts AS (SELECT doc_id, page_no, list_kind, list_seq, min(para_no) AS p, greatest(1, coalesce(min_by(coalesce(list_start, 1), para_no), 1)) AS start FROM paras WHERE list_kind IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT doc_id, page_no, list_kind, list_seq, cast(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, p) AS int) AS list_id, start FROM firsts""")
def w5_ids(spark, sf):
    return G.list_ids(G.list_items(fx.list_lines(spark, sf)))


# ------------------------------------------------------------------ columns

_SPLIT_SQL = fx.COLUMN_GLYPHS_SQL + """,
bounds AS (SELECT doc_id, page_no, min(x) AS min_x, max(x + width) AS max_x, count(*) AS n FROM glyphs GROUP BY 1, 2 HAVING count(*) >= 6 AND max(x + width) - min(x) >= 140),
binned AS (SELECT g.*, b.min_x, b.max_x - b.min_x AS inner_w, greatest(0, floor((x - min_x) / (max_x - min_x) * 48)) AS a, least(47, floor((x + width - min_x) / (max_x - min_x) * 48)) AS z FROM glyphs g JOIN bounds b USING (doc_id, page_no)),
hits AS (SELECT b.doc_id, b.page_no, any_value(b.min_x) AS min_x, any_value(b.inner_w) AS inner_w, r.i, count(*) FILTER (b.a <= r.i AND b.z >= r.i) AS h FROM binned b, range(8, 40) r(i) GROUP BY b.doc_id, b.page_no, r.i),
isles AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i) AS isle FROM hits WHERE h <= 1),
runs AS (SELECT doc_id, page_no, min_x, inner_w, min(i) AS s, count(*) AS len FROM isles GROUP BY 1, 2, 3, 4, isle),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY len DESC, s) = 1),
split AS (SELECT doc_id, page_no, min_x, inner_w, min_x + (s + floor(len / 2) + 0.5) / 48 * inner_w AS split_x FROM best WHERE len / 48 * inner_w >= 24),
sided AS (SELECT g.*, s.split_x, s.inner_w, x + width <= split_x + 3 AS l, x >= split_x - 3 AS r, x < split_x AND x + width > split_x AS spans FROM glyphs g JOIN split s USING (doc_id, page_no)),
sides AS (SELECT *, 'left' AS side FROM sided WHERE l UNION ALL SELECT *, 'right' FROM sided WHERE r),
slines AS (SELECT doc_id, page_no, side, y, sum(length(str)) + count(*) - 1 - count(*) FILTER (regexp_matches(str, '^[,.;:!?%)\\]}]') AND glyph_no <> first_no) AS len
  FROM (SELECT *, min(glyph_no) OVER (PARTITION BY doc_id, page_no, side, y) AS first_no FROM sides) GROUP BY 1, 2, 3, 4),
mid AS (SELECT doc_id, page_no, side, list_sort(list(len))[cast(floor(count(*) / 2) AS int) + 1] AS m, count(*) AS n FROM slines GROUP BY 1, 2, 3),
aligned AS (SELECT doc_id, page_no, avg(CASE WHEN EXISTS (SELECT 1 FROM slines l WHERE l.doc_id = r.doc_id AND l.page_no = r.page_no AND l.side = 'left' AND abs(l.y - r.y) < 6) THEN 1 ELSE 0 END) >= 0.6 AS ok FROM slines r WHERE side = 'right' GROUP BY 1, 2),
short AS (SELECT m.doc_id, m.page_no FROM mid m JOIN aligned USING (doc_id, page_no) WHERE ok GROUP BY 1, 2 HAVING max(m) < 28 AND min(n) >= 2 AND count(*) = 2),
facts AS (SELECT doc_id, page_no, least(max(y) FILTER (side = 'left'), max(y) FILTER (side = 'right')) AS lower_top, median(size) AS body FROM sides GROUP BY 1, 2
  HAVING count(*) FILTER (side = 'left') >= 3 AND count(*) FILTER (side = 'right') >= 3),
headed AS (SELECT s.*, spans OR (y > lower_top + greatest(8, body * 1.15) AND (size >= body * 1.22 OR width >= inner_w * 0.46)) AS head FROM sided s JOIN facts USING (doc_id, page_no)
  WHERE (doc_id, page_no) NOT IN (SELECT (doc_id, page_no) FROM short)),
good AS (SELECT doc_id, page_no FROM headed GROUP BY 1, 2 HAVING count(*) FILTER (l AND NOT head) >= 2 AND count(*) FILTER (r AND NOT head) >= 2),
regions AS (SELECT doc_id, page_no, glyph_no, 1 AS region, split_x FROM headed JOIN good USING (doc_id, page_no) WHERE head
  UNION ALL SELECT doc_id, page_no, glyph_no, 2, split_x FROM headed JOIN good USING (doc_id, page_no) WHERE l AND NOT head
  UNION ALL SELECT doc_id, page_no, glyph_no, 3, split_x FROM headed JOIN good USING (doc_id, page_no) WHERE r AND NOT head
  UNION ALL SELECT doc_id, page_no, glyph_no, 0, NULL FROM glyphs WHERE (doc_id, page_no) NOT IN (SELECT (doc_id, page_no) FROM good))"""


@query("w9_split_columns", f"WITH {_SPLIT_SQL} SELECT * FROM regions")
def w9(spark, sf):
    pages = fx.pages_like(fx.column_titles(spark, sf))
    return C.split_columns(fx.column_glyphs(spark, sf), pages, columns=["glyph_no"]).select("doc_id", "page_no", "glyph_no", "region", "split_x")


_PAIRED_SQL = fx.PROSE_LINES_SQL + """,
paired AS (SELECT doc_id, page_no, CASE WHEN line_no % 2 = 0 THEN 'left' ELSE 'right' END AS side, 740 - 14 * (line_no // 2) + CASE WHEN line_no % 2 = 1 THEN doc_id % 13 ELSE 0 END AS y FROM lines)"""


@query("j7_y_aligned", f"""WITH {_PAIRED_SQL}
SELECT doc_id, page_no, count(*) FILTER (side = 'left') >= 2 AND count(*) FILTER (side = 'right') >= 2 AND count(*) FILTER (side = 'right' AND EXISTS (
  SELECT 1 FROM paired q WHERE q.doc_id = p.doc_id AND q.page_no = p.page_no AND q.side = 'left' AND abs(q.y - p.y) < 6)) / count(*) FILTER (side = 'right') >= 0.6 AS aligned
FROM paired p GROUP BY 1, 2""")
def j7(spark, sf):
    right = F.col("line_no") % 2 == 1
    y = 740 - 14 * F.floor(F.col("line_no") / 2) + F.when(right, F.col("doc_id") % 13).otherwise(0)
    l = fx.prose_lines(spark, sf).select(
        "doc_id", "page_no", F.when(right, "right").otherwise("left").alias("side"), y.cast("double").alias("y")
    )
    a = C.y_aligned(l)
    return a.withColumn("aligned", F.coalesce("aligned", F.lit(False)))


# ------------------------------------------------------------------ coordinates, grids, draw ops

@query("w7_unique_coordinates", f"""WITH RECURSIVE {fx.ORDER_LINES_SQL},
vals AS MATERIALIZED (SELECT doc_id, qty AS v, row_number() OVER (PARTITION BY doc_id ORDER BY qty, rn) AS i FROM order_lines),
walk AS (SELECT doc_id, i, v AS m, 0 AS pos FROM vals WHERE i = 1 UNION ALL
  SELECT v.doc_id, v.i, CASE WHEN abs(w.m - v.v) <= 2 THEN (w.m + v.v) / 2 ELSE v.v END, w.pos + CASE WHEN abs(w.m - v.v) <= 2 THEN 0 ELSE 1 END FROM walk w JOIN vals v ON v.doc_id = w.doc_id AND v.i = w.i + 1)
SELECT doc_id, pos, max_by(m, i) AS value FROM walk GROUP BY 1, 2""")
def w7(spark, sf):
    v = fx.order_lines(spark, sf).groupBy("doc_id").agg(F.collect_list("qty").alias("v"))
    return v.select("doc_id", F.posexplode(T.unique_coordinates(F.col("v"))).alias("pos", "value"))


def _grid_rulings(spark, sf):
    """A full grid per order, except that every fourth misses a line and every fourth has one that ends above its bottom."""
    d = fx.order_ids(spark, sf).groupBy("doc_id").agg((F.count(F.lit(1)) + 1).cast("int").alias("rows"))
    bottom = 732.0 - 16 * F.col("rows")
    k = F.col("doc_id") % 4
    xs = F.array(*[F.lit(v) for v in (66.0, 196.0, 326.0, 456.0)])
    xs = F.when(k == 1, F.slice(xs, 1, 2)).otherwise(xs)
    vertical = F.transform(
        xs,
        lambda x: F.struct(
            x.alias("x1"), F.when((k == 2) & (x == 196.0), bottom + 10).otherwise(bottom).alias("y1"), (x + 0.5).alias("x2"), F.lit(732.0).alias("y2")
        ),
    )
    horizontal = F.transform(
        F.sequence(F.lit(0), F.col("rows")),
        lambda i: F.struct(F.lit(66.0).alias("x1"), (732.0 - 16 * i).alias("y1"), F.lit(456.5).alias("x2"), (732.0 - 16 * i).alias("y2")),
    )
    return d.select("doc_id", F.lit(0).alias("page_no"), F.inline(F.concat(vertical, horizontal)))


@query("j2_grid_cells", f"""WITH {fx.ORDER_GLYPHS_SQL}
SELECT doc_id, page_no, cast(rn AS int) AS row, cast(col AS int) AS col, str AS text FROM glyphs WHERE doc_id % 4 IN (0, 3)""")
def j2(spark, sf):
    return T.ruled_cells(fx.order_glyphs(spark, sf), _grid_rulings(spark, sf)).drop("bold")


_DRAW_SQL = fx.ORDER_LINES_SQL + """,
draw_ops AS (
  SELECT doc_id, 0 AS page_no, rn * 4 AS op_no, CASE WHEN part % 3 = 0 THEN 'restore' ELSE 'save' END AS op, cast([] AS double[]) AS args FROM order_lines UNION ALL
  SELECT doc_id, 0, rn * 4 + 1, 'transform', CASE WHEN part % 7 = 0 THEN [1.0::double] ELSE [1 + (part % 3) / 2, CASE WHEN part % 5 = 0 THEN 1 ELSE 0 END, 0, 1, rn * 5, part % 50]::double[] END FROM order_lines UNION ALL
  SELECT doc_id, 0, rn * 4 + 2, 'path', [10, 20, 10 + supp % 40, 20 + qty % 4]::double[] FROM order_lines UNION ALL
  SELECT doc_id, 0, rn * 4 + 3, 'image', cast([] AS double[]) FROM order_lines)"""


def _draw_ops(spark, sf):
    rn, part = F.col("rn"), F.col("part")
    none = F.array().cast("array<double>")

    def op(k, kind, args):
        return F.struct(F.lit(k).alias("k"), kind.alias("op"), args.alias("args"))

    matrix = F.array(
        1 + (part % 3) / 2, F.when(part % 5 == 0, 1.0).otherwise(0.0), F.lit(0.0), F.lit(1.0),
        (rn * 5).cast("double"), (part % 50).cast("double"),
    )
    path = F.array(F.lit(10.0), F.lit(20.0), (10 + F.col("supp") % 40).cast("double"), 20 + F.col("qty") % 4)
    ops = F.array(
        op(0, F.when(part % 3 == 0, "restore").otherwise("save"), none),
        op(1, F.lit("transform"), F.when(part % 7 == 0, F.array(F.lit(1.0))).otherwise(matrix)),
        op(2, F.lit("path"), path), op(3, F.lit("image"), none),
    )
    o = fx.order_lines(spark, sf).select("doc_id", "rn", F.explode(ops).alias("_o"))
    return o.select(
        "doc_id", F.lit(0).alias("page_no"), (rn * 4 + F.col("_o.k")).alias("op_no"), F.col("_o.op").alias("op"), F.col("_o.args").alias("args")
    )


_STACK_SQL = _DRAW_SQL + """,
ops AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY op_no) AS i FROM draw_ops),
walk AS (
  SELECT doc_id, cast(0 AS bigint) AS i, [1, 0, 0, 1, 0, 0]::double[] AS m, []::double[][] AS stack FROM (SELECT DISTINCT doc_id FROM ops)
  UNION ALL
  SELECT o.doc_id, o.i, CASE WHEN op = 'restore' THEN coalesce(stack[-1], [1, 0, 0, 1, 0, 0]::double[])
      WHEN op = 'transform' AND len(args) >= 6 THEN [m[1]*args[1]+m[3]*args[2], m[2]*args[1]+m[4]*args[2], m[1]*args[3]+m[3]*args[4], m[2]*args[3]+m[4]*args[4], m[1]*args[5]+m[3]*args[6]+m[5], m[2]*args[5]+m[4]*args[6]+m[6]] ELSE m END,
    CASE WHEN op = 'save' THEN list_append(stack, m) WHEN op = 'restore' THEN stack[1:-2] ELSE stack END
  FROM walk w JOIN ops o ON o.doc_id = w.doc_id AND o.i = w.i + 1),
painted AS (SELECT o.doc_id, o.page_no, o.op_no, o.op, w.m, CASE WHEN op = 'image' THEN [0, 0, 1, 1]::double[] ELSE o.args END AS b FROM ops o JOIN walk w USING (doc_id, i) WHERE op IN ('path', 'image')),
corners AS (SELECT *, [m[1]*b[1]+m[3]*b[2]+m[5], m[1]*b[3]+m[3]*b[2]+m[5], m[1]*b[1]+m[3]*b[4]+m[5], m[1]*b[3]+m[3]*b[4]+m[5]] AS xs,
  [m[2]*b[1]+m[4]*b[2]+m[6], m[2]*b[3]+m[4]*b[2]+m[6], m[2]*b[1]+m[4]*b[4]+m[6], m[2]*b[3]+m[4]*b[4]+m[6]] AS ys FROM painted),
boxes AS (SELECT doc_id, page_no, op_no, op, list_min(xs) AS x1, list_min(ys) AS y1, list_max(xs) AS x2, list_max(ys) AS y2 FROM corners)"""


@query("w15_ruling_segments", f"""WITH RECURSIVE {_STACK_SQL}
SELECT doc_id, page_no, cast(op_no AS bigint) AS op_no, x1, y1, x2, y2 FROM boxes WHERE op = 'path' AND ((x2 - x1 <= 2.5 AND y2 - y1 >= 8) OR (y2 - y1 <= 2.5 AND x2 - x1 >= 8))""")
def w15(spark, sf):
    return D.ruling_segments(_draw_ops(spark, sf))


@query("w16_image_placements", f"WITH RECURSIVE {_STACK_SQL} SELECT doc_id, page_no, cast(op_no AS bigint) AS op_no, x1, y1, x2, y2 FROM boxes WHERE op = 'image'")
def w16(spark, sf):
    return D.image_placements(_draw_ops(spark, sf))


_PLACE_SQL = fx.ORDER_LINES_SQL + """,
put AS (SELECT doc_id, 0 AS page_no, cast(rn AS bigint) AS op_no, cast((part % 4) * 0.9 - 1 AS double) AS x1, cast((supp % 3) * 1.1 + 700 AS double) AS y1, cast((part % 4) * 0.9 + 14 + supp % 7 AS double) AS x2, cast(800 - disc * 100 AS double) AS y2 FROM order_lines),
clip AS (SELECT doc_id, page_no, op_no, greatest(0.0, x1) AS x, least(792.0, y2) AS top, greatest(0.0, y1) AS bottom, least(612.0, x2) - greatest(0.0, x1) AS width, least(792.0, y2) - greatest(0.0, y1) AS height FROM put),
big AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY op_no) AS i FROM clip WHERE width >= 16 AND height >= 16 AND width * height / (612 * 792) >= 0.0001),
walk AS (SELECT doc_id, i, [{'x': x, 't': top, 'w': width, 'h': height}] AS kept, true AS keep FROM big WHERE i = 1 UNION ALL
  SELECT b.doc_id, b.i, CASE WHEN len(list_filter(kept, lambda k: abs(k.x - b.x) < 2 AND abs(k.t - b.top) < 2 AND abs(k.w - b.width) < 2 AND abs(k.h - b.height) < 2)) > 0 THEN kept ELSE list_append(kept, {'x': b.x, 't': b.top, 'w': b.width, 'h': b.height}) END,
    len(list_filter(kept, lambda k: abs(k.x - b.x) < 2 AND abs(k.t - b.top) < 2 AND abs(k.w - b.width) < 2 AND abs(k.h - b.height) < 2)) = 0
  FROM walk w JOIN big b ON b.doc_id = w.doc_id AND b.i = w.i + 1)"""


@query("j8_dedupe_placements", f"WITH RECURSIVE {_PLACE_SQL} SELECT doc_id, page_no, op_no, x, top, bottom, width, height FROM big JOIN walk USING (doc_id, i) WHERE keep")
def j8(spark, sf):
    part, supp = F.col("part"), F.col("supp")
    put = fx.order_lines(spark, sf).select(
        "doc_id", F.lit(0).alias("page_no"), F.col("rn").cast("long").alias("op_no"), ((part % 4) * 0.9 - 1).alias("x1"),
        ((supp % 3) * 1.1 + 700).alias("y1"), ((part % 4) * 0.9 + 14 + supp % 7).alias("x2"), (800 - F.col("disc") * 100).alias("y2"),
    )
    return D.dedupe_placements(put, fx.pages_like(put))


# ------------------------------------------------------------------ blocks

@query("w10_order_and_space", f"""WITH {fx.ORDER_LINES_SQL},
b AS (SELECT doc_id, 0 AS page_no, rn AS block_no, CASE WHEN rn <> 5 THEN cast(700 - part % 600 AS double) END AS top, CASE WHEN rn <> 3 THEN cast(700 - part % 600 - 12 AS double) END AS bottom FROM order_lines)
SELECT *, row_number() OVER w - 1 AS position,
  CASE WHEN top IS NOT NULL THEN greatest(0.0, least(792.0, coalesce(last_value(bottom IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY top DESC NULLS LAST, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 792.0) - top) * 0.65) END AS space_before
FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY top DESC NULLS LAST, block_no)""")
def w10(spark, sf):
    top = (700 - F.col("part") % 600).cast("double")
    b = fx.order_lines(spark, sf).select(
        "doc_id", F.lit(0).alias("page_no"), F.col("rn").alias("block_no"), F.when(F.col("rn") != 5, top).alias("top"), F.when(F.col("rn") != 3, top - 12).alias("bottom")
    )
    return K.order_and_space(b, fx.pages_like(b))


_BLOCKS_SQL = fx.DOC_PAGES_SQL + """,
tops AS (SELECT doc_id, page_no, cast(u.b AS int) AS block_no, (['image', 'table', 'columns', 'para'])[(doc_id * 7 + page_no * 3 + u.b * (doc_id % 2)) % 4 + 1] AS kind
  FROM doc_pages, unnest(range(0, (doc_id + page_no) % 4)) AS u(b)),
blocks AS (SELECT doc_id, page_no, block_no, NULL AS parent_block_no, kind FROM tops UNION ALL
  SELECT doc_id, page_no, 100 + block_no, block_no, CASE WHEN doc_id % 2 = 0 THEN 'image' ELSE 'table' END FROM tops WHERE kind = 'columns')"""


def _blocks(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("image", "table", "columns", "para")])
    n = (F.col("doc_id") + F.col("page_no")) % 4
    t = fx.doc_pages(spark, sf).where(n > 0).select("doc_id", "page_no", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("block_no"))
    t = t.withColumn("kind", F.get(kinds, ((F.col("doc_id") * 7 + F.col("page_no") * 3 + F.col("block_no") * (F.col("doc_id") % 2)) % 4).cast("int")))
    top = t.withColumn("parent_block_no", F.lit(None).cast("int"))
    nested = t.where(F.col("kind") == "columns").select(
        "doc_id", "page_no", (100 + F.col("block_no")).alias("block_no"), F.when(F.col("doc_id") % 2 == 0, "image").otherwise("table").alias("kind"),
        F.col("block_no").alias("parent_block_no"),
    )
    return top.unionByName(nested)


@query("a2_conversion_report", f"""WITH {_BLOCKS_SQL},
pg AS (SELECT p.doc_id, p.page_no, p.ocr_confidence, count(kind) FILTER (parent_block_no IS NULL) AS n, count(kind) FILTER (parent_block_no IS NULL AND kind = 'image') AS ni,
  count(*) FILTER (kind = 'table') AS t, count(*) FILTER (kind = 'columns') AS c, count(*) FILTER (kind = 'image') AS i FROM doc_pages p LEFT JOIN blocks b USING (doc_id, page_no) GROUP BY 1, 2, 3),
r AS (SELECT doc_id, count(*) FILTER (NOT (n > 0 AND n = ni)) AS editable_pages, count(*) FILTER (n > 0 AND n = ni) AS image_only_pages,
  coalesce(string_agg(cast(page_no + 1 AS varchar), ',' ORDER BY page_no) FILTER (n > 0 AND n = ni), '') AS image_only_page_numbers, cast(sum(t) AS bigint) AS tables, cast(sum(c) AS bigint) AS column_groups, cast(sum(i) AS bigint) AS images,
  coalesce(string_agg(cast(page_no + 1 AS varchar), ',' ORDER BY page_no) FILTER (ocr_confidence IS NOT NULL), '') AS ocr_page_numbers FROM pg GROUP BY 1)
SELECT *, cast(ocr_page_numbers <> '' AS int) + cast(image_only_pages > 0 AS int) AS warning_count FROM r""")
def a2(spark, sf):
    return K.conversion_report(_blocks(spark, sf), fx.doc_pages(spark, sf))


_SPOTS_SQL = _BLOCKS_SQL + """,
spots AS (SELECT doc_id, page_no, block_no, parent_block_no, kind, cast(20 + (doc_id * 3 + block_no * 11) % 260 AS double) AS x, cast(20 + (doc_id * 3 + block_no * 11) % 260 + (page_no * 37) % 330 AS double) AS x_end,
  CASE WHEN doc_id % 5 = 0 THEN 600.0::double ELSE cast(150 + (doc_id * 17 + page_no) % 200 AS double) END AS width, CASE WHEN doc_id % 5 = 0 THEN 800.0::double ELSE 90.0::double END AS height,
  CASE WHEN block_no % 3 <> 2 THEN cast(780 - (doc_id % 300) - block_no AS double) END AS top, CASE WHEN block_no % 3 <> 1 THEN cast(400 - (doc_id % 390) AS double) END AS bottom FROM blocks)"""


@query("a6_page_margins", f"""WITH {_SPOTS_SQL},
e AS (SELECT *, x AS l, CASE WHEN kind = 'para' THEN x_end ELSE x + width END AS r FROM spots WHERE parent_block_no IS NULL),
b AS (SELECT p.doc_id, p.page_no, p.width AS w, p.height AS h, min(l) FILTER (r > l) AS l, max(r) FILTER (r > l) AS r, max(top) AS t, min(bottom) AS m,
  coalesce(bool_or(e.kind = 'image' AND e.width >= p.width * 0.92 AND e.height >= p.height * 0.92), false) AS full_page FROM doc_pages p LEFT JOIN e USING (doc_id, page_no) GROUP BY 1, 2, 3, 4),
q AS (SELECT *, greatest(0, least(w * 0.28, coalesce(l, 36))) AS ml, greatest(0, w - coalesce(r, w - coalesce(l, 36))) AS gap FROM b),
s AS (SELECT *, CASE WHEN gap < ml * 0.55 THEN gap ELSE ml END AS mr FROM q),
z AS (SELECT *, CASE WHEN ml + mr > w - 72 THEN (w - 72) / greatest(1, ml + mr) ELSE 1 END AS k FROM s)
SELECT doc_id, page_no, cast(CASE WHEN full_page THEN 0 ELSE ml * k END AS double) AS margin_left, cast(CASE WHEN full_page THEN 0 ELSE mr * k END AS double) AS margin_right,
  cast(CASE WHEN full_page THEN 0 WHEN greatest(0, coalesce(t, 0)) > 0 THEN greatest(0, least(h * 0.25, h - t)) ELSE 36 END AS double) AS margin_top,
  cast(CASE WHEN full_page THEN 0 ELSE greatest(0, least(72, least(h, coalesce(m, h)))) END AS double) AS margin_bottom,
  cast(CASE WHEN full_page THEN w ELSE greatest(72, w - (ml + mr) * k) END AS double) AS content_width FROM z""")
def a6(spark, sf):
    d, p, n = F.col("doc_id"), F.col("page_no"), F.col("block_no")
    x = (20 + (d * 3 + n * 11) % 260).cast("double")
    spots = _blocks(spark, sf).select(
        "doc_id", "page_no", "block_no", "parent_block_no", "kind", x.alias("x"), (x + (p * 37) % 330).alias("x_end"),
        F.when(d % 5 == 0, 600.0).otherwise((150 + (d * 17 + p) % 200).cast("double")).alias("width"), F.when(d % 5 == 0, 800.0).otherwise(90.0).alias("height"),
        F.when(n % 3 != 2, (780 - d % 300 - n).cast("double")).alias("top"), F.when(n % 3 != 1, (400 - d % 390).cast("double")).alias("bottom"),
    )
    return K.page_margins(spots, fx.doc_pages(spark, sf))


@query("f3_page_route", f"""WITH {fx.DOC_PAGES_SQL},
s AS (SELECT doc_id, page_no, (doc_id * 13 + page_no * 7) % 40 AS chars, width * height * ((doc_id % 10) / 10) AS image_area, width * height AS page_area, ocr_confidence, doc_id % 25 AS ocr_chars, page_no % 3 AS ocr_blocks FROM doc_pages)
SELECT doc_id, page_no, CASE WHEN chars >= 12 AND image_area <= page_area * 0.55 THEN 'text' WHEN ocr_confidence >= 65 AND ocr_chars >= 10 AND ocr_blocks > 0 THEN 'ocr' ELSE 'image' END AS route FROM s""")
def f3(spark, sf):
    d, p = F.col("doc_id"), F.col("page_no")
    area = F.col("width") * F.col("height")
    s = fx.doc_pages(spark, sf).select(
        "doc_id", "page_no", ((d * 13 + p * 7) % 40).alias("chars"), (area * ((d % 10) / 10)).alias("image_area"), area.alias("page_area"),
        "ocr_confidence", (d % 25).alias("ocr_chars"), (p % 3).alias("ocr_blocks"),
    )
    return K.page_route(s).select("doc_id", "page_no", "route")


# ------------------------------------------------------------------ sources

@query("s1_sniff_kind", f"""WITH {FILES_SQL}
SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE
  CASE WHEN lower(mime) IN ('image/jpeg', 'image/jpg') OR regexp_matches(lower(name), '\\.jpe?g$') THEN 'jpg' WHEN lower(mime) = 'image/png' OR ends_with(lower(name), '.png') THEN 'png'
   WHEN lower(mime) = 'image/webp' OR ends_with(lower(name), '.webp') THEN 'webp' ELSE 'other' END END AS kind FROM files""")
def s1(spark, sf):
    k = F.col("file_id") % 5
    head = F.when(k == 0, "FFD8FF00").when(k == 1, "89504E470D0A1A0A").when(k == 2, "524946460000000057454250").otherwise("25504446")
    f = files(spark, sf).withColumn("content", F.concat(F.unhex(head), F.encode("html", "UTF-8")))
    return N.sniff_kind(f).select("file_id", "kind")


_ITEMS_SQL = fx.PROSE_GLYPHS_SQL + """,
items AS (SELECT *, CASE glyph_no % 4 WHEN 0 THEN 'F1' WHEN 1 THEN 'F2' WHEN 2 THEN 'ABCDEF+BoldItalic' ELSE 'F9' END AS font FROM glyphs WHERE glyph_no % 50 NOT IN (7, 8)),
styled AS (SELECT *, CASE font WHEN 'F1' THEN 'Georgia' WHEN 'F2' THEN 'Demi Sans' END AS family FROM items)"""


def _text_items(spark, sf):
    n = F.col("glyph_no")
    font = F.when(n % 4 == 0, "F1").when(n % 4 == 1, "F2").when(n % 4 == 2, "ABCDEF+BoldItalic").otherwise("F9")
    full = F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.when(n % 3 == 0, 0.0).otherwise(F.col("size")), F.col("x"), F.col("y"))
    g = fx.prose_glyphs(spark, sf)
    item = F.to_json(
        F.struct(
            F.when(n % 50 == 7, "").otherwise(F.col("str")).alias("str"), F.when(F.col("rtl"), "rtl").otherwise("ltr").alias("dir"),
            F.when(n % 5 == 0, -1.0).otherwise(F.col("width")).alias("width"), F.when(n % 6 == 1, F.col("size")).otherwise(0.0).alias("height"),
            F.when(n % 50 == 8, F.slice(full, 1, 4)).otherwise(full).alias("transform"), font.alias("fontName"), (n % 8 == 7).alias("hasEOL"),
        )
    )
    fonts = F.array(
        F.struct(F.lit("F1").alias("font_name"), F.lit("\"Georgia\", serif").alias("family"), F.lit(True).alias("bold"), F.lit(False).alias("italic")),
        F.struct(F.lit("F2").alias("font_name"), F.lit("QWERTY+Demi Sans").alias("family"), F.lit(False).alias("bold"), F.lit(True).alias("italic")),
    )
    styles = table(spark, sf, "documents").select("doc_id", F.inline(fonts))
    return g.select("doc_id", "page_no", "glyph_no", item.alias("item")), styles


@query("s2_read_text_items", f"""WITH {_ITEMS_SQL}
SELECT doc_id, page_no, glyph_no, str, x, y, CASE WHEN glyph_no % 5 = 0 THEN 0.0::double ELSE width END AS width,
  CASE WHEN glyph_no % 6 = 1 THEN size WHEN glyph_no % 3 = 0 THEN 5.0::double ELSE size END AS size, glyph_no % 8 = 7 AS eol, font AS font_name, family AS font_family,
  font = 'F1' OR regexp_matches(font || ' ' || coalesce(family, ''), '(?i)bold|black|heavy|demi') AS bold, font = 'F2' OR regexp_matches(font || ' ' || coalesce(family, ''), '(?i)italic|oblique') AS italic, rtl FROM styled""")
def s2(spark, sf):
    return N.read_text_items(*_text_items(spark, sf))


_OCR_SQL = fx.PROSE_GLYPHS_SQL + """,
w AS (SELECT doc_id, page_no, true_line // 9 AS para_no, true_line AS line_no, glyph_no AS word_no, ' ' || str || ' ' AS text, CASE WHEN doc_id % 7 = 2 THEN 10 ELSE (glyph_no * 37) % 100 END AS confidence,
  x * 2 AS x0, (792 - y - 10) * 2 AS y0, (x + width) * 2 AS x1, (792 - y) * 2 AS y1, doc_id % 10 <> 3 AS is_ltr FROM glyphs),
kept AS (SELECT *, lead(word_no) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY word_no) IS NULL AS eol, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY word_no) - 1 AS g FROM w WHERE confidence >= 25),
raw AS (SELECT doc_id, page_no, true_line, string_agg(str, ' ' ORDER BY glyph_no) AS line FROM glyphs GROUP BY 1, 2, 3)"""


@query("s3_read_ocr_words", f"""WITH {_OCR_SQL}
SELECT doc_id, page_no, cast(g AS int) AS glyph_no, trim(text) AS str, x0 / 2 AS x, 792 - y1 / 2 AS y, greatest(1, (x1 - x0) / 2) AS width, greatest(7, least(42, greatest(1, (y1 - y0) / 2) * 0.82)) AS size, eol, 'Arial' AS font_family, NOT is_ltr AS rtl FROM kept
UNION ALL SELECT doc_id, page_no, cast(true_line AS int), line, 36, greatest(24, 792 - 48 - true_line * 16), least(540, length(line) * 5.6::double), 11, true, 'Arial', false FROM raw WHERE (doc_id, page_no) NOT IN (SELECT (doc_id, page_no) FROM kept)""")
def s3(spark, sf):
    g = fx.prose_glyphs(spark, sf).withColumn("line_no", F.floor((740 - F.col("y")) / 14).cast("int"))
    words = g.select(
        "doc_id", "page_no", F.floor(F.col("line_no") / 9).alias("para_no"), "line_no", F.col("glyph_no").alias("word_no"),
        F.concat(F.lit(" "), "str", F.lit(" ")).alias("text"), F.when(F.col("doc_id") % 7 == 2, 10).otherwise((F.col("glyph_no") * 37) % 100).alias("confidence"),
        (F.col("x") * 2).alias("x0"), ((792 - F.col("y") - 10) * 2).alias("y0"), ((F.col("x") + F.col("width")) * 2).alias("x1"), ((792 - F.col("y")) * 2).alias("y1"),
        (F.col("doc_id") % 10 != 3).alias("is_ltr"), F.lit("").alias("font_name"),
    )
    ws = F.sort_array(F.collect_list(F.struct("glyph_no", "line_no", "str")))

    def printed(w, i):
        before = F.get(F.col("_ws"), i - 1)["line_no"]
        return F.concat(F.when(i == 0, "").when(before == w["line_no"], " ").otherwise("\r\n"), w["str"])

    pages = g.groupBy("doc_id", "page_no").agg(ws.alias("_ws")).select(
        "doc_id", "page_no", F.array_join(F.transform("_ws", printed), "").alias("raw_text"), F.lit(792.0).alias("height"), F.lit(2.0).alias("scale")
    )
    return N.read_ocr_words(words, pages)


_OUTLINE_SQL = """outline AS (SELECT concat('r', cast(r_regionkey AS varchar)) AS node_id, cast(NULL AS varchar) AS parent_id, cast(r_regionkey AS bigint) AS ord, r_name AS title, 0 AS page_index FROM region
 UNION ALL SELECT concat('n', cast(n_nationkey AS varchar)), concat('r', cast(n_regionkey AS varchar)), n_nationkey, n_name, n_nationkey % 50 FROM nation
 UNION ALL SELECT concat('c', cast(c_custkey AS varchar)), concat('n', cast(c_nationkey AS varchar)), c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE cast(c_custkey % 50 AS int) END FROM customer
 UNION ALL SELECT concat('o', cast(o_orderkey AS varchar)), concat('c', cast(o_custkey AS varchar)), o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_orderpriority END, cast(o_orderkey % 50 AS int) FROM orders)"""


@query("s6_flatten_outline", f"""WITH RECURSIVE {_OUTLINE_SQL},
tree AS (SELECT node_id, title, page_index, 0 AS depth, lpad(cast(ord::HUGEINT + 9223372036854775808 AS varchar), 20, '0') AS sort_path FROM outline WHERE parent_id IS NULL
  UNION ALL SELECT o.node_id, o.title, o.page_index, t.depth + 1, t.sort_path || '/' || lpad(cast(o.ord::HUGEINT + 9223372036854775808 AS varchar), 20, '0') FROM tree t JOIN outline o ON o.parent_id = t.node_id)
SELECT 0 AS doc_id, node_id, trim(title) AS title, page_index, least(3, depth) AS depth, position FROM (SELECT *, row_number() OVER (ORDER BY sort_path) - 1 AS position FROM tree) WHERE trim(title) <> '' AND page_index IS NOT NULL""")
def s6(spark, sf):
    def key(prefix, col):
        return F.concat(F.lit(prefix), F.col(col).cast("string"))

    def nodes(df, node, parent, ord_, title, page):
        return df.select(
            F.lit(0).alias("doc_id"), node.alias("node_id"), parent.alias("parent_id"), F.col(ord_).cast("long").alias("ord"), title.alias("title"), page.cast("int").alias("page_index")
        )

    r, n, c, o = (table(spark, sf, t) for t in ("region", "nation", "customer", "orders"))
    outline = (
        nodes(r, key("r", "r_regionkey"), F.lit(None).cast("string"), "r_regionkey", F.col("r_name"), F.lit(0))
        .unionByName(nodes(n, key("n", "n_nationkey"), key("r", "n_regionkey"), "n_nationkey", F.col("n_name"), F.col("n_nationkey") % 50))
        .unionByName(nodes(c, key("c", "c_custkey"), key("n", "c_nationkey"), "c_custkey", F.col("c_name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 50)))
        .unionByName(nodes(o, key("o", "o_orderkey"), key("c", "o_custkey"), "o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "  ").otherwise(F.col("o_orderpriority")), F.col("o_orderkey") % 50))
    )
    return N.flatten_outline(outline)


@query("s8_result_columns", """SELECT o_orderkey AS doc_id, o_orderstatus <> 'F' AS ok, CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'encrypted' WHEN 1 THEN 'failed' ELSE o_orderpriority END END AS error,
  cast(o_orderkey % 64 AS int) AS doc_bucket FROM orders""")
def s8(spark, sf):
    k = F.col("o_orderkey") % 3
    message = F.when(k == 0, "Input is ENCRYPTED").when(k == 1, "  ").otherwise(F.col("o_orderpriority"))
    o = table(spark, sf, "orders").withColumn("doc_id", F.col("o_orderkey"))
    return N.result_columns(o, F.col("o_orderstatus") == "F", message).select("doc_id", "ok", "error", "doc_bucket")

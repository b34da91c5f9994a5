"""Model tables derived from the given tables, with the same derivation in DuckDB SQL.

Rows come from one source row or from an aggregate that combines before the
shuffle.  Only lines of an order are numbered, by the order they are printed
on; an order is a page, the key that every layout operator works by anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.catalog.registry import table
from leafline.operators.ordering import deal, gather, laid, still

# ---------------------------------------------------------------- printed orders

ORDER_LINES_SQL = """
order_lines AS (
  SELECT l_orderkey AS doc_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
           l_quantity, l_returnflag, l_discount, l_tax) AS int) AS rn, l_partkey AS part, l_quantity AS qty,
         l_returnflag AS flag, l_discount AS disc, l_tax AS tax, l_suppkey AS supp
  FROM lineitem)"""


_PRINTED = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount", "l_tax"]


def _order_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), *_PRINTED)


def _numbered(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[F.asc_nulls_last(c) for c in _PRINTED]))
    return rows.select(
        "doc_id", place.alias("rn"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_suppkey").alias("supp"),
    )


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of lineitem, numbered from 1 within its order."""
    return _numbered(_order_rows(spark, sf))


def order_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The order of every row of lineitem, dealt to partitions as ``order_glyphs`` are."""
    rows = _order_rows(spark, sf)
    return deal(rows.select("doc_id"), ["doc_id"], rows)


ORDER_GLYPHS_SQL = ORDER_LINES_SQL + """,
order_cells AS (
  SELECT doc_id, rn, 0 AS col, cast(part AS varchar) AS str FROM order_lines UNION ALL
  SELECT doc_id, rn, 1, cast(cast(floor(qty) AS bigint) AS varchar) FROM order_lines UNION ALL
  SELECT doc_id, rn, 2, flag FROM order_lines UNION ALL
  SELECT DISTINCT doc_id, 0, h.col, h.str FROM order_lines,
    (VALUES (0, 'Part'), (1, 'Qty'), (2, 'Flag')) h(col, str)),
glyphs AS (
  SELECT doc_id, 0 AS page_no, rn * 3 + col AS glyph_no, rn, col, str,
         cast(72 + 130 * col AS double) AS x, cast(720 - 16 * rn AS double) AS y,
         cast(5 * length(str) AS double) AS width, cast(10 AS double) AS size,
         rn = 0 AND doc_id % 2 = 0 AS bold
  FROM order_cells)"""


def order_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    """One printed page per order: a header row and one row per line number.

    The rows of an order are gathered before they are taken apart, and the
    header goes with the first of them, so an order's glyphs lie together.
    """
    lines = _numbered(deal(_order_rows(spark, sf), ["doc_id"]))  # in the order of doc_id

    def cells(rn: Column, *texts: Column) -> list[Column]:
        return [F.struct(rn.cast("int").alias("rn"), F.lit(col).alias("col"), text.alias("str")) for col, text in enumerate(texts)]

    head = cells(F.lit(0), F.lit("Part"), F.lit("Qty"), F.lit("Flag"))
    body = cells(F.col("rn"), F.col("part").cast("string"), F.floor("qty").cast("string"), F.col("flag"))
    printed = F.when(F.col("rn") == 1, F.array(*head, *body)).otherwise(F.array(*body))
    glyphs = lines.select("doc_id", F.inline_outer(printed)).select(
        "doc_id", F.lit(0).alias("page_no"), (F.col("rn") * 3 + F.col("col")).alias("glyph_no"), "str",
        (72 + 130 * F.col("col")).cast("double").alias("x"), (720 - 16 * F.col("rn")).cast("double").alias("y"),
        (5 * F.length("str")).cast("double").alias("width"), F.lit(10.0).alias("size"),
        ((F.col("rn") == 0) & (F.col("doc_id") % 2 == 0)).alias("bold"),
    )
    return laid(glyphs, ["doc_id"])


# ---------------------------------------------------------------- prose pages

_WORDS_SQL = """
prose_words AS (
  SELECT doc_id, u.word, u.n - 1 AS n,
    (u.n - 1) // {per_line} AS ln
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]'), lambda w: w <> '') AS ws FROM documents),
       unnest(ws) WITH ORDINALITY AS u(word, n)),
prose AS (
  SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, ln ORDER BY n
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead_chars FROM prose_words)"""

PROSE_GLYPHS_SQL = _WORDS_SQL.format(per_line=8) + """,
glyphs AS (
  SELECT doc_id, cast(ln // 45 AS int) AS page_no, n AS glyph_no, word AS str, cast(ln % 45 AS int) AS true_line,
         cast(72 + 5 * lead_chars AS double) AS x, cast(740 - 14 * (ln % 45) AS double) AS y,
         cast(5 * length(word) AS double) AS width,
         cast(CASE WHEN ln % 45 = 0 THEN 16 WHEN n % 8 = 3 THEN 9 ELSE 10 END AS double) AS size,
         n % 11 = 0 AS bold, n % 7 = 0 AS italic, doc_id % 10 = 3 AS rtl,
         CASE WHEN doc_id % 2 = 0 THEN 'Arial' ELSE 'Georgia' END AS font_family
  FROM prose)"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their words as one array."""
    return _words(table(spark, sf, "documents"))


def _words(docs: DataFrame) -> DataFrame:
    return still(docs.select("doc_id", F.array_remove(F.split("text", "[ \n]"), "").alias("ws")), docs)


def _gathered_words(spark: SparkSession, sf: str) -> DataFrame:
    """``words``, rows of one doc_id together, so that their words lie together when they are taken apart."""
    return _words(gather(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"]))


def _placed_words(spark: SparkSession, sf: str, per_line: int | Column, titled: int | None = None) -> DataFrame:
    """Words with their number, line, and the characters before them on that line; a line is cut once, then taken apart.

    With ``titled``, a word without text and with number -1 stands before every so many lines of a document.
    """
    per = F.lit(per_line) if isinstance(per_line, int) else per_line
    last = F.floor((F.size("ws") - 1) / per).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("ws"), i * per + 1, per))
    docs = _gathered_words(spark, sf)
    lines = docs.select("doc_id", F.posexplode_outer(F.when(F.size("ws") > 0, cut)).alias("ln", "_line"))
    shift = F.lit(0) if titled is None else F.when(F.col("ln") % titled == 0, 1).otherwise(0)
    each = F.col("_line") if titled is None else F.when(F.col("ln") % titled == 0, F.concat(F.array(F.lit("")), "_line")).otherwise(F.col("_line"))
    placed = lines.select("doc_id", "ln", "_line", F.posexplode_outer(each).alias("_i", "word")).where(F.col("word").isNotNull())
    placed = placed.withColumn("_i", F.col("_i") - shift)
    lead = F.length(F.array_join(F.slice("_line", F.lit(1), F.greatest(F.lit(0), "_i")), " ")) + F.when(F.col("_i") > 0, 1).otherwise(0)
    n = F.when(F.col("_i") < 0, -1).otherwise(F.col("ln") * per + F.col("_i"))
    return still(placed.select("doc_id", "word", n.alias("n"), "ln", lead.alias("lead")), docs)


def prose_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents set as prose: 8 words per line, 45 lines per page."""
    p = _placed_words(spark, sf, 8)
    glyphs = p.select(
        "doc_id", F.floor(F.col("ln") / 45).cast("int").alias("page_no"), F.col("n").alias("glyph_no"),
        F.col("word").alias("str"), (72 + 5 * F.col("lead")).cast("double").alias("x"),
        (740 - 14 * (F.col("ln") % 45)).cast("double").alias("y"),
        (5 * F.length("word")).cast("double").alias("width"),
        F.when(F.col("ln") % 45 == 0, 16.0).when(F.col("n") % 8 == 3, 9.0).otherwise(10.0).alias("size"),
        (F.col("n") % 11 == 0).alias("bold"), (F.col("n") % 7 == 0).alias("italic"),
        (F.col("doc_id") % 10 == 3).alias("rtl"),
        F.when(F.col("doc_id") % 2 == 0, "Arial").otherwise("Georgia").alias("font_family"),
    )
    return still(glyphs, p)


SKEWED_GLYPHS_SQL = PROSE_GLYPHS_SQL + """,
skewed AS (SELECT doc_id, page_no, glyph_no, str, x, y - (glyph_no % 4) * 1.5 AS y, width, size FROM glyphs)"""


def skewed_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    """Prose whose baselines wobble by up to 4.5 points, so lines need the running mean."""
    g = prose_glyphs(spark, sf)
    return g.select(
        "doc_id", "page_no", "glyph_no", "str", "x",
        (F.col("y") - (F.col("glyph_no") % 4) * 1.5).alias("y"), "width", "size",
    )


COLUMN_GLYPHS_SQL = _WORDS_SQL.format(per_line="(CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 6 END)") + """,
column_words AS (
  SELECT doc_id, cast(ln // 60 AS int) AS page_no, n AS glyph_no, word AS str,
         cast(72 + 260 * ((ln // 30) % 2) + 2 * lead_chars AS double) AS x,
         cast(700 - 14 * (ln % 30) AS double) AS y, cast(2 * length(word) AS double) AS width, cast(6 AS double) AS size
  FROM prose),
glyphs AS (
  SELECT * FROM column_words UNION ALL
  SELECT DISTINCT doc_id, page_no, -1, 'Title of this page', cast(72 AS double), cast(760 AS double),
         cast(400 AS double), cast(14 AS double) FROM column_words)"""


def column_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of 30 lines under a wide title; every third document has short lines."""
    per_line = F.when(F.col("doc_id") % 3 == 0, 3).otherwise(6)
    p = _placed_words(spark, sf, per_line, titled=60)

    def either(title, body):
        return F.when(F.col("n") < 0, F.lit(title)).otherwise(body)

    glyphs = p.select(
        "doc_id", F.floor(F.col("ln") / 60).cast("int").alias("page_no"), F.col("n").alias("glyph_no"),
        either("Title of this page", F.col("word")).alias("str"),
        either(72.0, (72 + 260 * (F.floor(F.col("ln") / 30) % 2) + 2 * F.col("lead")).cast("double")).alias("x"),
        either(760.0, (700 - 14 * (F.col("ln") % 30)).cast("double")).alias("y"),
        either(400.0, (2 * F.length("word")).cast("double")).alias("width"), either(14.0, F.lit(6.0)).alias("size"),
    )
    return still(glyphs, p)


def column_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The wide title on every page of ``column_glyphs``."""
    per_line = F.when(F.col("doc_id") % 3 == 0, 3).otherwise(6)
    pages = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("ws") - 1) / (60 * per_line))).cast("int"))
    return _words(table(spark, sf, "documents", spread=False)).where(F.size("ws") > 0).select(
        "doc_id", F.explode(pages).alias("page_no"), F.lit(-1).alias("glyph_no"),
        F.lit("Title of this page").alias("str"), F.lit(72.0).alias("x"), F.lit(760.0).alias("y"),
        F.lit(400.0).alias("width"), F.lit(14.0).alias("size"),
    )


# ---------------------------------------------------------------- lines

PROSE_LINES_SQL = """
line_words AS (
  SELECT doc_id, (u.n - 1) // 8 AS ln, string_agg(u.word, ' ' ORDER BY u.n) AS text
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]'), lambda w: w <> '') AS ws FROM documents),
       unnest(ws) WITH ORDINALITY AS u(word, n) GROUP BY 1, 2),
lines AS (
  SELECT doc_id, cast(ln // 45 AS int) AS page_no, cast(ln % 45 AS int) AS line_no, text,
         cast(CASE WHEN ln % 7 = 0 THEN 90 ELSE 72 END AS double) AS x,
         cast(CASE WHEN ln % 7 = 0 THEN 90 ELSE 72 END + 5 * length(text) AS double) AS x_end,
         cast(740 - 14 * (ln % 45) - 10 * ((ln % 45) // 7) AS double) AS y,
         cast(11 AS double) AS height, cast(CASE WHEN ln % 13 = 0 THEN 14 ELSE 10 END AS double) AS font_size,
         ln % 5 = 0 AS bold, false AS italic, ln % 17 = 0 AS rtl, cast(612 AS double) AS page_width
  FROM line_words)"""


def prose_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Finished lines of prose with indents, gaps, larger and bold lines."""
    last = F.floor((F.size("ws") - 1) / 8).cast("int")
    l = words(spark, sf).where(F.size("ws") > 0).select(
        "doc_id",
        F.posexplode(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(F.col("ws"), i * 8 + 1, 8), " "))
        ).alias("ln", "text"),
    )
    x = F.when(F.col("ln") % 7 == 0, 90.0).otherwise(72.0)
    on_page = F.col("ln") % 45
    return l.select(
        "doc_id", F.floor(F.col("ln") / 45).cast("int").alias("page_no"), on_page.alias("line_no"), "text",
        x.alias("x"), (x + 5 * F.length("text")).alias("x_end"),
        (740 - 14 * on_page - 10 * F.floor(on_page / 7)).cast("double").alias("y"), F.lit(11.0).alias("height"),
        F.when(F.col("ln") % 13 == 0, 14.0).otherwise(10.0).alias("font_size"),
        (F.col("ln") % 5 == 0).alias("bold"), F.lit(False).alias("italic"), (F.col("ln") % 17 == 0).alias("rtl"),
        F.lit(612.0).alias("page_width"),
    )


LIST_LINES_SQL = ORDER_LINES_SQL + """,
lines AS (
  SELECT doc_id, 0 AS page_no, rn AS line_no,
         CASE WHEN rn % 4 = 3 THEN p_name WHEN (doc_id + rn // 5) % 2 = 0 THEN concat(cast(rn AS varchar), '. ', p_name)
              ELSE concat('• ', p_name) END AS text,
         cast(72 + 24 * (rn % 3) AS double) AS x, cast(72 + 24 * (rn % 3) + 90 AS double) AS x_end,
         cast(720 - 14 * rn AS double) AS y, cast(11 AS double) AS height, cast(10 AS double) AS font_size,
         false AS bold, false AS italic, false AS rtl, cast(612 AS double) AS page_width
  FROM order_lines JOIN part ON part = p_partkey)"""


def list_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines printed as numbered and bulleted items with plain follow-on lines."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_name")
    rn = F.col("rn")
    numbered = (F.col("doc_id") + F.floor(rn / 5)) % 2 == 0
    x = (72 + 24 * (rn % 3)).cast("double")
    return order_lines(spark, sf).join(part, "part").select(
        "doc_id", F.lit(0).alias("page_no"), rn.alias("line_no"),
        F.when(rn % 4 == 3, F.col("p_name")).when(numbered, F.concat(rn.cast("string"), F.lit(". "), "p_name"))
        .otherwise(F.concat(F.lit("• "), "p_name")).alias("text"),
        x.alias("x"), (x + 90).alias("x_end"), (720 - 14 * rn).cast("double").alias("y"),
        F.lit(11.0).alias("height"), F.lit(10.0).alias("font_size"), F.lit(False).alias("bold"),
        F.lit(False).alias("italic"), F.lit(False).alias("rtl"), F.lit(612.0).alias("page_width"),
    )


# ---------------------------------------------------------------- document pages

DOC_PAGES_SQL = """
doc_pages AS (
  SELECT doc_id, cast(page_no AS int) AS page_no,
         CASE WHEN doc_id % 2 = 0 THEN 595.5::double ELSE 612::double END AS width,
         CASE WHEN doc_id % 2 = 0 THEN 842::double ELSE 792::double END AS height, 0 AS rotation,
         CASE WHEN page_no % 5 = 4 THEN cast(60 + doc_id % 40 AS double) END AS ocr_confidence
  FROM documents, unnest(range(0, greatest(1, cast(ceil(n_chars / 1800) AS int)))) AS u(page_no))"""


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    last = F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 1800).cast("int")) - 1
    p = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("page_no"))
    even = F.col("doc_id") % 2 == 0
    return p.select(
        "doc_id", "page_no", F.when(even, 595.5).otherwise(612.0).alias("width"),
        F.when(even, 842.0).otherwise(792.0).alias("height"), F.lit(0).alias("rotation"),
        F.when(F.col("page_no") % 5 == 4, (60 + F.col("doc_id") % 40).cast("double")).alias("ocr_confidence"),
    )


def pages_like(glyphs: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Page rows of one size for every page a glyph or line table mentions."""
    return glyphs.select("doc_id", "page_no").distinct().select(
        "doc_id", "page_no", F.lit(width).alias("width"), F.lit(height).alias("height"),
        F.lit(None).cast("double").alias("ocr_confidence"),
    )

"""Word-corpus analysis on table rows.

Everything is keyed by document. A document part is at most 32 MiB (see
``docx_admission``), which bounds the rows any one document can bring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leafline.functions.text import letter_count, replaced_count, strip_white, trim_all
from leafline.functions.word import clamp, heading_from_name, heading_from_outline, heading_size, on_off, twips
from leafline.runtime import cut_lineage

SIDES = ("top", "left", "bottom", "right", "inside_h", "inside_v")
COVERAGE_ERROR = "unsupported_characters"


def glyph_coverage(runs: DataFrame) -> DataFrame:
    """Letters and replaced characters per document, and the verdict."""
    a = runs.groupBy("doc_id").agg(
        F.sum(letter_count(F.col("text"))).alias("letters"), F.sum(replaced_count(F.col("text"))).alias("replaced")
    )
    return a.select(
        "doc_id", "letters", "replaced", (F.col("replaced") == 0).alias("ok"),
        F.when(F.col("replaced") > 0, COVERAGE_ERROR).alias("error"),
    )


def docx_notes(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """Notes that the body refers to, as trailing paragraphs.

    ``notes`` is (doc_id, kind F or E, note_id, para_no, text), a row for each
    paragraph. Output paragraphs are ordered by (kind_no, note_id, part): the
    marker, then the note's own.
    """
    used = notes.where(F.col("note_id") > 0).join(
        refs.select("doc_id", "kind", "note_id"), ["doc_id", "kind", "note_id"], "left_semi"
    )
    keys = ["doc_id", F.when(F.col("kind") == "F", 0).otherwise(1).alias("kind_no"), "note_id"]
    marker = F.concat(F.lit("["), "kind", F.col("note_id").cast("string"), F.lit("]"))
    markers = used.where(F.col("para_no") == 0).select(*keys, F.lit(0).alias("part"), marker.alias("text"))
    return markers.unionByName(used.select(*keys, (F.col("para_no") + 1).alias("part"), "text"))


def resolve_target(target: Column) -> Column:
    """Internal part path of a relationship target; NULL when external or above the root."""
    raw = F.replace(trim_all(target), F.lit("\\"), F.lit("/"))
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    path = F.when(decoded.startswith("/"), F.substring(decoded, F.lit(2), F.length(decoded))).otherwise(
        F.concat(F.lit("word/"), decoded)
    )

    def step(s, part):
        up = part == ".."
        return F.struct(
            (s["bad"] | (up & (F.size(s["parts"]) == 0))).alias("bad"),
            F.when(part.isin("", "."), s["parts"])
            .when(up, F.slice(s["parts"], 1, F.greatest(F.size(s["parts"]) - 1, F.lit(0))))
            .otherwise(F.concat(s["parts"], F.array(part))).alias("parts"),
        )

    zero = F.struct(F.lit(False).alias("bad"), F.array().cast("array<string>").alias("parts"))
    folded = F.aggregate(
        F.split(path, "/"), zero, step,
        lambda s: F.when(~s["bad"] & (F.size(s["parts"]) > 0), F.array_join(s["parts"], "/")),
    )
    return F.when((raw != "") & ~raw.rlike("(?i)^(https?:|mailto:|file:)"), folded)


def part_path(name: Column) -> Column:
    """Comparable form of a part name."""
    return F.lower(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "^/+", ""))


def resolve_rels(refs: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Each reference with the stored name of the part it means, or NULL.

    Of parts whose names differ in case only, the first in order of name is meant.
    ``refs`` (doc_id, ref_no, rel_id), ``rels`` (doc_id, rel_id, target,
    external), ``parts`` (doc_id, part_name).
    """
    r = rels.select(
        "doc_id", "rel_id", F.when(~F.col("external"), F.lower(resolve_target(F.col("target")))).alias("_path")
    )
    p = parts.groupBy("doc_id", part_path(F.col("part_name")).alias("_path")).agg(F.min("part_name").alias("part_name"))
    return (
        refs.join(r, ["doc_id", "rel_id"], "left").join(p, ["doc_id", "_path"], "left")
        .select("doc_id", "ref_no", "rel_id", "part_name")
    )


def resolve_table_styles(styles: DataFrame, edges: DataFrame) -> DataFrame:
    """Effective edge of each side of each table style.

    ``styles`` is (doc_id, style_id, based_on); ``edges`` is (doc_id, style_id,
    side, edge) with a row only where the side is stated, ``edge`` NULL meaning
    "none". The nearest statement up the chain wins; a style already seen on the
    way ends the chain.

    Every style points at its ancestor 1, 2, 4, ... steps up and holds the
    nearest statements on the way there; one self-join doubles the steps, so
    the joins grow with the logarithm of the longest chain. A chain that runs
    in a circle only meets its statements again, and ends when it has had as
    many steps as its document has styles.
    """
    own = edges.groupBy("doc_id", "style_id", "side").agg(F.max(F.struct("edge")).alias("edge"))
    own = own.groupBy("doc_id", "style_id").agg(F.map_from_entries(F.collect_list(F.struct("side", "edge"))).alias("sides"))
    known = styles.groupBy("doc_id", "style_id").agg(F.min("based_on").alias("next"), F.lit(True).alias("asked"))
    empty = F.map_from_entries(F.array().cast(own.schema["sides"].dataType.simpleString().replace("map<string,", "array<struct<side:string,edge:") + ">"))
    state = cut_lineage(known.join(own, ["doc_id", "style_id"], "full").withColumn("sides", F.coalesce("sides", empty)))
    most = state.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        if state.where(F.col("next").isNotNull()).isEmpty():
            break
        up = state.select("doc_id", F.col("style_id").alias("next"), F.col("next").alias("_next"), F.col("sides").alias("_sides"))
        more = F.map_filter("_sides", lambda side, _: ~F.map_contains_key("sides", side))
        state = cut_lineage(
            state.join(up, ["doc_id", "next"], "left").select(
                "doc_id", "style_id", F.col("_next").alias("next"), "asked", F.when(F.col("_sides").isNull(), F.col("sides")).otherwise(F.map_concat("sides", more)).alias("sides")
            )
        )
    return state.where("asked").select("doc_id", "style_id", F.explode("sides").alias("side", "_e")).select("doc_id", "style_id", "side", F.col("_e.edge").alias("edge"))


def cell_edge(
    own_set: Column, own: Column, table_outer: Column, table_inner: Column, at_border: Column
) -> Column:
    """Edge of a cell side: its own statement, else the table's outer or inner edge."""
    return F.when(own_set, own).when(at_border, table_outer).otherwise(table_inner)


def spacing(prefix: str, size: Column, style_before: Column, style_after: Column, style_mult: Column) -> Column:
    """struct(before, after, line_mult) from raw spacing columns and the style's values.

    Raw columns are ``{prefix}line``, ``line_rule``, ``before``, ``after``,
    ``before_lines`` and ``after_lines``, all strings.
    """

    def raw(name: str) -> Column:
        return F.col(prefix + name)

    line = raw("line").try_cast("double")
    fixed = F.lower(raw("line_rule")).isin("exact", "atleast")
    own = F.when(F.coalesce(fixed, F.lit(False)), line / 20 / F.greatest(size, F.lit(1.0))).otherwise(line / 240)
    mult = F.when(line > 0, F.greatest(F.lit(0.7), own)).otherwise(F.coalesce(style_mult, F.lit(1.08)))

    def gap(name: str, inherited: Column) -> Column:
        lines = raw(f"{name}_lines").try_cast("double")
        by_lines = F.when(lines > 0, lines / 100 * size * mult)
        return F.greatest(F.lit(0.0), F.coalesce(twips(raw(name)), by_lines, inherited, F.lit(0.0)))

    return F.struct(
        gap("before", style_before).alias("before"), gap("after", style_after).alias("after"), mult.alias("line_mult")
    )


def resolve_styles(w_styles: DataFrame) -> DataFrame:
    """Paragraph styles with typed values from their raw property strings."""
    s = spacing("", F.lit(11.0), F.lit(None), F.lit(None), F.lit(None))
    first = F.when(twips(F.col("hanging")).isNotNull(), -twips(F.col("hanging"))).otherwise(
        F.coalesce(twips(F.col("first_line")), F.lit(0.0))
    )
    listed = F.col("num_id").isNotNull() & (F.col("num_id") != "0")
    half = F.col("size_half").try_cast("double")
    return w_styles.select(
        "doc_id", "style_id",
        F.coalesce(
            heading_from_name(F.coalesce("name", F.lit(""))), heading_from_name(F.col("style_id")),
            heading_from_outline(F.col("outline")),
        ).alias("s_heading"),
        F.when(listed, F.col("num_id")).alias("s_num_id"),
        F.when(listed, F.greatest(F.lit(0), F.coalesce("ilvl", F.lit(0)))).alias("s_ilvl"),
        on_off(F.col("bold_set"), F.col("bold")).alias("s_bold"),
        on_off(F.col("italic_set"), F.col("italic")).alias("s_italic"),
        F.when(half > 0, half / 2).alias("s_size"),
        s["before"].alias("s_before"), s["after"].alias("s_after"), s["line_mult"].alias("s_mult"),
        F.greatest(F.lit(0.0), F.coalesce(twips(F.col("left")), F.lit(0.0))).alias("s_left"), first.alias("s_first"),
    )


def inherit_paragraph(w_paras: DataFrame, styles: DataFrame, default_size: float = 11.0) -> DataFrame:
    """Effective properties of every paragraph.

    ``w_paras`` has raw strings: style_id, outline, jc, num_id, ilvl, left,
    first_line, hanging, has_spacing, the spacing columns, and mark_bold,
    mark_italic, mark_size of the paragraph mark. ``styles`` comes from
    ``resolve_styles``.
    """
    p = w_paras.join(styles, ["doc_id", "style_id"], "left")
    heading = F.coalesce(
        heading_from_name(F.col("style_id")), F.col("s_heading"), heading_from_outline(F.col("outline"))
    )
    own_list = F.col("num_id").isNotNull() & (F.col("num_id") != "0")
    off = F.coalesce(F.col("num_id") == "0", F.lit(False))
    p = p.withColumns(
        {
            "heading": heading,
            "align": F.when(F.lower("jc") == "center", "center")
            .when(F.lower("jc").isin("right", "end"), "right").otherwise("left"),
            "_num": F.when(~off, F.coalesce("num_id", "s_num_id")),
            "_ilvl": F.when(own_list, F.greatest(F.lit(0), F.coalesce("ilvl", F.lit(0)))).otherwise(
                F.coalesce("s_ilvl", F.lit(0))
            ),
        }
    )
    size = F.when(F.col("heading").isNotNull(), heading_size(F.col("heading"))).otherwise(
        clamp(F.coalesce("s_size", "mark_size", F.lit(default_size)), 8.0, 28.0)
    )
    p = p.withColumn("size", size)
    p = p.withColumn("_sp", spacing("", F.col("size"), F.col("s_before"), F.col("s_after"), F.col("s_mult")))
    bare = F.col("heading").isNotNull() & ~F.col("has_spacing")
    before = F.when(
        bare & (F.coalesce("s_before", F.lit(0.0)) == 0),
        F.when(F.col("heading") == 1, 12.0).when(F.col("heading") == 2, 10.0).otherwise(8.0),
    ).otherwise(F.col("_sp.before"))
    after = F.when(
        bare & (F.coalesce("s_after", F.lit(0.0)) == 0), F.when(F.col("heading") == 1, 6.0).otherwise(4.0)
    ).otherwise(F.col("_sp.after"))
    is_list = F.col("_num").isNotNull() & F.col("heading").isNull()
    left = F.greatest(F.lit(0.0), F.coalesce(twips(F.col("left")), F.col("s_left"), F.lit(0.0)))
    hanging = twips(F.col("hanging"))
    first = F.when(hanging.isNotNull(), -hanging).otherwise(
        F.coalesce(twips(F.col("first_line")), F.col("s_first"), F.lit(0.0))
    )
    pad = F.when(is_list & (left == 0), 18 + F.least(F.col("_ilvl"), F.lit(8)) * 14).otherwise(0)
    return p.select(
        "doc_id", "para_no", "heading", "align", F.when(is_list, F.col("_num")).alias("num_id"),
        F.col("_ilvl").cast("int").alias("ilvl"), is_list.alias("is_list"), "size",
        (F.col("heading").isNotNull() | F.coalesce("s_bold", "mark_bold", F.lit(False))).alias("bold"),
        F.coalesce("s_italic", "mark_italic", F.lit(False)).alias("italic"),
        before.alias("space_before"), after.alias("space_after"), F.col("_sp.line_mult").alias("line_mult"),
        (left + pad).alias("indent"), first.alias("first_indent"),
    )


def list_numbers(items: DataFrame, w_numbering: DataFrame, w_levels: DataFrame) -> DataFrame:
    """Printed prefix of each list paragraph that has text.

    ``items`` (doc_id, para_no, num_id, ilvl); ``w_numbering`` (doc_id, num_id,
    abs_id); ``w_levels`` (doc_id, abs_id, ilvl, fmt). A number counts the
    numbered items of its level since the last numbered item of a lower level:
    one pass over each list, with a stack of the counts of rising levels, so
    any levels may be in use and a list of any length is a stream.
    """
    fmt = items.join(w_numbering, ["doc_id", "num_id"], "left").join(w_levels, ["doc_id", "abs_id", "ilvl"], "left")
    numbered = F.coalesce(F.col("fmt").rlike("(?i)decimal|ordinal|cardinal|arabic"), F.lit(False))
    i = fmt.select("doc_id", "para_no", "num_id", "ilvl", numbered.alias("_numbered"))
    counted = i.where("_numbered").drop("_numbered").repartition("doc_id", "num_id").sortWithinPartitions("doc_id", "num_id", "para_no")
    schema = StructType([*counted.schema.fields, StructField("prefix", StringType())])
    bullets = i.where("NOT _numbered").drop("_numbered").withColumn("prefix", F.lit("• "))
    return counted.mapInArrow(_count_items, schema).unionByName(bullets)


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, stack = None, []  # of [level, items], levels rise
    for batch in batches:
        out = []
        for doc, num, level in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "num_id", "ilvl"))):
            if now != (doc, num):
                now, stack = (doc, num), []
            while stack and stack[-1][0] > level:
                stack.pop()
            if stack and stack[-1][0] == level:
                stack[-1][1] += 1
            else:
                stack.append([level, 1])
            out.append(f"{stack[-1][1]}. ")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "prefix"])


def coalesce_runs(pieces: DataFrame, keys: Sequence[str] = ("doc_id", "para_no")) -> DataFrame:
    """Pieces of a paragraph to runs, split at images and page breaks.

    ``pieces`` is (keys, piece_no, kind text|nl|break|image, text, bold,
    italic, size, base_bold, base_italic, base_size). A segment without
    printed text yields nothing.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("piece_no")
    p = pieces.withColumn(
        "segment", F.sum(F.col("kind").isin("break", "image").cast("int")).over(w).cast("int")
    ).where((F.col("kind") == "nl") | ((F.col("kind") == "text") & (F.coalesce("text", F.lit("")) != "")))
    newline = F.col("kind") == "nl"
    p = p.withColumns(
        {
            "text": F.when(newline, F.lit("\n")).otherwise(F.col("text")),
            "bold": F.when(newline, F.col("base_bold")).otherwise(F.col("bold")),
            "italic": F.when(newline, F.col("base_italic")).otherwise(F.col("italic")),
            "size": F.when(newline, F.col("base_size")).otherwise(F.col("size")),
        }
    )
    s = Window.partitionBy(*keys, "segment").orderBy("piece_no")
    first = F.lag("piece_no").over(s).isNull()
    changed = (
        F.lag("text").over(s).endswith("\n") | (F.lag("bold").over(s) != F.col("bold"))
        | (F.lag("italic").over(s) != F.col("italic")) | (F.lag("size").over(s) != F.col("size"))
    )
    p = p.withColumn("_new", (first | ((F.col("kind") == "text") & changed)).cast("int"))
    p = p.withColumn("run_no", (F.sum("_new").over(s) - 1).cast("int"))
    printed = Window.partitionBy(*keys, "segment")
    p = p.withColumn("_shown", F.max(F.length(strip_white(F.col("text"))) > 0).over(printed)).where("_shown")
    parts = F.sort_array(F.collect_list(F.struct("piece_no", "text")))
    style = F.min_by(F.struct("bold", "italic", "size"), "piece_no")
    r = p.groupBy(*keys, "segment", "run_no").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), style.alias("_s")
    )
    return r.select(*keys, "segment", "run_no", "text", "_s.bold", "_s.italic", "_s.size")


def table_shape(w_cells: DataFrame, w_grid: DataFrame, keys: Sequence[str] = ("doc_id", "table_no")) -> DataFrame:
    """Columns and column weights of each table.

    ``w_cells`` (keys, row_no, cell_no, span), ``w_grid`` (keys, col, width).
    Missing or non-positive weights are 1.
    """
    keys = list(keys)
    span = F.least(F.lit(12), F.greatest(F.lit(1), F.coalesce(F.col("span").cast("int"), F.lit(1))))
    rows = w_cells.groupBy(*keys, "row_no").agg(F.sum(span).alias("_span"))
    shape = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max("_span").alias("columns"))
    weight = F.when(F.col("width") > 0, F.col("width").cast("double")).otherwise(1.0)
    wide = shape.select(*keys, "rows", "columns", F.explode(F.sequence(F.lit(0), F.col("columns").cast("int") - 1)).alias("col"))
    grid = w_grid.select(*keys, "col", weight.alias("_w"))
    return wide.join(grid, [*keys, "col"], "left").select(
        *keys, "rows", "columns", "col", F.coalesce("_w", F.lit(1.0)).alias("weight")
    )


def cell_columns(w_cells: DataFrame, keys: Sequence[str] = ("doc_id", "table_no")) -> DataFrame:
    """First column and clamped span of each cell."""
    keys = list(keys)
    span = F.least(F.lit(12), F.greatest(F.lit(1), F.coalesce(F.col("span").cast("int"), F.lit(1))))
    before = Window.partitionBy(*keys, "row_no").orderBy("cell_no").rowsBetween(Window.unboundedPreceding, -1)
    c = w_cells.withColumn("_span", span)
    return c.select(
        *keys, "row_no", "cell_no", F.coalesce(F.sum("_span").over(before), F.lit(0)).alias("col"), F.col("_span").alias("span")
    )

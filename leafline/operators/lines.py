"""Positioned glyphs to lines and tokens.

Glyphs are shuffled and sorted once by page; lines come out of one pass over
them. Order inside a page is y descending, x ascending, glyph_no.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions import glyph_math
from leafline.functions.text import clean_text, strip_white
from leafline.operators.ordering import page_pass, still

PAGE = ("doc_id", "page_no")
#: the order that lines are clustered by, and that of lines
DOWN = (("y", True), ("x", False), ("glyph_no", False))
LINES_DOWN = (("y", True), ("x", False), ("line_no", False))


def with_glyph_defaults(glyphs: DataFrame) -> DataFrame:
    """Add the optional glyph columns that are absent."""
    defaults = {c: F.lit(False) for c in ("bold", "italic", "rtl")}
    defaults["font_family"] = F.lit(None).cast("string")
    missing = {k: v for k, v in defaults.items() if k not in glyphs.columns}
    return still(glyphs.withColumns(missing), glyphs) if missing else glyphs


def glyph_width(width: Column, size: Column, text: Column) -> Column:
    """Stated width, else an estimate from the size and the text length."""
    usable = (width > 0) & ~F.isnan(width) & (width < F.lit(float("inf")))
    return F.when(usable, width).otherwise(
        F.greatest(size * 0.4, F.length(text) * size * 0.45)
    )


def cluster_lines(glyphs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Glyphs with ``line_no``; empty strings are dropped.

    A vertical step larger than any threshold on the page is a certain line
    break and cuts the page into bands. A band whose spread is within the
    smallest threshold is one line. Only the remaining bands need the
    running-mean fold, which then sees a handful of glyphs.
    """
    keys = list(keys)
    g = with_glyph_defaults(glyphs)
    g = still(g.where(F.length("str") > 0), g)
    columns = [*keys, *(c for c in ("glyph_no", "x", "y") if c in g.columns)]
    columns += [c for c in g.columns if c not in columns]
    schema = g.select(*columns, F.lit(0).alias("line_no")).schema

    def number(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        line = pa.array(glyph_math.line_numbers(table, bounds), pa.int32())
        yield from table.append_column("line_no", line).to_batches()

    return page_pass(still(g.select(*columns), g), keys, DOWN, number, schema)


def visible(glyphs: DataFrame) -> DataFrame:
    """Glyphs that still show something once cleaned, with ``_value`` and ``_gw``."""
    return (
        glyphs.withColumn("_value", clean_text(F.col("str")))
        .where(F.col("_value") != "")
        .withColumn("_gw", glyph_width(F.col("width"), F.col("size"), F.col("str")))
    )


def _pieces(glyphs: DataFrame, group: Sequence[str], tag: str) -> DataFrame:
    """W2 core: reading position and the text each glyph adds inside its group.

    Adds ``_pos{tag}``, ``_piece{tag}`` and ``_rtl{tag}``.
    """
    whole = Window.partitionBy(*group)
    rtl, ord_ = f"_rtl{tag}", f"_ord{tag}"
    g = glyphs.withColumn(
        rtl, F.sum(F.col("rtl").cast("int")).over(whole) * 2 > F.count(F.lit(1)).over(whole)
    ).withColumn(ord_, F.when(F.col(rtl), -F.col("x")).otherwise(F.col("x")))
    reading = whole.orderBy(F.asc(ord_), F.desc("y"), F.asc("glyph_no"))
    before = reading.rowsBetween(Window.unboundedPreceding, -1)
    right_edge = F.col("x") + F.col("_gw")
    g = g.withColumns(
        {
            f"_pos{tag}": F.row_number().over(reading),
            "_far": F.max(right_edge).over(before),
            "_near": F.min("x").over(before),
        }
    )
    gap = F.when(F.col(rtl), F.col("_near") - right_edge).otherwise(F.col("x") - F.col("_far"))
    per_char = F.col("_gw") / F.greatest(F.lit(1), F.length("_value"))
    least = F.greatest(F.lit(0.8), F.least(F.col("size") * 0.32, per_char * 0.55))
    closing = F.col("_value").rlike("^[,.;:!?%)\\]}]")
    spaced = (F.col(f"_pos{tag}") > 1) & ~closing & (gap > least)
    return g.withColumn(
        f"_piece{tag}",
        F.when(spaced, F.concat(F.lit(" "), F.col("_value"))).otherwise(F.col("_value")),
    ).drop("_far", "_near", ord_)


def _join_pieces(pos: str, piece: str) -> Column:
    """Aggregate: pieces concatenated by position."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(piece).alias("t"))))
    return F.array_join(F.transform(ordered, lambda s: s["t"]), "")


def row_text(glyphs: DataFrame, group: Sequence[str] = (*PAGE, "line_no")) -> DataFrame:
    """One text per group of glyphs, with spaces inferred from the gaps."""
    g = _pieces(visible(with_glyph_defaults(glyphs)), list(group), "")
    return g.groupBy(*group).agg(_join_pieces("_pos", "_piece").alias("text"))


def text_runs(glyphs: DataFrame, group: Sequence[str] = (*PAGE, "line_no")) -> DataFrame:
    """Styled runs of each group in reading order.

    Neighbours of exactly equal style are merged at once; what is left is
    walked, because a run keeps the size of its first glyph for comparison.
    """
    group = list(group)
    shown = visible(with_glyph_defaults(glyphs))
    g = shown.select(
        *group, "glyph_no", *[F.col(c).cast("double").alias(c) for c in ("x", "y")], F.col("_gw").cast("double").alias("gw"), "size",
        F.col("_value").alias("value"), F.length("_value").alias("chars"), F.col("_value").rlike("^[,.;:!?%)\\]}]").alias("closing"),
        F.col("rtl").cast("int").alias("rtl"), "font_family", "bold", "italic",
    )
    schema = g.select(*group, F.lit(0).alias("run_no"), F.lit("").alias("text"), F.col("size").alias("font_size"), "font_family", "bold", "italic").schema

    def read(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from glyph_math.style_runs(table, bounds, group).to_batches()

    return page_pass(still(g, glyphs), group, [("x", False), ("y", True), ("glyph_no", False)], read, schema)


def page_lines(glyphs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Glyphs to ``lines``; a page is clustered and read in one pass over its sorted glyphs."""
    g = with_glyph_defaults(glyphs)
    return _read(still(g.where(F.length("str") > 0), g), list(keys), [])


def lines(glyphs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """A1 with W2 and W3: one row per line, its attributes and its ``tokens`` array.

    Input carries ``line_no``. Lines without visible text vanish and the rest
    keep their numbers.
    """
    return _read(with_glyph_defaults(glyphs), list(keys), ["line_no"])


def shown_glyphs(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Visible glyphs with what their text and place need, and no more."""
    value = clean_text(F.col("str"))
    shown = with_glyph_defaults(glyphs).where(value != "").select(
        *keys, "glyph_no", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "size")],
        glyph_width(F.col("width"), F.col("size"), F.col("str")).cast("double").alias("gw"), value.alias("value"), "bold", "rtl",
    )
    return still(shown, glyphs)


def group_texts(glyphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text of each group of visible glyphs, its lines joined by newline, and whether a line is ``bold``; one pass over sorted glyphs."""
    keys = list(keys)
    g = shown_glyphs(glyphs, keys)
    schema = g.select(*keys, F.lit("").alias("text"), F.lit(None).cast("boolean").alias("bold")).schema

    def read(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = glyph_math.cell_texts(table, bounds, keys)
        if found is not None:
            yield from found.to_batches()

    return page_pass(g, keys, DOWN, read, schema)


def _read(g: DataFrame, keys: list[str], known: list[str]) -> DataFrame:
    value, before = clean_text(F.col("str")), g
    g = g.select(
        *keys, *known, "glyph_no", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "size")], value.alias("value"),
        F.length(value).alias("chars"), glyph_width(F.col("width"), F.col("size"), F.col("str")).cast("double").alias("gw"),
        F.greatest(F.lit(1), F.length(strip_white(F.col("str")))).alias("w"), value.rlike("^[,.;:!?%)\\]}]").alias("closing"),
        *[F.col(c).cast("int").alias(c) for c in ("bold", "italic", "rtl")],
    )
    tokens_ = "array<struct<token_no:int,text:string,x:double,x_end:double>>"
    line = {"line_no": "int", "text": "string", "font_size": "double", "x": "double", "x_end": "double", "y": "double", "height": "double"}
    line |= {"bold": "boolean", "italic": "boolean", "rtl": "boolean", "tokens": tokens_}
    schema = g.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in line.items()]).schema

    def read(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = glyph_math.read_lines(table, bounds, keys)
        if found is not None:
            yield from found.to_batches()

    return page_pass(still(g, before), keys, [*[(c, False) for c in known], *DOWN], read, schema)


def line_lengths(glyphs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Baseline and text length of each line, without assembling the text."""
    line = [*keys, "line_no"]
    g = _pieces(visible(with_glyph_defaults(glyphs)), line, "")
    return g.groupBy(*line).agg(F.avg("y").alias("y"), F.sum(F.length("_piece")).cast("int").alias("length"))


def tokens(lines_: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Token rows of ``page_lines``."""
    return lines_.select(*keys, "line_no", F.inline_outer("tokens"))


def page_char_count(lines_: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """A5: printed characters per page."""
    return lines_.groupBy(*keys).agg(F.sum(F.length(strip_white(F.col("text")))).alias("chars"))

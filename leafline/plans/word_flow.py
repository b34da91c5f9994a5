"""Word files to placed lines: the document path as one plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.functions.text import map_text
from leafline.functions.word import resolve_size
from leafline.operators.flow import flow_lines
from leafline.operators.paging import paginate
from leafline.operators.word import (
    cell_columns, coalesce_runs, glyph_coverage, inherit_paragraph, list_numbers, resolve_styles, table_shape,
)
from leafline.runtime import cut_lineage
from leafline.sources.docx import docx_records, docx_style_tables, docx_tables

PARA = ["doc_id", "para_no"]
ROW = ["doc_id", "table_no", "row_no"]
CELL_PAD = 5.0


@dataclass
class WordFlow:
    """Effective paragraphs, runs, wrapped lines, blocks to be paged, and the coverage verdict."""

    paragraphs: DataFrame
    runs: DataFrame
    lines: DataFrame
    blocks: DataFrame
    coverage: DataFrame

    @cached_property
    def placed(self) -> DataFrame:
        """Pages and places of the blocks, which are written once when this is asked for."""
        return paginate(self.blocks)


def _cell_widths(cells: DataFrame, grid: DataFrame, inner: float) -> DataFrame:
    """Text width of every cell, from the weights of the columns it spans."""
    table = ["doc_id", "table_no"]
    columns = table_shape(cells, grid)
    totals = columns.groupBy(*table).agg(F.sum("weight").alias("_total"))
    spans = cell_columns(cells).select(
        *ROW, "cell_no", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("span") - 1)).alias("col")
    )
    weights = spans.join(columns.select(*table, "col", "weight"), [*table, "col"])
    w = weights.groupBy(*ROW, "cell_no").agg(F.sum("weight").alias("_w")).join(totals, table)
    width = F.greatest(F.lit(16.0), F.col("_w") / F.col("_total") * inner)
    return w.select(*ROW, "cell_no", F.greatest(F.lit(20.0), width - 2 * CELL_PAD).alias("_cell"))


def word_flow(parts: DataFrame, inner: float = 451.28) -> WordFlow:
    """Paragraphs of Word files with their inherited style, list prefix, wrapped and paged.

    ``parts`` comes from ``docx_parts``; ``inner`` is the text width. Style and
    list tables are joined by document, so Spark picks the join by their size.
    """
    t = docx_tables(cut_lineage(docx_records(parts)))
    s = docx_style_tables(parts)
    place = ["table_no", "row_no", "cell_no"]
    effective = inherit_paragraph(t["paras"], resolve_styles(s["styles"])).join(t["paras"].select(*PARA, *place), PARA)
    base = effective.select(
        *PARA, F.col("bold").alias("base_bold"), F.col("italic").alias("base_italic"), F.col("size").alias("base_size"), "heading"
    )
    pieces = t["pieces"].select(*PARA, "piece_no", "kind", "text", "bold", "italic", "size").join(base, PARA)
    pieces = pieces.withColumns(
        {
            "bold": F.coalesce("bold", "base_bold"), "italic": F.coalesce("italic", "base_italic"),
            "size": resolve_size(F.col("size"), F.col("base_size"), F.col("heading")),
        }
    )
    runs = cut_lineage(coalesce_runs(pieces))
    parts_ = F.sort_array(F.collect_list(F.struct("segment", "run_no", "text")))
    texts = runs.groupBy(*PARA).agg(
        F.array_join(F.transform(parts_, lambda r: r["text"]), "").alias("text"), F.max("size").alias("_tallest")
    )
    listed = effective.where("is_list").select(*PARA, "num_id", "ilvl").join(texts.select(*PARA), PARA, "left_semi")
    prefixes = list_numbers(listed, s["numbering"], s["levels"]).select(*PARA, "prefix")
    paras = effective.join(texts, PARA, "left").join(prefixes, PARA, "left")
    paras = paras.join(_cell_widths(t["cells"], t["grid"], inner), [*ROW, "cell_no"], "left")
    shown = paras.where(F.col("text").isNotNull()).select(
        *PARA, map_text(F.concat(F.coalesce("prefix", F.lit("")), "text")).alias("text"), "size",
        F.coalesce("_cell", F.greatest(F.lit(40.0), F.lit(inner) - F.col("indent"))).alias("_room"),
    )
    wrapped = flow_lines(shown, F.col("_room"))
    counts = wrapped.groupBy(*PARA).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    sized = paras.join(counts, PARA, "left").withColumn("_line", F.coalesce("_tallest", "size") * F.col("line_mult"))
    body = sized.where(F.col("table_no").isNull()).select(
        "doc_id", F.col("para_no").alias("block_no"), F.when(F.col("_n").isNull(), "empty").otherwise("para").alias("kind"),
        F.array_repeat("_line", F.coalesce("_n", F.lit(1))).alias("heights"), "size", "line_mult", "space_before", "space_after",
        F.lit(False).alias("opens_table"),
    )
    cell = sized.where(F.col("table_no").isNotNull()).groupBy(*ROW, "cell_no").agg(
        F.min("para_no").alias("block_no"),
        F.sum(F.when(F.col("_n").isNotNull(), F.col("_n") * F.col("_line") + F.col("space_after"))).alias("_h"),
    )
    rows = cell.groupBy(*ROW).agg(
        F.min("block_no").alias("block_no"), F.max(F.coalesce("_h", F.lit(0.0)) + 2 * CELL_PAD).alias("_h")
    ).select(
        "doc_id", "block_no", F.lit("row").alias("kind"), F.array(F.greatest(F.lit(16.0), "_h")).alias("heights"),
        F.lit(0.0).alias("size"), F.lit(1.0).alias("line_mult"), F.lit(0.0).alias("space_before"), F.lit(0.0).alias("space_after"),
        (F.col("row_no") == 0).alias("opens_table"),
    )
    breaks = t["pieces"].where(F.col("kind") == "break").groupBy(*PARA).agg(F.count(F.lit(1)).alias("_b"))
    blocks = body.unionByName(rows).join(
        breaks.withColumnRenamed("para_no", "block_no"), ["doc_id", "block_no"], "left"
    )
    only_break = F.col("_b").isNotNull() & (F.col("kind") == "empty")
    blocks = blocks.withColumn("kind", F.when(only_break, "break").otherwise(F.col("kind"))).drop("_b")
    return WordFlow(effective, runs, wrapped, blocks, glyph_coverage(runs))

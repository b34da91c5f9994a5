"""Text items, OCR words, outlines and files as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafline.functions.files import image_kind, mime_from_name
from leafline.functions.text import font_family, is_bold, is_italic, trim_all
from leafline.operators.lines import PAGE
from leafline.runtime import cut_lineage

ITEM_SCHEMA = (
    "str string, dir string, width double, height double, transform array<double>, fontName string, hasEOL boolean"
)


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A corpus folder as (path, name, mime, size, modified, content, kind); Spark lists no empty files."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    f = f.select(
        "path", name.alias("name"), mime_from_name(name).alias("mime"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), "content",
    )
    return sniff_kind(f)


def sniff_kind(files: DataFrame) -> DataFrame:
    """Files with ``kind`` jpg, png, webp or other."""
    return files.withColumn("kind", image_kind(F.col("content"), F.col("name"), F.col("mime")))


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def read_text_items(items: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """Text-item JSON to glyphs.

    ``items`` is (doc_id, page_no, glyph_no, item STRING); ``styles`` is
    (doc_id, font_name, family, bold, italic). Items without text, with a short
    transform or without a finite position are dropped.
    """
    # as a generator's rows: a filter below would read the JSON again for each of its conditions
    i = items.select(*PAGE, "glyph_no", F.inline_outer(F.array(F.from_json("item", ITEM_SCHEMA))))
    t = F.col("transform")

    def number(k):
        return F.coalesce(F.nanvl(F.get(t, F.lit(k)), F.lit(0.0)), F.lit(0.0))

    i = i.where(
        (F.coalesce("str", F.lit("")) != "") & (F.size(t) >= 6) & _finite(F.get(t, F.lit(4))) & _finite(F.get(t, F.lit(5)))
    )
    stated = F.when(_finite(F.col("height")) & (F.col("height") > 0), F.col("height"))
    size = F.coalesce(
        stated, F.nullif(F.hypot(number(2), number(3)), F.lit(0.0)), F.nullif(F.hypot(number(0), number(1)), F.lit(0.0)),
        F.lit(11.0),
    )
    if styles is not None:
        s = styles.select(
            "doc_id", F.col("font_name").alias("fontName"), font_family(F.col("family")).alias("font_family"),
            F.col("bold").alias("_bold"), F.col("italic").alias("_italic"),
        )
        i = i.join(s, ["doc_id", "fontName"], "left")
    else:
        i = i.withColumns({
            "font_family": F.lit(None).cast("string"), "_bold": F.lit(False), "_italic": F.lit(False),
        })
    named = F.concat_ws(" ", "fontName", "font_family")
    return i.select(
        *PAGE, "glyph_no", "str", F.get(t, F.lit(4)).alias("x"), F.get(t, F.lit(5)).alias("y"),
        F.when(_finite(F.col("width")) & (F.col("width") > 0), F.col("width")).otherwise(0.0).alias("width"),
        size.alias("size"), F.coalesce("hasEOL", F.lit(False)).alias("eol"), F.col("fontName").alias("font_name"),
        "font_family", is_bold(named, F.col("_bold")).alias("bold"), is_italic(named, F.col("_italic")).alias("italic"),
        F.coalesce(F.col("dir") == "rtl", F.lit(False)).alias("rtl"),
    )


def read_ocr_words(ocr_words: DataFrame, ocr_pages: DataFrame) -> DataFrame:
    """S3: recognised words to glyphs; a page without a usable word falls back to its raw lines.

    ``ocr_words`` is (doc_id, page_no, para_no, line_no, word_no, text,
    confidence, x0, y0, x1, y1, is_ltr, font_name); ``ocr_pages`` is (doc_id,
    page_no, height, scale, raw_text).
    """
    pages = ocr_pages.select(*PAGE, F.col("height").alias("_h"), F.greatest(F.lit(0.1), "scale").alias("_s"), "raw_text", F.lit(True).alias("_page"))
    word = trim_all(F.col("text"))
    kept = ocr_words.where((word != "") & (F.col("confidence") >= 25)).withColumn("str", word)
    # lines and pages in one sort of a page, its own row before its words
    kept = kept.withColumns({"_at": F.struct("para_no", "line_no", "word_no"), "_page": F.lit(False)}).drop("text", "confidence")
    both = kept.unionByName(pages, allowMissingColumns=True)
    page = Window.partitionBy(*PAGE).orderBy("_at")
    all_ = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = F.struct("para_no", "line_no")
    s = F.max("_s").over(all_)
    pages_, words_ = F.count_if("_page").over(all_), F.count_if(~F.col("_page")).over(all_)
    found = both.withColumns({
        "eol": ~F.coalesce(F.lead(line).over(page).eqNullSafe(line), F.lit(False)) | F.lead("word_no").over(page).isNull(),
        "_row": F.row_number().over(page), "_pages": pages_, "_words": words_, "_scale": s, "_high": F.max("_h").over(all_),
    })
    named = F.col("doc_id").isNotNull() & F.col("page_no").isNotNull()  # other words are on no page
    found = found.where((~F.col("_page") & (F.col("_pages") > 0) & named) | (F.col("_page") & ((F.col("_words") == 0) | ~named)))
    s = F.col("_scale")
    tall = F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")) / s)
    glyph = F.struct(
        F.col("str").alias("str"), (F.col("x0") / s).alias("x"),
        (F.col("_high") - F.col("y1") / s).alias("y"), F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) / s).alias("width"),
        F.greatest(F.lit(7.0), F.least(F.lit(42.0), tall * 0.82)).alias("size"), F.col("eol").alias("eol"),
        F.when(F.coalesce("font_name", F.lit("")) == "", "Arial").otherwise(F.col("font_name")).alias("font_family"),
        (~F.coalesce("is_ltr", F.lit(True))).alias("rtl"), (F.col("_row") - F.col("_pages") - 1).cast("int").alias("glyph_no"),
    )
    raw_lines = F.filter(F.transform(F.split("raw_text", "\r?\n"), trim_all), lambda t: t != "")
    fallback = F.transform(raw_lines, lambda t, i: F.struct(
        t.alias("str"), F.lit(36.0).alias("x"),
        F.greatest(F.lit(24.0), F.col("_h") - 48 - i * 16).alias("y"),
        F.least(F.lit(540.0), F.length(t) * 5.6).alias("width"), F.lit(11.0).alias("size"),
        F.lit(True).alias("eol"), F.lit("Arial").alias("font_family"), F.lit(False).alias("rtl"), i.alias("glyph_no"),
    ))
    glyphs = found.select(*PAGE, F.inline_outer(F.when(F.col("_page"), fallback).otherwise(F.array(glyph))))
    return glyphs.where(F.col("str").isNotNull())


def flatten_outline(outline: DataFrame, key: str = "doc_id") -> DataFrame:
    """Outline nodes with capped ``depth`` and their ``position`` in pre-order, from 0.

    ``outline`` is (doc_id, node_id, parent_id, ord, title, page_index); equal
    ``ord`` are told apart by node_id. Nodes that no root leads to are left out.

    Leaves are taken off in rounds, and each adds its size to its parent's; a
    node then stands after its parent and all that its earlier siblings hold,
    from the last round to the first. A round reads what the rounds before it
    left. Documents that are too deep for that are ranked as tours.
    """
    left = outline.select(
        key, "node_id", "parent_id", "ord", trim_all(F.coalesce("title", F.lit(""))).alias("title"), "page_index", F.lit(1).cast("long").alias("_size")
    )
    rounds, read, first = [], 0, None
    while True:
        children = left.where(F.col("parent_id").isNotNull()).groupBy(key, F.col("parent_id").alias("node_id")).agg(F.lit(True).alias("_parent"))
        marked = cut_lineage(left.join(children, [key, "node_id"], "left"))
        rows, rest = marked.agg(F.count(F.lit(1)), F.count("_parent")).first()
        first = rows if first is None else first
        read += rows
        leaves = marked.where(F.col("_parent").isNull()).drop("_parent")
        rounds.append(leaves)
        sizes = leaves.where(F.col("parent_id").isNotNull()).groupBy(key, F.col("parent_id").alias("node_id")).agg(F.sum("_size").alias("_more"))
        left = marked.where("_parent").drop("_parent").join(sizes, [key, "node_id"], "left")
        left = left.withColumn("_size", F.col("_size") + F.coalesce("_more", F.lit(0))).drop("_more")
        if rest == 0 or rest == rows or read > 4 * first or len(rounds) == 64:
            break
    each = [leaves.withColumn("_round", F.lit(number)) for number, leaves in enumerate(rounds)]
    nodes = reduce(DataFrame.unionByName, each)
    deep = None
    if 0 < rest < rows:  # all that is left of ``rest == rows`` goes in circles
        deep = cut_lineage(left.select(key).distinct())
        nodes = nodes.join(deep, key, "left_anti")
    siblings = Window.partitionBy(key, "parent_id").orderBy("ord", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    nodes = cut_lineage(nodes.withColumn("_before", F.coalesce(F.sum("_size").over(siblings), F.lit(0))).drop("ord", "_size"))
    held = [nodes]
    for number in range(len(rounds) - 1):
        held.append(cut_lineage(held[-1].where(F.col("_round") > number)))
    placed: list[DataFrame] = []
    for number in reversed(range(len(rounds))):
        here = held[number].where(F.col("_round") == number).drop("_round")
        found = here.where(F.col("parent_id").isNull()).withColumns({"position": F.col("_before"), "depth": F.lit(0)})
        if placed:
            above = reduce(DataFrame.unionByName, placed).select(key, F.col("node_id").alias("parent_id"), F.col("position").alias("_top"), F.col("depth").alias("_over"))
            under = here.join(above, [key, "parent_id"]).withColumns({"position": F.col("_top") + 1 + F.col("_before"), "depth": F.col("_over") + 1})
            found = found.unionByName(under.drop("_top", "_over"))
        placed.append(cut_lineage(found) if number else found)
    result = [key, "node_id", "title", "page_index", F.least(F.lit(3), "depth").alias("depth"), "position"]
    shown = (F.col("title") != "") & F.col("page_index").isNotNull()
    out = reduce(DataFrame.unionByName, placed).where(shown).select(result)
    if deep is None:
        return out
    deep_nodes = outline.withColumn("title", trim_all(F.coalesce("title", F.lit("")))).join(deep, key, "left_semi")
    return out.unionByName(deep_nodes.where(shown).join(_tour_places(deep_nodes, key), [key, "node_id"]).select(result))


def _tour_places(nodes: DataFrame, key: str) -> DataFrame:
    """(doc_id, node_id, position, depth) of outlines of any depth.

    Every node is entered and left once, and each of these steps knows the next one: the first child, the next sibling,
    or leaving the parent. Steps point 1, 2, 4, ... steps on and hold the sums
    of nodes entered and of depth on the way, so the joins grow with the
    logarithm of the largest outline, whether it is deep or wide. Steps that do
    not come to the end belong to nodes that no root leads to, and are left out.
    """
    nodes = nodes.select(key, "node_id", "parent_id", "ord")
    siblings = Window.partitionBy(key, "parent_id").orderBy("ord", "node_id")
    nodes = nodes.select(key, "node_id", "parent_id", F.row_number().over(siblings).alias("_at"), F.lead("node_id").over(siblings).alias("_next"))
    first = nodes.where((F.col("_at") == 1) & F.col("parent_id").isNotNull()).select(key, F.col("parent_id").alias("node_id"), F.col("node_id").alias("_child"))
    nodes = nodes.join(first, [key, "node_id"], "left")

    def step(node: Column, leaves: Column) -> Column:
        return F.struct(node.alias("node"), leaves.alias("leaves"))

    no, yes = F.lit(False), F.lit(True)
    enter = F.struct(step(F.col("node_id"), no).alias("step"), F.when(F.col("_child").isNotNull(), step(F.col("_child"), no)).otherwise(step(F.col("node_id"), yes)).alias("to"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("deeper"))
    after = F.when(F.col("_next").isNotNull(), step(F.col("_next"), no)).when(F.col("parent_id").isNotNull(), step(F.col("parent_id"), yes))
    leave = F.struct(step(F.col("node_id"), yes).alias("step"), after.alias("to"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("deeper"))
    tour = cut_lineage(nodes.select(key, F.inline(F.array(enter, leave))))
    most = tour.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        open_ = tour.where(F.col("to").isNotNull())
        if open_.isEmpty():
            break
        on = tour.select(key, F.col("step").alias("to"), F.col("to").alias("_to"), F.col("entered").alias("_entered"), F.col("deeper").alias("_deeper"))
        # a step without an end keeps pointing somewhere, also to a node that does not exist
        # steps at the end are kept aside, since a join would send them all to one task
        tour = cut_lineage(
            open_.join(on, [key, "to"], "left").select(
                key, "step", F.when(F.col("_entered").isNull(), F.col("to")).otherwise(F.col("_to")).alias("to"),
                (F.col("entered") + F.coalesce("_entered", F.lit(0))).alias("entered"), (F.col("deeper") + F.coalesce("_deeper", F.lit(0))).alias("deeper"),
            ).unionByName(tour.where(F.col("to").isNull()))
        )
    ended = tour.where(F.col("to").isNull() & ~F.col("step.leaves"))
    total = ended.groupBy(key).agg(F.max("entered").alias("_total"))
    # what is entered and what goes deeper from a step on, seen from the start
    return ended.join(total, key).select(key, F.col("step.node").alias("node_id"), (F.col("_total") - F.col("entered")).alias("position"), (-F.col("deeper")).cast("int").alias("depth"))


ENCRYPTED = "encrypted"
FAILED = "failed"


def human_error(message: Column) -> Column:
    """Message shown for a raw error text."""
    return (
        F.when(trim_all(F.coalesce(message, F.lit(""))) == "", FAILED)
        .when(message.rlike("(?i)encrypted"), ENCRYPTED)
        .otherwise(message)
    )


def result_columns(results: DataFrame, failed: Column, message: Column, key: str = "doc_id", buckets: int = 64) -> DataFrame:
    """Results with ``ok``, ``error`` and ``doc_bucket``."""
    return results.withColumns(
        {
            "ok": ~failed, "error": F.when(failed, human_error(message)),
            "doc_bucket": F.pmod(F.col(key), F.lit(buckets)).cast("int"),
        }
    )


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by ``doc_bucket``."""
    df.write.mode(mode).partitionBy("doc_bucket").parquet(path)

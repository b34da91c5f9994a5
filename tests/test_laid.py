"""Rows that lie together are not moved again, and give the rows that a shuffle gives."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafline.catalog import fixtures as fx
from leafline.catalog.blocks import _grid_rulings
from leafline.catalog.registry import QUERIES
from leafline.operators.columns import split_columns
from leafline.operators.lines import cluster_lines, page_lines, text_runs
from leafline.operators.ordering import arranged, bundled, cut_packed, gather, laid, laid_by, page_pass, still, unbundled
from leafline.operators.paragraphs import paragraphs
from leafline.operators.tables import ruled_grids, segment_region, table_cells
from leafline.plans.reconstruct import reconstruct
from leafline.sources.items import read_ocr_words

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def bag(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def free(df):
    """The same rows, of which nothing is known."""
    return df.select("*")


def test_sorted_in_place_as_spark_sorts(spark):
    values = [None, math.nan, 2.0, -1.0, math.inf, -math.inf, 2.0]
    rows = [(d, p, y, x, n) for d in (None, 7) for p in (1, None, 0) for n, (y, x) in enumerate(zip(values, values[3:] + values[:3]))]
    df = spark.createDataFrame(rows, "d bigint, p int, y double, x double, n int").coalesce(1)
    want = [tuple(r) for r in df.sortWithinPartitions("d", "p", F.desc("y"), F.asc("x"), F.asc("n")).select("d", "p", "n").collect()]
    batches = gather(df, ["d"]).coalesce(1).select("d", "p", "y", "x", "n").toArrow().to_batches(max_chunksize=5)
    got = [t for t, _ in arranged(iter(batches), ["d"], ["d", "p"], [("y", True), ("x", False), ("n", False)])]
    table = pa.concat_tables(got).select(["d", "p", "n"]).to_pylist()
    assert sorted(want, key=repr) == sorted((tuple(r.values()) for r in table), key=repr)
    for d in (None, 7):
        assert [w for w in want if w[0] == d] == [tuple(r.values()) for r in table if r["d"] == d]


def test_bounds_of_pages_and_words_as_keys():
    table = pa.table({"d": ["a", "a", "a", "b", None], "p": ["y", "x", "y", "x", "x"], "n": [2, 1, 0, 0, 0]})
    ((sorted_, bounds), *rest) = list(arranged(iter(table.to_batches()), ["d"], ["d", "p"], [("n", False)]))
    assert [tuple(r.values()) for r in sorted_.to_pylist()][:3] == [("a", "x", 1), ("a", "y", 0), ("a", "y", 2)]
    assert bounds.tolist() == [0, 1, 3] and sum(t.num_rows for t, _ in rest) == 1


def test_other_rows_are_still_shuffled(spark):
    df = spark.createDataFrame([(n % 5, n) for n in range(40)], "k int, n int")

    def count(table, bounds):
        n = np.diff(np.append(bounds[bounds < table.num_rows], table.num_rows))
        yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64())})

    assert laid_by(df) == () and laid_by(gather(df, ["k"]).where("n > 0")) == ()
    assert laid_by(still(df.select("n"), laid(df.select("*"), ["k"]))) == ()
    for rows, moved in ((df, 1), (gather(df, ["k"]), 1), (laid(df.coalesce(1).sortWithinPartitions("k"), ["k"]), 0)):
        counted = page_pass(rows, ["k"], [("n", False)], count, "n bigint")
        assert plan(counted).count("Exchange") == moved
        assert [r.n for r in counted.collect()] == [8] * 5


@pytest.mark.parametrize("columns", [("segment_no", "row_no", "col", "text")])
def test_an_order_is_shuffled_once_for_its_tables(spark, columns):
    glyphs = fx.order_glyphs(spark, SF)
    cells = table_cells(segment_region(page_lines(glyphs)))
    assert plan(cells).count("Exchange") == 1
    lines = page_lines(free(glyphs))
    assert plan(lines).count("Exchange") == 2
    want = table_cells(free(segment_region(free(lines))))
    assert bag(cells, "doc_id", "page_no", *columns) == bag(want, "doc_id", "page_no", *columns)


def test_wrapped_cells_keep_the_order_of_their_lines(spark):
    rows = [(1, 0, n, t, x, y, 5.0 * len(t), 10.0) for n, (t, x, y) in enumerate([
        ("Part", 72.0, 700.0), ("Qty", 202.0, 700.0), ("long", 72.0, 684.0), ("3", 202.0, 684.0), (" name ", 72.0, 668.0), ("more", 72.0, 652.0),
        ("Bolt", 72.0, 636.0), ("4", 202.0, 636.0)])]
    glyphs = spark.createDataFrame(rows, "doc_id bigint, page_no int, glyph_no int, str string, x double, y double, width double, size double")
    seg = segment_region(page_lines(glyphs))
    assert laid_by(seg) == ("doc_id", "page_no")
    got = {(r.row_no, r.col): r.text for r in table_cells(seg).collect()}
    assert got == {(r.row_no, r.col): r.text for r in table_cells(free(seg)).collect()}
    assert got[1, 0] == "long\nname\nmore"


def test_pages_ride_with_their_glyphs(spark):
    glyphs = fx.column_glyphs(spark, SF)
    pages = fx.pages_like(fx.column_titles(spark, SF)).where("doc_id % 7 <> 0 OR page_no > 0")
    pages = pages.withColumn("width", F.when(F.col("doc_id") % 5 == 0, 150.0).otherwise(F.col("width")))
    split = split_columns(glyphs, pages, paged=True)
    # pages to their document, documents before they are taken apart
    assert laid_by(split) == ("doc_id",) and plan(split).count("Exchange") == plan(pages).count("Exchange") + 2
    other = split_columns(free(glyphs), pages, paged=True)
    assert laid_by(other) == ("doc_id", "page_no")
    names = split.columns
    assert {r.paged for r in split.select("paged").distinct().collect()} == {True, False}
    assert bag(split, *names) == bag(other, *names)


def test_rows_dealt_otherwise_are_shuffled(spark):
    rows = gather(spark.range(50).selectExpr("id % 5 AS k", "id AS n"), ["k"])
    moved = laid(rows.coalesce(1), ["k"])
    few = spark.range(5).selectExpr("id AS k", "-1L AS n")

    def count(table, bounds):
        yield pa.RecordBatch.from_pydict({"n": pa.array(np.diff(np.append(bounds[bounds < table.num_rows], table.num_rows)), pa.int64())})

    for df in (rows, moved):
        assert [r.n for r in page_pass(df, ["k"], [("n", False)], count, "n bigint", few).collect()] == [11] * 5


def test_packed_rows_lie_as_they_did(spark):
    glyphs = fx.order_glyphs(spark, SF)
    packed = cut_packed(glyphs)
    assert laid_by(packed) == ("doc_id",) and bag(packed, *glyphs.columns) == bag(glyphs, *glyphs.columns)
    cells, want = (table_cells(segment_region(page_lines(g))) for g in (packed, glyphs))
    assert "Exchange" not in plan(cells) and bag(cells, *cells.columns) == bag(want, *want.columns)


def test_a_page_of_columns_is_moved_by_its_words_and_blocks_only(spark):
    built = reconstruct(fx.column_glyphs(spark, SF), fx.pages_like(fx.column_titles(spark, SF)))
    # texts: blocks to their page, and those at its top level once more
    assert plan(built.blocks).count("collect_list") == 0
    assert spark.sparkContext.getCheckpointDir() is not None
    assert laid_by(fx.column_glyphs(spark, SF)) == ("doc_id",)


def test_paragraphs_are_joined_where_their_lines_are(spark):
    rows = [
        (1, 0, 0, "first line", 72.0, 172.0, 700.0, 11.0), (1, 0, 1, "second", 72.0, 150.0, 688.0, 11.0), (1, 0, 2, "1. item", 72.0, 150.0, 660.0, 11.0),
        (1, 0, 3, "goes on", 84.0, 190.0, 648.0, 11.0), (1, 1, 0, "no place", None, math.nan, 700.0, 11.0), (None, 0, 0, None, 72.0, 80.0, 700.0, 11.0),
    ]
    lines = spark.createDataFrame(
        [(*r, 10.0, False, False, False, 612.0) for r in rows],
        "doc_id bigint, page_no int, line_no int, text string, x double, x_end double, y double, height double, font_size double, "
        "bold boolean, italic boolean, rtl boolean, page_width double",
    )
    paras = paragraphs(lines)
    assert plan(paras).count("Exchange") == 1
    got = {(r.doc_id, r.page_no, r.para_no): (r.text, r.line_count, r.x, repr(r.x_end), r.bottom, r.list_kind, r.list_start, r.line_spacing) for r in paras.collect()}
    assert got[1, 0, 0][:5] == ("first line\nsecond", 2, 72.0, "172.0", 688 - 2.75) and got[1, 0, 0][7] == 12.0
    assert got[1, 0, 1][:7] == ("item\ngoes on", 2, 72.0, "190.0", 648 - 2.75, "number", 1)
    assert got[1, 1, 0][:4] == ("no place", 1, None, "nan") and got[None, 0, 0][:2] == ("", 1)


def test_rulings_and_pages_ride_with_the_glyphs_of_orders(spark):
    glyphs, rulings = fx.order_glyphs(spark, SF), _grid_rulings(spark, SF).where("doc_id % 10 <> 3")
    pages = fx.pages_like(fx.order_ids(spark, SF).withColumn("page_no", F.lit(0)))
    assert bag(pages, "doc_id", "page_no", "width") == bag(fx.pages_like(glyphs), "doc_id", "page_no", "width")
    some = pages.where("doc_id % 6 <> 0")
    grids, other = (ruled_grids(g, rulings, doc_pages=some) for g in (glyphs, free(glyphs)))
    assert laid_by(grids) == ("doc_id",) and laid_by(other) == ("doc_id", "page_no")
    # lines of an order, its number for its rulings and for its page; no glyph
    assert plan(grids).count("Exchange") == 3 and plan(other).count("Exchange") == 4
    names = grids.columns
    found = bag(grids, *names)
    assert found == bag(other, *names) and len(found) == glyphs.count()
    assert {tuple(r) for r in grids.selectExpr("xs IS NULL AS n", "paged").distinct().collect()} == {(a, b) for a in (True, False) for b in (True, False)}
    alone = ruled_grids(glyphs, rulings)
    assert bag(alone, *alone.columns) == bag(grids.where("xs IS NOT NULL"), *alone.columns)
    split, want = split_columns(grids.drop("xs", "ys", "_shown", "row", "col"), None, paged=True), split_columns(glyphs, some, paged=True)
    assert bag(split, *want.columns) == bag(want, *want.columns)


def test_cells_of_a_table_travel_as_one_row(spark):
    cells = [(d, 0, 1, r, c, None if (r, c) == (1, 1) else f"{d} {r} {c}") for d in (1, None) for r in range(3) for c in range(2)]
    df = spark.createDataFrame(cells, "doc_id bigint, page_no int, segment_no int, row_no int, col int, text string")
    keys, fields = ["doc_id", "page_no", "segment_no"], ["row_no", "col", "text"]
    packed = bundled(df, keys, fields)
    assert packed.count() == 2 and bag(unbundled(packed, keys, fields), *df.columns) == bag(df, *df.columns)
    glyphs = fx.order_glyphs(spark, SF)
    pages = fx.pages_like(fx.order_ids(spark, SF).withColumn("page_no", F.lit(0)))
    built = reconstruct(glyphs, pages, _grid_rulings(spark, SF)).cells
    assert "arrays_zip" in plan(built) and built.count() == glyphs.count()


def test_runs_of_a_page_are_read_where_its_words_are(spark):
    glyphs = fx.prose_glyphs(spark, SF)
    lines = cluster_lines(glyphs)
    runs = text_runs(lines)
    # the words are spread once and then gathered, and no glyph is moved
    assert plan(runs).count("Exchange") == plan(glyphs).count("Exchange") == 1 and "Window" not in plan(runs)
    other = text_runs(free(cluster_lines(free(glyphs))))
    assert bag(runs, *runs.columns) == bag(other, *runs.columns)


def test_runs_of_odd_styles(spark):
    styles = [(10.0, "A", True), (10.1, "A", True), (10.2, "A", True), (10.2, None, True), (10.2, None, None), (10.2, None, None), (None, "A", True),
              (None, "A", True), (math.nan, "A", True), (math.nan, "A", True), (9.0, "A", True)]
    rows = [(1, 0, 0, n, chr(97 + n), 20.0 * n, 9.0, 5.0, size, bold, False, rtl, font) for rtl, page in ((False, 0), (True, 1))
            for n, (size, font, bold) in enumerate(styles)]
    rows = [(r[0], int(r[11]), *r[2:]) for r in rows]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, glyph_no int, str string, x double, y double, width double, size double, bold boolean, italic boolean, rtl boolean, font_family string")
    got = {}
    for r in text_runs(df).orderBy("page_no", "run_no").collect():
        got.setdefault(r.page_no, []).append((r.run_no, r.text.strip(), repr(r.font_size), r.font_family, r.bold))
    assert [t for _, t, *_ in got[0]] == ["a b", "c", "d", "e f", "g h", "i j", "k"]
    assert [n for n, *_ in got[0]] == list(range(7)) and got[0][3][2:] == ("10.2", None, None) and got[0][4][2] == "None" and got[0][5][2] == "nan"
    assert [t for _, t, *_ in got[1]] == ["k", "j i", "h g", "f e", "d", "c b", "a"] and got[1][5][2] == "10.2"


def test_page_rows_go_with_their_words(spark):
    words = [(d, p, 0, n // 2, n, f" w{n} ", 90.0 if (d, p) != (1, 1) else 9.0, 2.0 * n, 0.0, 2.0 * n + 1, 9.0, True, "") for d, p in ((1, 0), (1, 1), (2, 0), (None, 0)) for n in range(3)]
    words = spark.createDataFrame(
        words, "doc_id bigint, page_no int, para_no int, line_no int, word_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, is_ltr boolean, font_name string"
    )
    pages = [(1, 0, 100.0, 2.0, "not read"), (1, 1, 100.0, 1.0, "one\r\n\n two "), (3, 0, 100.0, 1.0, None), (None, 0, 100.0, 1.0, "unnamed")]
    glyphs = read_ocr_words(words, spark.createDataFrame(pages, "doc_id bigint, page_no int, height double, scale double, raw_text string"))
    assert "Join" not in plan(glyphs) and plan(glyphs).count("Exchange") == 1
    got = sorted((r.doc_id or 0, r.page_no, r.glyph_no, r.str, r.x, r.eol) for r in glyphs.collect())
    # no page for document 2, and keys that are not known match nothing
    assert got == [(0, 0, 0, "unnamed", 36.0, True), (1, 0, 0, "w0", 0.0, False), (1, 0, 1, "w1", 1.0, True), (1, 0, 2, "w2", 2.0, True),
                   (1, 1, 0, "one", 36.0, True), (1, 1, 1, "two", 36.0, True)]


def test_ocr_words_are_not_moved_where_documents_lie_together(spark):
    glyphs = QUERIES["s3_read_ocr_words"](spark, SF)
    assert "Join" not in plan(glyphs) and plan(glyphs).count("Exchange") == 2  # texts, for words and for pages


def test_riders_find_their_rows_when_tasks_take_several_partitions(spark):
    glyphs, pages = fx.column_glyphs(spark, SF), fx.pages_like(fx.column_titles(spark, SF))
    split = split_columns(glyphs, pages, paged=True)
    assert laid_by(split) == ("doc_id",)
    assert split.where("paged").coalesce(2).count() == split.count() > 0


def test_rows_of_other_partitions_are_refused():
    def batch(homes, rides):
        return pa.RecordBatch.from_pydict({"k": pa.array([1] * len(homes)), "_home": pa.array(homes, pa.int32()), "_rides": pa.array(rides)})

    for batches in ([batch([3, 3], [True, False]), batch([4], [False])], [batch([3, 3, 3], [True, False, False]), batch([3, 3], [False, True])]):
        with pytest.raises(RuntimeError):
            list(arranged(iter(batches), ["k"], ["k"], [], riders=True))
    ((table, bounds),) = list(arranged(iter([batch([3, 3], [True, True]), batch([3, 3], [True, False])]), ["k"], ["k"], [], riders=True))
    assert table.num_rows == 4 and bounds.tolist() == [0]

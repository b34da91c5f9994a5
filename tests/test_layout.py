"""Literal pages through the whole layout path."""

import pytest
from pyspark.sql import functions as F

from leafline.catalog.fixtures import order_glyphs
from leafline.operators.draws import ruling_segments
from leafline.operators.lines import cluster_lines, lines, page_lines, text_runs
from leafline.operators.tables import column_alignments, header_rows, segment_region, table_cells, table_columns
from leafline.plans.reconstruct import reconstruct
from leafline.sources.items import read_ocr_words

GLYPH = "doc_id int, page_no int, glyph_no int, str string, x double, y double, width double, size double, bold boolean, italic boolean, rtl boolean, font_family string"


def page(doc, rows):
    return [
        (doc, 0, i, r[0], float(r[1]), float(r[2]), float(r[3]), float(r[4]), *(r[5:] or (False, False, False, None)))
        for i, r in enumerate(rows)
    ]


def rows_of(xs, y, *lines, size=10, step=22, width=6.0):
    """Cells of a plain table: one glyph each, the columns at ``xs``, the rows ``step`` apart."""
    return [(t, x, y - i * step, max(5.0, len(t) * width), size) for i, line in enumerate(lines) for x, t in zip(xs, line) if t]


STOCK = (("Part", "Bin", "Weight"), ("Valve", "B7", "2.4"), ("Gasket", "C1", "0.1"), ("Flange", "A3", "8.9"))
WIDE = rows_of((45, 230, 415), 640, *STOCK)
CLOSE = rows_of((45, 105, 150), 640, *STOCK, step=18)
# blanks drawn between the cells, as some writers do
FILLED = [g for y in (520, 498, 476) for g in (("Vent" if y < 520 else "Device", 50, y, 40, 10), ("  ", 90, y, 110, 10), (f"{y}", 200, y, 22, 10), (" ", 222, y, 120, 10), (f"{y // 2} kPa", 342, y, 40, 10))]
ARTICLE = [(f"Story {side} keeps its own margin on row {i}, from word to word.", 60 if side == "one" else 345, 610 - 18 * i - (0 if side == "one" else 4), 215, 10) for side in ("one", "two") for i in range(4)]
PARTED = [("Heat moves from", 80, 600, 85, 10), ("warm to cold.", 80, 586, 66, 10), ("Work can turn it back.", 80, 540, 118, 10)]
INSET = [("A first line that is set in and long enough to need another one", 104, 600, 310, 10), ("so that the second begins at the margin of the body of text", 80, 586, 300, 10)]
STEPS = [("3. Close the tap", 80, 300, 82, 10), ("4. Open the vent", 80, 285, 84, 10), ("5. Wait", 80, 270, 40, 10)]


def styled(text, x, y, size=11, bold=False, italic=False, family="Charter"):
    return (text, x, y, len(text) * size * 0.45, size, bold, italic, False, family)


LEDGER = [styled("Room", 80, 630, 13, True), styled("Rent", 330, 630, 13, True), styled("Attic, front", 80, 588, italic=True), styled("and landing", 80, 570), styled("310", 330, 588), styled("95", 330, 520)]
LEDGER_RULES = [(x, 500, x, 652) for x in (70, 320, 430)] + [(70, y, 430, y) for y in (652, 612, 545, 500)]
WIDE_RULES = [(x, 560, x, 656) for x in (38, 222, 408, 470)] + [(38, y, 470, y) for y in (656, 632, 610, 588, 560)]

CASES = {1: (WIDE, 560, 842), 2: (WIDE, 560, 842), 3: (CLOSE, 420, 842), 4: (ARTICLE, 620, 842), 5: (FILLED, 450, 700),
         6: (PARTED, 595, 842), 7: (INSET, 595, 842), 8: (STEPS, 595, 842), 9: (LEDGER, 595, 842)}


@pytest.fixture(scope="module")
def built(spark):
    glyphs = spark.createDataFrame([g for d, (rows, _, _) in CASES.items() for g in page(d, rows)], GLYPH)
    pages = spark.createDataFrame(
        [(d, 0, float(w), float(h)) for d, (_, w, h) in CASES.items()], "doc_id int, page_no int, width double, height double"
    )
    ops = [(2, 0, i, "path", [float(v) for v in r]) for i, r in enumerate(WIDE_RULES)]
    ops += [(9, 0, i, "path", [float(v) for v in r]) for i, r in enumerate(LEDGER_RULES)]
    draws = spark.createDataFrame(ops, "doc_id int, page_no int, op_no int, op string, args array<double>")
    r = reconstruct(glyphs, pages, ruling_segments(draws))
    blocks, cells = {}, {}
    for b in r.blocks.orderBy("doc_id", "block_no").collect():
        blocks.setdefault(b.doc_id, []).append(b)
    for c in r.cells.collect():
        cells.setdefault(c.doc_id, {})[(c.row_no, c.col)] = c.text
    return blocks, cells


def test_aligned_text_is_a_borderless_table(built):
    blocks, cells = built
    assert [(b.kind, b.bordered, b.header_rows) for b in blocks[1]] == [("table", False, 1)]
    assert cells[1] == {(r, c): t for r, line in enumerate(STOCK) for c, t in enumerate(line)}


def test_drawn_rules_make_a_bordered_table(built):
    blocks, cells = built
    assert [(b.kind, b.bordered) for b in blocks[2]] == [("table", True)]
    assert cells[2][(3, 0)] == "Flange"


def test_close_columns_and_blank_glyphs_keep_cells(built):
    blocks, cells = built
    assert [b.kind for b in blocks[3]] == ["table"] and [b.kind for b in blocks[5]] == ["table"]
    assert cells[3][(2, 1)] == "C1"
    assert cells[5][(2, 2)] == "238 kPa"


def test_two_columns(built):
    found = built[0][4]
    assert ("columns", None) in [(b.kind, b.col_no) for b in found]
    for col, side in enumerate(("one", "two")):
        text = " ".join(b.text for b in found if b.col_no == col)
        assert text.count(f"Story {side}") == 4 and text.count("Story") == 4


def test_paragraph_gap_splits(built):
    assert [b.text for b in built[0][6]] == ["Heat moves from\nwarm to cold.", "Work can turn it back."]


def test_first_line_indent(built):
    (para,) = built[0][7]
    assert (para.first_indent, para.x) == (24.0, 80.0)


def test_numbered_list(built):
    assert [(b.list_kind, b.list_start, b.text) for b in built[0][8]] == [("number", n, t) for n, t in ((3, "Close the tap"), (4, "Open the vent"), (5, "Wait"))]
    assert len({b.list_seq for b in built[0][8]}) == 1


def test_ruled_grid(built):
    blocks, cells = built
    assert cells[9] == {(0, 0): "Room", (0, 1): "Rent", (1, 0): "Attic, front\nand landing", (1, 1): "310", (2, 1): "95"}
    assert [(b.kind, b.x, b.width, b.top, b.bottom) for b in blocks[9]] == [("table", 70.0, 360.0, 652.0, 500.0)]


def test_glyphs_join_into_words(spark):
    rows = [("dr", 33, 210, 11, 10), ("um", 44, 210.3, 14, 10), ("beat", 64, 209.8, 22, 10), ("s", 86, 210, 5, 10)]
    g = cluster_lines(spark.createDataFrame(page(1, rows), GLYPH))
    assert [r.text for r in lines(g).collect()] == ["drum beats"]


def test_right_to_left_line_reads_from_the_right(spark):
    rows = [(t, x, 300, w, 12, False, False, True, None) for t, x, w in (("late", 70, 22), ("soon", 130, 26), ("?", 66, 4))]
    (line,) = lines(cluster_lines(spark.createDataFrame(page(1, rows), GLYPH))).collect()
    assert (line.text, line.rtl, line.x) == ("soon late?", True, 66.0)


def test_runs_compare_with_the_first_glyph_of_a_run(spark):
    rows = [("a", 0, 100, 5, 10.0), ("b", 10, 100, 5, 10.1), ("c", 20, 100, 5, 10.2)]
    g = cluster_lines(spark.createDataFrame(page(1, rows), GLYPH))
    assert [(r.text, r.font_size) for r in text_runs(g).orderBy("run_no").collect()] == [("a b", 10.0), (" c", 10.2)]


def test_lines_follow_the_running_mean(spark):
    # 100, 96, 92: each step is small, but the mean of the first two is 98, six points above the third.
    rows = [("a", 0, 100, 5, 10), ("b", 10, 96, 5, 10), ("c", 20, 92, 5, 10)]
    g = cluster_lines(spark.createDataFrame(page(1, rows), GLYPH))
    assert [r.line_no for r in g.orderBy("glyph_no").collect()] == [0, 0, 1]


def test_ocr_words_become_a_table(spark):
    table = (("Lake", "Depth", "Area"), ("Ober", "44", "1310"), ("Unter", "9", "87"))
    rows = []
    for r, line in enumerate(table):
        for c, t in enumerate(line):
            x, y = 150.0 + 420 * c, 360.0 + 90 * r
            rows.append((1, 0, 0, r, len(rows), t, 88.0 + c, x, y, x + 24 * len(t), y + 42, True, "Georgia"))
    rows.append((1, 0, 0, 2, 9, "smudge", 12.0, 1500.0, 540.0, 1600.0, 582.0, True, "Georgia"))
    w = spark.createDataFrame(rows, "doc_id int, page_no int, para_no int, line_no int, word_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, is_ltr boolean, font_name string")
    pages = spark.createDataFrame([(1, 0, 560.0, 700.0, 3.0, "x")], "doc_id int, page_no int, width double, height double, scale double, raw_text string")
    g = read_ocr_words(w, pages)
    got = g.orderBy("glyph_no").collect()
    assert [x.str for x in got] == [t for line in table for t in line] and (got[1].x, got[0].y) == (190.0, 700 - 402 / 3)
    cells = {(c.row_no, c.col): c.text for c in reconstruct(g, pages).cells.collect()}
    assert cells == {(r, c): t for r, line in enumerate(table) for c, t in enumerate(line)}


def test_matrix_stack(spark):
    ops = [(0, "save", []), (1, "transform", [2.0, 0, 0, 2, 10, 20]), (2, "path", [0.0, 0, 50, 1]), (3, "restore", []),
           (4, "path", [0.0, 0, 50, 1]), (5, "restore", []), (6, "transform", [1.0]), (7, "path", [0.0, 0, 4, 4])]
    d = spark.createDataFrame([(1, 0, n, o, [float(v) for v in a]) for n, o, a in ops], "doc_id int, page_no int, op_no int, op string, args array<double>")
    got = [(r.x1, r.y1, r.x2, r.y2) for r in ruling_segments(d).orderBy("op_no").collect()]
    assert got == [(10.0, 20.0, 110.0, 22.0), (0.0, 0.0, 50.0, 1.0)]


def test_blocks_are_ordered_from_the_top(built):
    positions = [(b.position, b.top) for b in built[0][6]]
    assert positions == sorted(positions, key=lambda p: -p[1])


def test_a_page_is_sorted_once_for_its_lines(spark):
    # a page of an unnamed document, one of a named one, and a glyph that shows nothing but opens a line
    rows = [(None, 0, 0, "one", 10.0, 90.0, 15.0, 10.0), (None, 0, 1, "two", 40.0, 90.0, 15.0, 10.0), (None, 0, 2, "three", 10.0, 70.0, 25.0, 10.0)]
    rows += [(4, 0, 0, " ", 10.0, 90.0, 15.0, 10.0), (4, 0, 1, "four", 10.0, 60.0, 20.0, 12.0), (4, 0, 2, "five", 33.0, 60.0, 20.0, 10.0)]
    found = page_lines(spark.createDataFrame(rows, "doc_id int, page_no int, glyph_no int, str string, x double, y double, width double, size double"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Window" not in plan and "Aggregate" not in plan
    got = {(r.doc_id, r.line_no): (r.text, r.font_size, r.x_end, [(t.token_no, t.text) for t in r.tokens]) for r in found.collect()}
    assert got == {
        (None, 0): ("one two", 10.0, 55.0, [(0, "one"), (1, "two")]), (None, 1): ("three", 10.0, 35.0, [(0, "three")]),
        (4, 1): ("four five", 12.0, 53.0, [(0, "four five")]),
    }


def test_headers_and_alignments_read_the_lines_once(spark):
    seg = segment_region(page_lines(order_glyphs(spark, "/root/testdata/sf0.001")))
    group = ["doc_id", "page_no", "segment_no"]
    columns = table_columns(seg)
    plan = columns._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == seg._jdf.queryExecution().executedPlan().toString().count("MapInArrow") and "Join" not in plan
    cells = table_cells(seg)
    heads = header_rows(cells, seg.where("is_table").groupBy(*group).agg(F.min_by("bold", "line_no").alias("bold")), group)
    want = column_alignments(cells, heads, group).join(heads, group)
    order = [*group, "col", "header_rows", "alignment"]
    got = sorted(tuple(r) for r in columns.select(order).collect())
    assert got and got == sorted(tuple(r) for r in want.select(order).collect())


def test_regions_are_segmented_in_one_sorted_pass(spark):
    seg = segment_region(page_lines(order_glyphs(spark, "/root/testdata/sf0.001")))
    plan = seg._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "collect_list" not in plan

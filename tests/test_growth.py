"""Steps whose work must not grow faster than their input."""

from __future__ import annotations


from pyspark.sql import functions as F

from leafline.catalog import fixtures as fx
from leafline.operators.columns import split_columns
from leafline.operators.images import few_distinct
from leafline.operators.paragraphs import list_ids, list_items, paragraph_lines, paragraphs
from leafline.operators.tables import grid_cells, ruled_cells, ruled_grids
from leafline.sources.items import read_ocr_words, read_text_items


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_sampled_whole_are_counted_without_a_join(spark):
    short = spark.createDataFrame([(g, i, str(i % n)) for g, n in ((1, 95), (2, 96)) for i in range(200)], "g int, i int, v string")
    few = few_distinct(short, ["g"], "v", "i")
    assert "Join" not in plan(few)
    assert dict(few.collect()) == {1: True, 2: False}


def test_longer_groups_are_sampled(spark):
    # 90,000 rows are sampled at every second one, which holds 50 of the 100 values
    rows = spark.range(90_000).selectExpr("1 AS g", "cast(id AS int) AS i", "cast(id % 100 AS string) AS v")
    more = rows.unionByName(spark.range(300).selectExpr("2 AS g", "cast(id AS int) AS i", "cast(id AS string) AS v"))
    assert dict(few_distinct(more, ["g"], "v", "i").collect()) == {1: True, 2: False}


def test_placed_words_cut_each_line_once(spark, tmp_path):
    text = "aé b\n\n ccc dd  e f g h i jj k " * 60
    spark.createDataFrame([(3, text), (4, None), (5, "  "), (6, "x")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for per, column in ((8, 8), (3, F.when(F.col("doc_id") % 3 == 0, 3).otherwise(6))):
        placed = fx._placed_words(spark, str(tmp_path), column)
        assert "aggregate" not in plan(placed)
        got = {(r.doc_id, r.n): (r.word, r.ln, r.lead) for r in placed.collect()}
        expected = {}
        for doc_id, t in ((3, text), (6, "x")):
            ws = [w for w in t.replace("\n", " ").split(" ") if w]
            for n, w in enumerate(ws):
                line = n // per
                expected[doc_id, n] = (w, line, sum(len(v) + 1 for v in ws[line * per:n]))
        assert got == expected


def test_an_item_is_read_from_its_json_once(spark):
    item = '{"str":"a","width":2.0,"height":3.0,"transform":[1,0,0,1,5,6],"fontName":"F"}'
    glyphs = read_text_items(spark.createDataFrame([(1, 0, 0, item), (1, 0, 1, "{}"), (1, 0, 2, None)], "doc_id bigint, page_no int, glyph_no int, item string"))
    assert [(r.glyph_no, r.str, r.x, r.y) for r in glyphs.collect()] == [(0, "a", 5.0, 6.0)]
    assert plan(glyphs).count("from_json") == 1


def test_words_of_a_page_are_sorted_once(spark):
    words = [(1, 0, n // 5, n // 3, n, f" w{n} ", 90.0, 0.0, 0.0, 9.0, 9.0, True, "") for n in range(7)]
    words = spark.createDataFrame(
        words, "doc_id bigint, page_no int, para_no int, line_no int, word_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, is_ltr boolean, font_name string"
    )
    pages = spark.createDataFrame([(1, 0, 100.0, 1.0, "x"), (1, 1, 100.0, 1.0, "a\r\nb")], "doc_id bigint, page_no int, height double, scale double, raw_text string")
    glyphs = read_ocr_words(words, pages)
    assert plan(glyphs).count("Window [") == 1
    got = sorted((r.page_no, r.glyph_no, r.str, r.eol) for r in glyphs.collect())
    ends = {2, 4, 5, 6}
    assert got == [(0, n, f"w{n}", n in ends) for n in range(7)] + [(1, 0, "a", True), (1, 1, "b", True)]


def test_a_page_is_split_in_one_pass(spark):
    # eight lines a side; the left and right lines of page 0 share no baseline, those of page 1 do and are short
    rows = [(1, p, n, "word" * 8 if p == 0 else "word", 72.0 + 260 * (n % 2), 700.0 - 14 * (n // 2) - (7 * (n % 2) if p == 0 else 0), 160.0, 10.0) for p in (0, 1, 2) for n in range(16)]
    rows += [(1, 0, 90, "Title", 72.0, 760.0, 400.0, 14.0), (1, 0, 91, "both", 238.0, 500.0, 4.0, 10.0), (1, 0, 92, " ", 72.0, 10.0, 4.0, 10.0), (1, 0, 93, "lost", None, 600.0, 4.0, 10.0)]
    glyphs = spark.createDataFrame(rows, "doc_id bigint, page_no int, glyph_no int, str string, x double, y double, width double, size double")
    pages = spark.createDataFrame([(1, 0, 612.0), (1, 1, 612.0), (1, 2, 150.0), (1, 3, 612.0)], "doc_id bigint, page_no int, width double")
    split = split_columns(glyphs.where("glyph_no <> 93"), pages)
    shown = plan(split)
    assert shown.count("Exchange") == 1 and "aggregate(" not in shown and "Join" not in shown
    got = {(r.page_no, r.glyph_no, r.region, r.split_x is None) for r in split.collect()}
    expected = {(0, n, 2 + n % 2, False) for n in range(16)} | {(0, 90, 1, False)} | {(p, n, 0, True) for p in (1, 2) for n in range(16)}
    assert {g for g in got if g[1] != 91} == expected
    assert {g[2] for g in got if g[1] == 91} <= {1, 2, 3}
    # a glyph without a place touches every bin, but one alone crowds none; it goes with no side
    assert {(r.page_no, r.glyph_no) for r in split_columns(glyphs, pages).where("page_no = 0").collect()} >= {(0, 90)}


def test_a_region_is_walked_in_one_pass(spark):
    texts = ["1. one", "more", "2. two", "plain", "plain", "• dot", "3. three", "1. again"]
    ys = [700.0, 688.0, 676.0, 640.0, 628.0, 616.0, 604.0, 592.0]
    xs = [72.0, 80.0, 72.0, 72.0, 72.0, 72.0, 72.0, None]
    rows = [(1, p, n, t, x, 300.0, y, 11.0, 10.0, False, False, False, 612.0) for p in (0, 1) for n, (t, x, y) in enumerate(zip(texts, xs, ys))]
    lines = spark.createDataFrame(
        rows, "doc_id bigint, page_no int, line_no int, text string, x double, x_end double, y double, height double, font_size double, "
        "bold boolean, italic boolean, rtl boolean, page_width double"
    )
    walked = paragraph_lines(lines)
    assert plan(walked).count("Exchange") == 1 and "aggregate(" not in plan(walked) and "Window" not in plan(walked)
    got = sorted((r.page_no, r.line_no, r.para_no, r.list_seq, r.opens) for r in walked.collect())
    one = [(0, 0, 1, True), (1, 0, 1, False), (2, 1, 1, True), (3, 2, None, True), (4, 2, None, False), (5, 3, 2, True), (6, 4, 3, True), (7, 5, 4, True)]
    assert got == [(p, *line) for p in (0, 1) for line in one]
    ids = sorted((r.page_no, r.list_seq, r.list_kind, r.list_id, r.start) for r in list_ids(list_items(lines)).collect())
    assert ids == [(p, s, k, 4 * p + s, b) for p in (0, 1) for s, k, b in ((1, "number", 1), (2, "bullet", 1), (3, "number", 3), (4, "number", 1))]
    assert ids == sorted((r.page_no, r.list_seq, r.list_kind, r.list_id, r.start) for r in list_ids(paragraphs(lines)).collect())


def test_a_ruled_page_is_read_in_one_pass(spark):
    def page(p, columns, lowest):
        xs, ys = [50.0 + 60 * i for i in range(columns + 1)], [700.0, 680.0, 660.0]
        return [(1, p, x, lowest, x + 0.5, 700.0) for x in xs] + [(1, p, xs[0], y, xs[-1] + 0.5, y) for y in ys] + [(1, p, xs[0], 679.0, xs[-1] + 0.5, 679.0)]

    # page 0 is a grid, the lines of page 1 end above its bottom, page 2 has a glyph over a line, page 3 has too few glyphs
    rulings = page(0, 2, 660.0) + page(1, 2, 670.0) + page(2, 2, 660.0) + page(3, 2, 660.0) + [(1, 0, 10.0, 10.0, 14.0, 200.0), (1, 0, None, 1.0, 90.0, 1.0)]
    glyphs = [(1, p, n, t, x, y, 10.0, 5.0) for p in (0, 1, 2) for n, (t, x, y) in enumerate([("b", 70.0, 690.0), ("a", 55.0, 690.0), ("c", 55.0, 683.0), ("d", 120.0, 690.0), (",", 131.0, 690.0), ("e", 120.0, 670.0), ("out", 10.0, 10.0), (" ", 55.0, 670.0)])]
    glyphs += [(1, 2, 20, "wide", 100.0, 690.0, 20.0, 5.0), (1, 3, 0, "x", 55.0, 690.0, 10.0, 5.0)]
    glyphs = spark.createDataFrame(glyphs, "doc_id bigint, page_no int, glyph_no int, str string, x double, y double, width double, size double")
    rulings = spark.createDataFrame(rulings, "doc_id bigint, page_no int, x1 double, y1 double, x2 double, y2 double")
    cells, gridded = ruled_cells(glyphs, rulings), ruled_grids(glyphs, rulings)
    for df in (cells, gridded):
        assert plan(df).count("Exchange") == 1 and "Join" not in plan(df) and "Window" not in plan(df) and "aggregate(" not in plan(df)
    expected = [(0, 0, 0, "a b\nc"), (0, 0, 1, "d,"), (0, 1, 1, "e")]
    assert sorted((r.page_no, r.row, r.col, r.text) for r in cells.collect()) == expected
    assert sorted((r.page_no, r.row, r.col, r.text) for r in grid_cells(gridded).collect()) == expected
    assert {(tuple(r.xs), tuple(r.ys)) for r in gridded.collect()} == {((50.25, 110.25, 170.25), (700.0, 679.5, 660.0))}

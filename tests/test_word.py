"""Word files, flow and paging against small hand-made inputs and brute force."""

import io
import random
import zipfile

import pytest
from leafline.operators.flow import flow_lines
from leafline.operators.paging import paginate
from leafline.operators.pages import page_selection
from leafline.sources.docx import docx_manifest, docx_parts, docx_rels, read_docx_corpus
from leafline.operators.word import cell_edge, resolve_target
from pyspark.sql import functions as F

NS = 'xmlns:w="urn:w" xmlns:mc="urn:mc" xmlns:a="urn:a" xmlns:r="urn:r" xmlns:wp="urn:wp"'


def package(body, **parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return buffer.getvalue()


def p(text, props=""):
    return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"


BODY = (
    p("Title", '<w:pPr><w:pStyle w:val="Heading1"/><w:jc w:val="center"/></w:pPr>')
    + '<w:p><w:r><w:rPr><w:b/><w:sz w:val="24"/></w:rPr><w:t>bold</w:t><w:tab/><w:br/><w:t>x</w:t><w:lastRenderedPageBreak/></w:r></w:p>'
    + '<w:p><w:ins><w:r><w:t>in</w:t></w:r></w:ins><w:del><w:r><w:t>out</w:t></w:r></w:del><w:r><w:br w:type="page"/></w:r></w:p>'
    + "<w:sdt><w:sdtContent>" + p("control") + "</w:sdtContent></w:sdt>"
    + "<w:p><mc:AlternateContent><mc:Choice/><mc:Fallback><w:r><w:t>fall</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>"
    + '<w:p><w:r><w:drawing><wp:extent cx="127000" cy="254000"/><a:blip r:embed="rId5"/></w:drawing></w:r></w:p>'
    + '<w:tbl><w:tblGrid><w:gridCol w:w="100"/><w:gridCol w:w="50"/></w:tblGrid><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:vMerge/></w:tcPr>'
    + '<w:p><w:r><w:t>cell</w:t><w:br w:type="page"/></w:r></w:p><w:tbl><w:tr><w:tc>' + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
)


def test_docx_reader(spark):
    rels = '<Relationships><Relationship Id="rId5" Type="t" Target="media/dot.png"/><Relationship Id="e" Target="http://x" TargetMode="External"/></Relationships>'
    content = package(BODY, **{"word___rels__document.xml.rels": rels})
    files = spark.createDataFrame([(1, content), (2, b"nope")], "doc_id bigint, content binary")
    t = read_docx_corpus(files)
    pieces = {}
    for r in t["pieces"].orderBy("para_no", "piece_no").collect():
        pieces.setdefault(r.para_no, []).append((r.kind, r.text))
    assert pieces == {
        0: [("text", "Title")], 1: [("text", "bold"), ("text", "    "), ("nl", None), ("text", "x")],
        2: [("text", "in"), ("break", None)], 3: [("text", "control")], 4: [("text", "fall")], 5: [("image", None)],
        6: [("text", "cell"), ("nl", None)], 7: [("text", "a  |  b")],
    }
    first = t["paras"].where("para_no = 0").first()
    assert (first.style_id, first.jc) == ("Heading1", "center")
    run = t["pieces"].where("para_no = 1 AND piece_no = 0").first()
    assert (run.bold, run.size) == (True, 12.0)
    image = t["pieces"].where("kind = 'image'").first()
    assert (image.rel_id, image.cx, image.cy) == ("rId5", 127000.0, 254000.0)
    assert [(c.span, c.v_continue) for c in t["cells"].collect()] == [(2, True)]
    assert [(g.col, g.width) for g in t["grid"].orderBy("col").collect()] == [(0, 100.0), (1, 50.0)]
    got = {(r.rel_id, r.external) for r in docx_rels(docx_parts(files)).collect()}
    assert got == {("rId5", False), ("e", True)}
    assert [r.entry_no for r in docx_manifest(files).where("doc_id = 2").collect()] == [None]


def test_targets(spark):
    cases = {"media/a.png": "word/media/a.png", "/x/./y.xml": "x/y.xml", "../z.xml": "z.xml", "../../z.xml": None,
             "HTTPS://a": None, " ": None, "a%2Zb": "word/a%2Zb", "..\\media\\b+c.png": "media/b+c.png"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", resolve_target(F.col("t")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == cases


def test_cell_edges(spark):
    df = spark.createDataFrame([(True, None, 1, 2, True), (False, None, 1, 2, True), (False, None, 1, 2, False)], "s boolean, o int, t int, i int, b boolean")
    edge = cell_edge(*[F.col(c) for c in ("s", "o", "t", "i", "b")])
    assert [r.e for r in df.select(edge.alias("e")).collect()] == [None, 1, 2]


def test_page_selection(spark):
    rows = [("3, 1-2, 2", 5), ("0", 5), ("4-2", 5), ("1,,2", 5), ("8", 5), ("1.5", 5), ("-1", 5), ("", 3), (" 2 - 3 ", 5), ("1", 0)]
    df = spark.createDataFrame(rows, "s string, n int").select("s", page_selection(F.col("s"), F.col("n")).alias("r"))
    got = [(r.s, r.r.pages, r.r.error is None) for r in df.collect()]
    assert got[0] == ("3, 1-2, 2", [2, 0, 1], True)
    assert [ok for _, _, ok in got[1:7]] == [False] * 6
    assert got[7][1] == [0, 1, 2] and got[8][1] == [1, 2] and not got[9][2]


def wrap(text, width, size, metrics):
    """Greedy wrap written token by token, as an independent statement of the rule."""
    import re

    def measure(t):
        return sum(metrics.get(c, 0.5) for c in t) * size

    out, cur, used, filled = [], "", 0.0, False
    for t in re.findall(r" +|\n|[^ \n]+", text):
        if t == "\n":
            out.append(cur)
            cur, used, filled = "", 0.0, False
            continue
        w = measure(t)
        if used + w > width and filled:
            out.append(cur)
            cur, used, filled = "", 0.0, False
            if t[0] == " ":
                continue
        if w > width and t[0] != " ":
            piece = ""
            for c in t:
                if measure(piece + c) > width and piece:
                    out.append(cur + piece)
                    cur, piece = "", c
                else:
                    piece += c
            t, w = piece, measure(piece)
            used = 0.0
        cur, used, filled = cur + t, used + w, True
    if filled or not out:
        out.append(cur)
    return out


def test_flow_lines_match_brute_force(spark):
    rng = random.Random(5)
    metrics = {"i": 0.25, "m": 0.9, " ": 0.3}
    texts = ["", "\n", "a\n\nb", "   lead", "mmmmmmmmmmmmmmmmmmmm end"] + [
        "".join(rng.choice("abim   \n" if rng.random() < 0.9 else "mmmmmm") for _ in range(rng.randint(1, 120))) for _ in range(40)
    ]
    df = spark.createDataFrame([(1, i, t, 10.0) for i, t in enumerate(texts)], "doc_id bigint, para_no int, text string, size double")
    got = {}
    for r in flow_lines(df, 60.0, metrics).orderBy("para_no", "line_no").collect():
        got.setdefault(r.para_no, []).append(r.text)
    assert got == {i: wrap(t, 60.0, 10.0, metrics) for i, t in enumerate(texts)}


def test_flow_lines_of_unknown_width_keep_their_last_line(spark):
    rows = [(1, 0, "x\na b ", 10.0, None), (1, 1, None, 10.0, 60.0), (1, 2, "x\na b ", None, 60.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, para_no int, text string, size double, room double")
    got = sorted(map(tuple, flow_lines(df, F.col("room")).collect()), key=lambda r: (r[1], r[2] or 0))
    assert got == [
        (1, 0, 0, "x", 5.0), (1, 0, 1, "a b ", 20.0), (1, 1, None, None, None), (1, 2, 0, "x", None), (1, 2, 1, "a b ", None),
    ]


def pages_of(blocks, top, bottom):
    """Paging written over a whole document in memory."""
    out, page, y, ink = [], -1, 0.0, -1

    def reserve(i, room):
        total = 0.0
        for b in blocks[i + 1:] if room > 0 else []:
            if b["kind"] == "break":
                break
            h = {"para": b["size"] * b["line_mult"], "image": 8.0, "row": 16.0 if b["opens_table"] else 0.0}.get(b["kind"], 0.0)
            if h and total + h > room:
                break
            total += h
        return total

    for i, b in enumerate(blocks):
        if b["kind"] == "break":
            if page >= 0:
                page, y = page + 1, top
            continue
        gaps = []
        if b["kind"] == "empty":
            gaps = [(b["space_before"] + b["space_after"] + b["size"] * b["line_mult"], reserve(i, y - bottom))]
        elif b["kind"] == "para":
            first = b["heights"][0]
            gaps = [(b["space_before"], first + reserve(i, y - first - bottom))]
        for gap, kept in gaps:
            if page >= 0 and gap > 0 and y - gap - kept >= bottom:
                y -= gap
        if b["kind"] == "empty":
            continue
        for n, h in enumerate(b["heights"]):
            if page < 0:
                page, y = 0, top
            if y - h < bottom:
                page, y = page + 1, top
            out.append((b["block_no"], n, page, round(y, 6)))
            ink = page
            y -= h + (8 if b["kind"] == "image" else 0)
        if b["kind"] == "para" and b["space_after"] > 0 and y - b["space_after"] - reserve(i, y - bottom) >= bottom:
            y -= b["space_after"]
    return out, max(1, ink + 1)


def paged(spark, docs, **page):
    schema = "doc_id bigint, block_no int, kind string, heights array<double>, size double, line_mult double, space_before double, space_after double, opens_table boolean"
    fields = ["block_no", "kind", "heights", "size", "line_mult", "space_before", "space_after", "opens_table"]
    df = spark.createDataFrame([(doc, *(b[f] for f in fields)) for doc, bs in docs.items() for b in bs], schema).repartition(5)
    placed, counts = {d: [] for d in docs}, {}
    for r in paginate(df, height=300.0, margin_top=20.0, margin_bottom=20.0, **page).collect():
        if r.block_no is None:
            counts[r.doc_id] = r.page_count
        else:
            placed[r.doc_id].append((r.block_no, r.line_no, r.page_no, round(r.y, 6)))
    return {d: sorted(p) for d, p in placed.items()}, counts


def block(n, kind="para", heights=(13.0,), before=0.0, after=0.0, opens=False, size=12.0):
    return dict(block_no=n, kind=kind, heights=list(heights), size=size, line_mult=1.08, space_before=before, space_after=after, opens_table=opens)


@pytest.mark.parametrize("chunk", [1, 3, 17, 10_000])
def test_paginate_matches_brute_force(spark, chunk):
    rng, docs = random.Random(11), {}
    for doc in [None, *range(1, 14)]:
        blocks = []
        for n in range(rng.randint(1, 160)):
            kind = rng.choice(["para"] * 6 + ["empty", "empty", "image", "row", "row"] + (["break"] if rng.random() < 0.3 else []))
            heights = [13.0] * rng.randint(1, 6) if kind == "para" else [float(rng.randint(16, 90) if rng.random() < 0.97 else 300)]
            blocks.append(block(n, kind, heights, float(rng.choice([0, 6, 20])), float(rng.choice([0, 8])), rng.random() < 0.5))
        docs[doc] = blocks
    docs[20] = [block(0, "empty", size=1.0)]
    docs[21] = [block(0, "break"), block(1, "row", [300.0]), block(2, "break"), block(3, "break")]
    docs[22] = [block(n, "empty", before=2.0) if 5 < n < 60 else block(n) for n in range(0, 200, 2)]
    placed, counts = paged(spark, docs, chunk=chunk)
    for doc, blocks in docs.items():
        want, count = pages_of(blocks, 280.0, 20.0)
        assert placed[doc] == want
        assert counts[doc] == count


def test_paginate_takes_linear_time_for_blank_runs(spark):
    n = 100_000
    docs = {1: [block(0), *[block(i, "empty", before=1.0, after=1.0) for i in range(1, n)], block(n), block(n + 1)]}
    placed, counts = paged(spark, docs, chunk=5000)
    assert [p[:3] for p in placed[1]] == [(0, 0, 0), (n, 0, 0), (n + 1, 0, 0)] and counts == {1: 1}


STYLES = f"""<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:styleId="L"><w:name w:val="List"/><w:pPr><w:numPr><w:numId w:val="4"/></w:numPr></w:pPr><w:rPr><w:b/></w:rPr></w:style>
<w:style w:type="table" w:styleId="T1"><w:name w:val="Base"/><w:tblPr><w:tblBorders><w:top w:val="single" w:sz="8" w:color="FF0000"/><w:left w:val="single"/></w:tblBorders></w:tblPr></w:style>
<w:style w:type="table" w:styleId="T2"><w:basedOn w:val="T1"/><w:tblPr><w:tblBorders><w:left w:val="nil"/></w:tblBorders></w:tblPr></w:style></w:styles>"""
NUMBERING = f"""<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum>
<w:num w:numId="4"><w:abstractNumId w:val="7"/></w:num></w:numbering>"""


def item(text, level):
    return p(text, f'<w:pPr><w:pStyle w:val="L"/><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="4"/></w:numPr></w:pPr>')


def test_word_flow_numbers_lists_and_pages(spark):
    from leafline.operators.word import resolve_table_styles
    from leafline.plans.word_flow import word_flow
    from leafline.sources.docx import docx_style_tables

    body = (
        p("Heading", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + item("one", 0) + item("sub", 1) + item("two", 0) + item("again", 1)
        + '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + p("After the break")
        + "<w:tbl><w:tr><w:tc>" + p("cell a") + "</w:tc><w:tc>" + p("cell b") + "</w:tc></w:tr></w:tbl>"
    )
    content = package(body, **{"word__styles.xml": STYLES, "word__numbering.xml": NUMBERING})
    parts = docx_parts(spark.createDataFrame([(1, content)], "doc_id bigint, content binary"))
    f = word_flow(parts)
    texts = [r.text for r in f.lines.orderBy("para_no", "line_no").collect()]
    assert texts == ["Heading", "1. one", "1. sub", "2. two", "1. again", "After the break", "cell a", "cell b"]
    placed = f.placed.where("block_no IS NOT NULL").orderBy("block_no").collect()
    assert [(r.block_no, r.page_no) for r in placed] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (6, 1), (7, 1)]
    assert f.placed.where("block_no IS NULL").first().page_count == 2
    heading = f.paragraphs.where("para_no = 0").first()
    assert (heading.heading, heading.size, heading.bold) == (1, 18.0, True)
    s = docx_style_tables(parts)
    edges = {(r.style_id, r.side): r.edge for r in resolve_table_styles(s["table_styles"], s["edges"]).collect()}
    assert edges == {("T1", "top"): "1 FF0000", ("T1", "left"): "0.5 000000", ("T2", "top"): "1 FF0000", ("T2", "left"): None}
    assert s["defaults"].first().default_size == 10.0

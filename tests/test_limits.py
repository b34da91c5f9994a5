"""Bad files among good ones, and values beyond the usual ranges."""

import io
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from leafline.operators.admission import docx_admission
from leafline.operators.word import list_numbers, resolve_rels, resolve_table_styles
from leafline.runtime import cut_lineage
from leafline.sources.docx import docx_manifest, read_docx_corpus
from leafline.sources.items import flatten_outline
from leafline.streaming.intake import start_intake


def archive(parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


def test_every_word_file_has_an_outcome(spark):
    body = '<w:document xmlns:w="urn:w"><w:body><w:p><w:r><w:t>kept</w:t></w:r></w:p></w:body></w:document>'
    good = archive({"word/document.xml": body, "word/media/a.png": "pixels"})
    at = good.index(b"pixels")
    files = {
        1: good, 2: b"no archive at all", 3: good[:at] + b"PIXELS" + good[at + 6 :], 4: archive({"word/document.xml": "<w:document"}),
        5: archive({"word/other.xml": body}), 6: archive({f"word/{i}.xml": "x" for i in range(2001)}), 7: archive({"word/document.xml": body, "big.bin": "0" * (33 << 20)}), 8: archive({}), 9: good,
    }
    df = spark.createDataFrame(list(files.items()), "doc_id bigint, content binary").repartition(3)
    read = read_docx_corpus(df)
    want = {2: "not_an_archive", 3: "damaged", 4: "not_xml", 5: "no_document", 6: "too_many_parts", 7: "too_large", 8: "not_an_archive"}
    assert {r.doc_id: r.error for r in read["outcomes"].where("NOT ok").collect()} == want
    assert sorted(r.doc_id for r in read["outcomes"].where("ok").collect()) == [1, 9]
    assert sorted((r.doc_id, r.text) for r in read["pieces"].collect()) == [(1, "kept"), (9, "kept")]
    judged = {r.doc_id: r.error for r in docx_admission(docx_manifest(df)).where("NOT ok").collect()}
    assert judged == {k: v for k, v in want.items() if k not in (4, 5)}


def test_list_levels_have_no_limit(spark):
    items = spark.createDataFrame([(1, i, "n", level) for i, level in enumerate([9, 0, 9, 9, 12, 9, 12])], "doc_id int, para_no int, num_id string, ilvl int")
    numbering = spark.createDataFrame([(1, "n", "a")], "doc_id int, num_id string, abs_id string")
    levels = spark.createDataFrame([(1, "a", level, "decimal") for level in (0, 9, 12)], "doc_id int, abs_id string, ilvl int, fmt string")
    got = [r.prefix for r in list_numbers(items, numbering, levels).orderBy("para_no").collect()]
    assert got == ["1. ", "1. ", "1. ", "2. ", "1. ", "3. ", "1. "]


def test_parts_that_differ_in_case_give_one_row(spark):
    refs = spark.createDataFrame([(1, 0, "r")], "doc_id int, ref_no int, rel_id string")
    rels = spark.createDataFrame([(1, "r", "media/dot.png", False)], "doc_id int, rel_id string, target string, external boolean")
    parts = spark.createDataFrame([(1, "word/media/dot.png"), (1, "word/Media/Dot.png")], "doc_id int, part_name string")
    assert [r.part_name for r in resolve_rels(refs, rels, parts).collect()] == ["word/Media/Dot.png"]


def test_outline_order_follows_any_number(spark):
    orders = [10_000_000_000_001, -5, 2_000_000_000_000, 2**63 - 1, -(2**63)]
    rows = [(1, f"n{i}", None, v, f"t{v}", 0) for i, v in enumerate(orders)]
    df = spark.createDataFrame(rows, "doc_id int, node_id string, parent_id string, ord bigint, title string, page_index int")
    assert [r.title for r in flatten_outline(df).orderBy("position").collect()] == [f"t{v}" for v in sorted(orders)]


def test_a_lost_library_version_fails_the_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    files = "lib_id bigint, batch_id bigint, file_no bigint, name string, mime string, size bigint, created_at bigint"

    def send(name):
        spark.createDataFrame([(1, 0, 0, name, "application/pdf", 5, 9)], files).write.mode("append").parquet(f"{folder}/in")
        query = start_intake(spark.readStream.schema(files).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", availableNow=True)
        query.awaitTermination()

    send("a.pdf")
    assert spark.read.parquet(f"{folder}/out/epoch=0").count() == 1
    spark.read.parquet(f"{folder}/out/epoch=0").write.parquet(f"{folder}/moved")
    import os

    os.rename(f"{folder}/out/epoch=0", f"{folder}/elsewhere")
    with pytest.raises(Exception, match="epoch=0"):
        send("b.pdf")


def test_deep_outlines_orphans_and_circles(spark):
    n = 3000
    rows = [(1, f"d{i}", f"d{i - 1}" if i else None, 0, "t", 0) for i in range(n)]  # a chain
    rows += [(2, "r", None, 1, "t", 0), (2, "b", "r", 5, "t", 0), (2, "a", "r", 5, "t", 0), (2, "c", "a", 1, "t", None), (2, "d", "c", 1, " x ", 3), (2, "q", None, 9, "t", 0)]
    rows += [(2, "lost", "nobody", 0, "t", 0), (2, "under", "lost", 0, "t", 0), (2, "x", "y", 0, "t", 0), (2, "y", "x", 0, "t", 0)]
    df = spark.createDataFrame(rows, "doc_id int, node_id string, parent_id string, ord bigint, title string, page_index int").repartition(4)
    got = {(r.doc_id, r.node_id): (r.position, r.depth, r.title) for r in flatten_outline(df).collect()}
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, "r"): (0, 0, "t"), (2, "a"): (1, 1, "t"), (2, "d"): (3, 3, "x"), (2, "b"): (4, 1, "t"), (2, "q"): (5, 0, "t")}
    assert all(got[(1, f"d{i}")][:2] == (i, min(3, i)) for i in range(n)) and len(got) == n + 5
    assert flatten_outline(df.limit(0)).count() == 0


def test_table_styles_in_long_chains_and_circles(spark):
    n = 200
    styles = [(1, i, i + 1 if i + 1 < n else None) for i in range(n)] + [(2, 0, 1), (2, 1, 2), (2, 2, 1), (3, 0, 7)]
    edges = [(1, n - 1, "top", "far"), (1, 50, "top", None), (1, 60, "left", "x"), (2, 2, "top", "c"), (2, 0, "left", "own"), (3, 7, "top", "not a style")]
    got = resolve_table_styles(
        spark.createDataFrame(styles, "doc_id int, style_id int, based_on int"), spark.createDataFrame(edges, "doc_id int, style_id int, side string, edge string")
    ).collect()
    got = {(r.doc_id, r.style_id, r.side): r.edge for r in got}
    want = {(1, i, "top"): None if i <= 50 else "far" for i in range(n)} | {(1, i, "left"): "x" for i in range(61)}
    want |= {(2, 0, "left"): "own", (2, 0, "top"): "c", (2, 1, "top"): "c", (2, 2, "top"): "c", (3, 0, "top"): "not a style"}
    assert got == want


def test_wide_outlines_are_not_read_once_for_every_doubling(spark, monkeypatch):
    kept = []

    def counted(df):
        cut = cut_lineage(df)
        kept.append(cut.count())
        return cut

    monkeypatch.setattr("leafline.sources.items.cut_lineage", counted)
    n = 2000
    rows = [(1, "r", None, 0, "t", 0)] + [(1, f"a{i:04}", "r", i, "t", 0) for i in range(40)] + [(1, f"b{i:04}", f"a{i % 40:04}", i, "t", 0) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id int, node_id string, parent_id string, ord bigint, title string, page_index int").repartition(4)
    got = [r.node_id for r in flatten_outline(df).orderBy("position").collect()]
    assert got == ["r"] + [v for i in range(40) for v in [f"a{i:04}"] + [f"b{j:04}" for j in range(i, n, 40)]]
    assert sum(kept) < 4 * len(rows)

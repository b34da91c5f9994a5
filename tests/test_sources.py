"""File sources and sinks, NFKC names, and the lineage helper."""

import tempfile

from pyspark.sql import functions as F

from leafline.functions.files import sanitize_filename
from leafline.functions.text import list_marker, normalize_font
from leafline.runtime import cut_lineage
from leafline.sources.items import result_columns, scan_files, write_result


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_scan_files_sniffs_bytes_first(spark):
    path = folder()
    for name, head in {"a.bin": b"\xff\xd8\xff\x00", "b.jpg": b"\x89PNG\r\n\x1a\n", "c.png": b"%PDF", "d.txt": b"RIFF\0\0\0\0WEBP"}.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(head)
    got = {r["name"]: (r.kind, r.mime, r.size) for r in scan_files(spark, path).collect()}
    assert got == {
        "a.bin": ("jpg", "application/octet-stream", 4), "b.jpg": ("png", "image/jpeg", 8), "c.png": ("png", "image/png", 4),
        "d.txt": ("webp", "text/plain", 12),
    }


def test_write_result_is_bucketed(spark):
    path = folder()
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    write_result(result_columns(df, F.col("doc_id") % 2 == 0, F.lit("was Encrypted"), buckets=8), f"{path}/out")
    back = spark.read.parquet(f"{path}/out")
    assert back.where("doc_bucket = 3").count() == 25
    assert {r.error for r in back.where("NOT ok").collect()} == {"encrypted"}


def test_names_are_normalised(spark):
    cases = {"ｆｉｌｅ．pdf": "file.pdf", "a/b\\c\x01\x02d?.pdf": "c_d_.pdf", " .. ": "export", "x" * 130 + ".docx": "x" * 115 + ".docx", "‮name": "_name"}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", sanitize_filename(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == cases


def test_markers_and_fonts(spark):
    cases = {"1. a": ("number", 3, 1), " 12)  b": ("number", 6, 12), "• c": ("bullet", 2, None), "– d": ("bullet", 2, None), "1234. e": None, "-f": None, "plain": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", list_marker(F.col("t")).alias("m"))
    assert {r.t: None if r.m is None else tuple(r.m) for r in df.collect()} == cases
    fonts = {"ABCDEF+Helvetica, x": "Arial", "sans-serif": "Arial", "Noto Serif": "Times New Roman", "'Courier'": "Courier New", "": "Arial", "Cambria": "Cambria"}
    df = spark.createDataFrame([(k,) for k in fonts], "t string").select("t", normalize_font(F.col("t")).alias("f"))
    assert {r.t: r.f for r in df.collect()} == fonts


def test_cut_lineage_keeps_rows(spark):
    assert cut_lineage(spark.range(10)).count() == 10

"""Budgets, routing and freshness rules as data (F5 to F9, S5, S7, R5 batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions.files import extension_for_mime, filename_stem, normalize_mime, sanitize_filename

MIB = 1024 * 1024
MAX_FILES = 200
MAX_INPUT = 128 * MIB
MAX_ARCHIVE = 64 * MIB
HOUR_MS = 3_600_000
# limits of a Word file: entries, bytes of one part, bytes of all parts
MAX_ENTRIES = 2000
MAX_PART = 32 * MIB
MAX_TOTAL = 128 * MIB


def _verdict(error: Column) -> tuple[Column, Column]:
    return error.isNull().alias("ok"), error.alias("error")


def docx_admission(entries: DataFrame, max_entries: int = MAX_ENTRIES, max_part: int = MAX_PART, max_total: int = MAX_TOTAL) -> DataFrame:
    """Ok and error per archive from its manifest.

    ``entries`` is (doc_id, entry_no, size, damaged); a file whose directory
    could not be found has one row with NULL ``entry_no``.
    """
    a = entries.groupBy("doc_id").agg(
        F.count("entry_no").alias("parts"), F.max("size").alias("_largest"), F.sum("size").alias("expanded"),
        F.max("damaged").alias("_damaged"),
    )
    error = (
        F.when(F.col("parts") == 0, "not_an_archive")
        .when(F.col("parts") > max_entries, "too_many_parts")
        .when(F.coalesce(F.col("_damaged"), F.lit(False)), "damaged")
        .when(
            (F.col("_largest") > max_part) | (F.col("expanded") > max_total),
            "too_large",
        )
    )
    return a.select("doc_id", "parts", "expanded", *_verdict(error))


def input_budget(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_INPUT) -> DataFrame:
    """ok and error per batch of picked files."""
    b = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    error = F.when(
        (F.col("files") > max_files) | (F.col("bytes") > max_bytes),
        "over_budget",
    )
    return b.select("batch_id", "files", "bytes", *_verdict(error))


def scan_budget(pages: DataFrame, max_pages: int, max_bytes: int = MAX_INPUT) -> DataFrame:
    """budget of scanned batches; a kept original counts when it is another object.

    ``pages`` is (batch_id, size, original_size, original_distinct).
    """
    kept = F.when(F.coalesce("original_distinct", F.lit(False)), F.coalesce("original_size", F.lit(0))).otherwise(0)
    b = pages.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.col("size") + kept).alias("bytes"),
        F.count_if(F.col("size") <= 0).alias("_empty"),
    )
    error = F.when(F.col("_empty") > 0, "empty_page").when(
        (F.col("files") > max_pages) | (F.col("bytes") > max_bytes),
        "over_budget",
    )
    return b.select("batch_id", "files", "bytes", *_verdict(error))


def append_pages(pages: DataFrame, incoming: DataFrame, max_pages: int) -> DataFrame:
    """verdict on pages plus incoming ones."""
    return scan_budget(pages.unionByName(incoming), max_pages)


def replace_pages(pages: DataFrame, replacements: DataFrame, max_pages: int) -> DataFrame:
    """verdict after pages with the same (batch_id, page_no) are replaced."""
    kept = pages.join(replacements.select("batch_id", "page_no"), ["batch_id", "page_no"], "left_anti")
    return scan_budget(kept.unionByName(replacements), max_pages)


def input_kind_check(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_INPUT) -> DataFrame:
    """a batch is exactly one PDF, or images only."""
    is_pdf = (F.col("mime") == "application/pdf") | F.col("name").rlike("(?i)\\.pdf$")
    is_image = normalize_mime(F.col("name"), F.col("mime")).startswith("image/")
    b = files.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(is_pdf).alias("pdfs"),
        F.count_if(is_image).alias("images"),
    )
    error = (
        F.when(
            (F.col("files") > max_files) | (F.col("bytes") > max_bytes),
            "over_budget",
        )
        .when(
            (F.col("pdfs") > 0) & (F.col("files") != 1),
            "mixed_kinds",
        )
        .when((F.col("pdfs") == 0) & (F.col("images") < F.col("files")), "unsupported_kind")
    )
    return b.select("batch_id", "files", "pdfs", "images", *_verdict(error))


def stale_exports(entries: DataFrame, now_ms: Column, max_age_ms: int = HOUR_MS) -> DataFrame:
    """F8: directories older than the limit whose name is a safe id."""
    return entries.where(
        (F.col("type") == "directory")
        & (F.col("mtime") < now_ms - max_age_ms)
        & F.col("name").rlike("(?i)^[a-z0-9-]+$")
    )


def drop_stale(results: DataFrame, limit_ms: int = 150) -> DataFrame:
    """results of the current generation shown within the limit.

    ``results`` is (started, shown_at, generation, current_generation).
    """
    return results.where(
        (F.col("generation") == F.col("current_generation")) & (F.col("shown_at") - F.col("started") <= limit_ms)
    )


def latest_only(results: DataFrame, keys: tuple[str, ...] = ("source_id",), order: str = "started", tie: str = "seq") -> DataFrame:
    """Newest result per key; partial maxima before the shuffle."""
    rest = [c for c in results.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(order, tie))
    return results.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def export_manifest(exports: DataFrame, ascii_only: bool = False) -> DataFrame:
    """File name of every exported image, archive name, and the verdict per document.

    ``exports`` is (doc_id, ord, basename, mime, size) with dense 0-based ``ord``.
    """
    totals = exports.groupBy("doc_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    e = exports.join(totals, "doc_id")
    mime = normalize_mime(F.lit(""), F.when(F.coalesce("mime", F.lit("")) == "", "image/jpeg").otherwise(F.col("mime")))
    number = (F.col("ord") + 1).cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    e = e.withColumn("_stem", filename_stem(F.col("basename"), "page", ascii_only))
    name = sanitize_filename(
        F.concat("_stem", F.lit("-"), padded, F.lit("."), extension_for_mime(mime)), ascii_only=True
    )
    many = F.col("files") > 1
    error = F.when(many & (F.col("files") > MAX_FILES), "too many files").when(
        many & (F.col("bytes") > MAX_ARCHIVE), "too large"
    )
    archive = F.when(many, F.concat(filename_stem(F.col("basename"), "pages", ascii_only), F.lit(".zip")))
    return e.select("doc_id", "ord", name.alias("filename"), archive.alias("archive"), "files", "bytes", *_verdict(error))


# What each finding means, and the pattern in the document part that shows it.
DOCX_FINDINGS = {
    "notes": "<w:(?:footnoteReference|endnoteReference)\\b",
    "floating": "<(?:w:txbxContent|wp:anchor)\\b",
    "charts": "<c:chart\\b",
    "tracked": "<w:(?:ins|del|moveFrom|moveTo)\\b",
}


def docx_warnings(parts: DataFrame) -> DataFrame:
    """(doc_id, warning) from part names and the text of the document part.

    ``parts`` is (doc_id, part_name, xml). The patterns run in the scan and
    only five flags per part are shuffled.
    """
    is_main = F.lower("part_name") == "word/document.xml"
    flags = {k: F.coalesce(is_main & F.col("xml").rlike(p), F.lit(False)) for k, p in DOCX_FINDINGS.items()}
    flags["headers"] = F.col("part_name").rlike("^word/(header|footer)[0-9]*\\.xml$")
    f = parts.select("doc_id", *[c.alias(k) for k, c in flags.items()])
    per_doc = f.groupBy("doc_id").agg(*[F.max(k).alias(k) for k in flags])
    found = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in flags]))
    return per_doc.select("doc_id", F.explode(found).alias("warning"))

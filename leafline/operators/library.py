"""Document library: retention, replay, migration, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.files import DOCX

MAX_ITEMS = 200
MAX_BYTES = 512 * 1024 * 1024

# Ids of the document tools.
TOOLS = (
    "merge", "split", "images", "pdf-images", "compress", "scan", "organize", "watermark", "numbers",
    "protect", "view", "docx-pdf", "pdf-docx",
)


def retain_library(log: DataFrame, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of an append-only log that each library still holds.

    ``log`` is (lib_id, seq, created_at, size, stored, ...). What stays is the
    newest run of rows within both limits. The row limit comes first, as a rank
    filter, so Spark cuts every library to that many rows per task before the
    shuffle and the running sum sees no more than ``max_items`` rows.
    """
    bytes_ = F.when(F.col("stored"), F.col("size")).otherwise(0)
    newest = Window.partitionBy("lib_id").orderBy(F.desc("created_at"), F.desc("seq"))
    recent = (
        log.where(bytes_ <= max_bytes)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= max_items)
    )
    running = F.sum(bytes_).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return recent.withColumn("_bytes", running).where(F.col("_bytes") <= max_bytes).drop("_rank", "_bytes")


def library_state(log: DataFrame) -> DataFrame:
    """Live rows after save, rename, delete and clear operations.

    ``log`` is (lib_id, seq, op, item_id, name, mime, tool, created_at, size).
    Every item's operations combine before the shuffle; clears are one small
    row per library.
    """
    def at(kind: str) -> Column:
        return F.col("op") == kind

    items = log.where(F.col("op") != "clear").groupBy("lib_id", "item_id").agg(
        F.max(F.when(at("save"), F.struct("seq", "name", "mime", "tool", "created_at", "size"))).alias("_save"),
        F.max(F.when(at("rename"), F.struct("seq", "name"))).alias("_rename"),
        F.max(F.when(at("delete"), F.col("seq"))).alias("_deleted"),
    )
    cleared = log.where(at("clear")).groupBy("lib_id").agg(F.max("seq").alias("_cleared"))
    saved = F.col("_save.seq")
    live = (
        items.where(F.col("_save").isNotNull())
        .where(F.coalesce(F.col("_deleted") < saved, F.lit(True)))
        .join(cleared, "lib_id", "left")
        .where(F.coalesce(F.col("_cleared") < saved, F.lit(True)))
    )
    name = F.when(F.col("_rename.seq") > saved, F.col("_rename.name")).otherwise(F.col("_save.name"))
    return live.select(
        "lib_id", "item_id", name.alias("name"), F.col("_save.mime").alias("mime"), F.col("_save.tool").alias("tool"),
        F.col("_save.created_at").alias("created_at"), F.col("_save.size").alias("size"),
    )


def list_recents(library: DataFrame) -> DataFrame:
    """Metadata of every library, newest first; the content column is never read."""
    return library.drop("content").orderBy("lib_id", F.desc("created_at"), F.desc("item_id"))


def name_search(library: DataFrame, text: str) -> DataFrame:
    """rows whose name contains the text, any case."""
    return library.where(F.contains(F.lower("name"), F.lit(text.lower())))


def migrate_library(legacy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata, contents) of legacy rows; unknown tools and missing ids are dropped."""
    valid = legacy.where(F.col("item_id").isNotNull() & F.col("tool").isin(*TOOLS))
    has_bytes = F.coalesce(F.length("content") > 0, F.lit(False))
    mime = F.when(F.coalesce("mime", F.lit("")) != "", F.col("mime")).otherwise(
        F.when(F.col("name").endswith(".docx"), DOCX).otherwise("application/pdf")
    )
    meta = valid.select(
        "lib_id", "item_id", "name", mime.alias("mime"), "tool", "created_at", "size", has_bytes.alias("stored")
    )
    return meta, valid.where(has_bytes).select("lib_id", "item_id", "content")

"""Embedded images, histograms and shape candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import js_round
from leafline.runtime import cut_lineage

# Target resolution of each compression level, in dots per inch.
LEVEL_DPI = {"keep": 200, "balanced": 150}

SAMPLES = 40_000
MIN_COLOURS = 96
BROADCAST = 1 << 16  # counted groups up to which their steps are broadcast


def exclude_masks(images: DataFrame) -> DataFrame:
    """Images that no other image of the document uses as a mask.

    ``images`` is (doc_id, obj_id, mask_ref, ...).
    """
    masks = images.where(F.col("mask_ref").isNotNull()).select("doc_id", F.col("mask_ref").alias("obj_id"))
    return images.join(masks, ["doc_id", "obj_id"], "left_anti")


def recompress_candidates(
    images: DataFrame, doc_pages: DataFrame, level: str = "balanced",
    least_pixels: int = 160 * 160, most_jpeg: int = 120_000_000, most_raw: int = 40_000_000, most_target: int = 50_000_000,
) -> DataFrame:
    """images worth re-encoding, with their target size.

    The rule leaves out images of fewer or more pixels than the parameters say.

    ``images`` also has width, height, filter (DCT, Flate, ...), bytes,
    components, stencil, few_colours. Page size enters as one row per document.
    """
    dpi = LEVEL_DPI[level]
    sides = doc_pages.groupBy("doc_id").agg(F.max(F.greatest("width", "height")).alias("_side"))
    largest = F.greatest(F.lit(1.0), F.coalesce("_side", F.lit(1.0)))
    i = exclude_masks(images).where(~F.col("stencil") & F.col("components").isin(1, 3) & F.col("filter").isin("DCT", "Flate"))
    pixels = F.col("width").cast("double") * F.col("height")
    jpeg = F.col("filter") == "DCT"
    i = i.where((pixels >= least_pixels) & (pixels <= F.when(jpeg, most_jpeg).otherwise(most_raw)))
    i = i.join(sides, "doc_id", "left").withColumn("_max", F.greatest(F.lit(256), js_round(largest / 72 * dpi)))
    i = i.withColumn(
        "scale",
        F.least(
            F.lit(1.0), F.col("_max") / F.greatest("width", "height"), F.sqrt(F.lit(float(most_target)) / pixels)
        ),
    )
    thrifty = jpeg & (F.col("scale") > 0.9) & (F.col("bytes") / pixels < 0.5)
    flat = ~jpeg & F.coalesce("few_colours", F.lit(False))
    return i.where(~thrifty & ~flat).select(
        "doc_id", "obj_id", "scale",
        F.greatest(F.lit(1), js_round(F.col("width") * F.col("scale"))).cast("long").alias("target_width"),
        F.greatest(F.lit(1), js_round(F.col("height") * F.col("scale"))).cast("long").alias("target_height"),
    )


def otsu_threshold(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Threshold per group over integer values 0 to 255; NULL when there is no split.

    The histogram combines before the shuffle, so what is ordered per group is
    at most 256 rows.
    """
    group = list(group)
    h = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.col("_n") * F.col(value)
    h = h.withColumns(
        {
            "_c": F.sum("_n").over(upto), "_l": F.sum(weight).over(upto),
            "_all": F.sum("_n").over(whole), "_sum": F.sum(weight).over(whole),
        }
    )
    low, high = F.col("_l") / F.col("_c"), (F.col("_sum") - F.col("_l")) / (F.col("_all") - F.col("_c"))
    score = F.when(
        (F.col("_c") < F.col("_all")) & (F.col(value) < 255),
        F.col("_c").cast("double") * (F.col("_all") - F.col("_c")) * (low - high) * (low - high),
    )
    best = F.max_by(F.struct(score.alias("s"), F.col(value).alias("v")), F.struct(score, -F.col(value)))
    return h.groupBy(*group).agg(best.alias("_b")).select(
        *group, F.when(F.col("_b.s") > 0, F.col("_b.v")).cast("int").alias("threshold")
    )


def few_distinct(df: DataFrame, group: Sequence[str], value: str, ord_: str) -> DataFrame:
    """A10: does a systematic sample of the group hold under 96 distinct values?

    ``ord_`` is a dense 0-based index in the group. Rows are counted by group
    and value before their shuffle; that decides every group that is sampled
    whole. Only the rows of longer groups are read again for their sample.
    """
    group = list(group)
    values = cut_lineage(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_rows")))
    found = values.groupBy(*group).agg(F.sum("_rows").alias("_n"), F.count(F.lit(1)).alias("colours"))
    step = F.floor(F.col("_n") / SAMPLES).cast("int")
    whole = found.where(step <= 1).select(*group, "colours")
    keys = [f"_{c}" for c in group]
    longer = found.where(step > 1).select(*[F.col(c).alias(k) for c, k in zip(group, keys)], step.alias("_step"))
    few = longer.count()
    if few:
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(group, keys)])
        sampled = df.select(*group, value, ord_).join(F.broadcast(longer) if few <= BROADCAST else longer, same)
        sampled = sampled.where(F.col(ord_) % F.col("_step") == 0).select(*group, value).distinct()
        whole = whole.unionByName(sampled.groupBy(*group).agg(F.count(F.lit(1)).alias("colours")))
    return whole.select(*group, (F.col("colours") < MIN_COLOURS).alias("few_colours"))


def keep_smaller_images(candidates: DataFrame, gain: float = 0.9) -> DataFrame:
    """Per image, ``replaced`` when the new stream is below ``gain`` of the old one."""
    return candidates.withColumn("replaced", F.col("new_bytes") < F.col("bytes") * gain)


def compression_report(results: DataFrame) -> DataFrame:
    """One row per document from (doc_id, original_bytes, output_bytes) and its images.

    ``results`` has images_recompressed per document.
    """
    retained = F.col("output_bytes") >= F.col("original_bytes")
    count = F.coalesce("images_recompressed", F.lit(0))
    return results.select(
        "doc_id", "original_bytes",
        F.when(retained, F.col("original_bytes")).otherwise(F.col("output_bytes")).alias("output_bytes"),
        F.when(count > 0, "images").otherwise("lossless").alias("mode"),
        retained.alias("original_retained"), count.alias("images_recompressed"),
    )


def best_candidate(candidates: DataFrame, largest: int = 16) -> DataFrame:
    """Best shape of each frame.

    ``candidates`` is (frame_id, cand_no, area, points, plausible, support,
    contrast). Only the ``largest`` shapes of a frame are judged, which is the
    rule and not a saving; they are cut by rank, which Spark limits per task
    before the shuffle.
    """
    by_area = Window.partitionBy("frame_id").orderBy(F.desc("area"), F.asc("cand_no"))
    top = (
        candidates.where(F.col("area").between(0.12, 0.93))
        .withColumn("_rank", F.row_number().over(by_area))
        .where(F.col("_rank") <= largest)
        .where((F.col("points") == 4) & F.col("plausible") & (F.col("support") >= 0.55))
    )
    score = F.col("support") * 0.62 + F.sqrt("area") * 0.18 + F.col("contrast") * 0.20
    best = F.max_by(F.struct("cand_no", score.alias("score")), F.struct(score, -F.col("_rank")))
    return top.groupBy("frame_id").agg(best.alias("_b")).select("frame_id", "_b.cand_no", "_b.score")

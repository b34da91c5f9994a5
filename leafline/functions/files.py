"""Column functions over file names, MIME types and tool routing."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.functions.text import let, trim_all

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"

# MIME type of each known extension; the first extension of a type is its own.
MIME_BY_EXTENSION = {
    "pdf": "application/pdf",
    "docx": DOCX,
    "doc": "application/msword",
    "zip": "application/zip",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
    "avif": "image/avif",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "tiff": "image/tiff",
    "tif": "image/tiff",
    "heic": "image/heic",
    "heif": "image/heif",
    "svg": "image/svg+xml",
    "txt": "text/plain",
}
UNKNOWN = "application/octet-stream"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def mime_from_name(name: Column) -> Column:
    """MIME type by extension, any case."""
    extension = F.regexp_extract(F.lower(name), "\\.([a-z]+)$", 1)
    return F.coalesce(_literal_map(MIME_BY_EXTENSION)[extension], F.lit(UNKNOWN))


def normalize_mime(name: Column, mime: Column) -> Column:
    """Supplied type cleaned, or the one of the extension when it says nothing."""
    supplied = F.lower(trim_all(F.coalesce(mime, F.lit(""))))
    return (
        F.when(supplied == "image/jpg", "image/jpeg")
        .when(supplied == "application/x-zip-compressed", "application/zip")
        .when((supplied != "") & (supplied != UNKNOWN), supplied)
        .otherwise(mime_from_name(name))
    )


def extension_for_mime(mime: Column) -> Column:
    """Extension of a type, ``bin`` when unknown."""
    inverse: dict[str, str] = {}
    for extension, kind in MIME_BY_EXTENSION.items():
        inverse.setdefault(kind, extension)
    return F.coalesce(_literal_map(inverse)[normalize_mime(F.lit(""), mime)], F.lit("bin"))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _clean_leaf(leaf: Column, fallback: Column) -> Column:
    cleaned = F.regexp_replace(leaf, "[\\x00-\\x1F\\x7F-\\x9F]+", "_")
    cleaned = F.regexp_replace(cleaned, "\\p{Cf}+", "_")
    cleaned = F.regexp_replace(cleaned, '[<>:"/\\\\|?*]+', "_")
    cleaned = trim_all(F.regexp_replace(cleaned, "[. ]+$", ""))
    safe = let(cleaned, lambda c: F.when(c.isin("", ".", ".."), fallback).otherwise(c))

    def capped(s, extension):
        plain_cut = (extension == "") | (F.length(extension) == F.length(s)) | (F.length(extension) > 16)
        short = F.concat(F.substring(s, F.lit(1), F.greatest(F.lit(1), F.lit(120) - F.length(extension))), extension)
        return F.when(F.length(s) <= 120, s).when(plain_cut, F.substring(s, 1, 120)).otherwise(short)

    return let(safe, lambda s: let(F.regexp_extract(s, "(\\.[^.]*)$", 1), lambda e: capped(s, e)))


def leaf_name(name: Column) -> Column:
    """Part after the last slash or backslash."""
    return F.regexp_extract(name, "([^/\\\\]*)$", 1)


def sanitize_filename(name: Column, fallback: str = "export", ascii_only: bool = False) -> Column:
    """Safe file name of at most 120 characters.

    Spark has no NFKC, so names that hold non-ASCII characters pass through one
    Arrow function; ASCII names are already in that form. ``ascii_only`` leaves
    the function out of the plan where the caller knows there are none.
    """
    leaf = leaf_name(name)
    if not ascii_only:
        plain = ~leaf.rlike("[^\\x00-\\x7F]")
        leaf = F.when(plain, leaf).otherwise(_nfkc(F.when(~plain, leaf)))
    return _clean_leaf(leaf, F.lit(fallback))


def filename_stem(name: Column, fallback: str, ascii_only: bool = False) -> Column:
    """Safe name without its extension."""
    stem = F.regexp_replace(sanitize_filename(name, fallback, ascii_only), "\\.[^.]+$", "")
    return let(stem, lambda s: F.when(s == "", F.lit(fallback)).otherwise(s))


def swap_extension(name: Column, old: str, new: str) -> Column:
    """Base name with ``old`` replaced by ``new``; ``document`` when nothing is left."""
    stem = trim_all(F.regexp_replace(leaf_name(name), f"(?i)\\.{old}$", ""))
    return F.concat(F.when(stem == "", F.lit("document")).otherwise(stem), F.lit(f".{new}"))


_IMAGE_NAME = "(?i)\\.(png|jpe?g|webp|gif|bmp)$"


def route_tool(name: Column, mime: Column) -> Column:
    """Tool that opens an incoming file."""
    return (
        F.when(mime.startswith("image/") | name.rlike(_IMAGE_NAME), "scan")
        .when(mime.contains("wordprocessingml") | F.lower(name).endswith(".docx"), "docx-pdf")
        .otherwise("view")
    )


def default_mime(name: Column, mime: Column) -> Column:
    """Given type, or one by the name."""
    return (
        F.when(F.coalesce(mime, F.lit("")) != "", mime)
        .when(F.lower(name).endswith(".docx"), DOCX)
        .when(name.rlike(_IMAGE_NAME), "image/jpeg")
        .otherwise("application/pdf")
    )


def image_kind(content: Column, name: Column, mime: Column) -> Column:
    """Jpg, png, webp or other, by leading bytes, else type, else extension."""
    lower_name, lower_mime = F.lower(name), F.lower(F.coalesce(mime, F.lit("")))

    def bytes_at(first, n):
        return F.hex(F.substring(content, first, n))

    return (
        F.when(bytes_at(1, 3) == "FFD8FF", "jpg")
        .when((F.length(content) >= 8) & (bytes_at(1, 4) == "89504E47"), "png")
        .when((F.length(content) >= 12) & (bytes_at(1, 4) == "52494646") & (bytes_at(9, 4) == "57454250"), "webp")
        .when(
            lower_mime.isin("image/jpeg", "image/jpg") | lower_name.endswith(".jpg") | lower_name.endswith(".jpeg"), "jpg"
        )
        .when((lower_mime == "image/png") | lower_name.endswith(".png"), "png")
        .when((lower_mime == "image/webp") | lower_name.endswith(".webp"), "webp")
        .otherwise("other")
    )

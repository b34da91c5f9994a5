"""Text search over pages (Q1 to Q4, F1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions.text import WHITE, occurrences, trim_all, words_of
from leafline.operators.lines import PAGE


def page_text(glyphs: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Q1: items of a page in stream order, joined by a space, white space collapsed."""
    items = F.sort_array(F.collect_list(F.struct("glyph_no", "str")))
    joined = F.array_join(F.transform(items, lambda s: s["str"]), " ")
    return glyphs.where(F.col("str") != "").groupBy(*keys).agg(
        trim_all(F.regexp_replace(joined, f"[{WHITE}]+", " ")).alias("text")
    )


def _needle(text: str) -> str:
    return text.strip().lower()


def search_pages(pages: DataFrame, text: str, keys: Sequence[str] = PAGE) -> DataFrame:
    """Q2: hits per page for a query of two or more characters; a scan and a filter, no shuffle."""
    needle = _needle(text)
    if len(needle) < 2:
        return pages.select(*keys, F.lit(0).cast("long").alias("hits")).where(F.lit(False))
    hits = occurrences(F.lower("text"), F.lit(needle))
    return pages.select(*keys, hits.alias("hits")).where(F.col("hits") > 0)


def search_totals(hits: DataFrame) -> DataFrame:
    """Q3: matches and matching pages per document."""
    return hits.groupBy("doc_id").agg(F.sum("hits").alias("matches"), F.count(F.lit(1)).alias("pages"))


def mark_items(glyphs: DataFrame, text: str) -> DataFrame:
    """Q4: glyphs with ``is_hit``."""
    needle = _needle(text)
    hit = F.contains(F.lower("str"), F.lit(needle)) if len(needle) >= 2 else F.lit(False)
    return glyphs.withColumn("is_hit", hit)


def _starts_with(word: str):
    return lambda h: h.startswith(word)


def matches_query(columns: Sequence[Column], text: str) -> Column:
    """every word of the query equals or starts some word of the columns."""
    import re

    # \w minus the underscore is letters and digits, the classes words_of splits on.
    wanted = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    if not wanted:
        return F.lit(True)
    hay = words_of(F.concat_ws(" ", *columns))
    condition = F.lit(True)
    for word in wanted:
        condition = condition & F.exists(hay, _starts_with(word))
    return condition


def prefix_search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """rows that match the query by word prefixes."""
    return df.where(matches_query([F.col(c) for c in columns], text))

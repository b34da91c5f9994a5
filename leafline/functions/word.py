"""Column functions over word-processing properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    """Value limited to [low, high]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def heading_from_name(name: Column) -> Column:
    """Heading level 1 to 3 of a style name or id; NULL otherwise."""
    v = F.regexp_replace(F.lower(F.trim(name)), "[_-]+", " ")
    digit = F.regexp_extract(v, "heading\\s*([0-9])", 1)
    return (
        F.when(v.isin("title", "heading 1", "heading1"), 1)
        .when(v.isin("subtitle", "heading 2", "heading2"), 2)
        .when(v.isin("heading 3", "heading3"), 3)
        .when(digit.isin("1", "2", "3"), digit.cast("int"))
    )


def heading_from_outline(level: Column) -> Column:
    """Outline levels 0 to 2 are headings 1 to 3."""
    return F.when(level.isin(0, 1, 2), level + 1)


def heading_level(style_name: Column, style_id: Column, outline: Column) -> Column:
    """By style name, else style id, else outline level."""
    return F.coalesce(heading_from_name(style_name), heading_from_name(style_id), heading_from_outline(outline))


def heading_size(level: Column) -> Column:
    """Point size of a heading."""
    return F.when(level == 1, 18.0).when(level == 2, 14.0).when(level.isNotNull(), 12.0)


def resolve_size(run: Column, para: Column, heading: Column) -> Column:
    """Run size floored at the heading size, or limited to body sizes."""
    floor = heading_size(heading)
    return F.when(
        heading.isNotNull(), F.when(run.isNull(), floor).otherwise(clamp(F.greatest(run, floor), 8.0, 36.0))
    ).otherwise(F.when(run.isNull(), para).otherwise(clamp(run, 8.0, 28.0)))


def on_off(present: Column, value: Column) -> Column:
    """A flag element is true unless its value says 0, false or off; NULL when absent."""
    return F.when(present, ~F.coalesce(F.lower(value).isin("0", "false", "off"), F.lit(False)))


def twips(value: Column) -> Column:
    """Twentieths of a point to points; NULL for blanks and non-numbers."""
    return F.try_divide(value.try_cast("double"), F.lit(20.0))

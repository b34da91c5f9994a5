"""Column functions over text: cleaning, fonts, list markers, code-point mapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript treats as white space.
WHITE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"

# Code points of the Windows-1252 block 0x80-0x9F.
CP1252_EXTRA = (
    "ŒœŠšŸŽžƒˆ˜–—‘’"
    "‚“”„†‡•…‰‹›€™"
)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def js_round(value: Column) -> Column:
    """Half-up rounding, including negative halves."""
    return F.floor(value + F.lit(0.5))


def trim_all(text: Column) -> Column:
    """Strip every kind of Unicode white space at both ends."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def strip_white(text: Column) -> Column:
    """Remove every white-space character."""
    return F.regexp_replace(text, f"[{WHITE}]+", "")


def clean_text(text: Column) -> Column:
    """Runs of tab, CR, LF and space become one space; ends trimmed.

    Single words, which most glyphs are, pass one test and no replacement.
    """
    cleaned = trim_all(F.regexp_replace(text, "[\\t\\r\\n ]+", " "))
    return F.when(text.rlike(f"[{WHITE}]"), cleaned).otherwise(text)


def strip_control(text: Column) -> Column:
    """Drop C0 controls other than tab, LF, CR, and the two non-characters."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")


def xml_escape(text: Column) -> Column:
    """Control-free text with the four markup characters escaped."""
    out = strip_control(text)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def font_family(name: Column) -> Column:
    """First family of a font list, unquoted, without its subset prefix; NULL when blank."""
    first = trim_all(F.regexp_replace(F.split(name, ",").getItem(0), "[\"']", ""))
    return F.when(first != "", F.regexp_replace(first, "^[A-Z]{6}\\+", ""))


def output_font(family: Column) -> Column:
    """Family name mapped to one of the three standard output fonts where it is alike."""
    cleaned = trim_all(
        F.regexp_replace(F.regexp_replace(F.coalesce(family, F.lit("")), "^[A-Z]{6}\\+", ""), "[\"']", "")
    )
    return (
        F.when(cleaned == "", "Arial")
        .when(cleaned.rlike("(?i)helvetica|sans-serif"), "Arial")
        .when(cleaned.rlike("(?i)times|serif"), "Times New Roman")
        .when(cleaned.rlike("(?i)courier|monospace"), "Courier New")
        .otherwise(F.substring(cleaned, 1, 80))
    )


def normalize_font(name: Column) -> Column:
    """Raw font list to output font."""
    return output_font(font_family(name))


def is_bold(style_name: Column, flag: Column | None = None) -> Column:
    """P10: bold by flag or by font name."""
    named = F.coalesce(style_name.rlike("(?i)bold|black|heavy|semibold|demi"), F.lit(False))
    return named if flag is None else F.coalesce(flag, F.lit(False)) | named


def is_italic(style_name: Column, flag: Column | None = None) -> Column:
    """P10: italic by flag or by font name."""
    named = F.coalesce(style_name.rlike("(?i)italic|oblique"), F.lit(False))
    return named if flag is None else F.coalesce(flag, F.lit(False)) | named


_NUMBER_MARK = f"^[{WHITE}]*([0-9]{{1,3}})[.)][{WHITE}]+"
_BULLET_MARK = f"^[{WHITE}]*[•●◦▪‣\\-–—][{WHITE}]+"


def list_marker(text: Column) -> Column:
    """struct(kind, prefix_len, start); NULL when the text opens no list item."""
    number = F.regexp_extract(text, _NUMBER_MARK, 0)
    bullet = F.regexp_extract(text, _BULLET_MARK, 0)
    return F.when(
        number != "",
        F.struct(
            F.lit("number").alias("kind"),
            F.length(number).alias("prefix_len"),
            F.regexp_extract(text, _NUMBER_MARK, 1).cast("int").alias("start"),
        ),
    ).when(
        bullet != "",
        F.struct(
            F.lit("bullet").alias("kind"),
            F.length(bullet).alias("prefix_len"),
            F.lit(None).cast("int").alias("start"),
        ),
    )


def is_numeric_cell(text: Column) -> Column:
    """A number, an amount, a percentage or a plain date."""
    return text.rlike(f"^\\(?[{WHITE}]*[-+]?[$£€¥]?[{WHITE}]*[0-9][0-9{WHITE},.%/\\-]*\\)?$")


def is_rtl_text(text: Column) -> Column:
    """Any character of the right-to-left blocks U+0590 to U+08FF."""
    return text.rlike("[\\u0590-\\u08FF]")


_SPACES = "\u00a0\u2002\u2003\u2009\u202f"
_ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_DROP = "\\r\\x00-\\x08\\x0B-\\x1F"
_KEEP = "\\n\\x20-\\x7E\\xA0-\\xFF" + CP1252_EXTRA


def normalize_spaces(text: Column) -> Column:
    """Odd spaces to plain ones, zero-width marks out, tabs to four spaces, controls out."""
    plain = F.translate(text, _SPACES + _ZERO_WIDTH, " " * len(_SPACES))
    return F.regexp_replace(F.replace(plain, F.lit("\t"), F.lit("    ")), f"[{_DROP}]", "")


def map_text(text: Column) -> Column:
    """Text limited to the standard fonts; each unsupported code point becomes ``?``."""
    return F.regexp_replace(normalize_spaces(text), f"[^{_KEEP}]", "?")


def letter_count(text: Column) -> Column:
    """Number of letter code points."""
    return F.length(F.regexp_replace(text, "[^\\p{L}]", ""))


def replaced_count(text: Column) -> Column:
    """Number of code points that ``map_text`` turns into ``?``."""
    return F.length(F.regexp_replace(normalize_spaces(text), f"[{_KEEP}]", ""))


def words_of(text: Column) -> Column:
    """Lower-cased runs of Unicode letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping count of ``needle`` in ``text``; both already lower-cased."""
    hits = (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)
    return F.when(F.length(needle) > 0, F.floor(hits)).otherwise(F.lit(0))

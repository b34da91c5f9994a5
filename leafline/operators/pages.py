"""Page algebra: documents as ordered page rows.

``doc_pages`` holds dense 0-based ``page_no`` per document, so positions come
from arithmetic on per-document counts instead of ordering whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import trim_all
from leafline.operators.ordering import chunked_position

PAGES_PER_CHUNK = 1000

NO_FILES = "no_files"
NO_PAGES = "no_pages"
BAD_SYNTAX = "bad_syntax"
NO_COUNT = "no_page_count"
BAD_SPLIT = "bad_pages"
NOTHING_LEFT = "nothing_left"


def page_count(documents: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """Pages per document; ``ok`` is false where there are none."""
    counts = doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    d = documents.select("doc_id").join(counts, "doc_id", "left")
    return d.select("doc_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.col("pages").isNotNull().alias("ok"))


def merge_documents(members: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """G1: pages of each group in file order, renumbered by ``position``.

    ``members`` is (group_id, ord, doc_id); the same document may come twice.
    Only file rows are ordered; a page's place is its file's offset plus its
    number.
    """
    counts = doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("group_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    files = members.join(counts, "doc_id").withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return files.join(doc_pages, "doc_id").select(
        "group_id", (F.col("_off") + F.col("page_no")).alias("position"), "doc_id", "page_no"
    )


def merge_status(groups: DataFrame, members: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """G1: ok and error per requested group."""
    counts = doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    per_group = members.join(counts, "doc_id", "left").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("_files"), F.coalesce(F.sum("_n"), F.lit(0)).alias("pages")
    )
    g = groups.select("group_id").join(per_group, "group_id", "left").fillna(0, ["_files", "pages"])
    error = F.when(F.col("_files") == 0, NO_FILES).when(F.col("pages") == 0, NO_PAGES)
    return g.select("group_id", "pages", error.isNull().alias("ok"), error.alias("error"))


def page_selection(selection: Column, count: Column) -> Column:
    """struct(pages, error) for a text such as ``1-3, 5``; pages are 0-based and distinct."""
    parts = F.transform(
        F.split(selection, ","),
        lambda t: F.struct(
            F.regexp_extract(trim_all(t), "^([0-9]+)(?:\\s*-\\s*([0-9]+))?$", 1).alias("a"),
            F.regexp_extract(trim_all(t), "^([0-9]+)(?:\\s*-\\s*([0-9]+))?$", 2).alias("b"),
        ),
    )
    bounds = F.transform(
        parts,
        lambda p: F.struct(
            p["a"].try_cast("double").alias("lo"),
            F.when(p["b"] == "", p["a"]).otherwise(p["b"]).try_cast("double").alias("hi"),
        ),
    )
    bad_at = F.array_position(
        F.transform(
            bounds,
            lambda b: b["lo"].isNull() | (b["lo"] < 1) | (b["hi"] > count) | (b["lo"] > b["hi"]),
        ),
        True,
    )
    first_bad = F.get(bounds, (bad_at - 1).cast("int"))
    range_error = F.concat(
        F.lit("outside_1_to_"), count.cast("string")
    )
    error = (
        F.when(count.isNull() | (count < 1), NO_COUNT)
        .when(trim_all(selection) == "", F.lit(None).cast("string"))
        .when((bad_at > 0) & first_bad["lo"].isNull(), BAD_SYNTAX)
        .when(bad_at > 0, range_error)
    )
    chosen = F.array_distinct(
        F.flatten(F.transform(bounds, lambda b: F.sequence((b["lo"] - 1).cast("int"), (b["hi"] - 1).cast("int"))))
    )
    every = F.sequence(F.lit(0), (count - 1).cast("int"))
    pages = F.when(error.isNull(), F.when(trim_all(selection) == "", every).otherwise(chosen))
    return F.struct(pages.alias("pages"), error.alias("error"))


def parse_pages(requests: DataFrame) -> DataFrame:
    """(request_id, position, page_index, error); a bad request is one error row."""
    r = requests.withColumn("_s", page_selection(F.col("selection"), F.col("page_count")))
    return r.select("request_id", F.col("_s.error").alias("error"), F.posexplode_outer("_s.pages").alias("position", "page_index"))


def split_document(requests: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """Pages taken from a document, by explicit indices or by a 1-based range.

    ``requests`` is (request_id, doc_id, pages ARRAY<INT>, start, end); with
    NULL ``pages`` the range is clamped and swapped into order. Repeated
    indices stay. A bad request is one error row.
    """
    counts = doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    r = requests.join(counts, "doc_id", "left")

    def bounded(c):
        return F.least(F.col("_n"), F.greatest(F.lit(1), c.cast("int")))

    a, b = bounded(F.col("start")), bounded(F.col("end"))
    wanted = F.when(F.col("pages").isNotNull(), F.col("pages")).otherwise(
        F.sequence(F.least(a, b) - 1, F.greatest(a, b) - 1)
    )
    r = r.withColumn("_want", F.when(F.col("_n").isNotNull(), wanted))
    bad = (
        F.col("_want").isNull() | (F.size("_want") == 0)
        | F.exists("_want", lambda i: i.isNull() | (i < 0) | (i >= F.col("_n")))
    )
    r = r.withColumn("error", F.when(bad, BAD_SPLIT)).withColumn("_want", F.when(~bad, F.col("_want")))
    rows = r.select("request_id", "doc_id", "error", F.posexplode_outer("_want").alias("position", "page_no"))
    pages = doc_pages.select("doc_id", "page_no", "width", "height")
    return rows.join(pages, ["doc_id", "page_no"], "left")


def organize_pages(doc_pages: DataFrame, page_ops: DataFrame) -> DataFrame:
    """Pages after reorder or removes, then rotations of the resulting positions.

    ``page_ops`` is (doc_id, op_no, type, page_index, degrees, page_order
    ARRAY<INT>). The last reorder wins and makes removes void.
    """
    counts = doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    reorder = page_ops.where(F.col("type") == "reorder").groupBy("doc_id").agg(
        F.max_by("page_order", "op_no").alias("_order")
    )
    ordered = reorder.join(counts, "doc_id").select(
        "doc_id",
        F.posexplode_outer(
            F.array_distinct(F.filter("_order", lambda i: (i >= 0) & (i < F.col("_n"))))
        ).alias("position", "page_no"),
    ).where(F.col("page_no").isNotNull())
    removed = page_ops.where(F.col("type") == "remove").select("doc_id", F.col("page_index").alias("page_no")).distinct()
    kept = doc_pages.select("doc_id", "page_no").join(removed, ["doc_id", "page_no"], "left_anti")
    kept = kept.join(reorder.select("doc_id"), "doc_id", "left_anti")
    kept = chunked_position(
        kept, ["doc_id"], [F.col("page_no")], F.floor(F.col("page_no") / PAGES_PER_CHUNK), "position"
    )
    sequence = ordered.select("doc_id", F.col("position").cast("long").alias("position"), "page_no").unionByName(
        kept.select("doc_id", F.col("position").cast("long").alias("position"), "page_no")
    )
    turns = page_ops.where(F.col("type") == "rotate").groupBy(
        "doc_id", F.col("page_index").cast("long").alias("position")
    ).agg(F.sum("degrees").alias("_turn"))
    base = doc_pages.select("doc_id", "page_no", F.col("rotation").alias("_base"))
    return (
        sequence.join(base, ["doc_id", "page_no"])
        .join(turns, ["doc_id", "position"], "left")
        .select(
            "doc_id", "position", "page_no",
            F.pmod(F.col("_base") + F.coalesce("_turn", F.lit(0)), F.lit(360)).cast("int").alias("rotation"),
        )
    )


def organize_status(doc_pages: DataFrame, organized: DataFrame) -> DataFrame:
    """Ok and error per document."""
    left = organized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    d = doc_pages.select("doc_id").distinct().join(left, "doc_id", "left")
    return d.select(
        "doc_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.col("pages").isNotNull().alias("ok"),
        F.when(F.col("pages").isNull(), NOTHING_LEFT).alias("error"),
    )


def move_page(doc_pages: DataFrame, moves: DataFrame) -> DataFrame:
    """New position of every page after one move (doc_id, from, to) per document."""
    p, a, b = F.col("page_no"), F.col("from"), F.col("to")
    position = (
        F.when(a.isNull(), p).when(p == a, b)
        .when((a < b) & (p > a) & (p <= b), p - 1)
        .when((a > b) & (p >= b) & (p < a), p + 1)
        .otherwise(p)
    )
    return doc_pages.join(moves, "doc_id", "left").select("doc_id", "page_no", position.alias("position"))


def number_pages(doc_pages: DataFrame, start: int = 1, total: bool = True) -> DataFrame:
    """Printed label of each page."""
    start = max(1, int(start))
    label = (F.col("page_no") + start).cast("string")
    if not total:
        return doc_pages.select("doc_id", "page_no", label.alias("label"))
    counts = doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    of = F.concat(label, F.lit(" / "), (F.col("_n") + start - 1).cast("string"))
    return doc_pages.join(counts, "doc_id").select("doc_id", "page_no", of.alias("label"))


def keep_smaller(originals: DataFrame, candidates: DataFrame, key: str = "doc_id", gain: float | None = None) -> DataFrame:
    """Candidate only where strictly smaller (or below ``gain`` of the original).

    Signed originals stay. Columns: size, signed in originals; size in candidates.
    """
    o = originals.select(key, F.col("size").alias("original_bytes"), "signed")
    c = candidates.select(key, F.col("size").alias("_new"))
    smaller = F.col("_new") < (F.col("original_bytes") if gain is None else F.col("original_bytes") * gain)
    use = F.coalesce(smaller & ~F.col("signed"), F.lit(False))
    return o.join(c, key, "left").select(
        key, "original_bytes", F.when(use, F.col("_new")).otherwise(F.col("original_bytes")).alias("output_bytes"),
        (~use).alias("original_retained"),
    )

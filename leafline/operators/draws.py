"""Draw operators to ruling lines and image boxes.

``draw_ops`` rows are (keys, op_no, op, args) with op one of save, restore,
transform, path, image. The matrix stack makes each page a fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.operators.lines import PAGE

_BOX = "struct<op_no:bigint,x1:double,y1:double,x2:double,y2:double>"


def _finite(args: Column, n: int) -> Column:
    inf = F.lit(float("inf"))
    return (F.size(args) >= n) & F.forall(
        F.slice(args, 1, n), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != inf), F.lit(False))
    )


def _apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def _compose(m: Column, t: Column) -> Column:
    return F.array(
        m[0] * t[0] + m[2] * t[1], m[1] * t[0] + m[3] * t[1],
        m[0] * t[2] + m[2] * t[3], m[1] * t[2] + m[3] * t[3],
        m[0] * t[4] + m[2] * t[5] + m[4], m[1] * t[4] + m[3] * t[5] + m[5],
    )


def _boxes(draw_ops: DataFrame, keys: Sequence[str], paint: str, unit: bool) -> DataFrame:
    """Transformed bounding boxes of every ``paint`` op, in page space."""
    identity = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    wanted = draw_ops.where(F.col("op").isin("save", "restore", "transform", paint))
    pages = wanted.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("op_no", "op", "args"))).alias("_ops"),
        F.count_if(F.col("op") == paint).alias("_paints"),
    ).where(F.col("_paints") > 0)

    def step(s, o):
        m, stack = s["m"], s["stack"]
        is_save, is_restore = o["op"] == "save", o["op"] == "restore"
        moves = (o["op"] == "transform") & _finite(o["args"], 6)
        paints = o["op"] == paint
        if not unit:
            paints = paints & _finite(o["args"], 4)
        a = o["args"]
        x1, y1, x2, y2 = (F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)) if unit else (a[0], a[1], a[2], a[3])
        corners = [_apply(m, x, y) for x in (x1, x2) for y in (y1, y2)]
        xs, ys = [c[0] for c in corners], [c[1] for c in corners]
        box = F.struct(
            o["op_no"].cast("long").alias("op_no"), F.least(*xs).alias("x1"), F.least(*ys).alias("y1"),
            F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2"),
        )
        return F.struct(
            F.when(is_restore, F.coalesce(F.try_element_at(stack, F.lit(-1)), identity))
            .when(moves, _compose(m, a)).otherwise(m).alias("m"),
            F.when(is_save, F.concat(stack, F.array(m)))
            .when(is_restore, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(stack).alias("stack"),
            F.when(paints, F.concat(s["out"], F.array(box))).otherwise(s["out"]).alias("out"),
        )

    zero = F.struct(
        identity.alias("m"), F.array().cast("array<array<double>>").alias("stack"),
        F.array().cast(f"array<{_BOX}>").alias("out"),
    )
    return pages.select(*keys, F.inline(F.aggregate("_ops", zero, step, lambda s: s["out"])))


def ruling_segments(draw_ops: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Thin straight segments: (keys, op_no, x1, y1, x2, y2)."""
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    thin = ((width <= 2.5) & (height >= 8)) | ((height <= 2.5) & (width >= 8))
    return _boxes(draw_ops, list(keys), "path", unit=False).where(thin)


def image_placements(draw_ops: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Box of every painted image: (keys, op_no, x1, y1, x2, y2)."""
    return _boxes(draw_ops, list(keys), "image", unit=True)


def dedupe_placements(placements: DataFrame, doc_pages: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Boxes clipped to the page, tiny ones dropped, near repeats of an earlier kept box dropped."""
    keys = list(keys)
    size = doc_pages.select(*keys, F.col("width").alias("_w"), F.col("height").alias("_h"))
    p = placements.join(size, keys).select(
        *keys, "op_no", F.greatest(F.lit(0.0), "x1").alias("x"),
        F.least("_h", "y2").alias("top"), F.greatest(F.lit(0.0), "y1").alias("bottom"),
        F.least("_w", "x2").alias("_r"), "_w", "_h",
    ).withColumns({"width": F.col("_r") - F.col("x"), "height": F.col("top") - F.col("bottom")})
    area = F.col("width") * F.col("height") / F.greatest(F.lit(1.0), F.col("_w") * F.col("_h"))
    p = p.where((F.col("width") >= 16) & (F.col("height") >= 16) & (area >= 0.0001))
    box = F.struct("op_no", "x", "top", "bottom", "width", "height")

    def step(kept, b):
        seen = F.exists(
            kept,
            lambda k: (F.abs(k["x"] - b["x"]) < 2) & (F.abs(k["top"] - b["top"]) < 2)
            & (F.abs(k["width"] - b["width"]) < 2) & (F.abs(k["height"] - b["height"]) < 2),
        )
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(b)))

    kind = "array<struct<op_no:bigint,x:double,top:double,bottom:double,width:double,height:double>>"
    return p.groupBy(*keys).agg(F.sort_array(F.collect_list(box)).alias("_b")).select(
        *keys, F.inline(F.aggregate(F.col("_b").cast(kind), F.array().cast(kind), step))
    )

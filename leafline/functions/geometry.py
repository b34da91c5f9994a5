"""Column functions over quads: array<struct<x:double,y:double>>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafline.functions.text import let


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _triples(p: Column) -> list[tuple[Column, Column, Column]]:
    return [(p[i], p[(i + 1) % 4], p[(i + 2) % 4]) for i in range(4)]


def valid_quad(points: Column) -> Column:
    """P20: four finite points of the unit square, convex in order, area over 0.02."""

    def check(p):
        unit = [~F.isnan(p[i][c]) & p[i][c].between(0, 1) for i in range(4) for c in ("x", "y")]
        turns = [
            (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]) > 0.0001
            for a, b, c in _triples(p)
        ]
        doubled = reduce(
            lambda s, t: s + t, [a["x"] * b["y"] - b["x"] * a["y"] for a, b, _ in _triples(p)]
        )
        return F.coalesce(_all(unit + turns) & (F.abs(doubled) / 2 > 0.02), F.lit(False))

    return F.when(F.size(points) == 4, let(points, check)).otherwise(F.lit(False))


def plausible_quad(points: Column, width: Column, height: Column) -> Column:
    """Inside the border, long enough sides, convex, no acute or flat corner."""

    def check(p):
        tests = []
        for a, b, c in _triples(p):
            ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
            side = F.hypot(ux, uy)
            cosine = F.abs((ux * vx + uy * vy) / (side * F.hypot(vx, vy)))
            tests += [
                a["x"] >= 3, a["y"] >= 3, a["x"] <= width - 4, a["y"] <= height - 4,
                side >= F.least(width, height) * 0.16, ux * vy - uy * vx > 0,
                ~F.coalesce(cosine > 0.82, F.lit(False)),
            ]
        return _all(tests)

    return F.when(F.size(points) == 4, let(points, check)).otherwise(F.lit(False))


def order_quad(points: Column) -> Column:
    """Corners by angle about their centre, starting at the smallest x + y."""
    cx = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"]) / F.size(points)
    cy = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(points)
    turned = F.sort_array(
        F.transform(
            points,
            lambda p, i: F.struct(
                F.atan2(p["y"] - cy, p["x"] - cx).alias("angle"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")
            ),
        )
    )
    sums = F.transform(turned, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), i.alias("i")))
    first = F.array_min(sums)["i"]
    rotated = F.concat(F.slice(turned, first + 1, F.lit(4)), F.slice(turned, F.lit(1), first))
    return F.transform(rotated, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))

"""Polygons and lines as arrays of (x, y): areas, cuts by lines, places and directions along a line.

All are expressions over arrays, so any number of polygons is worked on by any number of tasks.
Corners may go round either way. Cuts are exact for convex polygons, and all parts of a convex one are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _following(points: Column, i: Column) -> Column:
    return F.get(points, F.pmod(i + 1, F.size(points)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _signed_area(points: Column) -> Column:
    def cross(p: Column, i: Column) -> Column:
        q = _following(points, i)
        return p["x"] * q["y"] - q["x"] * p["y"]

    return _sum(F.transform(points, cross)) / 2


def area(points: Column) -> Column:
    return F.abs(_signed_area(points))


def centroid(points: Column) -> Column:
    """The centre of the area; of a polygon without any, of its corners; null without corners."""

    def part(name: str, whole: Column) -> Column:
        def term(p: Column, i: Column) -> Column:
            q = _following(points, i)
            return (p[name] + q[name]) * (p["x"] * q["y"] - q["x"] * p["y"])

        corners = _sum(F.transform(points, lambda p: p[name])) / F.nullif(F.size(points), F.lit(0))
        return F.when(F.abs(whole) > 1e-12, _sum(F.transform(points, term)) / (6 * whole)).otherwise(corners)

    return _let(_signed_area(points), lambda whole: F.struct(part("x", whole).alias("x"), part("y", whole).alias("y")))


def bounds(points: Column) -> Column:
    low, high = (lambda n: F.array_min(F.transform(points, lambda p: p[n]))), (lambda n: F.array_max(F.transform(points, lambda p: p[n])))
    return F.struct(low("x").alias("x1"), low("y").alias("y1"), high("x").alias("x2"), high("y").alias("y2"))


def extent(points: Column, direction: Column) -> Column:
    """(width along a unit direction, height across it)."""
    along = F.transform(points, lambda p: p["x"] * direction["x"] + p["y"] * direction["y"])
    across = F.transform(points, lambda p: p["y"] * direction["x"] - p["x"] * direction["y"])
    return F.struct((F.array_max(along) - F.array_min(along)).alias("width"), (F.array_max(across) - F.array_min(across)).alias("height"))


def _between(p: Column, q: Column) -> Column:
    """Where an edge crosses the line from which its ends are p.s and q.s away."""
    part = p["s"] / (p["s"] - q["s"])
    return point(p["x"] + (q["x"] - p["x"]) * part, p["y"] + (q["y"] - p["y"]) * part)


def _line(at: Column, direction: Column) -> Column:
    return F.struct(at["x"].alias("x"), at["y"].alias("y"), direction["x"].alias("dx"), direction["y"].alias("dy"))


def _sides(points: Column, at: Column, direction: Column) -> Column:
    """Corners with how far to the left of a line they are, in units of its direction's length."""

    def sided(line: Column) -> Column:
        return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (line["dx"] * (p["y"] - line["y"]) - line["dy"] * (p["x"] - line["x"])).alias("s")))

    return _let(_line(at, direction), sided)


def clipped(points: Column, at: Column, direction: Column, left: bool = True) -> Column:
    """What of a polygon lies to the left (else right) of the line through ``at``; corners on the line belong to both sides.

    Each corner that lies there is kept, and each edge that crosses the line gives its crossing: one pass.
    """
    sign = 1 if left else -1

    def kept(corners: Column) -> Column:
        def of(p: Column, i: Column) -> Column:
            q, none = _following(corners, i), F.array().cast(POINTS)
            own = F.when(sign * p["s"] >= 0, F.array(point(p["x"], p["y"]))).otherwise(none)
            return F.concat(own, F.when(p["s"] * q["s"] < 0, F.array(_between(p, q))).otherwise(none))

        return F.flatten(F.transform(corners, of))

    return _let(_sides(points, at, direction), kept)


def chord(points: Column, at: Column, direction: Column) -> Column:
    """(from, to): where the line through ``at`` enters and leaves a convex polygon, in its direction; null if it misses it."""

    def met(corners: Column) -> Column:
        def of(p: Column, i: Column) -> Column:
            q = _following(corners, i)
            return F.when(p["s"] == 0, point(p["x"], p["y"])).when(p["s"] * q["s"] < 0, _between(p, q))

        return F.filter(F.transform(corners, of), lambda p: p.isNotNull())

    def ends(placed: Column) -> Column:
        end = lambda i: point(F.element_at(placed, i)["x"], F.element_at(placed, i)["y"])
        return F.when(F.size(placed) > 0, F.struct(end(1).alias("from"), end(-1).alias("to")))

    crossings = _let(_sides(points, at, direction), met)
    along_it = F.transform(crossings, lambda p: F.struct((p["x"] * direction["x"] + p["y"] * direction["y"]).alias("along"), p["x"].alias("x"), p["y"].alias("y")))
    return _let(F.array_sort(along_it), ends)


def centroid_cut(at: Column, direction: Column, magnitude: Column) -> Column:
    """The two ends of a line through ``at``, ``magnitude`` away on both sides; a direction of no length gives ``at`` twice."""
    size = F.hypot(direction["x"], direction["y"]) + 1e-8
    ux, uy = direction["x"] / size * magnitude, direction["y"] / size * magnitude
    return F.array(point(at["x"] + ux, at["y"] + uy), point(at["x"] - ux, at["y"] - uy))


def _pieces(line: Column) -> Column:
    """The line's pieces: begin, end, size, and where along the line they begin."""
    ends = F.transform(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), _following(line, i).alias("b")))
    sized = F.transform(ends, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]).alias("size")))

    def placed(parts: Column) -> Column:
        return F.transform(parts, lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), e["size"].alias("size"), _sum(F.transform(F.slice(parts, F.lit(1), i), lambda x: x["size"])).alias("start")))

    return _let(sized, placed)


def length(line: Column) -> Column:
    return _sum(F.transform(_pieces(line), lambda e: e["size"]))


def _along(pieces: Column, begin: Column, distance: Column) -> Column:
    def there(d: Column) -> Column:
        def on(e: Column) -> Column:
            part = F.least((d - e["start"]) / e["size"], F.lit(1.0))
            return F.when(e.isNull(), begin).otherwise(point(e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * part, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * part))

        inside = F.filter(pieces, lambda e: (e["start"] <= d) & (e["size"] > 0))
        return _let(F.get(inside, F.size(inside) - 1), on)

    def bounded(whole: Column) -> Column:
        return F.least(F.greatest(F.when(distance < 0, whole + distance).otherwise(distance), F.lit(0.0)), whole)

    return _let(_let(_sum(F.transform(pieces, lambda e: e["size"])), bounded), there)


def along(line: Column, distance: Column) -> Column:
    """The point so far along a line, at most its end; below 0 from the end backwards, at most to its begin."""
    return _let(_pieces(line), lambda pieces: _along(pieces, F.get(line, F.lit(0)), distance))


def _projected(pieces: Column, at: Column) -> Column:
    def near(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        part = F.when(e["size"] > 0, ((at["x"] - e["a"]["x"]) * dx + (at["y"] - e["a"]["y"]) * dy) / (e["size"] * e["size"])).otherwise(F.lit(0.0))

        def away(p: Column) -> Column:
            return F.struct(F.hypot(e["a"]["x"] + dx * p - at["x"], e["a"]["y"] + dy * p - at["y"]).alias("away"), (e["start"] + p * e["size"]).alias("distance"))

        return _let(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)), away)

    return F.coalesce(F.array_min(F.transform(pieces, near))["distance"], F.lit(0.0))


def projected(line: Column, at: Column) -> Column:
    """How far along a line the point nearest to ``at`` is; the first of equally near ones."""
    return _let(at, lambda here: _projected(_pieces(line), here))


#: How far before and after a place its direction is taken, and how far off such a point may be.
REACH, OFF = 5.0, 8.0


def tangent(line: Column, at: Column) -> Column:
    """Unit direction of a line at its point nearest to ``at``, to the right where it isn't upright; no length where the line has none."""

    def on(pieces: Column) -> Column:
        begin = F.get(line, F.lit(0))

        def placed(d: Column) -> Column:
            return F.struct(*[_along(pieces, begin, x).alias(name) for name, x in (("here", d), ("before", d - REACH), ("after", d + REACH))])

        return _let(_let(at, lambda here: _projected(pieces, here)), placed)

    def towards(p: Column) -> Column:
        near = lambda q: F.when(F.hypot(q["x"] - p["here"]["x"], q["y"] - p["here"]["y"]) > OFF, p["here"]).otherwise(q)
        return F.struct(*[(near(p["before"])[c] - near(p["after"])[c]).alias(c) for c in "xy"])

    def unit(v: Column) -> Column:
        size, flip = F.hypot(v["x"], v["y"]), F.when(v["x"] < 0, -1.0).otherwise(1.0)
        return F.struct(*[F.when(size > 0, v[c] / size * flip).otherwise(v[c]).alias(c) for c in "xy"])

    return _let(_let(_let(_pieces(line), on), towards), unit)


def crosswise(direction: Column) -> Column:
    """A direction turned left by a right angle."""
    return F.struct((-direction["y"]).alias("x"), direction["x"].alias("y"))

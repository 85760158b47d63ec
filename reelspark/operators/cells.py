"""Cutting polygons into cells: halves through centroids, shares of an axis or an area, and whole layouts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import polygon_batches as B
from reelspark.functions import polygons as P
from reelspark.operators import layout


def measured(shapes: DataFrame, points: str = "points", axis: str = "axis") -> DataFrame:
    """``shapes`` with centre, axial and crosswise direction at the centre, area, and extent along the axial one."""
    out = shapes.withColumn("centre", P.centroid(F.col(points)))
    out = out.withColumn("axial", P.tangent(F.col(axis), F.col("centre")))
    return out.withColumns({"crosswise": P.crosswise(F.col("axial")), "area": P.area(F.col(points)), "extent": P.extent(F.col(points), F.col("axial"))})


def halves(shapes: DataFrame, direction: str, name: str, points: str = "points") -> DataFrame:
    """``shapes`` with (larger, smaller) parts, their areas and the chord, under ``name``, of the cut through ``centre`` in a direction.

    Parts of one size go left part first. The cut is a whole chord, however long the polygon is.
    """
    at, to = F.col("centre"), F.col(direction)
    out = shapes.withColumns({"__left": P.clipped(F.col(points), at, to), "__right": P.clipped(F.col(points), at, to, left=False)})
    out = out.withColumns({"__al": P.area(F.col("__left")), "__ar": P.area(F.col("__right"))})
    first = F.col("__al") >= F.col("__ar") * (1 - 1e-9)
    pick = lambda a, b: F.struct(F.when(first, F.col(a)).otherwise(F.col(b)).alias("larger"), F.when(first, F.col(b)).otherwise(F.col(a)).alias("smaller"))
    out = out.withColumns({name: pick("__left", "__right"), f"{name}_areas": F.struct(F.col("__al").alias("left"), F.col("__ar").alias("right")), f"{name}_chord": P.chord(F.col(points), at, to)})
    return out.drop("__left", "__right", "__al", "__ar")


def forest(trees: DataFrame, keys: list[str], n: str = "n_leaves") -> DataFrame:
    """(keys, node_id, parent_id, side) of trees of ``n`` leaves each, halved again and again, the larger half on side 0.

    All trees grow together, one step a level; an id is the path from the root. A tree without leaves has no nodes.
    """
    most = trees.agg(F.max(n)).first()[0] or 0
    node = lambda id_, parent, side, leaves, open_: F.struct(id_.alias("node_id"), parent.alias("parent_id"), side.alias("side"), leaves.cast("long").alias("leaves"), open_.alias("open"))
    none = F.lit(None).cast("string")
    out = trees.where(F.col(n) > 0).select(*keys, node(F.lit("n"), none, none, F.col(n), F.lit(True)).alias("node"))
    for _ in range(max(int(most) - 1, 0).bit_length()):
        x = F.col("node")
        kids = [node(F.concat(x["node_id"], F.lit(s)), x["node_id"], F.lit(s), leaves, F.lit(True)) for s, leaves in (("0", F.ceil(x["leaves"] / 2)), ("1", F.floor(x["leaves"] / 2)))]
        own = node(x["node_id"], x["parent_id"], x["side"], x["leaves"], F.lit(False))
        out = out.select(*keys, F.explode(F.when(x["open"] & (x["leaves"] > 1), F.array(own, *kids)).otherwise(F.array(x))).alias("node"))
    return out.select(*keys, "node.node_id", "node.parent_id", "node.side")


def _worth(p: B.Polygons) -> np.ndarray:
    return np.where(B.good(p), 1.0, 0.5)


def _cut(keys: list[str]):
    """Of a batch of cells: the open inner nodes with their two cells, all others as they are."""

    def of(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        inner = batch["kid0"].is_valid().to_numpy(zero_copy_only=False)
        at, rest = np.flatnonzero(inner), np.flatnonzero(~inner)
        whole, axis = B.polygons(batch["points"].take(pa.array(at))), B.polygons(batch["axis"].take(pa.array(at)))
        cx, cy = B.centroid(whole)
        dx, dy = B.tangent(axis, cx, cy)
        sides = [B.clipped(whole, cx, cy, tx, ty, left) for tx, ty in ((dx, dy), (-dy, dx)) for left in (True, False)]
        areas, worths = [B.area(p) for p in sides], [_worth(p) for p in sides]
        along, across = worths[0] + worths[1], worths[2] + worths[3]
        turn = across > along
        first = np.where(turn, areas[2] >= areas[3] * (1 - 1e-9), areas[0] >= areas[1] * (1 - 1e-9))
        halves_ = [B.chosen(sides, 2 * turn + np.where(first == larger, 0, 1)) for larger in (True, False)]
        parts = [batch.take(pa.array(rows)) for rows in (rest, at, at, at)]
        points = [parts[0]["points"], parts[1]["points"], *map(B.column, halves_)]
        worth = [parts[0]["score"], *map(pa.array, (np.maximum(along, across), *map(_worth, halves_)))]
        join = pa.concat_arrays
        depth = parts[1]["depth"].to_numpy(zero_copy_only=False)
        new = pa.array(depth + 1, pa.int32())
        out = {k: join([p[k] for p in parts]) for k in (*keys, "axis")}
        out["node_id"] = join([parts[0]["node_id"], parts[1]["node_id"], parts[2]["kid0"], parts[3]["kid1"]])
        out["depth"] = join([parts[0]["depth"], parts[1]["depth"], new, new])
        out["points"] = join([p.cast(B.POINTS) for p in points])
        out["configuration"] = join([parts[0]["configuration"], pa.array(np.where(turn, 2, 0), pa.int32()), *[pa.array(np.full(len(at), -1), pa.int32())] * 2])
        out["score"] = join(worth)
        out["open"] = pa.array(np.repeat([False, True], [len(rest) + len(at), 2 * len(at)]))
        held = out["node_id"].is_valid()  # a node may have one child only
        return {c: v.filter(held) for c, v in out.items()}

    return of


def best_cuts(nodes: DataFrame, roots: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, node_id, depth, points, configuration, score) of every node of trees down to ``depth``.

    nodes: (keys, node_id, parent_id, side); roots: (keys, points, axis). An inner node's polygon is halved
    through its centre, along the axis (configuration 0) or across (2), whichever halves are worth more - good
    cells count 1, others 0.5 - and along on ties; the larger half goes to side 0, which is worth as much as the
    other way round (1 and 3). Leaves have configuration -1. All trees and all open cells of a level are cut
    in one step, an Arrow batch at once, with one join to the nodes. A tree without a root polygon has no cells.
    """
    kids = nodes.where("parent_id IS NOT NULL").groupBy(*keys, F.col("parent_id").alias("inner_id"))
    kids = kids.agg(*[F.max(F.when(F.col("side") == s, F.col("node_id"))).alias(f"kid{s}") for s in ("0", "1")])
    out = nodes.where("parent_id IS NULL").join(roots.hint("merge"), keys).select(*keys, "axis", "node_id", F.lit(0).alias("depth"), "points", F.lit(-1).alias("configuration"))
    schema = f"{B.fields(out, *keys, 'axis', 'node_id', 'depth')}, points {P.POINTS}, configuration int, score double, open boolean"

    def first(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        worth = _worth(B.polygons(batch["points"]))
        return {**{c: batch[c] for c in batch.schema.names}, "score": pa.array(worth), "open": pa.array(np.ones(len(worth), bool))}

    out = B.by_batch(out, first, schema)
    for _ in range(depth):
        out = out.withColumn("inner_id", F.when(F.col("open"), F.col("node_id"))).join(kids.hint("merge"), [*keys, "inner_id"], "left").drop("inner_id")
        out = B.by_batch(out, _cut(keys), schema)
    return out.drop("axis", "open")


def _running(weights: DataFrame, keys: list[str], weight: str, order: str) -> DataFrame:
    by = Window.partitionBy(*keys)
    run = F.sum(weight).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(by)
    last = F.lead(F.lit(1)).over(by.orderBy(order)).isNull()
    return weights.withColumns({"share": F.when(last, F.lit(1.0)).otherwise(run), "before": F.coalesce(F.lag(run).over(by.orderBy(order)), F.lit(0.0)), "last": last})


def axis_cuts(shapes: DataFrame, weights: DataFrame, keys: list[str], weight: str, order: str) -> DataFrame:
    """(keys, order, share, at, ends): cuts across a shape's axis where its length is shared out by weights in order.

    shapes: (keys, points, axis). One cut fewer than weights; none at the axis's ends. A cut goes as far to
    both sides as the shape is wide or high, whichever is more.
    """
    s = shapes.withColumns({"whole": P.length(F.col("axis")), "bounds": P.bounds(F.col("points"))})
    s = s.select(*keys, "axis", "whole", F.greatest(F.col("bounds.x2") - F.col("bounds.x1"), F.col("bounds.y2") - F.col("bounds.y1")).alias("reach"))
    out = _running(weights, keys, weight, order).where(~F.col("last")).join(s, keys).withColumn("distance", F.col("share") * F.col("whole")).where("distance > 0 AND distance < whole")
    near = F.least(F.lit(5.0), F.col("whole") * 0.05)
    out = out.withColumns({"at": P.along(F.col("axis"), F.col("distance")), "__a": P.along(F.col("axis"), F.greatest(F.col("distance") - near, F.lit(0.0))), "__b": P.along(F.col("axis"), F.least(F.col("distance") + near, F.col("whole")))})
    size = F.nullif(F.hypot(F.col("__b.x") - F.col("__a.x"), F.col("__b.y") - F.col("__a.y")), F.lit(0.0))
    x, y = (F.coalesce((F.col(f"__b.{c}") - F.col(f"__a.{c}")) / size, F.lit(0.0)) for c in "xy")
    out = out.withColumns({"__x": -y, "__y": x})
    end = lambda sign: P.point(F.col("at.x") + sign * F.col("__x") * F.col("reach"), F.col("at.y") + sign * F.col("__y") * F.col("reach"))
    return out.select(*keys, order, "share", "at", F.array(end(-1), end(1)).alias("ends"))


def area_cells(shapes: DataFrame, weights: DataFrame, keys: list[str], weight: str, order: str) -> DataFrame:
    """(keys, order, share, position, points, area): a shape cut across its axial direction into cells whose areas are as the weights.

    shapes: (keys, points, axis), convex. Between two corners the area before a cut grows as a square of its
    place, so three areas there give the place exactly; they are taken once a shape, whatever the number of weights, an Arrow
    batch of shapes and then of weights at once.
    ``position`` is where the cell ends, along the axial direction.
    """
    s = shapes.select(*keys, "points", "axis")
    s = B.by_batch(s, _places(keys), f"{B.fields(s, *keys, 'points')}, dx double, dy double, whole double, first double, final double, {_STEPS}")
    out = _running(weights, keys, weight, order).select(*keys, order, "share", "before", "last").join(s.hint("merge"), keys)
    return B.by_batch(out, _strip([*keys, order]), f"{B.fields(out, *keys, order, 'share')}, position double, points {P.POINTS}, area double")


_STEP = ("a", "b", "low", "mid", "high")
_STEPS = f"steps array<struct<{','.join(f'{c}:double' for c in _STEP)}>>"


def _places(keys: list[str]):
    """Of a batch of shapes: axial direction, area, ends, and between two corners the areas before both and before their middle."""

    def of(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        p = B.polygons(batch["points"])
        dx, dy = B.tangent(B.polygons(batch["axis"]), *B.centroid(p))
        along = np.sort(p.x * dx[:, None] + p.y * dy[:, None], 1)
        a, b = along[:, :-1], along[:, 1:]
        before = lambda d: np.stack([B.area(B.clipped(p, dx * x, dy * x, -dy, dx)) for x in d.T], 1) if d.size else d
        held = a < b
        steps = pa.StructArray.from_arrays([pa.array(v[held]) for v in (a, b, before(a), before((a + b) / 2), before(b))], list(_STEP))
        out = {c: batch[c] for c in (*keys, "points")} | {"dx": dx, "dy": dy, "whole": B.area(p), "first": along[:, 0], "final": along[:, -1]}
        return out | {"steps": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held.sum(1))), pa.int32()), steps)}

    return of


def _strip(names: list[str]):
    """Of a batch of shares: where each begins and ends along its shape's axial direction, and what lies between."""

    def of(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        (a, b, low, mid, high), n = B.lists(batch["steps"], _STEP)
        dx, dy, whole, first, final, share, before = (batch[c].to_numpy(zero_copy_only=False) for c in ("dx", "dy", "whole", "first", "final", "share", "before"))
        bend = 2 * (high - 2 * mid + low)
        rise = high - low - bend
        rows, within = np.arange(len(n)), np.arange(a.shape[1]) < n[:, None]

        def place(share: np.ndarray) -> np.ndarray:
            wanted = share * whole
            k = np.maximum(((low <= wanted[:, None]) & within).sum(1) - 1, 0)
            more = np.maximum(wanted - low[rows, k], 0.0)
            by = rise[rows, k] + np.sqrt(np.maximum(rise[rows, k] ** 2 + 4 * bend[rows, k] * more, 0.0))
            part = np.where(by != 0, 2 * more / np.where(by != 0, by, 1.0), 0.0)
            return np.where(n > 0, a[rows, k] + (b[rows, k] - a[rows, k]) * np.minimum(part, 1.0), first)

        position = np.where(batch["last"].to_numpy(zero_copy_only=False), final, place(share))
        start = np.where(before <= 0, first, place(before))
        p = B.clipped(B.polygons(batch["points"]), dx * position, dy * position, -dy, dx)
        p = B.clipped(p, dx * start, dy * start, -dy, dx, left=False)
        return {c: batch[c] for c in (*names, "share")} | {"position": position, "points": B.column(p), "area": B.area(p)}

    return of


def composed(items: DataFrame, canvases: DataFrame, canvas: str, cluster: str, item: str, priority: str, most: int = 12) -> DataFrame:
    """(canvas, cluster, tree, item, node_id, points, area): every item in a cell of its canvas.

    A cluster's items are dealt to trees of at most ``most`` leaves, best first; canvases (canvas, points,
    axis) are cut across into a part for each tree, as large as its number of items; parts are cut by
    ``best_cuts``, and in each tree the best item gets the largest cell, ties in order of ids and paths.
    One plan for all canvases: no cluster or tree is worked on alone. Items without a canvas get no cell.
    """
    tree = [canvas, cluster, "tree"]
    best = Window.partitionBy(canvas, cluster).orderBy(F.col(priority).desc(), item)
    dealt = items.withColumn("__at", F.row_number().over(best) - 1).withColumn("tree", F.floor(F.col("__at") / most).cast("int"))
    sizes = dealt.groupBy(*tree).agg(F.count(F.lit(1)).alias("n_leaves"))
    sizes = sizes.withColumn("__order", F.struct(cluster, "tree"))
    parts = area_cells(canvases, sizes, [canvas], "n_leaves", "__order").select(canvas, F.col(f"__order.{cluster}").alias(cluster), "__order.tree", "points")
    roots = parts.join(canvases.select(canvas, "axis"), canvas)
    depth = max(most - 1, 0).bit_length()
    cut = best_cuts(forest(sizes, tree), roots, tree, depth).where("configuration = -1").withColumn("area", P.area(F.col("points")))
    return layout.matched_by_rank(dealt.select(*tree, item, "__at"), cut.select(*tree, "node_id", "points", "area"), tree, [F.col("__at")], [F.round("area", 6).desc(), F.col("node_id")]).drop("rank", "__at")

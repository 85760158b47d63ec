"""Ranking items and giving them to the cells of a layout; trees are tables of (tree, node, parent)."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.functions.names import Named
from reelspark.functions.scalars import vector_angle
from reelspark.operators import sampling


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _scaled(x: Column, low: Column, high: Column) -> Column:
    return F.coalesce(F.when(high - low < 1e-6, F.lit(0.5)).otherwise((x - low) / (high - low)), F.lit(0.5))


def priorities(items: DataFrame, keys: list[str], scores: dict[str, float], order: str) -> DataFrame:
    """Weighted mean of min-max scores (constant columns and unknown values 0.5), and its 0-based rank; ties by order.

    Without keys the items are one group: its bounds are one row, and ranks are counted by ranges of
    priorities, so no task has all items.
    """
    total = max(sum(scores.values()), 1e-6)
    if keys:
        by = Window.partitionBy(*keys)
        bounds = {c: (F.min(_finite(c)).over(by), F.max(_finite(c)).over(by)) for c in scores}
    else:
        row = items.agg(*[f(_finite(c)).alias(f"{f.__name__}_{i}") for i, c in enumerate(scores) for f in (F.min, F.max)]).first()
        bounds = {c: (F.lit(row[f"min_{i}"]).cast("double"), F.lit(row[f"max_{i}"]).cast("double")) for i, c in enumerate(scores)}
    value = reduce(lambda a, b: a + b, [w * _scaled(_finite(c), *bounds[c]) for c, w in scores.items()]) / total
    out = items.withColumn("priority", value)
    if keys:
        return out.withColumn("priority_rank", F.row_number().over(by.orderBy(F.col("priority").desc(), order)) - 1)
    return sampling.global_position(out.withColumn("__p", -F.col("priority")), "__p", [order], "priority_rank").drop("__p")


def matched_by_rank(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """The k-th of the left with the k-th of the right."""
    rank = lambda df, order: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return rank(left, left_order).join(rank(right, right_order), [*keys, "rank"])


def tree_depths(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, depth, path) of (tree_id, node_id, parent_id, side): from the roots down; path orders leaves left to right.

    One join a level, over the nodes of the level above; trees may have any number of nodes.
    """
    level = nodes.where("parent_id IS NULL").select("tree_id", "node_id", F.lit(0).alias("depth"), F.lit("").alias("path")).persist()
    levels = [level]
    while not level.isEmpty():
        above = level.select("tree_id", F.col("node_id").alias("parent_id"), "depth", "path")
        level = nodes.join(above, ["tree_id", "parent_id"]).select("tree_id", "node_id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.col("side").cast("string")).alias("path")).persist()
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


#: Which side of a node grows, by the heights of both: the shallower one; equal ones by a draw.
GROWTH: Named[Callable[[int, int, random.Random], int]] = Named(
    "strategy",
    balanced=lambda left, right, draw: draw.randrange(2) if left == right else int(left > right),
    unbalanced=lambda left, right, draw: draw.randrange(2) if left == right else int(left > right),
)


def grown_tree(spark: SparkSession, n_leaves: int, strategy: str = "balanced", seed: int = 10, tree_id: int = 0) -> DataFrame:
    """(tree_id, node_id, parent_id, side) of a tree with ``n_leaves`` leaves: again and again the leaf to which the strategy leads is split in two.

    Trees are small (``leaf_budget``), so they are grown on the driver; node_id is the path from the root.
    """
    draw, grows, height = random.Random(seed), GROWTH[strategy], {"": 0}
    for _ in range(n_leaves - 1):
        at = ""
        while f"{at}0" in height:
            at += str(grows(height[f"{at}0"], height[f"{at}1"], draw))
        height |= {f"{at}0": 0, f"{at}1": 0}
        for k in range(len(at), -1, -1):
            height[at[:k]] = 1 + max(height[f"{at[:k]}0"], height[f"{at[:k]}1"])
    rows = [(tree_id, f"n{p}", f"n{p[:-1]}" if p else None, p[-1:]) for p in sorted(height)]
    return spark.createDataFrame(rows, "tree_id int, node_id string, parent_id string, side string")


def leaves(depths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Leaves with their 0-based place from left to right."""
    parents = nodes.where("parent_id IS NOT NULL").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    out = depths.join(parents, ["tree_id", "node_id"], "left_anti")
    return out.withColumn("leaf", F.row_number().over(Window.partitionBy("tree_id").orderBy("path")) - 1)


def tree_shape(depths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Height and number of leaves of each tree."""
    return leaves(depths, nodes).groupBy("tree_id").agg(F.max("depth").alias("height"), F.count(F.lit(1)).alias("n_leaves"))


def depth_histogram(leaf_rows: DataFrame) -> DataFrame:
    return leaf_rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def shares(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Each row's share of its group's total."""
    return rows.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*keys)))


#: Places of a block in which depths are looked up.
_PLACES = 4096


def fill_depths(items: DataFrame, capacity: DataFrame, order: str) -> DataFrame:
    """Items in order into the depths' places, the deepest first. capacity: (depth, n).

    An item's depth is looked up by its place: depths are ranges of places, of which a row for each block of places is joined.
    """
    c = capacity.withColumn("__to", F.sum("n").over(Window.orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("__from", F.col("__to") - F.col("n")).where("n > 0")
    ranges = c.select("depth", "__from", "__to", F.explode(F.sequence(F.floor(F.col("__from") / _PLACES), F.floor((F.col("__to") - 1) / _PLACES))).alias("__block"))
    i = sampling.global_position(items, order, [], "__i").withColumn("__block", F.floor(F.col("__i") / _PLACES))
    return i.join(ranges, "__block").where("__i >= __from AND __i < __to").drop("__i", "__block", "__from", "__to")


def leaf_budget(segments: DataFrame, n: str = "n", most: int = 12) -> DataFrame:
    """Trees of at most ``most`` leaves for each segment's items."""
    count = F.ceil(F.col(n) / most)
    at = F.posexplode(F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(1))))
    out = segments.select("*", at.alias("tree", "__k"))
    return out.withColumn("n_leaves", F.least(F.lit(most), F.col(n) - F.col("tree") * most)).drop("__k")


def strips(boxes: DataFrame, keys: list[str], weight: str, order: str) -> DataFrame:
    """Cuts a box (x1, y1, x2, y2) along its longer side into strips in proportion to the weights of its rows."""
    by = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(weight).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    a, b = before / F.sum(weight).over(by), (before + F.col(weight)) / F.sum(weight).over(by)
    wide = F.col("x2") - F.col("x1") >= F.col("y2") - F.col("y1")
    return boxes.withColumns({
        "cell_x1": F.when(wide, F.col("x1") + (F.col("x2") - F.col("x1")) * a).otherwise(F.col("x1")),
        "cell_x2": F.when(wide, F.col("x1") + (F.col("x2") - F.col("x1")) * b).otherwise(F.col("x2")),
        "cell_y1": F.when(~wide, F.col("y1") + (F.col("y2") - F.col("y1")) * a).otherwise(F.col("y1")),
        "cell_y2": F.when(~wide, F.col("y1") + (F.col("y2") - F.col("y1")) * b).otherwise(F.col("y2")),
    })


def cut_positions(rows: DataFrame, keys: list[str], weight: str, order: str) -> DataFrame:
    """Shares of an axis at which it is cut: running sums of weights, without the last."""
    by = Window.partitionBy(*keys)
    run = F.sum(weight).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(by)
    last = F.lead(F.lit(1)).over(by.orderBy(order)).isNull()
    return rows.withColumns({"cut": run, "__last": last}).where(~F.col("__last")).drop("__last")


def polygon_angles(points: Column) -> Column:
    """Inner angle, in degrees, at each corner of an array of (x, y)."""
    n = F.size(points)

    def angle(p: Column, i: Column) -> Column:
        a, b = F.get(points, F.pmod(i - 1, n)), F.get(points, F.pmod(i + 1, n))
        return vector_angle(a["x"] - p["x"], a["y"] - p["y"], b["x"] - p["x"], b["y"] - p["y"])

    return F.transform(points, angle)


def good_cell(points: Column) -> Column:
    """At least four sides and no corner under 35 degrees."""
    return (F.size(points) >= 4) & ~F.exists(polygon_angles(points), lambda a: a < 35)


def partition_score(rows: DataFrame, keys: list[str], expected: str, area: str, aspect: str) -> DataFrame:
    """0.7 of how well areas match their expected shares, 0.3 of how square the cells are."""
    by = Window.partitionBy(*keys)
    r = rows.withColumns({"__e": F.col(expected) / F.sum(expected).over(by), "__a": F.col(area) / F.sum(area).over(by)})
    return r.groupBy(*keys).agg((0.7 * F.avg(1 - F.abs(F.col("__e") - F.col("__a"))) + 0.3 * F.avg(1 / F.least(F.col(aspect), F.lit(3.0)))).alias("score"))


def geometry(leaf_rows: DataFrame, assigned: DataFrame, on: list[str]) -> DataFrame:
    """Parts of a layout with the item that each got, if any."""
    return leaf_rows.join(assigned, on, "left")


def matched_by_name(files: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """The first image of each file by equal names, else by equal stems, else by equal (scene, frame) in the
    names, else one whose name contains the file's path or its name.

    Each rule is an equi-join - containment is one with all parts of an image's name that are as long as
    some file's - and rules are tried in this order, images in the order of their names.
    """
    from reelspark.functions.scalars import basename, scene_and_frame, stem

    numbers = lambda c: F.when(c.rlike(r"scene_\d+_frame_\d+"), scene_and_frame(c).cast("string"))
    rules = [lambda c: c, basename, stem, numbers]
    found = [files.select(*keys, "file", f(F.col("file")).alias("__m")).join(images.select(*keys, "image", f(F.col("image")).alias("__m")), [*keys, "__m"]).select(*keys, "file", "image", F.lit(i).alias("rule")) for i, f in enumerate(rules)]
    name = F.when(basename(F.col("file")) != "", basename(F.col("file"))).otherwise(F.col("file"))  # whoever contains the path contains its name
    wanted = files.select(*keys, "file", name.alias("__m")).where("__m <> ''").withColumn("__l", F.char_length("__m"))
    lengths = wanted.select(*keys, "__l").distinct()
    starts = F.sequence(F.lit(1), F.char_length("image") - F.col("__l") + 1)
    parts = images.select(*keys, "image").join(lengths, keys).where(F.char_length("image") >= F.col("__l")).select(*keys, "image", "__l", F.explode(starts).alias("__s"))
    parts = parts.select(*keys, "image", F.substring("image", F.col("__s"), F.col("__l")).alias("__m"))
    rule = F.when(F.contains("image", "file"), len(found)).otherwise(len(found) + 1)
    found.append(wanted.join(parts, [*keys, "__m"]).select(*keys, "file", "image", rule.alias("rule")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(*keys, "file").agg(F.min_by("image", F.struct("rule", "image")).alias("image"))

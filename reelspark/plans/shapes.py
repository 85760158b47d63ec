"""Queries on polygons: cuts, cells and layouts of shapes whose measures are those of parts and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import polygons as P
from reelspark.operators import cells
from reelspark.plans.catalog import _r, query
from reelspark.plans.tables import table


def _shape(w: Column, h: Column, triangle: Column) -> tuple[Column, Column]:
    """A box, or the right triangle below its diagonal, and the middle line of its longer side."""
    zero = F.lit(0.0)
    corners = F.array(P.point(zero, zero), P.point(w, zero), P.point(zero, h))
    axis = F.when(w >= h, F.array(P.point(zero, h / 2), P.point(w, h / 2))).otherwise(F.array(P.point(w / 2, zero), P.point(w / 2, h)))
    return F.when(triangle, corners).otherwise(P.box(zero, zero, w, h)), axis


def _parts(spark: SparkSession, sf_dir: str, triangles: bool) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 30.0).alias("w"), (F.col("p_partkey") % 90 + 20.0).alias("h"), (1 + F.col("p_size") % 6).alias("n_leaves"))
    points, axis = _shape(F.col("w"), F.col("h"), (F.col("p_partkey") % 2 == 1) & F.lit(triangles))
    return p.select("*", points.alias("points"), axis.alias("axis"))


_PART = "s AS (SELECT p_partkey, p_size + 30.0::DOUBLE AS w, p_partkey % 90 + 20.0::DOUBLE AS h, p_partkey % 2 = 1 AS t, 1 + p_size % 6 AS n_leaves FROM part)"


@query(f"""WITH {_PART}, m AS (SELECT *, w >= h AS wide, CASE WHEN t THEN w * h / 2 ELSE w * h END AS area, CASE WHEN t THEN w / 3 ELSE w / 2 END AS cx, CASE WHEN t THEN h / 3 ELSE h / 2 END AS cy FROM s)
SELECT p_partkey, round(cx, 6) AS cx, round(cy, 6) AS cy, CASE WHEN wide THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS tx, CASE WHEN wide THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS ty, round(area, 6) AS area,
round(CASE WHEN wide THEN w ELSE h END, 6) AS width, round(CASE WHEN wide THEN h ELSE w END, 6) AS height, round(area * CASE WHEN t THEN 4.0::DOUBLE / 9 ELSE 0.5::DOUBLE END, 6) AS left_area, round(area * CASE WHEN t THEN 5.0::DOUBLE / 9 ELSE 0.5::DOUBLE END, 6) AS right_area,
round(CASE WHEN wide THEN w ELSE h END * CASE WHEN t THEN 2.0::DOUBLE / 3 ELSE 1 END, 6) AS chord, round(CASE WHEN wide THEN cx + w ELSE cx END, 4) AS end_x, round(CASE WHEN wide THEN cy ELSE cy - h END, 4) AS end_y FROM m""")
def centroid_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape's centre, its axis's direction there, and the cut through it in that direction."""
    s = cells.halves(cells.measured(_parts(spark, sf_dir, True)), "axial", "cut")
    s = s.withColumn("ends", P.centroid_cut(F.col("centre"), F.col("axial"), F.col("extent.width")))
    return s.select(
        "p_partkey", _r("centre.x").alias("cx"), _r("centre.y").alias("cy"), (F.col("axial.x") + 0.0).alias("tx"), (F.col("axial.y") + 0.0).alias("ty"), _r("area").alias("area"), _r("extent.width").alias("width"), _r("extent.height").alias("height"),
        _r("cut_areas.left").alias("left_area"), _r("cut_areas.right").alias("right_area"), _r(F.hypot(F.col("cut_chord.to.x") - F.col("cut_chord.from.x"), F.col("cut_chord.to.y") - F.col("cut_chord.from.y"))).alias("chord"),
        _r(F.col("ends")[0]["x"], 4).alias("end_x"), _r(F.col("ends")[0]["y"], 4).alias("end_y"),
    )


@query(f"""WITH RECURSIVE {_PART}, c AS (
    SELECT p_partkey, 'n' AS node_id, 0 AS depth, n_leaves::BIGINT AS n, w >= h AS wide, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, w AS x2, h AS y2 FROM s
    UNION ALL SELECT p_partkey, node_id || side, depth + 1, CASE WHEN side = '0' THEN (n + 1) // 2 ELSE n // 2 END, wide,
        CASE WHEN NOT wide AND side = '0' THEN (x1 + x2) / 2 ELSE x1 END, CASE WHEN wide AND side = '0' THEN (y1 + y2) / 2 ELSE y1 END, CASE WHEN NOT wide AND side = '1' THEN (x1 + x2) / 2 ELSE x2 END, CASE WHEN wide AND side = '1' THEN (y1 + y2) / 2 ELSE y2 END
    FROM c, (VALUES ('0'), ('1')) AS k(side) WHERE n > 1)
SELECT p_partkey, node_id, depth, CASE WHEN n > 1 THEN 0 ELSE -1 END AS configuration, CASE WHEN n > 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS score, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round((x2 - x1) * (y2 - y1), 6) AS area FROM c""")
def best_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes cut into cells by trees of 1 to 6 leaves: nodes, choices and boxes."""
    s = _parts(spark, sf_dir, False)
    cut = cells.best_cuts(cells.forest(s, ["p_partkey"]), s.select("p_partkey", "points", "axis"), ["p_partkey"], 3)
    cut = cut.withColumns({"bounds": P.bounds(F.col("points")), "area": P.area(F.col("points"))})
    return cut.select("p_partkey", "node_id", "depth", "configuration", "score", *[_r(f"bounds.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], _r("area").alias("area"))


_CUSTOMER = "s AS (SELECT c_custkey, 40.0::DOUBLE + c_custkey % 60 AS w, 20.0::DOUBLE + c_custkey % 17 AS h, c_custkey % 2 = 1 AS t FROM customer), r AS (SELECT c_custkey, w, h, t, o_orderkey, sum(o_totalprice::DOUBLE) OVER (PARTITION BY c_custkey ORDER BY o_orderkey) / sum(o_totalprice::DOUBLE) OVER (PARTITION BY c_custkey) AS share, o_totalprice::DOUBLE / sum(o_totalprice::DOUBLE) OVER (PARTITION BY c_custkey) AS part, lead(1) OVER (PARTITION BY c_custkey ORDER BY o_orderkey) IS NULL AS last FROM s JOIN orders ON o_custkey = c_custkey)"


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 60 + 40.0).alias("w"), (F.col("c_custkey") % 17 + 20.0).alias("h"))
    points, axis = _shape(F.col("w"), F.col("h"), F.col("c_custkey") % 2 == 1)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    return c.select("c_custkey", points.alias("points"), axis.alias("axis")), orders


@query(f"WITH {_CUSTOMER} SELECT c_custkey, o_orderkey, round(share, 6) AS share, round(share * w, 4) AS x, round(h / 2, 4) AS y, round(share * w, 4) AS from_x, round(h / 2 - w, 4) AS from_y, round(share * w, 4) AS to_x, round(h / 2 + w, 4) AS to_y FROM r WHERE NOT last")
def weighted_axis_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's shape cut across its axis where the length is shared out by its orders' prices."""
    cut = cells.axis_cuts(*_customers(spark, sf_dir), ["c_custkey"], "price", "o_orderkey")
    ends = [_r(F.col("ends")[i][c], 4).alias(f"{name}_{c}") for i, name in enumerate(("from", "to")) for c in "xy"]
    return cut.select("c_custkey", "o_orderkey", _r("share").alias("share"), _r("at.x", 4).alias("x"), _r("at.y", 4).alias("y"), *ends)


@query(f"WITH {_CUSTOMER} SELECT c_custkey, o_orderkey, round(CASE WHEN last THEN 1 ELSE share END, 6) AS share, round(CASE WHEN last THEN w WHEN t THEN w * (1 - sqrt(1 - share)) ELSE w * share END, 4) AS position, round(part * w * h / CASE WHEN t THEN 2 ELSE 1 END, 4) AS area FROM r")
def weighted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's shape cut into cells whose areas are as its orders' prices."""
    cut = cells.area_cells(*_customers(spark, sf_dir), ["c_custkey"], "price", "o_orderkey")
    return cut.select("c_custkey", "o_orderkey", _r("share").alias("share"), _r("position", 4).alias("position"), _r("area", 4).alias("area"))


_MOST = 12


@query(f"""WITH RECURSIVE i AS (
    SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) - 1 AS pl FROM part
), d AS (SELECT *, (pl // {_MOST})::INT AS tree FROM i
), z AS (SELECT p_brand, p_type, tree, count(*) AS n FROM d GROUP BY ALL
), b AS (SELECT *, 1200.0::DOUBLE * n / sum(n) OVER (PARTITION BY p_brand) AS w, 1200.0::DOUBLE * sum(n) OVER (PARTITION BY p_brand ORDER BY p_type, tree) / sum(n) OVER (PARTITION BY p_brand) AS x2 FROM z
), c AS (
    SELECT p_brand, p_type, tree, n, w, x2, 'n' AS node_id, 0.0::DOUBLE AS y1, 800.0::DOUBLE AS y2 FROM b
    UNION ALL SELECT p_brand, p_type, tree, CASE WHEN side = '0' THEN (n + 1) // 2 ELSE n // 2 END, w, x2, node_id || side, CASE WHEN side = '0' THEN (y1 + y2) / 2 ELSE y1 END, CASE WHEN side = '0' THEN y2 ELSE (y1 + y2) / 2 END
    FROM c, (VALUES ('0'), ('1')) AS k(side) WHERE n > 1
), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, tree ORDER BY round(w * (y2 - y1), 6) DESC, node_id) - 1 AS pl FROM c WHERE n = 1)
SELECT p_brand, p_type, tree, p_partkey, node_id, round(w * (y2 - y1), 4) AS area, round(x2 - w, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2
FROM d JOIN r USING (p_brand, p_type, tree) WHERE d.pl - tree * {_MOST} = r.pl""")
def composed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts placed on a canvas of their brand, types as clusters, the dearest part of a tree in its largest cell."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice")
    canvas = p.select("p_brand").distinct().select("p_brand", P.box(F.lit(0), F.lit(0), F.lit(1200), F.lit(800)).alias("points"), F.array(P.point(F.lit(0), F.lit(400)), P.point(F.lit(1200), F.lit(400))).alias("axis"))
    placed = cells.composed(p, canvas, "p_brand", "p_type", "p_partkey", "p_retailprice", _MOST).withColumn("bounds", P.bounds(F.col("points")))
    return placed.select("p_brand", "p_type", "tree", "p_partkey", "node_id", _r("area", 4).alias("area"), *[_r(f"bounds.{c}", 4).alias(c) for c in ("x1", "y1", "x2", "y2")])

"""Cuts and cells of polygons against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reelspark.functions import polygons as P
from reelspark.operators import cells


def convex(rng, n, r=50.0):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(60 + r * math.cos(t), 70 + 0.6 * r * math.sin(t)) for t in turns]
    return pts[::-1] if rng.random() < 0.5 else pts


def area(p):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2


def centre(p):
    pairs = list(zip(p, p[1:] + p[:1], strict=True))
    w = sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs)
    return tuple(sum((a[i] + b[i]) * (a[0] * b[1] - b[0] * a[1]) for a, b in pairs) / (3 * w) for i in (0, 1))


def cut(p, at, d, sign):
    out = []
    side = lambda q: sign * (d[0] * (q[1] - at[1]) - d[1] * (q[0] - at[0]))
    for a, b in zip(p, p[1:] + p[:1], strict=True):
        s, t = side(a), side(b)
        if s >= 0:
            out.append(a)
        if s * t < 0:
            k = s / (s - t)
            out.append((a[0] + (b[0] - a[0]) * k, a[1] + (b[1] - a[1]) * k))
    return out


def angles(p):
    for i, c in enumerate(p):
        a, b = p[i - 1], p[(i + 1) % len(p)]
        u, v = (a[0] - c[0], a[1] - c[1]), (b[0] - c[0], b[1] - c[1])
        yield math.degrees(math.acos(max(-1, min(1, (u[0] * v[0] + u[1] * v[1]) / (math.hypot(*u) * math.hypot(*v))))))


def worth(p):
    return 1.0 if len(p) >= 4 and min(angles(p)) >= 35 else 0.5


def along(line, d):
    whole = sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))
    d = min(max(whole + d if d < 0 else d, 0), whole)
    for a, b in zip(line, line[1:], strict=False):
        size = math.dist(a, b)
        if d <= size and size > 0:
            return tuple(a[i] + (b[i] - a[i]) * d / size for i in (0, 1))
        d -= size
    return line[-1]


def tangent(line, at):
    best, start = (math.inf, 0), 0.0
    for a, b in zip(line, line[1:], strict=False):
        size = math.dist(a, b)
        k = min(max(sum((at[i] - a[i]) * (b[i] - a[i]) for i in (0, 1)) / size**2, 0), 1)
        q = tuple(a[i] + (b[i] - a[i]) * k for i in (0, 1))
        best = min(best, (math.dist(q, at), start + k * size))
        start += size
    here = along(line, best[1])
    ends = [q if math.dist(q, here) <= 8 else here for q in (along(line, best[1] - 5), along(line, best[1] + 5))]
    v = (ends[0][0] - ends[1][0], ends[0][1] - ends[1][1])
    n = math.hypot(*v) * (-1 if v[0] < 0 else 1)
    return (v[0] / n, v[1] / n)


def solved(p, axis, tree, node, depth, out):
    kids = [k for k in (f"{node}0", f"{node}1") if k in tree]
    if not kids:
        out[node] = (depth, -1, worth(p), area(p))
        return
    c, t = centre(p), tangent(axis, centre(p))
    options = []
    for number, d in ((0, t), (2, (-t[1], t[0]))):
        left, right = cut(p, c, d, 1), cut(p, c, d, -1)
        big, small = (left, right) if area(left) >= area(right) * (1 - 1e-9) else (right, left)
        options.append((worth(big) + worth(small), number, big, small))
    score, number, big, small = max(options, key=lambda o: o[0])
    out[node] = (depth, number, score, area(p))
    for k, half in zip(kids, (big, small), strict=True):
        solved(half, axis, tree, k, depth + 1, out)


def rows_of(shapes):
    return [(k, [{"x": x, "y": y} for x, y in p], [{"x": float(x), "y": float(y)} for x, y in a]) for k, p, a in shapes]


SCHEMA = f"k int, points {P.POINTS}, axis {P.POINTS}"


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(8)
    return [(k, convex(rng, rng.randint(3, 8)), [(10 + rng.uniform(0, 5), 70), (40, 70 + rng.uniform(-9, 9)), (80, 60), (112, 75)]) for k in range(40)]


def test_measures(spark, shapes):
    got = cells.measured(spark.createDataFrame(rows_of(shapes), SCHEMA)).orderBy("k").collect()
    for (_, p, axis), r in zip(shapes, got, strict=True):
        assert r["area"] == pytest.approx(area(p))
        assert tuple(r["centre"]) == pytest.approx(centre(p))
        assert tuple(r["axial"]) == pytest.approx(tangent(axis, centre(p)))
        t = r["axial"]
        proj = [x * t["x"] + y * t["y"] for x, y in p]
        assert r["extent"]["width"] == pytest.approx(max(proj) - min(proj))


def test_halves_and_chord(spark, shapes):
    df = cells.halves(cells.measured(spark.createDataFrame(rows_of(shapes), SCHEMA)), "axial", "cut")
    for r in df.collect():
        assert r["cut_areas"]["left"] + r["cut_areas"]["right"] == pytest.approx(r["area"])
        a, b = r["cut_chord"]["from"], r["cut_chord"]["to"]
        assert (b["x"] - a["x"]) * r["axial"]["x"] + (b["y"] - a["y"]) * r["axial"]["y"] > 0
        assert len(r["cut"]["larger"]) >= 3
    missed = spark.range(1).select(P.chord(P.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), P.point(F.lit(0), F.lit(5)), P.point(F.lit(1), F.lit(0))).alias("c"))
    assert missed.first()["c"] is None


def test_forest(spark):
    sizes = spark.createDataFrame([(k, n) for k, n in enumerate([0, 1, 2, 3, 7, 12])], "k int, n_leaves int")
    nodes = cells.forest(sizes, ["k"]).collect()
    by = {}
    for r in nodes:
        by.setdefault(r["k"], {})[r["node_id"]] = r["parent_id"]
    assert 0 not in by
    for k, n in ((1, 1), (2, 2), (3, 3), (4, 7), (5, 12)):
        leaves = set(by[k]) - set(by[k].values())
        assert len(leaves) == n
        assert len(by[k]) == 2 * n - 1
        assert max(map(len, leaves)) - min(map(len, leaves)) <= 1


def test_best_cuts_against_recursion(spark, shapes):
    sizes = [(k, 1 + k % 9) for k, _, _ in shapes]
    nodes = cells.forest(spark.createDataFrame(sizes, "k int, n_leaves int"), ["k"]).cache()
    got = cells.best_cuts(nodes, spark.createDataFrame(rows_of(shapes), SCHEMA), ["k"], 4).withColumn("area", P.area(F.col("points"))).collect()
    trees = {}
    for r in nodes.collect():
        trees.setdefault(r["k"], set()).add(r["node_id"])
    want = {}
    for k, p, axis in shapes:
        out = {}
        solved(p, axis, trees[k], "n", 0, out)
        want |= {(k, node): x for node, x in out.items()}
    assert {(r["k"], r["node_id"]): (r["depth"], r["configuration"], r["score"], pytest.approx(r["area"])) for r in got} == want
    assert {r["configuration"] for r in got} == {-1, 0, 2}


def test_area_cells(spark, shapes):
    rng = random.Random(2)
    weights = [(k, i, rng.uniform(0.1, 5)) for k, _, _ in shapes for i in range(1 + k % 6)]
    got = cells.area_cells(spark.createDataFrame(rows_of(shapes), SCHEMA), spark.createDataFrame(weights, "k int, i int, w double"), ["k"], "w", "i").collect()
    total = {k: sum(w for j, _, w in weights if j == k) for k, _, _ in shapes}
    whole = {k: area(p) for k, p, _ in shapes}
    want = {(k, i): w / total[k] * whole[k] for k, i, w in weights}
    assert len(got) == len(weights)
    assert all(r["area"] == pytest.approx(want[r["k"], r["i"]], rel=1e-6) for r in got)


def test_axis_cuts(spark, shapes):
    weights = [(k, i, float(1 + i)) for k, _, _ in shapes for i in range(1 + k % 4)]
    got = {(r["k"], r["i"]): r for r in cells.axis_cuts(spark.createDataFrame(rows_of(shapes), SCHEMA), spark.createDataFrame(weights, "k int, i int, w double"), ["k"], "w", "i").collect()}
    assert len(got) == sum(k % 4 for k, _, _ in shapes)
    for k, p, axis in shapes:
        n = 1 + k % 4
        whole = sum(math.dist(a, b) for a, b in zip(axis, axis[1:], strict=False))
        reach = max(max(q[i] for q in p) - min(q[i] for q in p) for i in (0, 1))
        for i in range(n - 1):
            d = whole * sum(range(1, i + 2)) / sum(range(1, n + 1))
            near = min(5, whole * 0.05)
            a, b, at = along(axis, max(0, d - near)), along(axis, min(whole, d + near)), along(axis, d)
            t = [(b[j] - a[j]) / math.dist(a, b) for j in (0, 1)]
            assert tuple(got[k, i]["at"]) == pytest.approx(at)
            assert tuple(got[k, i]["ends"][1]) == pytest.approx((at[0] - t[1] * reach, at[1] + t[0] * reach))


def test_composed(spark):
    items = [("a", c, i, float((i * 7) % 31)) for c, n in (("x", 30), ("y", 1), ("z", 12)) for i in range(n)] + [("none", "x", 1, 1.0)]
    canvas = spark.createDataFrame([("a", [(0.0, 0.0), (90.0, 0.0), (100.0, 60.0), (0.0, 60.0)], [(0.0, 30.0), (95.0, 30.0)]), ("empty", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)])], f"c string, points {P.POINTS}, axis {P.POINTS}")
    got = cells.composed(spark.createDataFrame(items, "c string, g string, i int, p double"), canvas, "c", "g", "i", "p").collect()
    assert sorted((r["g"], r["i"]) for r in got) == sorted((g, i) for c, g, i, _ in items if c == "a")
    assert sum(r["area"] for r in got) == pytest.approx(area([(0, 0), (90, 0), (100, 60), (0, 60)]))
    p = {(g, i): v for _, g, i, v in items}
    for tree in {(r["g"], r["tree"]) for r in got}:
        own = sorted((r for r in got if (r["g"], r["tree"]) == tree), key=lambda r: -p[r["g"], r["i"]])
        assert len(own) <= 12
        assert all(a["area"] >= b["area"] - 1e-5 for a, b in zip(own, own[1:], strict=False))
    nothing = cells.composed(spark.createDataFrame([], "c string, g string, i int, p double"), canvas, "c", "g", "i", "p")
    assert nothing.count() == 0


def test_best_cuts_by_batches(spark, capsys):
    """A level is cut an Arrow batch at once: no polygon is worked on corner by corner, and the polygons aren't sent to all tasks."""
    boxes = spark.range(50).selectExpr("id AS k", "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 40D + id, 'y', 0D), named_struct('x', 40D + id, 'y', 30D), named_struct('x', 0D, 'y', 30D)) AS points", "array(named_struct('x', 0D, 'y', 15D), named_struct('x', 40D + id, 'y', 15D)) AS axis", "1 + id % 6 AS n_leaves")
    cut = cells.best_cuts(cells.forest(boxes, ["k"]), boxes.select("k", "points", "axis"), ["k"], 3)
    cut.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 4 and "lambdafunction" not in plan and "BroadcastHashJoin" not in plan
    assert cut.where("configuration = -1").count() == sum(1 + i % 6 for i in range(50))


def test_area_cells_by_batches(spark, capsys):
    """Cells of many weights: no polygon is worked on corner by corner, and areas are as the weights."""
    shapes = spark.range(20).selectExpr("id AS k", "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 40D + id, 'y', 0D), named_struct('x', 0D, 'y', 30D)) AS points", "array(named_struct('x', 0D, 'y', 15D), named_struct('x', 40D + id, 'y', 15D)) AS axis")
    got = cells.area_cells(shapes, spark.range(20 * 40).selectExpr("id % 20 AS k", "id AS o", "1D + id % 7 AS w"), ["k"], "w", "o")
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 2 and "lambdafunction" not in plan and "BroadcastHashJoin" not in plan
    weights = {k: sum(1 + i % 7 for i in range(k, 800, 20)) for k in range(20)}
    assert all(r["area"] == pytest.approx((40 + r["k"]) * 15 * (1 + r["o"] % 7) / weights[r["k"]]) for r in got.collect())

"""Folds, segments and metrics against plain Python, and edge cases."""

import itertools
import math
import time
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import scalars
from reelspark.functions import vectors as V
from reelspark.operators import batch, distance, kernel_search, layout, metrics, sampling, scenes, segment, selection, signal
from reelspark.plans import keyframes
from reelspark.sources import providers, readers, writers


def vectors(spark, groups=3, n=12, d=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, n, d))
    x /= np.linalg.norm(x, axis=-1, keepdims=True)
    return x, spark.createDataFrame([(g, i, x[g, i].tolist()) for g in range(groups) for i in range(n)], "g int, pos long, v array<double>")


def greedy(scores, k, radius):
    out = []
    for p in sorted(range(len(scores)), key=lambda i: (scores[i], i)):
        if len(out) < k and all(abs(p - q) > radius for q in out):
            out.append(p)
    return sorted(out)


@pytest.mark.parametrize("k,radius", [(1, 0), (3, 0), (3, 2), (5, 20), (50, 0)])
def test_medoids(spark, k, radius):
    x, df = vectors(spark)
    got = selection.medoids(df, ["g"], "pos", "v", k, radius).groupBy("g").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
    for r in got:
        cost = np.round((1 - x[r["g"]] @ x[r["g"]].T).sum(1) - (1 - (x[r["g"]] ** 2).sum(1)), 9)
        assert r["p"] == greedy(cost.tolist(), k, radius)


def test_equal_costs_take_the_first(spark):
    df = spark.createDataFrame([(0, i, [1.0, 0.0]) for i in range(4)], "g int, pos long, v array<double>")
    assert selection.medoids(df, ["g"], "pos", "v").first()["pos"] == 0


def test_lone_frame_is_its_scene(spark):
    df = spark.createDataFrame([(0, 5, [1.0, 0.0])], "g int, pos long, v array<double>")
    assert selection.medoids(df, ["g"], "pos", "v", 3, 2).collect() == [(0, 5, 0.0)]


def test_random_picks_keep_apart(spark):
    _, df = vectors(spark)
    for r in selection.random_picks(df, ["g"], "pos", 4, 1, 3).groupBy("g").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect():
        assert all(b - a > 1 for a, b in itertools.pairwise(r["p"]))


def test_peaks_prefer_later_on_ties(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 3.0, 0.0, 3.0, 2.0])], "g int, t long, x double")
    assert [r["t"] for r in selection.peaks(df, ["g"], "t", "x", 1, 2).orderBy("t").collect()] == [1, 3]
    assert [r["t"] for r in selection.peaks(df, ["g"], "t", "x", 2, 1).collect()] == [3]


@pytest.mark.parametrize("n,cap", [(1, 1), (5, 1), (5, 2), (5, 5), (9, 4), (100, 7), (3, 10), (50, 49)])
def test_linspace(spark, n, cap):
    want = sorted(set(np.linspace(0, n - 1, cap, dtype=int).tolist())) if n > cap else list(range(n))
    kept = spark.range(n).where(scalars.linspace_kept(F.col("id"), F.lit(n), cap)).collect()
    assert [r[0] for r in kept] == want
    spread = spark.range(1).select(scalars.linspace_positions(F.lit(n), cap)).first()[0]
    assert spread == np.linspace(0, n - 1, cap, dtype=int).tolist()


def merged(rows, least):
    out = []
    for a, b in sorted((min(r), max(r)) for r in rows):
        if out and b - a + 1 < least:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut(bounds, total):
    out, before = [], 0
    for b in sorted(set(bounds)):
        if b > before:
            out.append((before, b))
            before = b + 1
    return [*out, (before, total - 1)] if before < total else out


def test_scenes_from_boundaries_and_merging(spark):
    rng = random.Random(5)
    cases = [sorted(rng.sample(range(30), rng.randint(0, 12))) for _ in range(60)] + [[0], [0, 1, 2], [29], list(range(30))]
    b = spark.createDataFrame([(i, x) for i, c in enumerate(cases) for x in c], "video_id int, frame_idx long")
    v = spark.createDataFrame([(i, 30) for i in range(len(cases))], "video_id int, total_frames long")
    found = scenes.from_boundaries(b, v)
    for least in (0, 3, 8):
        whole = {}
        for r in scenes.merge_short(found, least).collect():
            whole.setdefault(r["video_id"], []).append((r["start_frame"], r["end_frame"]))
        for i, c in enumerate(cases):
            assert sorted(whole[i]) == merged(cut(c, 30), least), (c, least)


def test_scene_helpers(spark):
    v = spark.createDataFrame([("a", 10), ("b", 0)], "video_id string, total_frames long")
    none = spark.createDataFrame([], "video_id string, start_frame long, end_frame long")
    assert sorted(scenes.or_whole_video(none, v).collect()) == [("a", 0, 9), ("b", 0, 0)]
    assert sorted(scenes.fixed_length(v, 4).collect()) == [("a", 0, 3), ("a", 4, 7), ("a", 8, 9)]
    s = spark.createDataFrame([("a", 9, 2), ("a", 12, 12), ("a", 20, 40)], "video_id string, start_frame long, end_frame long")
    assert scenes.ordered_bounds(s).first()[1:] == (2, 9)
    assert sorted(scenes.clamped(scenes.ordered_bounds(s), F.lit(5), F.lit(30)).collect()) == [("a", 5, 9), ("a", 20, 30)]
    t = spark.createDataFrame([(0.0, 1.0, 25.0), (2.0, 2.0, 25.0)], "start_sec double, end_sec double, fps double")
    assert [(r["start_frame"], r["end_frame"]) for r in scenes.from_seconds(t).collect()] == [(0, 24), (50, 50)]


def test_frames_in_scenes_across_blocks(spark):
    f = spark.range(100).select(F.lit("a").alias("v"), F.col("id").alias("frame_idx"))
    s = spark.createDataFrame([("a", 3, 50), ("a", 51, 51), ("a", 60, 59)], "v string, start_frame long, end_frame long")
    got = scenes.frames_in_scenes(f, s.where("start_frame <= end_frame"), ["v"], block=7).groupBy("start_frame").count().collect()
    assert {r[0]: r[1] for r in got} == {3: 48, 51: 1}


def test_covered_counts_both_ends(spark):
    s = spark.createDataFrame([("a", 0, 4), ("a", 5, 9), ("a", 10, 14), ("b", 0, 9)], "v string, start_frame long, end_frame long")
    k = spark.createDataFrame([("a", 4), ("a", 10)], "v string, frame_idx long")
    got = {(r["v"], r["start_frame"]): r["covered"] for r in scenes.covered(s, k, ["v"]).collect()}
    assert got == {("a", 0): True, ("a", 5): False, ("a", 10): True, ("b", 0): False}


def test_timecodes_carry(spark):
    df = spark.createDataFrame([(1990, 23.976), (0, 0.0), (90000, 25.0), (1499, 25.0)], "f long, r double")
    got = [tuple(r) for r in df.select(scalars.frames_to_timecode(F.col("f"), F.col("r")), scalars.timecode_or_zero(F.col("f"), F.col("r"))).collect()]
    assert got == [("00:01:23.000", "00:01:23.000"), ("00:00:00.000", "00:00:00.000"), ("01:00:00.000", "01:00:00.000"), ("00:00:59.960", "00:00:59.960")]


def test_names(spark):
    df = spark.createDataFrame([("scene_0003_frame_00000042.jpg",), ("img12_7.png",), ("none.jpg",), ("",)], "n string")
    got = [(*r[0], r[1]) for r in df.select(scalars.scene_and_frame(F.col("n")), scalars.first_number(F.col("n"))).collect()]
    assert got == [(3, 42, 3), (0, 7, 12), (0, 0, -1), (0, 0, -1)]
    p = spark.createDataFrame([("/a/b/x.tar.MP4",)], "p string").select(scalars.stem(F.col("p")), scalars.first_stem(F.col("p")), scalars.extension(F.col("p"))).first()
    assert tuple(p) == ("x.tar", "x", ".mp4")


def test_captions(spark):
    df = spark.createDataFrame([("A red Cat and a blue dog",), ("nothing here",)], "c string")
    got = [r[0] for r in df.select(scalars.caption_phrases(F.col("c"))).collect()]
    assert got[0][:4] == ["blue cat", "blue dog", "red cat", "red dog"] and got[1] == ["character", "cartoon"]


def test_signals_against_numpy(spark):
    rng = np.random.default_rng(3)
    for n in (3, 10, 11, 40):
        x = rng.normal(size=n)
        df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "g int, t long, x double")
        near = np.pad(x, 2, mode="edge")
        want = x if n < 5 else [np.median(near[i : i + 5]) for i in range(n)]
        assert np.allclose([r["x"] for r in signal.median_filter(df, ["g"], "t", "x").orderBy("t").collect()], want)
        if n >= 11:
            near = np.pad(x, 5, mode="reflect")
            want = [max((x[i] - near[i : i + 11].mean()) / (near[i : i + 11].std() + 1e-8), 0) for i in range(n)]
        else:
            want = x
        assert np.allclose([r["x"] for r in signal.local_zscore(df, ["g"], "t", "x").orderBy("t").collect()], want)


def test_running_best_stops(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 2.0, 2.0, 1.0, 2.0, 3.0])], "g int, t long, x double")
    assert signal.stop_at(df, ["g"], "t", "x", 3).first()["stop_at"] == 3


def test_pool_and_upsample(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(9)], "g int, t long, x double")
    p = signal.block_pool(df, ["g"], "t", "x", 1)
    assert [r["pooled"] for r in p.orderBy("block").collect()] == [0.75, 2.75, 4.75, 6.75]
    up = [r["value"] for r in signal.upsampled(p, ["g"], 8).orderBy("t").collect()]
    assert np.allclose(up, [0.75, 1.25, 2.25, 3.25, 4.25, 5.25, 6.25, 6.75])


def brute_change_points(x, penalty, least):
    n, best = len(x), None
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), r) for r in range(n)):
        ends = [*cuts, n]
        if all(b - a >= least for a, b in itertools.pairwise([0, *ends])):
            c = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in itertools.pairwise([0, *ends])) + penalty * (len(ends) - 1)
            if best is None or c < best[0] - 1e-9:
                best = c, ends
    return best


def test_change_points_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(25):
        x = rng.normal(size=rng.integers(4, 11)) + np.repeat([0, 3], [2, 20])[: 11][: 11].mean() * rng.integers(0, 2)
        penalty, least = float(rng.uniform(0.05, 3)), int(rng.integers(1, 4))
        ends = segment.change_points(x, penalty, least)
        got = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in itertools.pairwise([0, *ends])) + penalty * (len(ends) - 1)
        assert got == pytest.approx(brute_change_points(x, penalty, least)[0], abs=1e-7)


def brute_segments(b, wanted, least, most, radius):
    """The rules of the segments in plain Python, from the boundary scores of one sequence."""
    n = len(b) + 1
    steps = np.geomspace(0.05, max(5.0, 10 * (b.mean() + 1e-3)), 20) if len(b) else []
    found = [segment.change_points(b, p, least) if n > least else [n - 1] for p in steps] or [[0]]
    gaps = [abs(len(f) - wanted) for f in found]
    near = [i for i, g in enumerate(gaps) if g == min(gaps)]
    more = [i for i in near if len(found[i]) >= wanted]
    ends = found[near[0] if min(gaps) == 0 or not more else more[-1]]
    kept, last = [], -1
    for e in ends:
        if e - last >= least:
            kept.append(min(e, n - 1))
            last = e
    kept = [*kept[:-1], n - 1]
    out, s = [], 0
    for e in kept:
        pieces = -(-(e - s + 1) // most)
        cuts = []
        for i in sorted(range(s, e), key=lambda i: (-b[i], -i)):
            if len(cuts) < pieces - 1 and all(abs(i - c) > radius for c in cuts):
                cuts.append(i)
        cuts = sorted({*cuts, *[c for c in (s + k * most - 1 for k in range(1, pieces - len(cuts))) if c < e]}) if pieces > 1 else []
        parts, a = [], s
        for c in [*cuts, e]:
            if parts and c - a + 1 < least:
                parts[-1] = parts[-1][0], c
            else:
                parts.append((a, c))
            a = c + 1
        out += [(x, min(x + most - 1, q)) for p, q in parts for x in range(p, q + 1, most)]
        s = e + 1
    return out


@pytest.mark.parametrize("least,most", [(3, 8), (2, 5)])
def test_segments_against_plain_rules(spark, least, most):
    rng = np.random.default_rng(2)
    scores = [rng.uniform(size=n) ** 3 for n in (1, 2, 5, 20, 41, 60)] + [np.zeros(30), np.repeat([0.0, 1.0, 0.0], 12)]
    rows = spark.createDataFrame([(g, i, float(x)) for g, b in enumerate(scores) for i, x in enumerate(b)], "g int, pos long, score double")
    got = {}
    for r in segment.segmented(rows, ["g"], "pos", "score", least, most, 2, 10).collect():
        got.setdefault(r["g"], {})[r["segment_id"]] = (r["start_pos"], r["end_pos"])
    for g, b in enumerate(scores):
        wanted = int(np.clip(np.round((len(b) + 1) / most), 2, 10))
        assert [got[g][i] for i in range(len(got[g]))] == brute_segments(b, wanted, least, most, 2), g


def one_task_search(x, penalty, least):
    """Ends of the segments by the kernel cost, from the whole kernel at once."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    width = np.median(d[np.triu_indices(n, 1)]) if n > 1 else 1.0
    k = np.exp(-np.clip(d / (width or 1.0), 1e-2, 1e2))
    below = np.vstack([np.zeros(n + 1), np.hstack([np.zeros((n, 1)), k.cumsum(1)])]).cumsum(0)
    inside = lambda a, b: below[b, b] - below[a, b] - below[b, a] + below[a, a]
    total, came, open_ = [-penalty] + [math.inf] * n, [0] * (n + 1), []
    for b in range(1, n + 1):
        if b >= least and math.isfinite(total[b - least]):
            open_.append(b - least)
        if not open_:
            continue
        value = [total[a] + (b - a) * math.exp(-1e-2) - inside(a, b) / (b - a) for a in open_]
        best = min(range(len(open_)), key=lambda i: value[i])
        total[b], came[b] = value[best] + penalty, open_[best]
        open_ = [a for a, v in zip(open_, value, strict=True) if v <= total[b]]
    ends = [n]
    while math.isfinite(total[n]) and came[ends[-1]] > 0:
        ends.append(came[ends[-1]])
    return ends[::-1]


def stepped(rng, n, d=3):
    x, level = [], rng.normal(size=d)
    for _ in range(n):
        if rng.random() < 0.04:
            level = rng.normal(size=d) * 2
        x.append(level + rng.normal(0, 0.3, d))
    return np.array(x)


@pytest.mark.parametrize(("block", "least", "sizes"), [(16, 3, (1, 2, 3, 15, 16, 17, 33, 160)), (7, 10, (9, 10, 50, 90)), (400, 3, (1500, 300, 1))])
def test_kernel_search_over_blocks(spark, block, least, sizes):
    """Blocks in several tasks against one search with the whole kernel."""
    rng = np.random.default_rng(block)
    data = [stepped(rng, n) for n in sizes]
    rows = spark.createDataFrame([(s, i, v.tolist(), len(x), 3.0 + s) for s, x in enumerate(data) for i, v in enumerate(x)], "sid long, i long, x array<double>, n long, penalty double").repartition(5)
    got = {r["sid"]: r["ends"] for r in kernel_search.change_points(rows, least, block).collect()}
    assert got == {s: one_task_search(x, 3.0 + s, least) for s, x in enumerate(data)}
    assert max(map(len, got.values())) > 1
    assert kernel_search.change_points(rows.where("false"), least, block).count() == 0


def test_kernel_widths(spark):
    rng = np.random.default_rng(5)
    data = [stepped(rng, n) for n in (1, 2, 3, 4, 50, 231)] + [np.ones((6, 3))]
    blocks = [(s, b, x[b * 40 : b * 40 + 40].tolist(), float((x**2).sum(1).max())) for s, x in enumerate(data) for b in range(-(-len(x) // 40))]
    got = {r["sid"]: r["width"] for r in kernel_search.widths(spark.createDataFrame(blocks, "sid long, block long, xs array<array<double>>, top double")).collect()}
    for s, x in enumerate(data):
        d = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(len(x), 1)]
        assert got[s] == pytest.approx((np.median(d) if len(d) else 1.0) or 1.0)


def test_kernel_segments_cover(spark):
    _, df = vectors(spark, 2, 30, 4)
    rows = df.withColumn("q", F.element_at("v", 1))
    got = segment.kernel_segmented(rows, ["g"], "pos", "v", "q", 3, 8).orderBy("g", "segment_id").collect()
    for g in (0, 1):
        assert [i for r in got if r["g"] == g for i in range(r["start_pos"], r["end_pos"] + 1)] == list(range(30))
    assert all(r["end_pos"] - r["start_pos"] < 8 for r in got)


def test_peaks_and_valleys_by_prominence(spark):
    x = [0.0, 1.0, 0.9, 0.95, 0.2, 0.6, 0.5, 2.0, 0.0, 0.3, 0.1]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "g int, t long, x double")
    got = [(r["t"], r["frame"], r["kind"], round(r["prominence"], 6)) for r in signal.peaks_and_valleys(rows, ["g"], "t", "x", 0.05, 1).orderBy("t").collect()]
    assert got == [(1, 3, "peak", 0.8), (4, 6, "valley", 0.8), (5, 7, "peak", 0.1), (6, 8, "valley", 0.1), (7, 9, "peak", 2.0), (8, 10, "valley", 0.3), (9, 11, "peak", 0.2)]
    kept = [r["t"] for r in signal.peaks_and_valleys(rows, ["g"], "t", "x", 0.05, 1, 3).orderBy("t").collect()]
    assert kept == [1, 4, 7]  # the most prominent, not the farthest from the mean
    assert [r["t"] for r in signal.peaks_and_valleys(rows, ["g"], "t", "x", 0.5, 5).where("kind = 'peak'").orderBy("t").collect()] == [1, 7]
    s = signal.analyzer_summary(rows, signal.peaks_and_valleys(rows, ["g"], "t", "x", 0.5, 5), ["g"], "x").first()
    assert (s["n_peaks"], s["max_score"]) == (2, 2.0)


def plain_prominent(x, least, distance):
    """(place, prominence) of the maxima of one sequence, by looking at every row."""
    edges = [i for i in range(1, len(x)) if x[i] != x[i - 1]]
    runs = list(zip([0, *edges], [*edges, len(x)], strict=True))
    tops = [(s + e - 1) // 2 for (a, _), (s, e), (b, _) in zip(runs, runs[1:], runs[2:], strict=False) if x[a] < x[s] > x[b]]
    kept = []
    for p in sorted(tops, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    for p in sorted(kept):
        left = max((i for i in range(p) if x[i] > x[p]), default=0)
        right = min((i for i in range(p + 1, len(x)) if x[i] > x[p]), default=len(x) - 1)
        height = x[p] - max(min(x[left : p + 1]), min(x[p : right + 1]))
        if height >= least:
            yield p, height


@pytest.mark.parametrize(("block", "distance"), [(1, 3), (4, 1), (7, 5), (1024, 5)])
def test_peaks_over_blocks(spark, block, distance):
    rng = random.Random(block)
    walk = [0.0]
    for _ in range(210):
        walk.append(round(walk[-1] + rng.choice([-1.0, -0.5, 0.0, 0.0, 0.5, 1.0]), 3))
    sequences = {"walk": walk, "noise": [round(rng.random(), 1) for _ in range(90)], "flat": [1.0] * 20, "up": [float(i) for i in range(30)], "one": [2.0], "saw": [float(i % 7 - (i % 2) * 3) for i in range(60)]}
    rows = spark.createDataFrame([(g, i, v) for g, x in sequences.items() for i, v in enumerate(x)], "g string, t long, x double").repartition(3)
    got = {(r["g"], r["t"], r["kind"]): r["prominence"] for r in signal.peaks_and_valleys(rows, ["g"], "t", "x", 0.3, distance, 1000, block).collect()}
    want = {(g, p, kind): h for g, x in sequences.items() for kind, y in (("peak", x), ("valley", [-v for v in x])) for p, h in plain_prominent(y, 0.3, distance)}
    assert got == pytest.approx(want)
    assert len(got) > 40


@pytest.mark.parametrize("beta", [0.0, 0.3, 0.9, 1.0])
def test_ema(spark, beta):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(v)) for g, n in ((0, 700), (1, 1), (None, 30)) for i, v in enumerate(rng.normal(size=n) * 10.0 ** rng.integers(0, 4))]
    got = {(r["g"], r["t"]): r["ema"] for r in signal.ema(spark.createDataFrame(rows, "g int, t long, x double"), ["g"], "t", "x", beta).collect()}
    b = {}
    for g, t, x in rows:
        b[g] = beta * b[g] + (1 - beta) * x if g in b else x
        assert got[g, t] == pytest.approx(b[g], rel=1e-9, abs=1e-9), (g, t)


def test_positions_in_the_order_of_all(spark):
    rng = random.Random(2)
    values = [rng.choice([None, 1.0, 2.5, rng.uniform(-5, 5)]) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x double").repartition(5)
    got = {r["i"]: r["at"] for r in sampling.global_position(rows, "x", ["i"], "at").collect()}
    order = sorted(range(3000), key=lambda i: (values[i] is not None, values[i] or 0.0, i))
    assert [got[i] for i in order] == list(range(3000))
    assert sampling.global_position(rows.where("false"), "x", ["i"], "at").collect() == []


def test_grown_trees(spark):
    for n in (1, 2, 5, 12):
        nodes = layout.grown_tree(spark, n)
        shape = layout.tree_shape(layout.tree_depths(nodes), nodes).first()
        assert shape["n_leaves"] == n and shape["height"] <= n
    with pytest.raises(KeyError):
        layout.grown_tree(spark, 2, "sideways")


def test_diversity_without_pairs(spark):
    x, df = vectors(spark)
    got = {r["g"]: (r["diversity"], r["redundancy"]) for r in metrics.diversity(df, ["g"], "v").collect()}
    for g, (d, r) in got.items():
        sims = (x[g] @ x[g].T)[np.triu_indices(12, 1)]
        assert d == pytest.approx(1 - sims.mean()) and r == pytest.approx(sims.mean())
    lone = metrics.diversity(df.where("pos = 0"), ["g"], "v").first()
    assert lone["diversity"] == 0.0 and lone["redundancy"] is None


def test_multi_scale_wasserstein(spark):
    _, df = vectors(spark, 2, 20, 3)
    assert all(r["swd"] < 1e-12 for r in metrics.multi_scale_wasserstein(df, df, ["g"], "pos", "v", 3).collect())
    moved = df.withColumn("v", F.transform("v", lambda e: e + 1))
    assert all(r["swd"] > 0.1 for r in metrics.multi_scale_wasserstein(df, moved, ["g"], "pos", "v", 3).collect())


def test_metrics_of_all_frames_as_keys(spark):
    _, df = vectors(spark)
    m = metrics.nearest_key_metrics(df, df.withColumnRenamed("pos", "key_idx"), ["g"], "pos", "v").collect()
    assert all(abs(r["rec_error"]) < 1e-9 and r["temporal_coverage"] == 1 for r in m)


def test_no_keys_give_null(spark):
    _, df = vectors(spark)
    none = df.where("false").withColumnRenamed("pos", "key_idx")
    m = metrics.nearest_key_metrics(df, none, ["g"], "pos", "v").first()
    assert m["rec_error"] is None and m["temporal_coverage"] is None


def test_frechet(spark):
    x, df = vectors(spark, 2, 20, 3)
    got = {r["g"]: r["frechet"] for r in metrics.frechet_distance(df, df.where("pos < 7"), ["g"], "v").collect()}
    assert all(got[g] == pytest.approx(metrics.frechet(x[g], x[g][:7]), rel=1e-6) for g in got)
    assert metrics.frechet_distance(df, df.where("pos < 1"), ["g"], "v").first()["frechet"] is None


def test_sliced_wasserstein(spark):
    _, df = vectors(spark, 2, 20, 3)
    assert all(r["swd"] < 1e-12 for r in metrics.sliced_wasserstein(df, df, ["g"], "pos", "v", 3).collect())
    moved = df.withColumn("v", F.transform("v", lambda e: e + 1))
    assert all(r["swd"] > 0.1 for r in metrics.sliced_wasserstein(df, moved, ["g"], "pos", "v", 3).collect())


def test_snapping_prefers_the_earlier(spark):
    k = spark.createDataFrame([("a", 5), ("a", 99), ("b", 10)], "v string, frame_idx long")
    s = spark.createDataFrame([("a", 4), ("a", 6), ("b", 10), ("b", 20)], "v string, frame_idx long")
    assert sorted(metrics.snapped_keys(k, s, ["v"]).collect()) == [("a", 4), ("a", 6), ("b", 10)]


def test_similar_keys_go(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [1.0, 0.01]), (0, 2, [0.0, 1.0])], "g int, pos long, v array<double>")
    assert [r["pos"] for r in selection.without_similar(df, ["g"], "pos", "v").orderBy("pos").collect()] == [0, 2]


def test_registry():
    assert {"cosine", "l1", "l2", "psnr", "dssim"} <= set(distance.MEASURES) and "COSINE " in distance.MEASURES
    with pytest.raises(KeyError):
        distance.MEASURES["none"]
    with pytest.raises(ValueError):
        distance.MEASURES.put(" Cosine ", V.l1)


def test_batch_metrics(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("b", "m", float("nan")), ("c", "m", None), ("d", "m", 3.0), ("a", "z", float("nan"))], "video_id string, metric string, value double")
    got = {r["metric"]: (r["mean"], r["std"], r["n"]) for r in batch.metric_summary(df, ["metric"]).collect()}
    assert got == {"m": (2.0, 1.0, 2), "z": (None, None, 0)}
    assert batch.grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).orderBy("iter").collect()[4] == (4, 2, "y")
    s = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "iter long, score double")
    assert batch.best_setting(s).first()["iter"] == 1
    assert batch.in_all(spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "v string, g int"), "v", "g").collect() == [("x",)]
    card = spark.createDataFrame([(0.5, 2.0, None)], "a double, b double, c double").select(batch.scorecard(None, {"representativeness": F.col("a"), "coverage": F.col("b"), "diversity": F.col("c")})).first()[0]
    assert card == pytest.approx(0.45)


def test_layout(spark):
    items = spark.createDataFrame([(0, i, float(v), 1.0) for i, v in enumerate([1.0, 3.0, float("nan"), 2.0])], "g int, i int, s double, q double")
    got = {r["i"]: (r["priority"], r["priority_rank"]) for r in layout.priorities(items, ["g"], {"s": 0.6, "q": 0.4}, "i").collect()}
    assert got[1][1] == 0 and got[0] == (pytest.approx(0.2), 3) and got[2][0] == pytest.approx(0.5)
    nodes = spark.createDataFrame([(0, "r", None, ""), (0, "a", "r", "0"), (0, "b", "r", "1"), (0, "c", "b", "0"), (0, "d", "b", "1")], "tree_id int, node_id string, parent_id string, side string")
    depths = layout.tree_depths(nodes)
    assert [r["node_id"] for r in layout.leaves(depths, nodes).orderBy("leaf").collect()] == ["a", "c", "d"]
    assert layout.tree_shape(depths, nodes).first()[1:] == (2, 3)
    filled = layout.fill_depths(spark.range(3).withColumnRenamed("id", "item"), layout.depth_histogram(layout.leaves(depths, nodes)), "item")
    assert sorted(filled.collect()) == [(0, 2), (1, 2), (2, 1)]
    assert [r["n_leaves"] for r in layout.leaf_budget(spark.createDataFrame([(25,)], "n long")).collect()] == [12, 12, 1]
    box = spark.createDataFrame([(0, i, w, 0.0, 0.0, 10.0, 4.0) for i, w in enumerate([1.0, 3.0])], "g int, i int, w double, x1 double, y1 double, x2 double, y2 double")
    assert [(r["cell_x1"], r["cell_x2"]) for r in layout.strips(box, ["g"], "w", "i").orderBy("i").collect()] == [(0.0, 2.5), (2.5, 10.0)]
    square = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)],)], "p array<struct<x:double,y:double>>")
    assert square.select(layout.good_cell(F.col("p"))).first()[0] and np.allclose(square.select(layout.polygon_angles(F.col("p"))).first()[0], 90)


def test_baselines(spark):
    v = spark.createDataFrame([("a", 20)], "video_id string, total_frames long")
    s = scenes.fixed_length(v, 7)
    assert [r[1] for r in sampling.middle_of_scene(s, v, 2).orderBy("frame_idx").collect()] == [3, 16]
    assert [r[1] for r in sampling.middle_of_scene(s, v, 5).orderBy("frame_idx").collect()] == [0, 3, 10, 16, 19]


def test_whole_plan_over_videos(spark):
    b = spark.createDataFrame([("a", 4), ("a", 5), ("a", 12)], "video_id string, frame_idx long")
    v = spark.createDataFrame([("a", 20, 25.0), ("b", 8, 25.0)], "video_id string, total_frames long, fps double")
    got = [(r["video_id"], r["scene_id"], r["start_frame"], r["end_frame"]) for r in keyframes.scene_table(b, v, 3).orderBy("video_id", "scene_id").collect()]
    assert got == [("a", 0, 0, 4), ("a", 1, 5, 12), ("a", 2, 13, 19), ("b", 0, 0, 7)]
    with pytest.raises(ValueError):
        keyframes.choose(v, ["video_id"], "fps", "fps", "best")


def test_sources_and_sinks(spark, tmp_path):
    keys = spark.createDataFrame([(0, 7, 0.12345678), (0, 3, 0.5)], "scene_id int, frame_idx long, score double")
    writers.keyframes(keys, f"{tmp_path}/k")
    assert [r[0] for r in readers.keyframes(spark, f"{tmp_path}/k").collect()] == [3, 7]
    (tmp_path / "blank.csv").write_text("frame_global,p\n9,0.1\n,0.2\n9,0.3\n")
    assert [r[0] for r in readers.keyframes(spark, f"{tmp_path}/blank.csv").collect()] == [9, 9]
    assert readers.keyframe_rows(spark, f"{tmp_path}/blank.csv").first()["selected"] is None
    (tmp_path / "v").mkdir()
    for n in ("b.MP4", "a.mp4", "c.mkv"):
        (tmp_path / "v" / n).write_bytes(b"x")
    assert [r["video_id"] for r in readers.videos(spark, f"{tmp_path}/v").collect()] == ["a", "b"]
    assert [r["video_id"] for r in readers.videos_in(spark, f"{tmp_path}/v").collect()] == ["a", "c"]
    (tmp_path / "r/x").mkdir(parents=True)
    (tmp_path / "r/x/eval_results.json").write_text('{"method": {"RecErr": 0.5, "n": null}, "uniform": {"RecErr": 1}}')
    (tmp_path / "r/y").mkdir()
    (tmp_path / "r/y/eval_results.json").write_text("not json")
    assert sorted(tuple(r)[:3] for r in readers.evaluation_results(spark, f"{tmp_path}/r/*/eval_results.json").where("value IS NOT NULL").collect()) == [("x", "method", "RecErr"), ("x", "uniform", "RecErr")]
    rows = spark.createDataFrame([("a", "m", "RecErr", 1.0)], "video_id string, method string, metric string, value double")
    assert '"RecErr"' in writers.nested_results(rows).first()["json"]
    s = spark.createDataFrame([("a", 0, 0, 4)], "video_id string, scene_id int, start_frame long, end_frame long")
    writers.scenes(s, f"{tmp_path}/s")
    assert readers.scenes(spark, f"{tmp_path}/s/scenes.json").first()["end_frame"] == 4


def test_grids_summaries_and_caches(spark, tmp_path):
    (tmp_path / "grid.json").write_text('{"tau": [0.1, 0.3], "k": 4, "mode": ["a", "b", "c"]}')
    g = readers.grid(spark, f"{tmp_path}/grid.json").orderBy("iter").collect()
    assert len(g) == 6 and tuple(g[4]) == (4, 0.3, 4, "b")
    (tmp_path / "summary.json").write_text('{"results": {"v1": {"metrics": {"method": {"RecErr": 0.5, "Frechet": null}}}, "v2": {"metrics": {"RecErr": 1}}}, "errors": {}}')
    assert sorted(tuple(r) for r in readers.summary(spark, f"{tmp_path}/summary.json").where("value IS NOT NULL").collect()) == [("v1", "RecErr", 0.5), ("v2", "RecErr", 1.0)]
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [readers.cached(spark, f"{tmp_path}/c", make).count() for _ in range(2)] == [3, 3] and made == [1]


def test_checked_batches(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("c", float("nan")), ("d", 3.0)], "video_id string, RecErr double")
    c = batch.checked(rows, {"missing": F.col("RecErr").isNotNull(), "unknown": ~F.isnan("RecErr")})
    assert {r["video_id"]: r["error"] for r in c.collect()} == {"a": None, "b": "missing", "c": "unknown", "d": None}
    s = batch.summary_document(c, "video_id", ["RecErr"]).first()
    assert (s["total_processed"], s["total_failed"], s["aggregate_metrics"]["RecErr_mean"]) == (2, 2, 2.0) and '"total_failed":2' in s["json"]


def test_providers(spark):
    name = "brightness-test"
    if name not in providers.PROVIDERS:
        providers.PROVIDERS.put(name, providers.Provider(lambda b: b.assign(twice=b["i"] * 2)[["i", "twice"]], "i long, twice long"))
    assert providers.apply(spark.range(3).withColumnRenamed("id", "i"), name).agg(F.sum("twice")).first()[0] == 6
    with pytest.raises(KeyError):
        providers.apply(spark.range(1), "none")


def test_scores(spark):
    df = spark.createDataFrame([(float("nan"), 5.0, 100.0)], "a double, b double, m double")
    r = df.select(scalars.first_finite(F.col("a"), F.col("b")), scalars.quality_from_distortion(F.lit(-1.0)), scalars.exposure(F.col("m")), scalars.combined_objective(F.col("a"), F.col("b"), F.col("m"))).first()
    assert tuple(r) == (5.0, 1.0, 199.0, 100.0)
    assert spark.range(1).select(scalars.chunks(F.array(*[F.lit(i) for i in range(5)]), 2)).first()[0] == [[0, 1], [2, 3], [4]]
    assert np.allclose(spark.range(1).select(scalars.geomspace(1.0, 100.0, 3)).first()[0], [1, 10, 100])
    assert math.isclose(spark.range(1).select(scalars.position_encoding(F.lit(1), 4)).first()[0][0], math.sin(1))


def test_detectors(spark):
    v = spark.createDataFrame([("a", 10)], "video_id string, total_frames long")
    p = spark.createDataFrame([("a", 3, 0.5), ("a", 6, 0.51)], "video_id string, frame_idx long, p double")
    assert sorted(scenes.DETECTORS[" Threshold "](v, p).collect()) == [("a", 0, 6), ("a", 7, 9)]
    assert scenes.DETECTORS["fixed"](v, length=6).count() == 2
    with pytest.raises(KeyError):
        scenes.DETECTORS["none"]
    with pytest.raises(ValueError):
        scenes.DETECTORS.put("FIXED", lambda v: v)


def test_nan_frames_are_left_out(spark):
    f = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [float("nan"), 1.0]), (0, 2, [0.0, 1.0])], "g int, pos long, v array<double>")
    r = keyframes.evaluate(f, {"m": f.select("g", "pos").where("pos = 0")}, ["g"], "pos", "v").first()
    assert (r["n_keys"], r["rec_error"]) == (1, 0.5)


def test_rescaling(spark):
    df = spark.createDataFrame([(4096.0, 2048.0), (500.0, 20.0)], "w double, h double")
    assert [tuple(r[0]) for r in df.select(scalars.rescaled(F.col("w"), F.col("h"))).collect()] == [(1024, 512), (500, 64)]
    assert spark.range(1).select(scalars.set_only(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("")))).first()[0] == {"a": "x"}


def test_no_window_goes_over_all_following_rows(spark, capsys):
    """A frame from the row to the end is worked out anew for each row; running ones from the far end give the same."""
    df = spark.createDataFrame([(g, float(i // 3), i % 4 % 2, i) for g in (1, None) for i in range(60)], "g int, d double, same int, id int")
    got = metrics.average_precision(df, ["g"], "d", "same", "id")
    frames = spark.range(40).selectExpr("id % 2 AS g", "id * 3 AS frame_idx")
    for x in (got, metrics.snapped_keys(spark.range(9).selectExpr("id % 2 AS g", "id * 7 + 1 AS frame_idx"), frames, ["g"]), scenes.covered(spark.range(5).selectExpr("id % 2 AS g", "id * 9 AS start_frame", "id * 9 + 3 AS end_frame"), frames, ["g"])):
        x.explain()
    assert "currentrow$(), unboundedfollowing" not in capsys.readouterr().out.lower()
    want, found, places = 0.0, 0, []
    for n, i in enumerate(range(60), 1):
        found += i % 4 % 2
        places.append((found / n, i % 4 % 2))
    want = sum(same * max(p for p, _ in places[i:]) for i, (_, same) in enumerate(places)) / found
    assert {r["g"]: r["average_precision"] for r in got.collect()} == {1: pytest.approx(want), None: pytest.approx(want)}


@pytest.mark.parametrize("least", [1, 3, 7])
def test_change_points_side_by_side(least):
    """Many sequences at once, the same as one by one, in a fraction of the time."""
    rng = np.random.default_rng(least)
    data = [np.round(np.repeat(rng.random(1 + n // 9), 9)[:n] + rng.normal(0, 0.05, n), 2) for n in rng.integers(least, 90, 400)]
    penalties = (0.05 * np.exp(rng.random(400) * 4)).tolist()
    start = time.perf_counter()
    got = segment._searched(data, penalties, least)
    together = time.perf_counter() - start
    start = time.perf_counter()
    assert got == [[len(b)] if len(b) + 1 <= least else segment.change_points(b, p, least) for b, p in zip(data, penalties, strict=True)]
    assert together < (time.perf_counter() - start) / 3
    assert max(map(len, got)) > 2


@pytest.mark.parametrize("block", [7, 5000])
def test_closest_by_blocks(spark, capsys, block):
    """The least distance of all pairs, without a row for each pair."""
    rng = np.random.default_rng(1)
    data = {g: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 5))) for g, n in enumerate((1, 2, 7, 8, 3000))}
    df = spark.createDataFrame([(g, i, v.tolist()) for g, x in data.items() for i, v in enumerate(x) if block > 100 or g < 4], "g int, i int, v array<double>")
    got = distance.closest(df, ["g"], "i", "v", block)
    want = {g: 1 - (x @ x.T)[np.triu_indices(len(x), 1)].max() for g, x in data.items() if 1 < len(x) and (block > 100 or g < 4)}
    assert {r["g"]: r["d"] for r in got.collect()} == pytest.approx(want)
    metrics.redundancy(df, ["g"], "i", "v").explain()
    assert "i#" not in "".join(line for line in capsys.readouterr().out.splitlines() if "Join" in line)


def test_kernel_search_takes_tiles_alone(spark, monkeypatch):
    """However many blocks a sequence has, Python gets one pair of them at a time."""
    taken = spark.sparkContext.accumulator(0)
    most = []
    data = np.random.default_rng(2).normal(size=(160, 3))
    blocks = spark.createDataFrame([(0, b, data[b * 8 : b * 8 + 8].tolist(), float((data**2).sum(1).max())) for b in range(20)], "sid long, block long, xs array<array<double>>, top double").coalesce(1)
    each = kernel_search._each

    def counted(rows, keys, of, schema):
        def one(batches):
            held = list(batches)
            taken.add(max(0, sum(map(len, held)) - 1))
            return of(iter(held))

        most.append(keys)
        return each(rows, keys, one, schema)

    monkeypatch.setattr(kernel_search, "_each", counted)
    d = ((data[:, None] - data[None]) ** 2).sum(-1)[np.triu_indices(160, 1)]
    assert kernel_search.widths(blocks).first()["width"] == pytest.approx(np.median(d))
    assert most == [["sid", "block", "b"]] * 2 and taken.value == 0


def moved(spark):
    """Bytes that tasks have given to exchanges so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_kernel_search_moves_rows_once(spark, monkeypatch):
    """Exchanges get a sequence's vectors, not each pair of its blocks."""
    monkeypatch.setattr(kernel_search, "WHOLE", 1, raising=False)
    data = np.random.default_rng(3).normal(size=(160, 200))
    rows = spark.createDataFrame([(0, i, v.tolist(), 160, 30.0) for i, v in enumerate(data)], "sid long, i long, x array<double>, n long, penalty double")
    began = moved(spark)
    assert kernel_search.change_points(rows, 3, 20).first()["ends"] == one_task_search(data, 30.0, 3)
    assert moved(spark) - began < 4 * data.nbytes


@pytest.mark.parametrize(("block", "least", "penalties", "sizes"), [(16, 3, (0.4, 5.0, 6.0), (100, 30, 17)), (9, 8, (0.3, 1.0), (40, 60)), (12, 2, (2.0, 30.0), (60, 33))])
def test_kernel_search_in_steps(spark, monkeypatch, block, least, penalties, sizes):
    """Sequences that no task sees whole, with small penalties, by which starts end within a block."""
    monkeypatch.setattr(kernel_search, "WHOLE", 1)
    rng = np.random.default_rng(block)
    data = [stepped(rng, n) for n in sizes]
    rows = spark.createDataFrame([(s, i, v.tolist(), len(x), p) for s, (x, p) in enumerate(zip(data, penalties, strict=True)) for i, v in enumerate(x)], "sid long, i long, x array<double>, n long, penalty double").repartition(3)
    got = {r["sid"]: r["ends"] for r in kernel_search.change_points(rows, least, block).collect()}
    assert got == {s: one_task_search(x, p, least) for s, (x, p) in enumerate(zip(data, penalties, strict=True))}
    assert len(got[0]) > 2


def test_kernel_widths_by_finer_ranges(spark, monkeypatch):
    """The middle range is divided until few pairs are left; equal distances and a gap in the middle do no harm."""
    monkeypatch.setattr(kernel_search, "FEW", 0)
    monkeypatch.setattr(kernel_search, "PANEL", 50)
    rng = np.random.default_rng(9)
    data = [rng.normal(size=(70, 3)), np.repeat(rng.normal(size=(4, 3)), 9, 0), np.array([[0.0], [1.0], [1.0], [101.0]]) * np.ones(3), np.ones((5, 3)), np.ones((1, 3))]
    blocks = [(s, b, x[b * 8 : b * 8 + 8].tolist(), float((x**2).sum(1).max())) for s, x in enumerate(data) for b in range(-(-len(x) // 8))]
    got = {r["sid"]: r["width"] for r in kernel_search.widths(spark.createDataFrame(blocks, "sid long, block long, xs array<array<double>>, top double")).collect()}
    for s, x in enumerate(data):
        d = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(len(x), 1)]
        want = (np.median(d) if len(d) else 1.0) or 1.0
        assert got[s] == pytest.approx(want) and kernel_search._width(x) == pytest.approx(want)


def test_names_are_taken_apart_once(spark, capsys):
    """Parts of images' names are listed once for both rules of containment, and not gathered before they are looked up."""
    files = spark.createDataFrame([(1, "n/5_a.jpg"), (1, "n/6_a.jpg"), (1, "n/")], "k int, file string")
    images = spark.createDataFrame([(1, "x5_a.jpg"), (1, "zn/5_a.jpg.tmp"), (1, "y6_a.jpg"), (1, "y6_a.jpg6_a.jpg")], "k int, image string")
    got = layout.matched_by_name(files, images, ["k"])
    got.explain()
    assert capsys.readouterr().out.count("Generate explode") == 1
    assert {r["file"]: r["image"] for r in got.collect()} == {"n/5_a.jpg": "zn/5_a.jpg.tmp", "n/6_a.jpg": "y6_a.jpg", "n/": "zn/5_a.jpg.tmp"}

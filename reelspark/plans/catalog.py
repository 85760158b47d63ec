"""Queries over the given tables, and the same in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import scalars
from reelspark.functions import vectors as V
from reelspark.operators import batch, distance, layout, metrics, sampling, scenes, segment, selection, signal
from reelspark.plans import keyframes
from reelspark.plans.tables import frames, table, videos
from reelspark.plans.tables import signal as signal_rows
from reelspark.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_FRAMES = "f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding::DOUBLE[] AS v FROM embeddings)"
_COSTS = f"{_FRAMES}, c AS (SELECT f.label, f.vec_id, f.pos, f.v, round(coalesce(sum(1 - list_dot_product(f.v, g.v)) FILTER (f.pos <> g.pos), 0), 9) AS cost FROM f JOIN f g USING (label) GROUP BY ALL)"
_SIGNAL = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, event_type FROM events)"
_VIDEOS = "v AS (SELECT user_id, count(*) AS total FROM events GROUP BY user_id)"
_KEYS3 = f"""{_FRAMES}, n AS (SELECT label, count(*) AS n FROM f GROUP BY label),
    k AS (SELECT DISTINCT f.label, f.pos AS key_idx, f.v AS kv FROM f JOIN n USING (label), generate_series(0, 2) g(i)
          WHERE f.pos = CASE WHEN i = 2 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 2)) END)"""


@query(f"WITH {_COSTS} SELECT label, vec_id, round(cost, 6) AS cost FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY cost, pos) = 1")
def medoid_per_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    best = selection.medoids(f, ["label"], "pos", "embedding")
    return best.join(f, ["label", "pos"]).select("label", "vec_id", _r("score").alias("cost"))


@query(f"""WITH RECURSIVE {_COSTS}, p(label, step, picks) AS (
    SELECT DISTINCT label, 0, []::BIGINT[] FROM c
    UNION ALL
    SELECT p.label, p.step + 1, list_append(p.picks, arg_min(c.pos, (c.cost, c.pos))) FROM p JOIN c ON c.label = p.label
    WHERE p.step < 3 AND len(list_filter(p.picks, lambda x: abs(x - c.pos) <= 2)) = 0 GROUP BY p.label, p.step, p.picks)
SELECT label, unnest(picks) AS pos FROM p WHERE step = 3""")
def medoid_topk_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.medoids(frames(spark, sf_dir), ["label"], "pos", "embedding", k=3, radius=2).select("label", "pos")


@query(f"WITH {_FRAMES} SELECT a.label, round(avg(list_dot_product(a.v, b.v)), 6) AS redundancy, round(min(1 - list_dot_product(a.v, b.v)), 6) AS min_distance, round(avg(1 - list_dot_product(a.v, b.v)), 6) AS diversity FROM f a JOIN f b ON a.label = b.label AND a.pos < b.pos GROUP BY a.label")
def pairwise_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.redundancy(frames(spark, sf_dir), ["label"], "pos", "embedding")
    return m.select("label", _r("redundancy").alias("redundancy"), _r("min_distance").alias("min_distance"), _r("diversity").alias("diversity"))


def _three_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, sf_dir)
    n = f.groupBy("label").agg(F.count(F.lit(1)).alias("total_frames"))
    k = sampling.uniform(n, 3).withColumnRenamed("frame_idx", "pos").distinct().join(f, ["label", "pos"])
    return f, k.select("label", F.col("pos").alias("key_idx"), "embedding")


@query(f"WITH {_KEYS3}, m AS (SELECT label, pos, max(list_dot_product(v, kv)) AS s FROM f JOIN k USING (label) GROUP BY ALL) SELECT label, round(avg(1 - s), 6) AS rec_error, round(avg((1 - s <= 0.9)::INT), 6) AS temporal_coverage FROM m GROUP BY label")
def rec_error_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.nearest_key_metrics(*_three_keys(spark, sf_dir), ["label"], "pos", "embedding", tau=0.9)
    return m.select("label", _r("rec_error").alias("rec_error"), _r("temporal_coverage").alias("temporal_coverage"))


@query(f"WITH {_KEYS3} SELECT label, pos, key_idx, round(list_dot_product(v, kv), 6) AS similarity FROM f JOIN k USING (label) QUALIFY row_number() OVER (PARTITION BY label, pos ORDER BY list_dot_product(v, kv) DESC, key_idx) = 1")
def nearest_key_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = distance.nearest_key(*_three_keys(spark, sf_dir), ["label"], "pos", "embedding")
    return n.select("label", "pos", "key_idx", _r("similarity").alias("similarity"))


@query(f"""WITH {_KEYS3}, a AS (SELECT label, pos, key_idx, list_dot_product(v, kv) AS s FROM f JOIN k USING (label) QUALIFY row_number() OVER (PARTITION BY label, pos ORDER BY s DESC, key_idx) = 1)
SELECT label, key_idx, pos FROM a QUALIFY row_number() OVER (PARTITION BY label, key_idx ORDER BY s DESC, pos) <= 4""")
def nearest_key_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = distance.nearest_key(*_three_keys(spark, sf_dir), ["label"], "pos", "embedding")
    return metrics.nearest_per_key(n, ["label"], "pos", 4).select("label", "key_idx", "pos")


_BLOCKS = f"{_VIDEOS}, b AS (SELECT user_id, i * 7 AS start_frame, least(i * 7 + 6, total - 1) AS end_frame FROM v, generate_series(0, 100000) g(i) WHERE i * 7 < total)"


@query(f"WITH {_SIGNAL}, {_BLOCKS}, k AS (SELECT user_id, t FROM s WHERE event_type = 'error') SELECT user_id, round(avg(EXISTS (SELECT 1 FROM k WHERE k.user_id = b.user_id AND k.t BETWEEN b.start_frame AND b.end_frame)::INT), 6) AS scene_coverage FROM b GROUP BY user_id")
def scene_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = scenes.fixed_length(videos(spark, sf_dir).drop("fps"), 7)
    keys = signal_rows(spark, sf_dir, "event_type").where("event_type = 'error'").select("user_id", F.col("t").alias("frame_idx"))
    return metrics.scene_coverage(cut, keys, ["user_id"]).select("user_id", _r("scene_coverage").alias("scene_coverage"))


@query(f"WITH {_SIGNAL}, {_BLOCKS} SELECT s.user_id, t, start_frame, end_frame FROM s JOIN b ON s.user_id = b.user_id AND t BETWEEN start_frame AND end_frame")
def frames_in_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = scenes.fixed_length(videos(spark, sf_dir).drop("fps"), 7)
    return scenes.frames_in_scenes(signal_rows(spark, sf_dir).drop("value"), cut, ["user_id"], "t").select("user_id", "t", "start_frame", "end_frame")


@query(f"""WITH {_SIGNAL}, i AS (SELECT user_id, t AS frame_idx FROM s WHERE t % 5 = 0), k AS (SELECT user_id, t AS frame_idx FROM s WHERE event_type = 'purchase'),
both_ AS (SELECT user_id, frame_idx FROM k SEMI JOIN i USING (user_id, frame_idx)), rest AS (SELECT * FROM k WHERE user_id NOT IN (SELECT user_id FROM both_)),
near AS (SELECT DISTINCT rest.user_id, i.frame_idx FROM rest JOIN i USING (user_id) QUALIFY row_number() OVER (PARTITION BY rest.user_id, rest.frame_idx ORDER BY abs(i.frame_idx - rest.frame_idx), i.frame_idx) = 1)
SELECT * FROM both_ UNION ALL SELECT DISTINCT user_id, frame_idx FROM near""")
def snap_to_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal_rows(spark, sf_dir, "event_type").withColumnRenamed("t", "frame_idx")
    return metrics.snapped_keys(s.where("event_type = 'purchase'"), s.where("frame_idx % 5 = 0"), ["user_id"])


@query(f"""WITH {_FRAMES}, s AS (SELECT *, (pos // 2) AS i, count(*) OVER (PARTITION BY label) AS n FROM f WHERE pos % 2 = 0)
SELECT label, vec_id FROM s WHERE n <= 9 OR i IN (SELECT CASE WHEN j = 8 THEN n - 1 ELSE floor(j * ((n - 1)::DOUBLE / 8)) END FROM generate_series(0, 8) g(j))""")
def stride_cap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stride_and_cap(frames(spark, sf_dir), ["label"], ["vec_id"], 2, 9).select("label", "vec_id")


@query(f"WITH {_VIDEOS} SELECT user_id, (CASE WHEN i = 4 THEN total - 1 ELSE floor(i * ((total - 1)::DOUBLE / 4)) END)::BIGINT AS frame_idx FROM v, generate_series(0, 4) g(i)")
def uniform_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(videos(spark, sf_dir).drop("fps"), 5).select("user_id", "frame_idx")


@query(f"""WITH {_BLOCKS}, m AS (SELECT user_id, list((start_frame + end_frame) // 2 ORDER BY start_frame) AS x, max(end_frame) + 1 AS n, count(*) AS c FROM b GROUP BY user_id)
SELECT user_id, x[(CASE WHEN i = 5 THEN c - 1 ELSE floor(i * ((c - 1)::DOUBLE / 5)) END)::BIGINT + 1] AS frame_idx FROM m, generate_series(0, 5) g(i) WHERE c >= 6
UNION ALL SELECT user_id, unnest(x) FROM m WHERE c < 6
UNION ALL SELECT user_id, (CASE WHEN 6 - c = 1 THEN 0 WHEN i = 5 - c THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / (5 - c))) END)::BIGINT FROM m, generate_series(0, 5) g(i) WHERE c < 6 AND i < 6 - c""")
def middle_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = videos(spark, sf_dir)
    return sampling.middle_of_scene(scenes.fixed_length(v.drop("fps"), 7), v, 6, "user_id").select("user_id", F.col("frame_idx").cast("long").alias("frame_idx"))


@query(f"WITH {_SIGNAL}, d AS (SELECT user_id, t, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t)) AS d FROM s) SELECT user_id, t, round(d, 6) AS d FROM d WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d DESC, t) <= 3")
def motion_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.motion_peaks(signal_rows(spark, sf_dir), ["user_id"], "t", "value", 3).select("user_id", "t", _r("d").alias("d"))


@query(f"WITH {_SIGNAL} SELECT user_id, t FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, t) <= least(greatest(ceil(count(*) OVER (PARTITION BY user_id) * 0.15::DOUBLE), 3), 15)")
def budget_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top_budget(signal_rows(spark, sf_dir), ["user_id"], "value", "t", 0.15, 3, 15).select("user_id", "t")


_CUTS = f"""{_SIGNAL}, {_VIDEOS}, e AS (SELECT user_id, t, t - row_number() OVER (PARTITION BY user_id ORDER BY t) AS run FROM s WHERE event_type IN ('error', 'view')),
r AS (SELECT *, min(t) OVER (PARTITION BY user_id, run) AS first FROM e), a AS (SELECT user_id, t FROM r WHERE (t - first) % 2 = CASE WHEN first = 0 THEN 1 ELSE 0 END),
z AS (SELECT user_id, coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t) + 1, 0) AS start_frame, t AS end_frame FROM a
  UNION ALL SELECT v.user_id, coalesce(max(a.t), -1) + 1, max(total) - 1 FROM v LEFT JOIN a USING (user_id) GROUP BY v.user_id HAVING coalesce(max(a.t), -1) + 1 <= max(total) - 1)"""


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = signal_rows(spark, sf_dir, "event_type").where(F.col("event_type").isin("error", "view")).select("user_id", F.col("t").alias("frame_idx"))
    return scenes.from_boundaries(b, videos(spark, sf_dir), "user_id")


@query(f"WITH {_CUTS} SELECT * FROM z")
def boundary_to_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir)


_MERGED = f"""{_CUTS}, g AS (SELECT *, sum((rn = 1 OR end_frame - start_frame + 1 >= 3)::INT) OVER (PARTITION BY user_id ORDER BY rn) AS grp
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_frame) AS rn FROM z)),
m AS (SELECT user_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM g GROUP BY user_id, grp)"""


@query(f"WITH {_MERGED} SELECT * FROM m")
def merge_short_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.merge_short(_cut(spark, sf_dir), 3, "user_id")


_TIME = "printf('%02d:%02d:%02d.%03d', x // 3600000, (x // 60000) % 60, (x // 1000) % 60, x % 1000)"


@query(f"""WITH {_MERGED}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_frame) - 1 AS scene_id, start_frame * 40 AS a, end_frame * 40 AS b FROM m)
SELECT user_id, scene_id, start_frame, end_frame, {_TIME.replace("x", "a")} AS start_time, {_TIME.replace("x", "b")} AS end_time, end_frame - start_frame + 1 AS duration_frames,
round((end_frame - start_frame + 1) / 25.0::DOUBLE, 3) AS duration_seconds, (start_frame + end_frame) // 2 AS preview FROM k""".replace("printf('%02d:%02d:%02d.%03d', a", "printf('%02d:%02d:%02d.%03d', a"))
def scene_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = signal_rows(spark, sf_dir, "event_type").where(F.col("event_type").isin("error", "view")).select("user_id", F.col("t").alias("frame_idx"))
    s = keyframes.scene_table(b, videos(spark, sf_dir), 3, "user_id")
    return s.withColumn("preview", scalars.preview_frame(F.col("start_frame"), F.col("end_frame"))).drop("fps")


@query(f"WITH {_FRAMES}, d AS (SELECT label, pos, v, lead(v) OVER (PARTITION BY label ORDER BY pos) AS w FROM f) SELECT label, pos, round(1 - list_dot_product(v, w) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(w, w)) + 1e-8)), 6) AS delta FROM d WHERE w IS NOT NULL")
def adjacent_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.adjacent_cosine(frames(spark, sf_dir), ["label"], "pos", "embedding").select("label", "pos", _r("delta").alias("delta"))


@query("SELECT conv_id, turn, (role IS DISTINCT FROM n)::INT::DOUBLE AS hint FROM (SELECT conv_id, turn, role, lead(role) OVER w AS n, lead(1) OVER w AS m FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE m = 1")
def change_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.change_hints(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


@query(f"""WITH {_SIGNAL}, d AS (SELECT user_id, t, abs(lead(value) OVER (PARTITION BY user_id ORDER BY t) - value) AS d FROM s), m AS (SELECT *, median(d) OVER (PARTITION BY user_id) AS med FROM d WHERE d IS NOT NULL),
a AS (SELECT *, median(abs(d - med)) OVER (PARTITION BY user_id) + 1e-8 AS mad FROM m) SELECT user_id, t, round(least(greatest((d - med) / (1.4826 * mad + 1e-8), 0), 6), 5) AS delta FROM a""")
def robust_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.robust_delta(signal_rows(spark, sf_dir), ["user_id"], "t", "value").select("user_id", "t", _r("delta", 5).alias("delta"))


@query(f"WITH {_SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s) SELECT a.user_id, a.t, round(CASE WHEN any_value(a.n) < 5 THEN any_value(a.value) ELSE median(b.value) END, 6) AS value FROM n a, generate_series(-2, 2) g(j) JOIN n b ON a.user_id = b.user_id AND b.t = least(greatest(a.t + j, 0), a.n - 1) GROUP BY a.user_id, a.t")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.median_filter(signal_rows(spark, sf_dir), ["user_id"], "t", "value").select("user_id", "t", _r("value").alias("value"))


@query(f"""WITH {_SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s) SELECT a.user_id, a.t, round(CASE WHEN any_value(a.n) < 11 THEN any_value(a.value) ELSE greatest((any_value(a.value) - avg(b.value)) / (stddev_pop(b.value) + 1e-8), 0) END, 6) AS value
FROM n a, generate_series(-5, 5) g(j) JOIN n b ON a.user_id = b.user_id AND b.t = CASE WHEN a.t + j < 0 THEN -(a.t + j) WHEN a.t + j >= a.n THEN 2 * (a.n - 1) - (a.t + j) ELSE a.t + j END OR (a.n < 11 AND a.user_id = b.user_id AND a.t = b.t) GROUP BY a.user_id, a.t""")
def local_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.local_zscore(signal_rows(spark, sf_dir), ["user_id"], "t", "value").select("user_id", "t", _r("value").alias("value"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumns({"quality": F.element_at(V.doubles("embedding"), 1), "block": F.floor(F.col("vec_id") / 40)})
    return signal.boundary_score(f, ["label"], "pos", "embedding", "quality", "block")


@query(f"""WITH {_FRAMES}, q AS (SELECT *, v[1] AS q, vec_id // 40 AS blk FROM f), z AS (SELECT *, (q - avg(q) OVER w) / CASE WHEN stddev_pop(q) OVER w = 0 THEN 1 ELSE stddev_pop(q) OVER w END AS sq FROM q WINDOW w AS (PARTITION BY label)),
l AS (SELECT *, lead(v) OVER w AS nv, abs(lead(sq) OVER w - sq) AS d, (lead(blk) OVER w <> blk)::INT AS hint FROM z WINDOW w AS (PARTITION BY label ORDER BY pos)), m AS (SELECT *, median(d) OVER (PARTITION BY label) AS med FROM l WHERE nv IS NOT NULL),
a AS (SELECT *, median(abs(d - med)) OVER (PARTITION BY label) + 1e-8 AS mad, count(*) OVER (PARTITION BY label) AS n FROM m),
b AS (SELECT label, pos, hint, n, 0.8::DOUBLE * (1 - list_dot_product(v, nv) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(nv, nv)) + 1e-8))) + 0.2::DOUBLE * least(greatest((d - med) / (1.4826 * mad + 1e-8), 0), 6) AS b FROM a),
f5 AS (SELECT x.label, x.pos, any_value(x.hint) AS hint, any_value(x.n) AS n, median(y.b) AS b FROM b x, generate_series(-2, 2) g(j) JOIN b y ON x.label = y.label AND y.pos = least(greatest(x.pos + j, 0), x.n - 1) GROUP BY x.label, x.pos),
zs AS (SELECT x.label, x.pos, any_value(x.hint) AS hint, any_value(x.b) AS b, greatest((any_value(x.b) - avg(y.b)) / (stddev_pop(y.b) + 1e-8), 0) AS z FROM f5 x, generate_series(-5, 5) g(j) JOIN f5 y ON x.label = y.label AND y.pos = CASE WHEN x.pos + j < 0 THEN -(x.pos + j) WHEN x.pos + j >= x.n THEN 2 * (x.n - 1) - (x.pos + j) ELSE x.pos + j END GROUP BY x.label, x.pos),
t AS (SELECT label, pos, 0.7::DOUBLE * b + 0.3::DOUBLE * z + 0.15::DOUBLE * hint AS b FROM zs) SELECT label, pos, round((b - min(b) OVER (PARTITION BY label)) / (max(b) OVER (PARTITION BY label) - min(b) OVER (PARTITION BY label) + 1e-8), 5) AS score FROM t""")
def boundary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("label", "pos", _r("score", 5).alias("score"))


@query("""WITH p AS (SELECT *, min(p_retailprice) OVER () AS a, max(p_retailprice) OVER () AS b, min(p_size) OVER () AS c, max(p_size) OVER () AS d FROM part),
q AS (SELECT p_partkey, (0.9::DOUBLE * (p_retailprice - a) / (b - a) + 0.6::DOUBLE * (p_size - c) / (d - c)) / 1.5 AS priority FROM p)
SELECT p_partkey, round(priority, 6) AS priority FROM q""")
def minmax_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return layout.priorities(p, [], {"p_retailprice": 0.9, "p_size": 0.6}, "p_partkey").select("p_partkey", _r("priority").alias("priority"))


@query("""WITH a AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS rank FROM supplier),
b AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer) SELECT k AS nationkey, rank, s_suppkey, c_custkey FROM a JOIN b USING (k, rank)""")
def rank_join_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"), "s_suppkey", "s_acctbal")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"), "c_custkey", "c_acctbal")
    return layout.matched_by_rank(s, c, ["nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], [F.col("c_acctbal").desc(), F.col("c_custkey")]).select("nationkey", "rank", "s_suppkey", "c_custkey")


_LINES = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{m}' AS metric, round(avg({m}), 4) AS mean, round(stddev_pop({m}), 4) AS std, min({m}) AS min, max({m}) AS max, count({m}) AS n FROM lineitem GROUP BY l_returnflag" for m in _LINES))
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.tall(table(spark, sf_dir, "lineitem").select("l_returnflag", *_LINES), ["l_returnflag"], _LINES)
    m = batch.metric_summary(rows, ["l_returnflag", "metric"])
    return m.withColumns({"mean": _r("mean", 4), "std": _r("std", 4)})


@query("WITH g AS (SELECT l_shipdate::DATE AS day, l_returnflag AS method, avg(l_discount) AS RecErr, avg(l_quantity) AS Coverage FROM lineitem GROUP BY ALL) SELECT day::VARCHAR AS day, method, metric, round(value, 6) AS value FROM g UNPIVOT (value FOR metric IN (RecErr, Coverage))")
def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_method(spark, sf_dir).withColumns({"day": F.col("day").cast("string"), "value": _r("value")})


def _by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("method")).agg(F.avg("l_discount").alias("RecErr"), F.avg("l_quantity").alias("Coverage"))
    return batch.tall(g, ["day", "method"], ["RecErr", "Coverage"])


_COMPARED = {"RecErr": "l_discount", "SceneCoverage": "l_quantity", "Noise_med": "l_tax", "RedundancyMeanCos": "l_extendedprice", "MinPairwiseDist": "l_linenumber", "Sharpness_med": "l_suppkey"}


@query(f"""WITH g AS (SELECT l_shipdate::DATE AS day, l_returnflag AS method, {", ".join(f"{'-' if m in ('SceneCoverage', 'Sharpness_med') else ''}avg({c}) AS {m}" for m, c in _COMPARED.items())} FROM lineitem GROUP BY ALL), t AS (SELECT day, method, metric, round(value, 9) AS value FROM g UNPIVOT (value FOR metric IN ({", ".join(_COMPARED)}))),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY day, metric ORDER BY value, method) = 1) SELECT method, count(*) AS n_best FROM b GROUP BY method""")
def method_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("method")).agg(*[F.avg(c).alias(m) for m, c in _COMPARED.items()])
    return batch.wins(batch.tall(g, ["day", "method"], list(_COMPARED)).withColumn("value", F.round("value", 9)), "day")


@query("""WITH p AS (SELECT (i * 3 + j) AS iter, w, cut FROM (VALUES (0, 0.5), (1, 1.0)) a(i, w), (VALUES (0, 1000.0), (1, 100000.0), (2, 200000.0)) b(j, cut)),
r AS (SELECT iter, o_custkey, avg(w * 0.1) AS e, avg((o_totalprice >= cut)::INT) AS c FROM orders, p GROUP BY ALL) SELECT iter, round(avg(0.7::DOUBLE * (1 - e) + 0.3::DOUBLE * c), 6) AS score FROM r GROUP BY iter""")
def combined_score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).withColumn("score", _r("score"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = batch.grid(spark, {"w": [0.5, 1.0], "cut": [1000.0, 100000.0, 200000.0]})
    # Every order is read once: a sum for each cut, and the few settings meet the sums of each customer.
    cuts = [r["cut"] for r in settings.select("cut").distinct().orderBy("cut").collect()]
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.map_from_arrays(F.array(*[F.lit(c) for c in cuts]), F.array(*[F.avg((F.col("o_totalprice") >= c).cast("double")) for c in cuts])).alias("covered"))
    each = F.explode(F.array(*[F.struct(F.lit(r["iter"]).alias("iter"), F.lit(r["w"]).alias("w"), F.lit(r["cut"]).alias("cut")) for r in settings.collect()])).alias("g")
    r = o.select("o_custkey", "covered", each).select("g.iter", (F.col("g.w") * 0.1).alias("e"), F.element_at("covered", F.col("g.cut")).alias("c"))
    return batch.grid_scores(r, ["iter"], "e", "c")


@query("""WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS i, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS best FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT *, lag(best, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS past FROM d) SELECT o_custkey, min(o_orderkey) FILTER (past = best AND i >= 4) AS stop_at, max(best) AS best FROM e GROUP BY o_custkey""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.stop_at(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice", 3)


@query(f"""WITH RECURSIVE {_SIGNAL}, e AS (SELECT user_id, t, value AS ema FROM s WHERE t = 0 UNION ALL SELECT s.user_id, s.t, 0.875::DOUBLE * e.ema + 0.125::DOUBLE * s.value FROM e JOIN s ON s.user_id = e.user_id AND s.t = e.t + 1) SELECT user_id, t, round(ema, 6) AS ema FROM e""")
def ema_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.ema(signal_rows(spark, sf_dir), ["user_id"], "t", "value", 0.875).withColumn("ema", _r("ema"))


@query("""WITH r AS (SELECT lang, n_chars, doc_id, quality, sum(quality) OVER w AS tp, row_number() OVER w AS n, sum(quality) OVER (PARTITION BY lang) AS p FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY n_chars, doc_id)),
e AS (SELECT *, max(tp / n) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, tp / p - coalesce(lag(tp / p) OVER (PARTITION BY lang ORDER BY n_chars, doc_id), 0) AS step FROM r)
SELECT lang, round(sum(step * env), 6) AS average_precision FROM e GROUP BY lang""")
def ap_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.average_precision(d, ["lang"], "n_chars", "quality", "doc_id").withColumn("average_precision", _r("average_precision"))


@query("SELECT l_linestatus, round(avg(CASE WHEN l_discount < l_tax THEN 1 - g WHEN l_tax < l_discount THEN g ELSE 0.5 END), 6) AS two_afc FROM (SELECT l_linestatus, l_discount, l_tax, (l_linenumber % 2)::DOUBLE AS g FROM lineitem) GROUP BY ALL")
def two_afc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_discount").alias("d0"), F.col("l_tax").alias("d1"), (F.col("l_linenumber") % 2).cast("double").alias("judge"))
    return metrics.two_afc(rows, ["l_linestatus"]).withColumn("two_afc", _r("two_afc"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem, coalesce(list_last(regexp_extract_all(url, '\\d+'))::BIGINT, 0) AS frame,
coalesce(nullif(regexp_extract(url, '\\d+'), '')::BIGINT, -1) AS first FROM pages""")
def parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", scalars.stem(u).alias("stem"), scalars.scene_and_frame(u)["frame"].alias("frame"), scalars.first_number(u).alias("first"))


@query("""WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS s FROM part), a AS (SELECT p_partkey, list_distinct(regexp_extract_all(s, '[a-z]+')) AS w, s FROM t)
SELECT p_partkey, len(list_filter(['part', 'red', 'small'], lambda x: list_contains(w, x))) AS n_words FROM a""")
def caption_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0)))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(F.array(F.lit("part"), F.lit("red"), F.lit("small")), words)).alias("n_words"))


@query("""WITH a AS (SELECT user_id, sum((props->>'k')::INT) AS value FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT user_id, max((props->>'k')::INT) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, coalesce(b.value, a.value)::BIGINT AS value FROM a FULL JOIN b USING (user_id)""")
def json_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    base = e.where("event_type = 'view'").groupBy("user_id").agg(F.sum("k").alias("value"))
    extra = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("k").cast("long").alias("value"))
    return batch.merged_metrics(base, extra, ["user_id"])


@query("(SELECT DISTINCT c_custkey AS k, 'both' AS part FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) UNION ALL (SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) UNION ALL SELECT k, 'any' FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    named = lambda df, part: df.withColumn("part", F.lit(part))
    return named(c.intersect(o), "both").unionByName(named(c.exceptAll(o.distinct()), "without")).unionByName(named(c.union(o).distinct(), "any"))


@query(f"WITH {_SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s) SELECT user_id, CASE WHEN n < 4 THEN t ELSE t // 4 END AS block, round((max(value) + avg(value)) / 2, 6) AS pooled FROM n GROUP BY user_id, block, n HAVING count(*) = 4 OR n < 4")
def block_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.block_pool(signal_rows(spark, sf_dir), ["user_id"], "t", "value", 2).withColumn("pooled", _r("pooled"))


@query("SELECT k AS nationkey, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY k")
def summed_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).groupBy(F.col(c).alias("nationkey")).agg(F.count(F.lit(1)).alias("n")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return batch.summed(parts, ["nationkey"])


@query("SELECT 2 AS depth, count(*) AS n FROM customer UNION ALL SELECT 1, count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) HAVING count(*) > 0")
def leaf_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = spark.range(1).select(F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("side"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.lit("root").alias("parent_id"), F.lit("0").alias("side"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.lit("0").alias("side"))
    nodes = root.unionByName(nations).unionByName(customers).withColumn("tree_id", F.lit(0))
    return layout.depth_histogram(layout.leaves(layout.tree_depths(nodes), nodes))


@query(f"""WITH RECURSIVE {_FRAMES}, n AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u FROM f), d(label, pos, kept, us) AS (
    SELECT label, pos, true, [u] FROM n WHERE pos = 0
    UNION ALL SELECT n.label, n.pos, ok, CASE WHEN ok THEN list_append(us, n.u) ELSE us END FROM d JOIN n ON n.label = d.label AND n.pos = d.pos + 1, LATERAL (SELECT len(list_filter(d.us, lambda w: list_dot_product(w, n.u) >= 0.25)) = 0 AS ok))
SELECT label, pos FROM d WHERE kept""")
def without_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.without_similar(frames(spark, sf_dir), ["label"], "pos", "embedding", 0.25)


@query()
def frechet_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = _three_keys(spark, sf_dir)
    return metrics.frechet_distance(f, k, ["label"], "embedding")


_DIRECTIONS = ", ".join(f"({i}, [{', '.join(map(repr, v))}]::DOUBLE[])" for i, v in enumerate(metrics.directions(64, 16)))
_SLICED = f"""d(d, w) AS (VALUES {_DIRECTIONS}), r AS (SELECT label, scale, side, vec_id, v, row_number() OVER (PARTITION BY label, scale, side ORDER BY md5('42:' || vec_id), vec_id) AS r FROM sides
), n AS (SELECT label, scale, least(max(r) FILTER (side = 0), max(r) FILTER (side = 1)) AS n FROM r GROUP BY label, scale HAVING count(DISTINCT side) = 2
), p AS (SELECT r.label, r.scale, side, d, list_dot_product(v, w) AS p, vec_id FROM r JOIN n USING (label, scale), d WHERE r.r <= n.n
), k AS (SELECT *, row_number() OVER (PARTITION BY label, scale, side, d ORDER BY p, vec_id) AS k FROM p
), w AS (SELECT label, scale, d, avg(abs(a - b)) AS w FROM (SELECT label, scale, d, k, max(p) FILTER (side = 0) AS a, max(p) FILTER (side = 1) AS b FROM k GROUP BY ALL) GROUP BY ALL
), swd AS (SELECT label, scale, avg(w) AS swd FROM w GROUP BY ALL)"""


@query(f"WITH {_FRAMES}, sides AS (SELECT label, 0 AS scale, 0 AS side, vec_id, v FROM f UNION ALL SELECT label, 0, 1, vec_id, v FROM f WHERE pos % 3 = 0), {_SLICED} SELECT label, round(swd, 6) AS swd FROM swd")
def sliced_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return metrics.sliced_wasserstein(f, f.where("pos % 3 = 0"), ["label"], "vec_id", "embedding", 64).withColumn("swd", _r("swd"))


@query(f"""WITH {_FRAMES}, o AS (SELECT label, 0 AS side, vec_id, v FROM f UNION ALL SELECT label, 1, vec_id, v FROM f WHERE pos % 2 = 1), t AS (SELECT *, row_number() OVER (PARTITION BY label, side ORDER BY vec_id) - 1 AS place FROM o),
sides AS (SELECT label, scale, side, vec_id, v FROM t, range(3) AS x(scale) WHERE place % (1 << scale) = 0), {_SLICED} SELECT label, round(avg(swd), 6) AS swd FROM swd GROUP BY label""")
def multi_scale_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return metrics.multi_scale_wasserstein(f, f.where("pos % 2 = 1"), ["label"], "vec_id", "embedding", 64).withColumn("swd", _r("swd"))


@query("""WITH r AS (SELECT l_returnflag, CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 'nan'::DOUBLE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity::DOUBLE END AS v FROM lineitem)
SELECT l_returnflag, rule, CASE WHEN rule = 'all' AND l_returnflag = 'A' THEN 'nan' ELSE round(avg(v) FILTER (NOT isnan(v)), 4)::VARCHAR END AS mean, count(v) FILTER (rule = 'all' OR NOT isnan(v)) AS n FROM r, (VALUES ('all'), ('known')) AS x(rule) GROUP BY l_returnflag, rule""")
def unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that leave NaN out, and those that it spoils."""
    unknown = F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "A"), F.lit(float("nan"))).when(F.col("l_linenumber") != 6, F.col("l_quantity").cast("double"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", unknown.alias("value"))
    both = [batch.metric_summary(rows, ["l_returnflag"], skip_nan=known).withColumn("rule", F.lit(name)) for known, name in ((False, "all"), (True, "known"))]
    mean = F.when(F.isnan("mean"), F.lit("nan")).otherwise(_r("mean", 4).cast("string"))
    return both[0].unionByName(both[1]).select("l_returnflag", "rule", mean.alias("mean"), "n")


@query()
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segmented(_scored(spark, sf_dir), ["label"], "pos", "score", 3, 8, 2, 10)


@query(f"""WITH RECURSIVE {_SIGNAL}, x AS (SELECT user_id, t, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8) AS b FROM s WINDOW w AS (PARTITION BY user_id)
), c AS (SELECT user_id, t, b, sum(b) OVER w AS r, sum(b * b) OVER w AS q FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)
), g AS (SELECT user_id, count(*)::INT AS m, avg(b) AS mean, list_prepend(0.0::DOUBLE, list(r ORDER BY t)) AS r, list_prepend(0.0::DOUBLE, list(q ORDER BY t)) AS q FROM c GROUP BY user_id
), z AS (SELECT user_id, m, r, q, i AS step, 0.05 * exp(i / 19.0::DOUBLE * ln(greatest(5.0, 10 * (mean + 1e-3)) / 0.05)) AS penalty FROM g, range(20) AS p(i)
), d AS (
    SELECT user_id, step, m, penalty, 0 AS b, [-penalty] AS total, [0] AS came, []::INT[] AS open_ FROM z
    UNION ALL
    SELECT user_id, step, m, penalty, b, list_append(total, CASE WHEN len(starts) = 0 THEN 'inf'::DOUBLE ELSE list_min(v) + penalty END), list_append(came, CASE WHEN len(starts) = 0 THEN 0 ELSE starts[list_position(v, list_min(v))] END),
        CASE WHEN len(starts) = 0 THEN starts ELSE list_filter(starts, lambda a, i: v[i] <= list_min(v) + penalty) END
    FROM (SELECT *, list_transform(starts, lambda a: total[a + 1] + (q[b + 1] - q[a + 1] - (r[b + 1] - r[a + 1]) * (r[b + 1] - r[a + 1]) / (b - a))) AS v FROM (
        SELECT d.user_id, d.step, d.m, d.penalty, d.b + 1 AS b, total, came, z.r, z.q, CASE WHEN d.b + 1 >= 3 AND isfinite(total[d.b - 1]) THEN list_append(open_, d.b - 2) ELSE open_ END AS starts FROM d JOIN z USING (user_id, step) WHERE d.b < d.m))
), e AS (
    SELECT user_id, step, came, [m] AS ends, m AS spot FROM d WHERE b = m
    UNION ALL SELECT user_id, step, came, list_prepend(came[spot + 1], ends), came[spot + 1] FROM e WHERE came[spot + 1] > 0
), f AS (SELECT user_id, ends, row_number() OVER (PARTITION BY user_id ORDER BY abs(len(ends) - 6), CASE WHEN len(ends) = 6 THEN step WHEN len(ends) >= 6 THEN step - 20 ELSE step END) AS best FROM e WHERE came[spot + 1] = 0)
SELECT user_id, (i - 1)::INT AS segment_id, (CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] + 1 END)::BIGINT AS start_pos, ends[i]::BIGINT AS end_pos FROM (SELECT user_id, ends, unnest(range(1, len(ends) + 1)) AS i FROM f WHERE best = 1)""")
def penalised_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events cut into about six segments: the search over penalties, with the change points of each."""
    s = signal.min_max(signal_rows(spark, sf_dir), ["user_id"], "value", "score")
    return segment.segmented(s, ["user_id"], "t", "score", 3, 0, 6, 6)


@query()
def kernel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("quality", F.element_at(V.doubles("embedding"), 1))
    return segment.kernel_segmented(f, ["label"], "pos", "embedding", "quality", 3, 8)


_PEAKS = f"""{_SIGNAL}, k AS (SELECT user_id, t, kind, value, CASE kind WHEN 'peak' THEN value ELSE -value END AS y FROM s, (VALUES ('peak'), ('valley')) AS v(kind)
), g AS (SELECT *, coalesce((y <> lag(y) OVER (PARTITION BY user_id, kind ORDER BY t))::INT, 0) AS new FROM k
), u AS (SELECT *, sum(new) OVER (PARTITION BY user_id, kind ORDER BY t) AS run FROM g
), r AS (SELECT user_id, kind, run, min(t) AS a, max(t) AS b, any_value(y) AS y FROM u GROUP BY ALL
), tops AS (SELECT user_id, kind, (a + b) // 2 AS p, y FROM (SELECT *, lag(y) OVER w AS l, lead(y) OVER w AS n FROM r WINDOW w AS (PARTITION BY user_id, kind ORDER BY run)) WHERE l < y AND n < y
), q AS (SELECT user_id, kind, list({{'y': y, 'p': p}} ORDER BY y DESC, p DESC) AS rest FROM tops GROUP BY ALL
), z AS (
    SELECT user_id, kind, rest[1].p AS p, rest[1].y AS y, list_filter(rest, lambda v: abs(v.p - rest[1].p) >= 5) AS rest FROM q
    UNION ALL SELECT user_id, kind, rest[1].p, rest[1].y, list_filter(rest, lambda v: abs(v.p - rest[1].p) >= 5) FROM z WHERE len(rest) > 0
), h AS (SELECT z.user_id, z.kind, z.p, z.y, coalesce(max(k.t) FILTER (k.t < z.p AND k.y > z.y), 0) AS a, coalesce(min(k.t) FILTER (k.t > z.p AND k.y > z.y), max(k.t)) AS b FROM z JOIN k USING (user_id, kind) GROUP BY ALL
), m AS (SELECT h.user_id, h.kind, h.p, h.y, h.y - greatest(min(k.y) FILTER (k.t BETWEEN h.a AND h.p), min(k.y) FILTER (k.t BETWEEN h.p AND h.b)) AS prominence FROM h JOIN k USING (user_id, kind) GROUP BY h.user_id, h.kind, h.p, h.y, h.a, h.b
), peaks AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prominence DESC, p, kind) AS best FROM m WHERE prominence >= 0.05 QUALIFY best <= 100)"""


@query(f"WITH RECURSIVE {_PEAKS} SELECT user_id, p AS t, p + 2 AS frame, round(CASE kind WHEN 'peak' THEN y ELSE -y END, 6) AS value, kind, round(prominence, 6) AS prominence FROM peaks")
def peaks_and_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.peaks_and_valleys(signal_rows(spark, sf_dir), ["user_id"], "t", "value")
    return found.select("user_id", "t", "frame", _r("value").alias("value"), "kind", _r("prominence").alias("prominence"))


#: The first ``k`` of c (g, pos, score) by score, none within ``radius`` of one before.
GREEDY = """p(g, step, picks) AS (SELECT DISTINCT g, 0, []::BIGINT[] FROM c UNION ALL
    SELECT p.g, p.step + 1, list_append(p.picks, arg_min(c.pos, (c.score, {tie}))) FROM p JOIN c ON c.g = p.g
    WHERE p.step < {k} AND len(list_filter(p.picks, lambda x: abs(x - c.pos) <= {radius})) = 0 GROUP BY p.g, p.step, p.picks),
q AS (SELECT g, arg_max(picks, step) AS picks FROM p GROUP BY g)"""


@query(f"""WITH RECURSIVE {_FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM f
), s AS (SELECT label, pos, v FROM n WHERE n <= 30 OR pos IN (SELECT CASE WHEN j = 29 THEN n - 1 ELSE floor(j * ((n - 1)::DOUBLE / 29)) END FROM generate_series(0, 29) x(j))
), c AS (
    SELECT a.label * 2 AS g, a.pos, round(coalesce(sum(1 - list_dot_product(a.v, b.v)) FILTER (a.pos <> b.pos), 0), 9) AS score FROM s a JOIN s b USING (label) GROUP BY a.label, a.pos
    UNION ALL SELECT label * 2 + 1, pos, ('0x' || md5('7:' || label || ':' || pos)[1:13])::BIGINT::DOUBLE FROM s
), {GREEDY.format(tie="c.pos", k=3, radius=2)}, k AS (
    SELECT g // 2 AS label, CASE g % 2 WHEN 0 THEN 'medoid' ELSE 'random' END AS method, unnest(picks) AS pos FROM q
    UNION ALL SELECT label, 'uniform', (CASE WHEN i = 2 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 2)) END)::BIGINT FROM (SELECT DISTINCT label, n FROM n), generate_series(0, 2) x(i)
), kv AS (SELECT DISTINCT k.label, method, pos, v FROM k JOIN f USING (label, pos)
), m AS (SELECT label, method, f.pos, max(list_dot_product(f.v, kv.v)) AS s FROM f JOIN kv USING (label) GROUP BY ALL
), near AS (SELECT label, method, round(avg(1 - s), 6) AS rec_error, round(avg((1 - s <= 0.3)::INT), 6) AS temporal_coverage FROM m GROUP BY ALL
), o AS (SELECT a.label, a.method, list_dot_product(a.v, b.v) AS d FROM kv a JOIN kv b ON a.label = b.label AND a.method = b.method AND a.pos < b.pos
), spread AS (SELECT label, method, round(avg(d), 6) AS redundancy, round(min(1 - d), 6) AS min_distance, round(avg(1 - d), 6) AS diversity FROM o GROUP BY ALL)
SELECT label, method, n_keys, rec_error, temporal_coverage, redundancy, min_distance, diversity FROM (SELECT label, method, count(*) AS n_keys FROM k GROUP BY ALL) LEFT JOIN near USING (label, method) LEFT JOIN spread USING (label, method)""")
def methods_against_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen keys of every scene against uniform and random ones, in one plan."""
    f = frames(spark, sf_dir).persist()  # numbered once for all that read it
    n = f.groupBy("label").agg(F.count(F.lit(1)).alias("total_frames"))
    chosen = {
        "medoid": keyframes.choose(f, ["label"], "pos", "embedding", cap=30, k=3, radius=2),
        "uniform": sampling.uniform(n, 3).withColumnRenamed("frame_idx", "pos"),
        "random": keyframes.choose(f, ["label"], "pos", "embedding", "random", cap=30, k=3, radius=2, seed=7),
    }
    judged = keyframes.evaluate(f, chosen, ["label"], "pos", "embedding")
    return judged.withColumns({c: _r(c) for c in ("rec_error", "temporal_coverage", "redundancy", "min_distance", "diversity")})


@query("""WITH e AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR)::INT AS new FROM events), g AS (SELECT *, sum(coalesce(new, 1)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, s""")
def session_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "6 hours", "1 hour")
    return s.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n")

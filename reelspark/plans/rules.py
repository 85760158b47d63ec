"""More queries of the catalog: scalar rules, rankings, shares, summaries and lookups on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import scalars
from reelspark.functions import vectors as V
from reelspark.operators import batch, distance, layout, metrics, scenes, signal
from reelspark.plans.catalog import _FRAMES, _SIGNAL, _TIME, _r, query
from reelspark.plans.tables import frames, table
from reelspark.plans.tables import signal as signal_rows


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, round(l_partkey * 1000.0::DOUBLE / greatest(l_quantity, 1.0), 0)::BIGINT AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, {_TIME} AS code FROM x""")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.frames_to_timecode(F.col("l_partkey"), F.col("l_quantity")).alias("code"))


@query("""SELECT l_orderkey, l_linenumber, least(greatest(ceil(l_quantity * 0.15::DOUBLE), 3), 6)::BIGINT AS budget, round(0.5::DOUBLE * (greatest(l_linenumber - 3, 0) + 0.5::DOUBLE * greatest(3 - l_linenumber, 0)), 6) AS penalty,
round(least(greatest(l_discount, 1e-6), 1 - 1e-6), 6) AS probability, round(1 / (1 + greatest(l_tax, 0)), 6) AS quality, round(255 - 2 * abs(l_quantity - 128), 6) AS exposure,
round(l_quantity / (l_quantity + 50) * exp(-((l_linenumber - 128) * (l_linenumber - 128)) / (2 * 4096.0::DOUBLE)), 6) AS heuristic FROM lineitem""")
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.budget(0.15, q, 3, 6).cast("long").alias("budget"), _r(scalars.budget_penalty(n, F.lit(3), 0.5)).alias("penalty"), _r(scalars.probability(F.col("l_discount"))).alias("probability"),
        _r(scalars.quality_from_distortion(F.col("l_tax"))).alias("quality"), _r(scalars.exposure(q)).alias("exposure"), _r(scalars.heuristic_quality(q, n)).alias("heuristic"),
    )


@query(f"WITH {_FRAMES}, g AS (SELECT *, first_value(v) OVER (PARTITION BY label ORDER BY pos) AS w FROM f) SELECT label, pos, round(1 - list_dot_product(v, w), 6) AS d FROM g WHERE pos > 0")
def distance_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.to_first(frames(spark, sf_dir), ["label"], "pos", "embedding").where("pos > 0").select("label", "pos", _r("d").alias("d"))


@query(f"WITH {_FRAMES}, n AS (SELECT label, pos, v, lead(v) OVER (PARTITION BY label ORDER BY pos) AS w FROM f) SELECT label, pos, round(list_distance(v, w), 6) AS l2, round(list_sum(list_transform(range(1, 65), lambda k: abs(v[k] - w[k]))), 6) AS l1 FROM n WHERE w IS NOT NULL")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the next of its label."""
    f = frames(spark, sf_dir)
    both = [distance.adjacent(f, ["label"], "pos", "embedding", m).withColumnRenamed("d", m) for m in ("l2", "l1")]
    return both[0].join(both[1], ["label", "pos"]).withColumns({"l2": _r("l2"), "l1": _r("l1")})


@query(f"WITH {_SIGNAL} SELECT user_id, t, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8), 6) AS scaled, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END, 5) AS standard FROM s WINDOW w AS (PARTITION BY user_id)")
def scaled_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal.standardized(signal.min_max(signal_rows(spark, sf_dir), ["user_id"], "value", "scaled"), ["user_id"], "value", "standard")
    return s.select("user_id", "t", _r("scaled").alias("scaled"), _r("standard", 5).alias("standard"))


@query(f"WITH {_SIGNAL}, n AS (SELECT user_id, t, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, t, CASE WHEN value > a THEN 'peak' ELSE 'valley' END AS kind FROM n WHERE (value > a AND value > b) OR (value < a AND value < b)")
def local_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.local_extrema(signal_rows(spark, sf_dir), ["user_id"], "t", "value").select("user_id", "t", "kind")


@query("SELECT c_nationkey, c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer")
def shares_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return layout.shares(c, ["c_nationkey"], "c_acctbal").select("c_nationkey", "c_custkey", _r("share").alias("share"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS cut FROM orders QUALIFY lead(1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def cut_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return layout.cut_positions(o, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", _r("cut").alias("cut"))


@query("""WITH w AS (SELECT s_nationkey, s_suppkey, p.w, coalesce(sum(p.w) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(p.w) OVER (PARTITION BY s_nationkey) AS t FROM (SELECT *, abs(s_acctbal) + 1 AS w FROM supplier) p)
SELECT s_suppkey, round(300 * b / t, 5) AS x1, round(300 * (b + w) / t, 5) AS x2 FROM w""")
def weighted_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.abs("s_acctbal") + 1).alias("w"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(300.0).alias("x2"), F.lit(200.0).alias("y2"))
    cells = layout.strips(s, ["s_nationkey"], "w", "s_suppkey")
    return cells.select("s_suppkey", _r("cell_x1", 5).alias("x1"), _r("cell_x2", 5).alias("x2"))


@query("""WITH e AS (SELECT o_custkey AS k, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS e, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey) AS a, 1 + o_orderkey % 4 AS s FROM orders)
SELECT k AS o_custkey, round(0.7::DOUBLE * avg(1 - abs(e - a)) + 0.3::DOUBLE * avg(1.0::DOUBLE / least(s, 3)), 6) AS score FROM e GROUP BY k""")
def partition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.lit(1.0).alias("area"), (1 + F.col("o_orderkey") % 4).cast("double").alias("aspect"))
    return layout.partition_score(o, ["o_custkey"], "o_totalprice", "area", "aspect").select("o_custkey", _r("score").alias("score"))


@query("WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, i AS tree, least(12, n - i * 12) AS n_leaves FROM n, generate_series(0, 100000) g(i) WHERE i * 12 < n")
def leaf_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return layout.leaf_budget(n).select("l_suppkey", F.col("tree").cast("long").alias("tree"), "n_leaves")


@query("""WITH t AS (SELECT l_shipdate::DATE AS day, l_returnflag AS m, avg(l_discount) AS RecErr, avg(l_quantity) AS Coverage FROM lineitem GROUP BY ALL)
SELECT m AS method, 'RecErr' AS metric, arg_min(day, (round(RecErr, 9), day))::VARCHAR AS day FROM t GROUP BY m UNION ALL SELECT m, 'Coverage', arg_min(day, (-round(Coverage, 9), day))::VARCHAR FROM t GROUP BY m""")
def best_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelspark.plans.catalog import _by_method

    rows = _by_method(spark, sf_dir).withColumn("value", F.round("value", 9))
    return batch.best_step(rows, ["method"], "day").select("method", "metric", F.col("day").cast("string").alias("day"))


@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 4) AS l_discount FROM lineitem GROUP BY l_returnflag")
def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = batch.column_means(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"])
    return m.withColumns({c: _r(c, 4) for c in ("l_quantity", "l_discount")})


@query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def items_in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.in_all(table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F') USING (c_custkey)")
def still_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return batch.missing(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.latest(table(spark, sf_dir, "events"), ["user_id"], "event_id", "ts").select("user_id", "event_id")


@query(f"WITH {_SIGNAL}, g AS (SELECT user_id, t, value, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g FROM s WHERE event_type = 'click') SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_prob, round(avg(g), 6) AS mean_spacing, min(t) AS first_frame, max(t) AS last_frame FROM g GROUP BY user_id")
def selection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal_rows(spark, sf_dir, "event_type").where("event_type = 'click'")
    return batch.selection_statistics(s, ["user_id"], "t", "value").withColumns({c: _r(c) for c in ("mean_prob", "mean_spacing")})


@query("""SELECT event_type, round(avg(value), 6) AS mean_reward, round(sum(user_id)::DOUBLE / sum(event_id), 6) AS selection_ratio, round(avg(value), 6) AS mean_entropy, round(avg(value), 6) AS mean_prob, round(stddev_pop(value), 6) AS std_reward, min(value) AS min_reward, max(value) AS max_reward FROM events GROUP BY event_type""")
def epoch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    e = table(spark, sf_dir, "events").select("event_type", v.alias("reward"), F.col("user_id").alias("selected"), F.col("event_id").alias("frames"), v.alias("entropy"), v.alias("prob"))
    rounded = ("mean_reward", "selection_ratio", "mean_entropy", "mean_prob", "std_reward")
    return batch.epoch_statistics(e, ["event_type"]).withColumns({c: _r(c) for c in rounded})


@query("SELECT l_suppkey, round(median(l_quantity), 6) AS sharpness_med, round(median(l_extendedprice), 4) AS exposure_med, round(median(l_tax), 6) AS noise_med FROM lineitem GROUP BY l_suppkey")
def technical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("sharpness"), F.col("l_extendedprice").alias("exposure"), F.col("l_tax").alias("noise"))
    m = metrics.technical_quality(rows, ["l_suppkey"])
    return m.withColumns({"sharpness_med": _r("sharpness_med"), "exposure_med": _r("exposure_med", 4), "noise_med": _r("noise_med")})


@query("""WITH g AS (SELECT l_shipdate::DATE AS day, avg(l_discount) AS RecErr, avg(l_quantity) AS Coverage FROM lineitem GROUP BY ALL ORDER BY day LIMIT 50) SELECT day::VARCHAR AS day, round(RecErr, 6) AS RecErr, round(Coverage, 6) AS Coverage FROM g""")
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.avg("l_discount").alias("RecErr"), F.avg("l_quantity").alias("Coverage"))
    t = batch.summary_table(batch.tall(g, ["day"], ["RecErr", "Coverage"]), "day", ["RecErr", "Coverage"])
    return t.select(F.col("day").cast("string").alias("day"), _r("RecErr").alias("RecErr"), _r("Coverage").alias("Coverage"))


@query("SELECT l_orderkey, round(0.3::DOUBLE * (1 - avg(l_discount)) + 0.3::DOUBLE * least(avg(l_linenumber) / 7, 1) + 0.2::DOUBLE * avg(l_tax) + 0.2::DOUBLE * least(avg(l_quantity) / 50, 1), 6) AS score FROM lineitem GROUP BY l_orderkey")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("d"), F.avg("l_linenumber").alias("n"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"))
    card = batch.scorecard(g, {"representativeness": 1 - F.col("d"), "coverage": F.col("n") / 7, "diversity": F.col("t"), "quality": F.col("q") / 50})
    return g.select("l_orderkey", _r(card).alias("score"))


@query(f"""WITH {_SIGNAL}, c AS (SELECT user_id, greatest(t * 3, 10) AS start_frame, least(t * 3 + 4, 60) AS end_frame FROM s) SELECT * FROM c WHERE end_frame >= start_frame AND end_frame - start_frame + 1 >= 2""")
def clamped_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal_rows(spark, sf_dir).select("user_id", (F.col("t") * 3).alias("start_frame"), (F.col("t") * 3 + 4).alias("end_frame"))
    return scenes.clamped(s, F.lit(10), F.lit(60))


@query("SELECT l_orderkey, l_linenumber, floor(l_quantity * 25)::BIGINT AS start_frame, greatest(floor((l_quantity + l_tax) * 25)::BIGINT - 1, floor(l_quantity * 25)::BIGINT) AS end_frame FROM lineitem")
def scenes_from_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("start_sec"), (F.col("l_quantity") + F.col("l_tax")).alias("end_sec"), F.lit(25).alias("fps"))
    return scenes.from_seconds(r).select("l_orderkey", "l_linenumber", "start_frame", "end_frame")


@query()
def feature_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", scalars.feature_hash(V.doubles("embedding")).alias("hash"))

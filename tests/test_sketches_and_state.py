"""Quantile sketches within their error, the keyed state operator against tables, columnar JSON, first rows."""

import json

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import latency, quality, quantise, sketches
from plumbline.shared import shared_path
from plumbline.streaming import keyed, streams

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_sketches_of_batches_merge_within_their_error(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else "b", i % 7, float(x)) for i, x in enumerate(rng.lognormal(size=30_000))] + [("a", 1, None), ("a", 2, float("nan")), ("c", 0, 4.0)]
    df = spark.createDataFrame(rows, "key string, day int, x double")
    own = df.filter("x is not null and not isnan(x)")
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    batches = sketches.sketched(df, ["key"], "x", batch=["day"])
    assert batches.count() == 15 and batches.agg(F.max(F.length("sketch"))).first()[0] < 40_000
    errors = sketches.rank_errors(own, sketches.merged(batches, ["key"]), ["key"], "x", shares).collect()
    assert len(errors) == 15 and {r.n for r in errors if r.key == "c"} == {1}
    assert max(r.error for r in errors) <= sketches.RANK_ERROR
    one = sketches.rank_errors(own, sketches.sketched(df, ["key"], "x"), ["key"], "x", shares).collect()
    assert max(r.error for r in one) <= sketches.RANK_ERROR
    worse = sketches.rank_errors(own, sketches.sketched(df, ["key"], "x", 8), ["key"], "x", shares).collect()
    assert max(r.error for r in worse) > sketches.RANK_ERROR  # the measure does find errors


def test_a_range_from_sketches_is_near_the_exact_one(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(8_000)], "item long, v array<double>")
    exact = {r.channel: r for r in quantise.q_range_percentile(df, 0.99).collect()}
    for r in sketches.q_range_sketch(df, 0.99).collect():
        assert abs(r.lo - exact[r.channel].lo) < 0.3 and abs(r.hi - exact[r.channel].hi) < 0.3


def events(spark, n=900):
    rng = np.random.default_rng(7)
    rows = [(i, int(i % 13), "hot" if i % 3 else "cold", float(x)) for i, x in enumerate(rng.normal(50, 10, n))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 60)).select("event_id", "ts", "user_id", "event_type", "value")


def deliver(spark, df, path, query, cuts, state):
    """Runs the stream anew after each delivery: what it holds comes from its checkpoint."""
    out = shared_path(spark, "out")
    for low, high in zip(cuts, cuts[1:], strict=False):
        df.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(path)
        stream = spark.readStream.schema(EVENT).parquet(path)
        query(stream).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(keyed.OUT).parquet(out).collect()


def test_keyed_state_survives_restarts_and_equals_the_tables(spark):
    df = events(spark)
    query = lambda lanes: lambda e: keyed.keyed_alarm(e, 50.0, n=20, lanes=lanes)
    run = lambda lanes, cuts: keyed.with_state_store(spark, lambda: deliver(spark, df, shared_path(spark, "in"), query(lanes), cuts, shared_path(spark, "state")))
    got = run(1, [0, 130, 131, 640, 900])
    done, _ = streams.count_alarm(df, spark.createDataFrame([], "event_type string, window_no long, count long, total double"), 50.0, 20)
    want = {(r.event_type, r.window_no): (r.mean, r.fired) for r in done.collect()}
    assert {(r.event_type, r.window_no): (r.mean, r.fired) for r in got} == want and len(got) == len(want) > 20
    split = run(4, [0, 130, 640, 900])
    assert sorted(split) == sorted(run(4, [0, 900])) and {r.lane for r in split} == {0, 1, 2, 3}
    rows = [r for r in df.orderBy("event_id").collect() if r.event_type == "hot" and r.user_id % 4 == 2][:20]
    first = next(r for r in split if (r.event_type, r.lane, r.window_no) == ("hot", 2, 0))
    assert abs(first.mean - np.mean([r.value for r in rows])) < 1e-6 and first.n == 20


def test_an_idle_lane_is_closed_by_its_timer(spark):
    df = events(spark, 60).withColumn("user_id", F.lit(1).cast("long")).withColumn("event_type", F.when(F.col("event_id") < 7, "early").otherwise("late"))
    query = lambda e: keyed.keyed_alarm(e, 50.0, n=20, delay="1 minute", idle_ms=600_000)
    got = keyed.with_state_store(spark, lambda: deliver(spark, df, shared_path(spark, "in"), query, [0, 10, 59, 60], shared_path(spark, "state")))
    early = [r for r in got if r.event_type == "early"]
    assert [(r.n, r.window_no) for r in early] == [(7, 0)] and {r.n for r in got if r.event_type == "late"} == {20}


def test_json_leaves_of_any_depth(spark):
    texts = ['{"a": {"b": [1, {"c": null}, []], "d": {}}, "e.f": "x\\"y", "g": [[true, 2.5], ["é"]]}', "[]", "3", '"s"', '{"a": []}', None, "null", "[null]"]

    def leaves(x, path=""):
        if isinstance(x, dict) and x:
            for k, v in x.items():
                yield from leaves(v, f"{path}.{k}" if path else k)
        elif isinstance(x, list) and x:
            for i, v in enumerate(x):
                yield from leaves(v, f"{path}[{i}]")
        else:
            yield path, json.dumps(x, ensure_ascii=False)

    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string")
    got = sorted((r.id, r.path, r.value) for r in quality.flatten_json(df, ["id"]).collect())
    assert got == sorted((i, *leaf) for i, t in enumerate(texts) if t is not None for leaf in leaves(json.loads(t)))
    assert quality.flatten_json(df.limit(0), ["id"]).count() == 0


def test_first_rows_without_a_window(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(100)], "id int, e double").repartition(7)
    got = quantise.first_ones(df, [F.desc("e"), F.asc("id")], 4)
    assert [(r.place, r.id) for r in got.orderBy("place").collect()] == [(1, 4), (2, 9), (3, 14), (4, 19)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "TakeOrdered" in plan


def test_speed_of_every_build_against_the_reference(spark):
    rows = [(b, s, 1, 0.0, 1.0, ms) for b, ms in (("a", 4.0), ("b", 2.0), ("c", 6.0)) for s in (1, 2)] + [("b", 3, 1, 0.0, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "build string, session int, run int, start double, stop double, ms double")
    assert {(r.build, r.session, r.ratio, r.slower) for r in latency.speed_ratio(t).collect()} == {("b", 1, 0.5, False), ("b", 2, 0.5, False), ("c", 1, 1.5, True), ("c", 2, 1.5, True)}
    assert {(r.build, r.session) for r in latency.speed_ratio(t, "b").collect()} == {("a", 1), ("a", 2), ("c", 1), ("c", 2)}


def test_a_users_range(spark):
    df = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(0, 40, 4)], "item long, v array<double>")
    mine = lambda rows: quantise.long(rows).groupBy("channel").agg(F.lit(0.0).alias("lo"), F.sum("x").alias("hi"))
    assert {tuple(r) for r in quantise.channel_ranges(df, mine).collect()} == {(0, 0.0, 180.0), (1, 0.0, -180.0)}
    assert {tuple(r) for r in quantise.channel_ranges(df, "minmax").collect()} == {(0, 0.0, 36.0), (1, -36.0, 0.0)}
    assert set(quantise.RANGES) == {"minmax", "percentile", "entropy"}

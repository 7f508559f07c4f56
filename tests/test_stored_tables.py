"""Stored tables that know their content: manifests, parts kept by key, grids that go on, rows at chosen positions."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from plumbline.shared import shared_path
from plumbline.sources import stored


def local(path):
    return path.removeprefix("file:")


def scored(spark):
    return spark.createDataFrame([(f"m{i % 2}", i, [i / 8, float(i), None if i == 5 else -1.0]) for i in range(60)], "model string, item long, z array<double>")


def test_content_adds_up_and_sees_every_change(spark):
    df = scored(spark)
    whole = stored.content(df, []).first()
    halves = [stored.content(df.filter(f"item % 2 = {k}"), []).first() for k in (0, 1)]
    assert whole.n == sum(h.n for h in halves) and int(whole.content) == sum(int(h.content) for h in halves)
    assert stored.content(df.orderBy(F.desc("item")).repartition(3), []).first() == whole
    changed = df.withColumn("z", F.when(F.col("item") == 9, F.array(F.lit(9 / 8), F.lit(9.0), F.lit(-1.000001))).otherwise(F.col("z")))
    twice, swapped = df.union(df.filter("item = 3")), df.withColumn("model", F.when(F.col("item") < 2, F.concat(F.lit("m"), (1 - F.col("item")).cast("string"))).otherwise(F.col("model")))
    assert len({stored.content(x, []).first().content for x in (df, changed, twice, swapped, df.limit(59))}) == 5
    assert stored.content(df.limit(0), ["model"]).count() == 0


def test_one_changed_score_is_found(spark):
    df, path = scored(spark), shared_path(spark, "scores")
    manifest = stored.sink_scores(df.repartition(4), path, ["model"])
    assert manifest.agg(F.sum("n")).first()[0] == 60 and manifest.count() > 2
    read = lambda: stored.read_scores(spark, path, df.schema, ["model"])
    assert sorted(map(str, read().select(*df.columns).collect())) == sorted(map(str, df.collect()))
    file = sorted(glob.glob(local(path) + "/data/model=m1/*.parquet"))[0]
    own = spark.read.parquet(file)
    item = own.first().item
    other = own.withColumn("z", F.when(F.col("item") == item, F.array(F.lit(0.123))).otherwise(F.col("z"))).coalesce(1)
    place = shared_path(spark, "one")
    other.write.parquet(place)
    os.replace(glob.glob(local(place) + "/*.parquet")[0], file)
    for crc in glob.glob(os.path.dirname(file) + "/." + os.path.basename(file) + ".crc"):
        os.replace(crc, local(place) + "/crc")
    spark.catalog.refreshByPath(path)
    assert [tuple(r) for r in stored.score_problems(spark, path, df.schema, ["model"]).collect()] == [("model=m1/" + os.path.basename(file), "differs")]
    with pytest.raises(ValueError, match=f"{os.path.basename(file)} differs"):
        read()
    os.replace(file, local(place) + "/gone")
    spark.catalog.refreshByPath(path)
    assert [r.problem for r in stored.score_problems(spark, path, df.schema, ["model"]).collect()] == ["missing"]


def test_one_changed_value_rebuilds_one_part(spark):
    rows = [(i, f"p{i % 3}" if i % 3 < 2 else None, f"t{i}") for i in range(30)]
    df, base, calls = spark.createDataFrame(rows, "id long, part string, text string"), shared_path(spark, "cache"), []

    def build(own):
        calls.append(sorted(r.id for r in own.collect()))
        return own.select("id", "part", F.upper("text").alias("text"))

    def run(own, made_by="a"):
        table, report = stored.cache_parts(own, "part", base, build, made_by)
        return sorted((r.id, r.text) for r in table.collect()), {r.part: r.rebuilt for r in report.collect()}

    want = sorted((i, f"T{i}") for i in range(30))
    assert run(df) == (want, {"p0": True, "p1": True, None: True})
    assert run(df.repartition(5)) == (want, {"p0": False, "p1": False, None: False})
    changed = df.withColumn("text", F.when(F.col("id") == 4, "new").otherwise(F.col("text")))
    assert run(changed) == (sorted((i, "NEW" if i == 4 else f"T{i}") for i in range(30)), {"p0": False, "p1": True, None: False})
    assert calls[-1] == list(range(1, 30, 3))
    assert run(df) == (want, {"p0": False, "p1": False, None: False})  # the older content is still there
    assert run(df, "b")[1] == {"p0": True, "p1": True, None: True}  # another way of building
    assert run(df.filter("id % 3 > 0")) == ([x for x in want if x[0] % 3], {"p1": False, None: False})
    assert run(df.limit(0)) == ([], {})


def test_a_stopped_grid_goes_on(spark):
    path, keys = shared_path(spark, "grid"), ["a", "b"]
    cells = spark.createDataFrame([(i, f"b{j}") for i in range(4) for j in range(3)], "a int, b string")
    batches, built = [], []

    def build(todo):
        own = sorted(map(tuple, todo.collect()))
        batches.append(own)
        if len(batches) == 3:
            raise RuntimeError("stopped")
        built.extend(own)
        return todo.withColumn("x", F.explode(F.array(F.col("a"), F.col("a") + 1)))

    with pytest.raises(RuntimeError, match="stopped"):
        stored.fill_grid(cells, keys, path, build)
    first = sorted(built)
    assert first and len(first) < 12
    missing = stored.fill_grid(cells, keys, path, build)
    assert sorted(map(tuple, missing.collect())) == sorted(set((i, f"b{j}") for i in range(4) for j in range(3)) - set(first))
    assert len(built) == len(set(built)) == 12
    got = spark.read.schema("a int, b string, x int").parquet(f"{path}/data")
    assert sorted(map(tuple, got.select("a", "b", "x").collect())) == sorted((i, f"b{j}", i + k) for i in range(4) for j in range(3) for k in (0, 1))
    assert stored.fill_grid(cells, keys, path, build).count() == 0 and len(built) == 12


def test_rows_at_positions_open_only_their_files(spark):
    path = shared_path(spark, "rows")
    for i, n in enumerate((3, 2, 0, 7, 1)):
        spark.range(10 * i, 10 * i + n).coalesce(1).write.parquet(f"{path}/f{i}")
    own = f"{path}/*"
    order = [10 * i + k for i, n in enumerate((3, 2, 0, 7, 1)) for k in range(n)]
    wanted = spark.createDataFrame([(p,) for p in (1, 3, 4, 4, -1, 13, 99, None)], "position long")
    rows = stored.read_positions(spark, own, wanted)
    assert sorted((r.position, r.id) for r in rows.collect()) == [(p, order[p]) for p in (1, 3, 4, 4)]
    assert sorted({f.split("/f")[-1][0] for f in rows.inputFiles() if local(path) in f}) == ["0", "1"]
    every = stored.read_positions(spark, own, spark.range(13).withColumnRenamed("id", "position"))
    assert [order[r.position] == r.id for r in every.collect()] == [True] * 13
    none = stored.read_positions(spark, own, wanted.filter("position < 0"))
    assert none.count() == 0 and none.columns == ["id", "position"]

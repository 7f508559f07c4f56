"""Stored tables that know their content: a content key that adds up, manifests by file, parts kept by key, grids that
are filled cell by cell and go on where they stopped, and rows read at chosen positions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.shared import written


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns, arrays and structs included."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def content(df: DataFrame, keys: list[str], row: Column | None = None) -> DataFrame:
    """keys, n and content, the sum of the rows' hashes: it needs no order and adds up over tasks, files and deliveries. A
    changed value, a row more or one less gives another content."""
    return df.select(*keys, (row_hash(df) if row is None else row).cast("decimal(38,0)").alias("_h")).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_h").cast("string").alias("content"))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls included."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at a path; empty if nothing has been written there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


# ---- scores with a manifest by file


def file_contents(df: DataFrame, cells: list[str], row: Column | None = None) -> DataFrame:
    """file (with its cell's folders), cells, n and content of a table read from files."""
    depth = len(cells) + 1
    file = F.array_join(F.slice(F.split(F.col("_metadata.file_path"), "/"), -depth, depth), "/")
    own = df.select(file.alias("file"), *cells, (row_hash(df) if row is None else row).alias("_row"))
    return content(own, ["file", *cells], F.col("_row"))


def sink_scores(df: DataFrame, path: str, cells: list[str], row: Column | None = None) -> DataFrame:
    """Writes scores by cell, and gives the manifest that is kept beside them: rows and content of every file, over all
    columns. What was written is compared with what was to be written, cell by cell."""
    spark = df.sparkSession
    df.write.partitionBy(*cells).parquet(f"{path}/data")
    manifest = file_contents(spark.read.schema(df.schema).parquet(f"{path}/data"), cells, row)
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def score_problems(spark: SparkSession, path: str, schema, cells: list[str], row: Column | None = None) -> DataFrame:
    """file and problem ('differs', 'missing', 'not listed') of stored scores against their manifest."""
    now = file_contents(spark.read.schema(schema).parquet(f"{path}/data"), cells, row).select("file", F.col("n").alias("_n"), F.col("content").alias("_content"))
    both = spark.read.parquet(f"{path}/manifest").select("file", "n", "content").join(now, "file", "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("n").isNull(), "not listed").when((F.col("n") != F.col("_n")) | (F.col("content") != F.col("_content")), "differs")
    return both.select("file", problem.alias("problem")).filter("problem is not null")


def read_scores(spark: SparkSession, path: str, schema, cells: list[str], row: Column | None = None) -> DataFrame:
    """Stored scores; refused if a file is missing, not listed, or differs from the manifest in any value."""
    found = score_problems(spark, path, schema, cells, row).orderBy("file").limit(5).collect()
    if found:
        raise ValueError("stored scores differ from their manifest: " + ", ".join(f"{r.file} {r.problem}" for r in found))
    return spark.read.schema(schema).parquet(f"{path}/data")


# ---- materialisations kept by the content of what each part is made from


def _folder(part: str) -> Column:
    return F.when(F.col(part).isNull(), "none").otherwise(F.concat(F.lit("part "), F.col(part).cast("string")))


def cache_parts(df: DataFrame, part: str, base: str, build: Callable[[DataFrame], DataFrame], made_by: str = "", row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, report) of `build`, kept by part: a part is built again only if the rows it is made from, or `made_by` (what
    else the result depends on), changed. report: the part, n, key, and whether it was `rebuilt`.

    A part's key is the content of its rows. Results lie below (part, key) and are listed after they are written, so a
    build that dies leaves no part half done, and results of older keys stay valid for a return to them."""
    spark = df.sparkSession
    now = content(df, [part], row).withColumn("key", F.sha2(F.concat_ws("|", F.lit(made_by), "n", "content"), 256)).select(part, "n", "key")
    now = written(spark, now, "contents")
    listed = stored(spark, f"{base}/listed", now.schema).select(F.col(part).alias("_part"), F.col("key").alias("_key")).distinct()
    report = now.join(listed, now[part].eqNullSafe(listed["_part"]) & (now["key"] == listed["_key"]), "left")
    report = written(spark, report.select(part, "n", "key", F.col("_key").isNull().alias("rebuilt")), "report")
    new = report.filter("rebuilt").select(F.col(part).alias("_part"), F.col("key").alias("_key"), "n")
    rows = build(df.join(new, df[part].eqNullSafe(new["_part"]), "left_semi"))
    if not new.isEmpty():
        keyed = rows.join(new, rows[part].eqNullSafe(new["_part"])).withColumn("_of", _folder(part))
        keyed.select(*rows.columns, "_of", "_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_of", "_key").parquet(f"{base}/data")
        new.select(F.col("_part").alias(part), "n", F.col("_key").alias("key")).write.mode("append").parquet(f"{base}/listed")
    schema = rows.schema.add("_of", "string").add("_key", "string")
    kept = stored(spark, f"{base}/data", schema)
    valid = report.select(_folder(part).alias("_of"), F.col("key").alias("_key"))
    return kept.join(valid, ["_of", "_key"], "left_semi").select(*rows.columns), report


# ---- grids


def fill_grid(cells: DataFrame, keys: list[str], path: str, build: Callable[[DataFrame], DataFrame], batches: int = 8) -> DataFrame:
    """Writes `build` of the cells that `path` lacks, and gives these cells. Cells go in batches: a batch replaces its own
    cells (dynamic partition overwrite) and is listed after that, so a run that is stopped goes on with the first batch
    that is not listed, and cells that were half written are written again."""
    spark = cells.sparkSession
    schema = cells.select(*keys).schema
    done = stored(spark, f"{path}/done", schema)
    own = cells.select(*keys).distinct()
    todo = written(spark, own.join(done, same(own, done, keys), "left_anti").withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(batches))), "todo")
    for i in range(batches):
        now = todo.filter(F.col("_batch") == i).select(*keys)
        if not now.isEmpty():
            build(now).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/data")
            now.write.mode("append").parquet(f"{path}/done")
    return todo.select(*keys)


# ---- rows at chosen positions


def file_intervals(spark: SparkSession, path: str) -> DataFrame:
    """file, first and last position of each file that has rows: positions run over all files in name order. Only the
    files' footers are read."""
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    after = F.sum("n").over(Window.orderBy("file"))  # a row a file
    return files.select("file", (after - F.col("n")).alias("first"), (after - 1).alias("last"))


def read_positions(spark: SparkSession, path: str, wanted: DataFrame, position: str = "position") -> DataFrame:
    """The rows at the wanted positions (a table, repeats allowed), with `position`. Positions that are null, negative or
    past the end give no row.

    The positions are looked up in the files' intervals by an equal join on strides of the mean file's length, in which
    each file begins few times. Only the files concerned are opened (their names are a list of files, which planning a
    scan holds as well), and in them the reader's row numbers are joined."""
    intervals = written(spark, file_intervals(spark, path), "intervals")
    total, n = intervals.agg(F.coalesce(F.max("last") + 1, F.lit(0)), F.count("*")).first()
    stride = max(1, -(-total // max(1, n)))
    grid = intervals.withColumn("_stride", F.explode(F.sequence(F.floor(F.col("first") / stride), F.floor(F.col("last") / stride))))
    own = wanted.select(F.col(position).cast("long").alias("position")).withColumn("_stride", F.floor(F.col("position") / stride))
    found = own.join(grid, "_stride").filter("position between first and last").select("position", "file", (F.col("position") - F.col("first")).alias("_row"))
    found = written(spark, found, "positions")
    files = [r.file for r in found.select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], spark.read.parquet(path).schema.add("position", "long"))
    rows = spark.read.parquet(*files).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return rows.join(found, (F.col("_file") == F.col("file")) & (F.col("_at") == F.col("_row"))).drop("_file", "_at", "file", "_row")

"""Sources and sinks: labelled folders, JSON records with a fixed schema, gated records, materialisations kept by a key of
everything that made them; and the queries over stored tables (`sources/stored.py`)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixtures import duck, scores, table
from plumbline.operators.quality import _REC, CHECKS, problems, records
from plumbline.shared import shared_path, written
from plumbline.sources.stored import cache_parts, content, fill_grid, read_positions, read_scores, sink_scores


def src_folder_labels(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file below one folder a class (3 or label=3): label, null where the name is no number; path, bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", r"/(?:label=)?([^/]*)/[^/]+$", 1).try_cast("int").alias("label"), "path", F.col("length").alias("bytes"))


def src_records(spark: SparkSession, path: str, schema, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records of the kinds, skipped ones) from every JSON file below a folder; the schema is never inferred."""
    all_ = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return all_.filter(F.col("kind").isin(kinds)), all_.filter(~F.col("kind").isin(kinds))


def sink_records(df: DataFrame, checks: dict[str, str], key: str, path: str) -> DataFrame:
    """Writes the records that break no check; gives what was written."""
    bad = problems(df, [key], checks).select(key).distinct()
    df.join(bad, key, "left_anti").write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def cache_keyed(spark: SparkSession, base: str, made_from: dict, build: Callable[[], DataFrame]) -> tuple[DataFrame, str, bool]:
    """(table, key, reused): the table is kept below a key of all it was made from; another key builds anew."""
    key = hashlib.sha256(json.dumps(made_from, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    path = f"{base}/key={key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    reused = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if not reused:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), key, reused


def q_folder(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "folders")
    rows = table(spark, sf, "embeddings").select("label", F.col("vec_id").cast("string").alias("value"))
    rows.repartition("label", F.pmod(F.xxhash64("value"), F.lit(4))).write.partitionBy("label").text(path)  # several tasks a class
    return src_folder_labels(spark, path).groupBy("label").agg(F.sum("bytes").alias("bytes"))


def q_records(spark: SparkSession, sf: str) -> DataFrame:
    own, path = records(spark, sf), shared_path(spark, "records")
    own.filter("schema_version = 1").write.json(f"{path}/v1")
    own.filter("schema_version <> 1").write.json(f"{path}/more/v2")
    kept, skipped = src_records(spark, path, own.schema, ["accuracy", "calibration", "latency", "conformal"])
    return kept.withColumn("skipped", F.lit(False)).unionByName(skipped.withColumn("skipped", F.lit(True))).select("id", "kind", "schema_version", "skipped")


def md5_int(text: Column) -> Column:
    """48 bits of a text's MD5, which both engines have."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _whole(values: str, unit: int) -> Column:
    """An array of numbers as whole multiples of 1 / unit, joined."""
    return F.array_join(F.transform(values, lambda x: F.round(x.cast("double") * unit).cast("long").cast("string")), ",")


def q_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The key holds the content of the data, arrays included, not just its number of rows."""
    base, own = shared_path(spark, "cache"), table(spark, sf, "embeddings")
    sums = content(own, [], md5_int(F.concat_ws("|", "vec_id", "label", _whole("embedding", 1_000_000)))).first()
    made_from = {"content": sums.content or "0", "dataset": "embeddings", "n": sums.n, "split": "calibration"}
    build = lambda: own.filter("vec_id % 4 = 0")
    _, _, first = cache_keyed(spark, base, made_from, build)
    again, key, reused = cache_keyed(spark, base, made_from, build)
    return again.agg(F.count("*").alias("n")).select(F.lit(key).alias("key"), "n", F.lit(first).alias("first_reused"), F.lit(reused).alias("reused"))


def q_cache_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of the documents, kept by source; then one text of one source changes."""
    base, docs = shared_path(spark, "cache-parts"), table(spark, sf, "documents").select("doc_id", "source", "text")
    build = lambda df: df.select("doc_id", "source", F.length("text").alias("chars"))
    _, first = cache_parts(docs, "source", base, build)
    one = written(spark, docs.filter("source = 'src3'").agg(F.min("doc_id").alias("doc_id")).withColumn("more", F.lit("!")), "changed")
    changed = docs.join(one, "doc_id", "left").withColumn("text", F.concat("text", F.coalesce("more", F.lit("")))).drop("more")
    kept, second = cache_parts(changed, "source", base, build)
    own = kept.groupBy("source").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return own.join(first.select("source", F.col("rebuilt").alias("first_built")), "source").join(second.select("source", "rebuilt"), "source")


SCORE_CELLS = ["model", "build", "cond_id"]


def score_row() -> Column:
    """All of a row, its scores as multiples of 1/2000, which they are."""
    return md5_int(F.concat_ws("|", "model", "build", "split", "cond_id", "item", "label", _whole("z", 2000)))


def q_sink_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores written by cell, the manifest of their files added up, and the rows that a checked read gives back."""
    own, path = scores(spark, sf), shared_path(spark, "scores")
    manifest = sink_scores(own, path, SCORE_CELLS, score_row())
    back = read_scores(spark, path, own.schema, SCORE_CELLS, score_row()).groupBy(*SCORE_CELLS).agg(F.count("*").alias("read_back"))
    sums = manifest.groupBy(*SCORE_CELLS).agg(F.sum("n").alias("n"), F.sum(F.col("content").cast("decimal(38,0)")).cast("string").alias("content"))
    return sums.join(back, SCORE_CELLS)


def q_resume(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of kinds and datasets of which two datasets are written first; the second run writes the other cells."""
    own, path = records(spark, sf), shared_path(spark, "grid")
    cells, keys = own.select("kind", "dataset").distinct(), ["kind", "dataset"]
    build = lambda todo: own.join(todo, keys, "left_semi").select(*keys, "id", "n_items")
    fill_grid(cells.filter("dataset in ('ds0', 'ds1')"), keys, path, build)
    later = fill_grid(cells, keys, path, build).withColumn("later", F.lit(True))
    rows = spark.read.schema(build(cells).schema).parquet(f"{path}/data").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("n_items").alias("items"))
    return rows.join(later, keys, "left").select(*keys, "n", "items", F.coalesce("later", F.lit(False)).alias("resumed"))


def q_chosen(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stored in several files in the order of their ids, and those at chosen positions read."""
    path, docs = shared_path(spark, "positions"), table(spark, sf, "documents").select("doc_id", "source")
    docs.repartitionByRange(16, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    wanted = docs.filter("doc_id % 7 = 3 and (doc_id div 100) % 3 = 1").select(F.col("doc_id").alias("position"))
    return read_positions(spark, path, wanted).select("position", "doc_id", "source")


QUERIES = {
    "src_folder_labels": q_folder,
    "src_records": q_records,
    "sink_scores": q_sink_scores,
    "sink_records": lambda s, d: sink_records(records(s, d), CHECKS["dq_record"], "id", shared_path(s, "records")).select("id", "kind", "build"),
    "cache_keyed": q_cache,
    "cache_parts": q_cache_parts,
    "work_grid_resume": q_resume,
    "src_parquet_chosen": q_chosen,
}
_BAD = " or ".join(f"({c.replace('regexp_like(', 'regexp_matches(')})" for c in CHECKS["dq_record"].values())
ORACLE = {
    "src_folder_labels": "select label, sum(length(vec_id::varchar) + 1)::bigint bytes from embeddings group by 1",
    "src_records": f"{_REC} select id, kind, schema_version, kind not in ('accuracy', 'calibration', 'latency', 'conformal') skipped from r",
    "sink_scores": duck("select model, build, cond_id, count(*) n, sum(('0x' || substr(md5(concat_ws('|', model, build, split, cond_id, item, label, array_to_string(list_transform(z, lambda x: round(x * 2000)::bigint), ','))), 1, 12))::bigint)::varchar as content, count(*) read_back from scores group by 1, 2, 3", "scores"),
    "sink_records": f"{_REC} select id, kind, build from r where not coalesce({_BAD}, false)",
    "cache_keyed": """with e as (select ('0x' || substr(md5(concat_ws('|', vec_id, label, array_to_string(list_transform(embedding, lambda x: round(x::double * 1000000)::bigint), ','))), 1, 12))::bigint h from embeddings)
select substr(sha256('{"content":"' || (select coalesce(sum(h), 0)::varchar from e) || '","dataset":"embeddings","n":' || (select count(*) from e) || ',"split":"calibration"}'), 1, 16) as key,
  (select count(*) from embeddings where vec_id % 4 = 0) n, false first_reused, true reused""",
    "cache_parts": "select source, count(*) n, (sum(length(text)) + (source = 'src3')::int)::bigint chars, true first_built, source = 'src3' rebuilt from documents group by source",
    "work_grid_resume": f"{_REC} select kind, dataset, count(*) n, sum(n_items)::bigint items, dataset not in ('ds0', 'ds1') resumed from r group by 1, 2",
    "src_parquet_chosen": "with p as (select row_number() over (order by doc_id) - 1 as position, doc_id, source from documents) select p.* from p where position in (select doc_id from documents where doc_id % 7 = 3 and (doc_id // 100) % 3 = 1)",
}

"""A corpus pipeline (part of the training-data subpackage): toxic documents go, near copies go, sources are mixed to
target weights, and what is left is encoded. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run`
writes each as Parquet in the shared folder and reads it again for the next.

Every stage takes null and empty texts as texts without words, texts of any length whole, null ids and sources as values
of their own, and an empty table as one that gives an empty table; columns beyond those of `documents` are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, near_copies, toxicity
from plumbline.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay, unchanged, repeated rows too. The field learns from the labelled rows that are not
    held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), f"not ({toxicity.HELD_OUT})")
    scored = toxicity.tag(docs.select(*COLUMNS, F.col("text").alias("_scored")), model, text="_scored")
    return scored.filter("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays, once: five-word shingles, a similarity of 0.8 or
    more. Repeated rows leave one; rows without an id stand only for groups in which no row has one."""
    return near_copies.deduplicate(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of about as many documents, by repeating or leaving out whole documents. Copies are
    equal rows; repeated rows are drawn alike."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, and whether they decode to its text (null for a null text)."""
    done = bpe.encode(docs.select("doc_id", "source", "text"), decoded="_decoded")
    return done.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("_decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: SQL cannot express the trained field, the hash or the vocabulary: tests hold `run` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Checks of texts: numbers nobody explained, sentences that say too much, quotes, fingerprints of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixtures import table

NUMBER = r"[0-9]+(?:\.[0-9]+)?%?"


def stray_numbers(docs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Number tokens of each text that are no allowed formatted value, with their counts."""
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n")).join(F.broadcast(allowed), "token", "left_anti")  # a fixed few hundred values


def sentences(text: Column) -> Column:
    """Sentences end at . ! ? before white space, at blank lines, and before list items and headings."""
    cut = F.regexp_replace(text, r"([.!?])\s+", "$1\x01")
    cut = F.regexp_replace(F.regexp_replace(cut, r"\n\s*\n", "\x01"), r"\n([ \t]*[-*+#|>][ \t])", "\x01$1")
    return F.filter(F.transform(F.split(cut, "\x01"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def overclaims(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Sentences that hold both patterns."""
    own = docs.select("doc_id", F.explode(sentences(F.col("text"))).alias("sentence"))
    return own.filter(F.col("sentence").rlike(first) & F.col("sentence").rlike(second))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quotes(quoted: DataFrame, docs: DataFrame) -> DataFrame:
    """How many source paragraphs (lines) equal each quoted text after white space is collapsed."""
    paragraphs = docs.select(F.explode(F.split("text", "\n")).alias("p")).select(squeezed(F.col("p")).alias("p"))
    wanted = quoted.select("item_id", squeezed(F.col("text")).alias("p"))
    hits = paragraphs.join(wanted, "p").groupBy("item_id").agg(F.count("*").alias("hits"))
    return quoted.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def content_fingerprint(text: Column) -> Column:
    """SHA-256 with line ends as line feeds."""
    return F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256)


def fp_verify(df: DataFrame, manifest: DataFrame, on: str) -> DataFrame:
    """Rows whose fingerprint differs from the stored one, or that have none."""
    both = df.join(manifest, on, "left")
    return both.filter(~F.col("sha").eqNullSafe(F.col("stored"))).select(on, F.when(F.col("stored").isNull(), "not listed").otherwise("differs").alias("problem"))


def pages_sha(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", content_fingerprint(F.col("html")).alias("sha"))


def q_verify(spark: SparkSession, sf: str) -> DataFrame:
    own = pages_sha(spark, sf)
    stored = own.filter("page_id % 50 <> 7").select("page_id", F.when(F.col("page_id") % 20 == 3, F.lit("0" * 64)).otherwise(F.col("sha")).alias("stored"))
    return fp_verify(own, stored, "page_id")


def positions(df: DataFrame) -> DataFrame:
    """df with `position`: the running number of its row over all files, in name order.

    Rows are numbered inside their file by the reader; only the table of files is summed in a window.
    """
    from pyspark.sql import Window

    own = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = own.groupBy("_file").agg(F.count("*").alias("_n"))
    before = files.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))  # a row a file
    return own.join(before, "_file").withColumn("position", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def q_positions(spark: SparkSession, sf: str) -> DataFrame:
    return positions(table(spark, sf, "documents")).select("position", "doc_id", "source")


def src_count_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.count("*").alias("n"))


ALLOWED = [str(i) for i in range(0, 100)] + [f"{i}%" for i in range(0, 101)] + ["2.0", "4.0", "2023", "2024"]
QUERIES = {
    "dq_stray_numbers": lambda s, d: stray_numbers(table(s, d, "documents"), s.createDataFrame([(t,) for t in ALLOWED], "token string")),
    "dq_overclaims": lambda s, d: overclaims(table(s, d, "documents"), "(?i)licensed", "(?i)version|cc by"),
    "dq_quotes": lambda s, d: quotes(table(s, d, "benchmark"), table(s, d, "documents")),
    "dq_unlisted_docs": lambda s, d: table(s, d, "documents").filter("lang not in ('fr', 'es')").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang"),
    "dq_claims": lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count_if(F.col("quality").isNull()).alias("without_claim"), F.count("*").alias("n")),
    "fp_content": pages_sha,
    "fp_verify": q_verify,
    "src_parquet_positions": q_positions,
    "src_count_rows": lambda s, d: src_count_rows(table(s, d, "lineitem")),
}
_SQ = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
ORACLE = {
    "dq_stray_numbers": f"with t as (select doc_id, unnest(regexp_extract_all(text, '{NUMBER}')) token from documents) select doc_id, token, count(*) n from t where token not in ({', '.join(repr(t) for t in ALLOWED)}) group by 1, 2",
    "dq_overclaims": r"with c as (select doc_id, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), '\n([ \t]*[-*+#|>][ \t])', chr(1) || '\1', 'g'), chr(1))) s from documents), n as (select doc_id, " + _SQ.format("s") + r" sentence from c) select doc_id, sentence from n where sentence <> '' and regexp_matches(sentence, '(?i)licensed') and regexp_matches(sentence, '(?i)version|cc by')",
    "dq_quotes": "with p as (select " + _SQ.format("p") + " p from (select unnest(string_split(text, chr(10))) p from documents)), q as (select item_id, " + _SQ.format("text") + " p from benchmark) select item_id, count(p.p) hits from q left join p on p.p = q.p group by 1",
    "dq_unlisted_docs": "select doc_id, lang from documents where lang not in ('fr', 'es') and doc_id not in (select doc_id from labels)",
    "dq_claims": "select source, count(*) filter (quality is null) without_claim, count(*) n from documents left join labels using (doc_id) group by 1",
    "fp_content": "select page_id, sha256(replace(html, chr(13) || chr(10), chr(10))) sha from pages",
    "fp_verify": "select page_id, case when page_id % 50 = 7 then 'not listed' else 'differs' end problem from pages where page_id % 50 = 7 or page_id % 20 = 3",
    "src_parquet_positions": "select row_number() over () - 1 as position, doc_id, source from documents",
    "src_count_rows": "select 'lineitem.parquet' file, count(*) n from lineitem",
}

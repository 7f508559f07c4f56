"""Repeated lines removed with two Bloom filters (operator 12).

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least `least` code points that
at least two documents hold lose all their lines but those of the document with the smallest id.

Filters.  One pass hashes the keys of each document into two Bloom filters: hashes seen once, and hashes that were
there already when another document brought them. Each task fills a pair of its own and sends the words that are not
zero; a bit of the second filter is set if a task set it there or two tasks set it in the first, so the pairs merge in
any order, segment by segment. A filter has 16 bits a line and at most `FILTER_WORDS` words (64 MB), the bound on what
is collected and broadcast; beyond 33 million lines it fills up, more keys are suspected, and results stay the same.

Confirmation.  A second pass shuffles only the lines whose hash is in the twice-seen filter, as (SHA-256 of the key,
document). The smallest and the largest id of a key say whether it repeats and who keeps it; keys that many documents
hold are reduced to two ids before the shuffle, and plain tables are joined, so that Spark can split a hot key.
Documents without suspected lines are passed on unshuffled; the others are joined with the keys that they lose.

Cases: a null or empty text is one empty line, which is too short to repeat; texts of any length and number of lines
are taken whole; rows of one id are one document; rows without an id are one document that comes after all others, so
they lose what a row with an id holds; lines repeated inside one document stay; an empty table gives an empty table;
other columns pass through, results replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import clean_text, table, written

#: 64-bit words of a filter, at most and at least (powers of two).
FILTER_WORDS, LEAST_WORDS = 1 << 23, 1 << 18
#: Words of a segment, the unit in which filters are merged.
SEGMENT = 1 << 12
#: Hashes added at a time.
AT_ONCE = 200_000

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def line_keys(text: bytes, least: int) -> list[bytes]:
    """The key of each line in order; empty for keys of fewer than `least` code points."""
    keys = [x.strip(WHITE) for x in text.translate(_TO_LOWER).split(b"\n")]
    return [k if len(k) >= 4 * least or (len(k) if k.isascii() else sum(b & 0xC0 != 0x80 for b in k)) >= least else b"" for k in keys]


class Filters:
    """The once-seen and the twice-seen filter. A hash sets four bits of one word."""

    def __init__(self, words: int):
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    @staticmethod
    def place(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.zeros(len(hashes), np.uint64)
        for shift in (40, 46, 52, 58):
            mask |= np.uint64(1) << (hashes >> np.uint64(shift) & np.uint64(63))
        return (hashes & np.uint64(words - 1)).astype(np.int64), mask

    def see(self, hashes: np.ndarray) -> None:
        """Adds hashes, each as often as documents hold it."""
        own, times = np.unique(hashes, return_counts=True)
        at, mask = self.place(own, len(self.once))
        again = (times > 1) | (self.once[at] & mask == mask)
        np.bitwise_or.at(self.twice, at[again], mask[again])
        np.bitwise_or.at(self.once, at, mask)

    def segments(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(segment, places of its words that are not zero, these words of both filters)."""
        for s in range(0, len(self.once), SEGMENT):
            at = np.flatnonzero(self.once[s : s + SEGMENT])
            if len(at):
                yield s // SEGMENT, at.astype(np.uint16).tobytes(), self.once[s + at].tobytes(), self.twice[s + at].tobytes()


def suspected(hashes: np.ndarray, twice: np.ndarray) -> np.ndarray:
    at, mask = Filters.place(hashes, len(twice))
    return twice[at] & mask == mask


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]


def twice_seen(df: DataFrame, text: str = "text", least: int = 10, words: int | None = None) -> np.ndarray:
    """The filter of hashes that more than one row may hold."""
    own = df.select(clean_text(F.col(f"`{text}`")).alias("text"))
    if words is None:
        lines = own.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
        words = 1 << max(0, (lines // 4 - 1).bit_length())  # 16 bits a line
        words = max(LEAST_WORDS, min(FILTER_WORDS, words))

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, waiting, n = Filters(words), [], 0
        for batch in it:
            for x in _texts(batch, 0):
                keys = set(line_keys(x, least)) - {b""}
                waiting.append(_hashes(list(keys)))
                n += len(keys)
                if n > AT_ONCE:
                    both.see(np.concatenate(waiting))
                    waiting, n = [], 0
        if n:
            both.see(np.concatenate(waiting))
        for part in both.segments():
            yield pa.RecordBatch.from_arrays([pa.array([part[0]], pa.int32()), *[pa.array([x], pa.binary()) for x in part[1:]]], names=["segment", "at", "once", "twice"])

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in it:
            for s, at, once, twice in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                o, t = held.setdefault(s, (np.zeros(SEGMENT, np.uint64), np.zeros(SEGMENT, np.uint64)))
                at, once = np.frombuffer(at, np.uint16), np.frombuffer(once, np.uint64)
                t[at] |= np.frombuffer(twice, np.uint64) | o[at] & once
                o[at] |= once
        for s, (_, t) in held.items():
            if t.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([t.tobytes()], pa.binary())], names=["segment", "twice"])

    filled = own.mapInArrow(fill, "segment int, at binary, once binary, twice binary").repartition("segment")
    out = np.zeros(words, np.uint64)
    for r in filled.mapInArrow(merge, "segment int, twice binary").toLocalIterator():  # FILTER_WORDS words at most
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.twice, np.uint64)
    return out


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = 10, words: int | None = None) -> DataFrame:
    """df with its texts without repeated lines, `n_lines` before and `n_dropped`."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in (text, "n_lines", "n_dropped")]
    docs = df.select(*[F.col(f"`{c}`") for c in rest], clean_text(F.col(f"`{text}`")).alias(text))
    shared = spark.sparkContext.broadcast(twice_seen(docs, text, least, words))
    at, id_at, plain = len(rest), rest.index(id), docs.schema

    def names(keys: list[bytes]) -> list[bytes]:
        """SHA-256 of the suspected keys."""
        keys = [k for k in dict.fromkeys(keys) if k]
        return [hashlib.sha256(keys[i]).digest() for i in np.flatnonzero(suspected(_hashes(keys), shared.value))]

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each suspected key of a document; `mark` tells texts without an id apart."""
        for batch in it:
            found = [names(line_keys(x, least)) for x in _texts(batch, 1)]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            marks = [hashlib.sha256(x).digest() if i is None else b"" for i, x in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([marks[i] for i in row], pa.binary()), pa.array([n for x in found for n in x], pa.binary())], names=["id", "mark", "name"])

    def parted(suspects: bool):
        """The documents that have suspected lines, or those that have none, with their numbers of lines."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                texts = _texts(batch, at)
                keep = pa.array([bool(names(line_keys(x, least))) == suspects for x in texts])
                lines = pa.array([x.count(b"\n") + 1 for x in texts], pa.int64())
                marks = pa.array([hashlib.sha256(x).digest() if i is None else b"" for i, x in zip(batch.column(id_at).to_pylist(), texts, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, lines, marks], names=[*plain.names, "n_lines", "_mark"]).filter(keep)

        return run

    id_type = docs.schema[id].dataType
    rows = T.StructType([T.StructField("id", id_type), T.StructField("mark", T.BinaryType()), T.StructField("name", T.BinaryType())])
    held = written(spark, docs.select(F.col(f"`{id}`"), F.col(f"`{text}`")).mapInArrow(emit, rows), "suspects")
    ends = held.groupBy("name").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("more"))
    first = written(spark, ends.filter("first is not null and (first < last or more)").select("name", "first"), "repeated")
    lost = held.join(first, "name").filter("id is null or id > first").select("id", "mark", "name")
    lost = written(spark, lost.groupBy("id", "mark").agg(F.collect_set("name").alias("_names")), "lost").withColumnsRenamed({"id": "_id", "mark": "_lost"})
    with_lines = T.StructType([*plain.fields, T.StructField("n_lines", T.LongType()), T.StructField("_mark", T.BinaryType())])
    dirty = docs.mapInArrow(parted(True), with_lines)
    joined = dirty.join(lost, dirty[id].eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_lost")), "left").drop("_mark", "_id", "_lost")

    def drop(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kept, dropped = [], []
            for x, gone in zip(_texts(batch, at), batch.column(at + 2).to_pylist(), strict=True):
                if gone:
                    gone = set(gone)
                    lines, keys = x.split(b"\n"), line_keys(x, least)
                    known = {k: hashlib.sha256(k).digest() in gone for k in set(keys) if k}
                    stay = [y for y, k in zip(lines, keys, strict=True) if not known.get(k)]
                    dropped.append(len(lines) - len(stay))
                    x = b"\n".join(stay)
                else:
                    dropped.append(0)
                kept.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(kept, pa.binary()).cast(pa.string(), safe=False), batch.column(at + 1), pa.array(dropped, pa.int64())], names=out.names)

    out = T.StructType([*plain.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    clean = docs.mapInArrow(parted(False), with_lines).drop("_mark").withColumn("n_dropped", F.lit(0).cast("long"))
    return clean.unionByName(joined.mapInArrow(drop, out))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op12_line_dedup": op12_line_dedup}
ORACLE = {
    "op12_line_dedup": """
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) parts from documents),
l as (select doc_id, unnest(parts) line, generate_subscripts(parts, 1) i from s),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
r as (select key, min(doc_id) first_id from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.*, r.key is not null and doc_id <> first_id dropped from k left join r using (key))
select doc_id, count(*)::bigint n_lines, (count(*) filter (where dropped))::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) kept_sha256
from m group by doc_id
"""
}

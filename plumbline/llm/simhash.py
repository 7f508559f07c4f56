"""SimHash near-duplicates found by Golay-code fuzzy hashing (operator 10).

Fingerprint.  A-Z are lower-cased, words are runs of non-space, shingles are `width` words joined by a space (a
shorter text is one shingle, a text without words has fingerprint zero). A bit of the 64-bit fingerprint is set if
it is set in more than half of the shingles' XXH64 hashes (seed 42), repeats included.

Keys.  Fingerprints link at `bits` = 3 or fewer differing bits. Three differing bits leave at least one of the four
16-bit segments untouched; the other 48 bits are two halves of 24, one of which has at most one difference. Of such
a half 23 bits are decoded by the perfect [23, 12, 7] Golay code: a fingerprint gets the index of every codeword
within distance 4 (one index, or six where the nearest codeword is three away). Two words up to two bits apart
always share such a codeword. A key is (segment, its 16 bits, half, the 12-bit index): 28 bits that the pair must
share, in 8 to 48 keys for each distinct fingerprint, so that buckets stay small until there are about 2**28 of them.

Links.  Equal fingerprints are folded first. Only keys that several fingerprints share go on. A bucket is dealt into
blocks of bounded size; each pair of blocks is one group, in which every pair is compared, so no pair is lost and no
group outgrows a task; a group gives a spanning forest of its links (at most one row a fingerprint), not all pairs.

Components.  Smallest reachable id by alternating large-star and small-star steps, each written to the shared folder; the
steps halve paths, so 40 rounds (`most`) reach further than any graph that fits storage, and more raise an error.

Fingerprints say little about a similarity of 0.8: `near_copies` is this operator's interface for that rule; it takes
these links as candidates, adds others, and verifies them.

Cases: null and empty texts have fingerprint zero and link with one another; a row with a null id gets a fingerprint
and its component's smallest id (null if no row there has one); repeated rows give repeated rows of one component; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import clean_text, table, written

SEED = 42
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GOLAY = 0b110001110101
#: Fingerprints of a block; a group compares two blocks.
BLOCK = 2048

_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_hashes(text: str, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 hashes of the text's shingles, repeats included."""
    words = text.encode().translate(_TO_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    k = min(width, n)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64, n - k + 1)


def fingerprint(text: str, width: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text."""
    return majority(shingle_hashes(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """df without its text, with the fingerprint as a signed 64-bit integer."""
    rest = [c for c in df.columns if c not in (out, text)]
    df = df.select(*[F.col(f"`{c}`") for c in rest], clean_text(text).alias(text))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField(out, T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([fingerprint(t, width) for t in batch.column(len(rest)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*rest, out])

    return df.mapInArrow(batches, schema)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits' values (4096 rows, 2 columns), and for each of the 2048
    syndromes the error patterns of weight up to 4 (up to six; -1 fills), lightest first."""
    unit = []
    for i in range(23):
        x = 1 << i
        for j in range(i, 10, -1):
            if x >> j & 1:
                x ^= GOLAY << (j - 11)
        unit.append(x)
    part = np.zeros((4096, 2), np.int64)
    for v in range(4096):
        for i in range(12):
            if v >> i & 1:
                part[v, 0] ^= unit[i]
                part[v, 1] ^= unit[12 + i] if i < 11 else 0
    errors = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    bits = np.array(unit)
    ranks = np.arange(23)
    for weight in range(5):
        grid = np.array(np.meshgrid(*[ranks] * weight, indexing="ij")).reshape(weight, -1).T if weight else np.zeros((1, 0), np.int64)
        grid = grid[np.all(np.diff(grid, axis=1) > 0, axis=1)] if weight > 1 else grid
        syndrome = np.bitwise_xor.reduce(bits[grid], axis=1) if weight else np.zeros(1, np.int64)
        pattern = (1 << grid).sum(axis=1) if weight else np.zeros(1, np.int64)
        for s, e in zip(syndrome.tolist(), pattern.tolist(), strict=True):
            if weight < 4 or errors[s, 0].item().bit_count() == 3:
                errors[s, filled[s]] = e
                filled[s] += 1
    return part, errors


def golay_indices(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Indices (12 information bits) of all codewords within distance 4 of 23-bit words: six columns, -1 fills."""
    part, errors = tables
    e = errors[part[words & 4095, 0] ^ part[words >> 12, 1]]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def fuzzy_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of signed fingerprints."""
    u = fps.view(np.uint64)
    seg = [(u >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    rows, keys = [], []
    for s in range(4):
        a, b, c = (seg[i] for i in range(4) if i != s)
        rest = a << 32 | b << 16 | c
        for half in range(2):
            word = rest >> (24 * half) & ((1 << 23) - 1)
            index = golay_indices(word, tables)
            r, k = np.nonzero(index >= 0)
            rows.append(r)
            keys.append(((np.int64(s << 1 | half) << 28) | (seg[s][r] << 12) | index[r, k]))
    return np.concatenate(rows), np.concatenate(keys)


def keyed(fps: DataFrame, col: str = "fp") -> DataFrame:
    """(key, fp) rows of distinct fingerprints."""
    tables = golay_tables()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(own), 20_000):
                part = own[i : i + 20_000]
                rows, keys = fuzzy_keys(part, tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    return fps.select(col).mapInArrow(batches, "key long, fp long")


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that span the components of the distinct fingerprints under `bits` differing bits."""
    label = np.arange(len(fps))
    out = []
    u = fps.view(np.uint64)
    for i in range(len(fps) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= bits)
        near = near[label[near] != label[i]]
        while len(near):  # one link to each other component met
            j = near[0]
            out.append((int(fps[i]), int(fps[j])))
            label[label == label[j]] = label[i]
            near = near[label[near] != label[i]]
    return out


def links(fps: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b) links of distinct fingerprints `fp` that connect exactly those that chains of `bits` or fewer
    differing bits connect."""
    if not 0 <= bits <= 3:
        raise ValueError(f"the keys find all pairs of up to 3 differing bits, not {bits}")
    keys = keyed(fps)
    sizes = written(fps.sparkSession, keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    # a block number for each row, and every pair of blocks that it takes part in
    dealt = keys.join(sizes, "key").withColumn("m", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(fp), m) as int)"))
    dealt = dealt.withColumn("pair", F.explode(F.expr("transform(sequence(0, m - 1), x -> struct(least(x, own) as i, greatest(x, own) as j))")))
    dealt = dealt.select("key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "fp")
    grouped = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: each run of equal (key, i, j) is one bounded group."""
        kept: np.ndarray | None = None
        for batch in it:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = rows if kept is None else np.concatenate([kept, rows])
            if not len(rows):
                continue
            cuts = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield _linked(rows[:last], cuts[:-1], bits)
            kept = rows[last:]
        if kept is not None:
            yield _linked(kept, np.zeros(0, np.int64), bits)

    return grouped.mapInArrow(runs, "a long, b long").distinct()


def _linked(rows: np.ndarray, cuts: np.ndarray, bits: int) -> pa.RecordBatch:
    found: list[tuple[int, int]] = []
    edges = [0, *cuts.tolist(), len(rows)]
    fp = rows[:, 3]
    size = np.diff(edges)
    two = np.array(edges[:-1])[size == 2]  # most groups: compared at once
    if len(two):
        x, y = fp[two], fp[two + 1]
        ok = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= bits
        found += zip(x[ok].tolist(), y[ok].tolist(), strict=True)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 2:
            found += forest(fp[a:b].copy(), bits)
    pairs = np.array([(min(x), max(x)) for x in found], np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def components(spark: SparkSession, edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node it is connected to.

    Large-star and small-star steps in turns, until a round changes nothing; all work is grouping and joining on
    nodes, with sums and minima formed before the shuffle.
    """
    now = written(spark, edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).filter("v > w").distinct(), "edges")
    state = None
    for _ in range(most):
        both = now.union(now.select(F.col("w").alias("v"), F.col("v").alias("w")))
        least = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
        # large star: every larger neighbour of v is led to the smallest of v and its neighbours
        least = written(spark, least, "least")  # a plain table: Spark can then split the join where a node has very many links
        large = now.select(F.col("w").alias("v"), F.col("v").alias("x")).join(least, "v").select(F.col("x").alias("v"), F.col("m").alias("w"))
        # small star: v and its smaller neighbours are led to the smallest of them
        large = written(spark, large, "large")
        small = written(spark, large.groupBy("v").agg(F.min("w").alias("m")), "small")
        led = large.join(small, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).filter("v > w")
        now = written(spark, led.union(small.select("v", F.col("m").alias("w"))).distinct(), "edges")
        # a star forest: every v has one neighbour, and no neighbour is itself a v
        own = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)")).alias("h")).first()
        if state == (own.n, own.h):
            break
        state = (own.n, own.h)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("w").alias("root"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id: the smallest id reachable through links."""
    spark = df.sparkSession
    docs = written(spark, fingerprints(df.select(F.col(id), F.col(text)), text, "fp", width), "fingerprints")
    least = docs.groupBy("fp").agg(F.min(id).alias("least"))
    distinct = written(spark, least, "distinct")
    nodes = components(spark, links(distinct.select("fp"), bits))
    # the component of a fingerprint, then its smallest id
    rooted = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    led = written(spark, rooted.join(smallest, "root").select("fp", "component_id"), "led")
    out = docs.join(led, "fp")  # plain tables: Spark can split a fingerprint that very many rows have
    return out.select(F.col(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash": op10_simhash}
ORACLE: dict[str, str] = {}

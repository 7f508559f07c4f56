"""Near copies by SimHash links and the exact similarity of word shingles (operator 10 with verification; the pipeline's
near-duplicate stage).

Rule.  Words and shingles are those of `simhash`, five words wide. Two texts are near copies if their sets of shingles
(as 64-bit hashes) have a Jaccard similarity of `least` = 0.8 or more; texts without words are copies of each other.
Groups are what chains of near copies connect.

Candidates.  SimHash fingerprints of the shingles, linked through Golay-code keys at three differing bits or fewer. These
alone miss most pairs of the rule, which differ by 4 to 11 of 64 bits; so texts that share a band of MinHash values are
candidates too: 32 bands of 6 values, a pair at 0.8 shares none with a probability of 6e-5 (0.85: 1e-7). Texts of a band
are led to the smallest of it, which makes as many links as rows, not pairs; the components of all these links hold
every candidate pair.

Names.  A text is named by its MD5: at 128 bits different texts do not share a name.

Verification.  A component of up to `BLOCK` texts and `BLOCK_BYTES` bytes is one group, in which all sets are compared. In larger ones each text
is first compared with the text that it was led to, in groups of bounded size: that connects most of a large group of
copies in linear work. Then only texts that are not connected yet are compared: connected parts of more than a block
have blocks of their own, the others share blocks (so many that a block holds about `BLOCK` texts or `BLOCK_BYTES` bytes), and each pair of blocks is a group, but pairs inside one connected
part. A pair is left out only where its sizes rule 0.8 out or where verified links connect it already.

Cases: null texts count as empty; repeated rows are one text; a text shorter than five words is one shingle; ties (equal
texts under several ids) go to the smallest id; texts of any length are compared whole; an empty table gives an empty
table; other columns pass through `deduplicate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.common import bucketed, clean_text, settled, written
from plumbline.llm.simhash import components, majority, shingle_hashes

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 32, 6
#: Texts and bytes of a block, about; a group compares two blocks.
BLOCK, BLOCK_BYTES = 256, 16_000_000

_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes; a text without words has the single hash 0."""
    return _distinct(shingle_hashes(text, width))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of the set's MinHash values."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(own), 1024):
        least = np.minimum(least, (own[i : i + 1024, None] * _FACTORS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(v.tobytes(), band) for band, v in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def node(text: str) -> Column:
    """Names a text: equal texts are one node."""
    return F.md5(clean_text(F.col(f"`{text}`")))


def spanning(nodes: list[str], sets: list[np.ndarray], least: float, labels: list[str] | None = None) -> list[tuple[str, str]]:
    """Links that span the components of the sets under a similarity of `least` or more; sets with equal labels are
    connected already."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    label = np.unique(labels if labels else nodes, return_inverse=True)[1][order]
    nodes, sets = [nodes[i] for i in order], [sets[i] for i in order]
    n = np.array([len(s) for s in sets])
    start = np.append(0, np.cumsum(n))
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    held, out = np.zeros(len(values), np.int64), []
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(n, n[i] / least + 1e-9, "right"))  # larger sets cannot be similar enough
        if np.all(label[i + 1 : stop] == label[i]):
            continue
        held[flat[start[i] : start[i + 1]]] = 1
        common = np.add.reduceat(held[flat[start[i + 1] : start[stop]]], start[i + 1 : stop] - start[i + 1])
        held[flat[start[i] : start[i + 1]]] = 0
        near = i + 1 + np.flatnonzero(common >= least * (n[i] + n[i + 1 : stop] - common) - 1e-9)
        for j in near:
            if label[j] != label[i]:
                out.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return out


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= least * (len(x) + len(y) - common) - 1e-9


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _pairs(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in range(2)], names=["a", "b"])


def _blocks(block: int) -> Column:
    """How many blocks the rows of a group make, by their number and their bytes."""
    return F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")


def candidates(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): texts (node, text) led to a smaller one that they share a band or nearly a fingerprint with; and each text once,
    combined before it is shuffled, in buckets of nodes. Both are written."""
    spark = texts.sparkSession

    def signed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps, keys = [], []
            for t in batch.column(1).to_pylist():
                hashes = shingle_hashes(t, width)
                fps.append(majority(hashes))
                keys.append(band_keys(_distinct(hashes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["node", "text", "fp", "keys"])

    once = texts.mapInArrow(signed, "node string, text string, fp long, keys array<long>").groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "keys", "text")], F.first(F.octet_length("text")).cast("long").alias("bytes"))
    once = bucketed(spark, once, "signatures", "node")  # the join that picks texts of candidates does not move them all again
    keys = once.select("node", F.explode("keys").alias("key"))
    shared = written(spark, keys.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared")
    by_band = keys.join(shared, "key").select(F.col("node").alias("a"), "b")
    leads = written(spark, once.groupBy("fp").agg(F.min("node").alias("b")), "fingerprints")
    alike = once.select("node", "fp").join(leads, "fp").select(F.col("node").alias("a"), "b")
    near = written(spark, simhash.links(leads.select("fp")), "links")
    by_print = near.join(leads.select(F.col("fp").alias("a"), F.col("b").alias("x")), "a").join(leads.select(F.col("fp").alias("b"), F.col("b").alias("y")), "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return written(spark, by_band.union(alike).union(by_print).filter("a != b").distinct(), "candidates"), once.select("node", "bytes", "text")


def led_pairs(pairs: DataFrame, texts: DataFrame, width: int, least: float, block: int) -> DataFrame:
    """The pairs (a, b) that are near copies. The members a of each b are dealt into groups of bounded size."""
    sizes = written(pairs.sparkSession, pairs.groupBy("b").agg(F.ceil(F.count("*") / block).cast("int").alias("m")), "led-sizes")
    heads = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("b", "part", F.lit(0).alias("side"), F.col("b").alias("node"))
    members = pairs.join(sizes, "b").select("b", F.expr("cast(pmod(xxhash64(a), m) as int)").alias("part"), F.lit(1).alias("side"), F.col("a").alias("node"))
    rows = heads.union(members).join(texts, "node").select("b", "part", "side", "node", "text")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "side")

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b, _), group in groupby(_rows(it), key=lambda r: r[:2]):
            head, found = None, []
            for _, _, side, node, text in group:
                own = shingle_set(text, width)
                if side == 0:
                    head = own
                elif similar(head, own, least):
                    found.append((node, b))
            yield _pairs(found)

    return rows.mapInArrow(compared, "a string, b string")


def _in_blocks(led: DataFrame, sizes: DataFrame, pairs: DataFrame, found: DataFrame, width: int, least: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(links found on the way, rows root, i, j, node, label): the groups in which the texts that are not connected yet meet."""
    spark = led.sparkSession
    # in large components each text is compared with the one that it is led to; what that connects has one label
    large = written(spark, led.join(sizes.filter("m > 1"), "root").select("node", "root", "bytes"), "large")
    first = written(spark, led_pairs(pairs.join(large.select(F.col("node").alias("a")), "a", "left_semi"), found, width, least, block), "led-links")
    label = components(spark, first).withColumnRenamed("root", "label")
    large = large.join(written(spark, label, "labels"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    small = led.join(large.select("node"), "node", "left_anti").select("node", "root", "bytes", F.col("node").alias("label"))
    nodes = written(spark, large.select("node", "root", "bytes", "label").union(small), "nodes")
    # series of blocks: one for the connected parts of more than a block each, one (part 0) for all other texts of a root
    parts = nodes.groupBy("root", "label").agg(_blocks(block).alias("m"))
    big = written(spark, parts.filter("m > 1"), "big")
    parted = nodes.join(big.select("root", "label", F.lit(True).alias("_big")), ["root", "label"], "left").withColumn("series", F.when(F.col("_big"), F.col("label")))
    parted = written(spark, parted.select("node", "root", "bytes", "label", "series"), "parted")
    series = parted.groupBy("root", "series").agg(_blocks(block).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("root").orderBy("series"))  # a row for each series, of more than a block each
    series = written(spark, series.select("root", "series", "m", (upto - F.col("m")).cast("int").alias("low"), F.sum("m").over(Window.partitionBy("root")).cast("int").alias("all")), "series")
    dealt = parted.join(series.withColumnRenamed("root", "r").withColumnRenamed("series", "s"), (F.col("root") == F.col("r")) & F.col("series").eqNullSafe(F.col("s")))
    dealt = dealt.withColumn("own", F.expr("low + cast(pmod(xxhash64(node), m) as int)"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda x: F.col("series").isNull() | (x < F.col("low")) | (x >= F.col("low") + F.col("m")))
    dealt = dealt.withColumn("pair", F.explode(F.transform(others, lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))))
    return first, dealt.select("root", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "node", "label")


def links(df: DataFrame, text: str = "text", width: int = WIDTH, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(a, b) links of nodes that connect those that chains of near copies connect."""
    if not 0.8 <= least <= 1:
        raise ValueError(f"the bands are made for a similarity of 0.8 or more, not {least}")
    spark = df.sparkSession
    texts = df.select(node(text).alias("node"), clean_text(F.col(f"`{text}`")).alias("text"))
    pairs, once = candidates(texts, width)
    led = components(spark, pairs)
    led = led.union(led.select(F.col("root").alias("node"), "root").distinct()).join(once.select("node", "bytes"), "node")
    led = written(spark, led, "led")
    sizes = written(spark, led.groupBy("root").agg(_blocks(block).alias("m")), "sizes")
    found = written(spark, once.join(led.select("node"), "node", "left_semi"), "texts")
    if sizes.filter("m > 1").limit(1).count():
        first, dealt = _in_blocks(led, sizes, pairs, found, width, least, block)
    else:
        first, dealt = None, led.select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", F.col("node").alias("label"))
    rows = dealt.join(found, "node").select("root", "i", "j", "node", "label", "text")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_rows(it), key=lambda r: r[:3]):
            own = [(r[3], shingle_set(r[5], width), r[4]) for r in group]
            yield _pairs(spanning([x for x, _, _ in own], [s for _, s, _ in own], least, [x for _, _, x in own]) if len(own) > 1 else [])

    near = rows.mapInArrow(compared, "a string, b string").distinct()
    return first.union(near) if first is not None else near


def groups(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """node, root (the smallest node of the group), the smallest id among the rows with the node's text, whether they have
    none, and how many of them have that id: a row a text."""
    led = written(df.sparkSession, components(df.sparkSession, links(df, text, width, least)), "led")
    each = df.groupBy(node(text).alias("node"), F.col(f"`{id}`").alias("id")).agg(F.count("*").alias("rows"))
    each = each.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rows")).alias("m"))
    return each.join(led, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "m.*")


def deduplicate(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """df with one row of each group of near copies: the one with the smallest id, then the smallest node. A row
    without an id stands only for a group in which no row has one. Only rows that occur more than once are dealt anew."""
    least_rows = lambda: groups(df, id, text, width, least).groupBy("root").agg(F.min(F.struct("none", "id", "node", "rows")).alias("row"))
    first = settled(df.sparkSession, lambda: least_rows().select(F.col("row.id").alias("_first"), F.col("row.node").alias("_node"), F.col("row.rows").alias("_rows")), "first")
    kept = lambda rows: df.join(rows, F.col(f"`{id}`").eqNullSafe(F.col("_first")) & (node(text) == F.col("_node")), "left_semi")
    once = kept(first.filter("_rows = 1"))
    if not first.filter("_rows > 1").count():
        return once
    return once.union(kept(first.filter("_rows > 1")).withColumn("_text_node", node(text)).dropDuplicates([id, "_text_node"]).drop("_text_node"))

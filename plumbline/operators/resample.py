"""Resampling and paired comparison by a Poisson bootstrap.

The weight of (item, replicate) is an inverse Poisson(1) draw from a hash of item, seed and replicate, so pairing across
builds, conditions and metrics is automatic: whatever is measured on an item gets the same weight everywhere. The hash
is 32-bit arithmetic that numpy does for whole batches and SQL repeats. An estimate is a function of weighted sums;
`boot_sums` forms these as matrix products and shuffles only replicates x keys rows from each task.

`Metric` is the registry's entry: columns of an item, and the statistic of their weighted sums. Users add their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixtures import GOLDEN, LAST, MIX, OTHER, duck, hits, poisson_steps, scores
from plumbline.functions import scoring as S
from plumbline.operators.metrics import aurc_columns, bin_of, harmonic, r9, scored, set_rows
from plumbline.operators.ordered import BLOCK_ROWS, in_blocks
from plumbline.operators.outcomes import CELL, outcomes
from plumbline.shared import written

#: Replicates and seed of every interval.
B, SEED = 1000, 0
#: Rows that are multiplied at a time, and keys whose sums a task holds before it gives them out.
ROWS, KEYS = 2_000, 500
#: Items of equal confidence whose weights are summed before the items are put in order.
HEAVY = 2_000

#: Items whose weights are drawn at a time, so that the arrays at work stay near the processor.
DRAWN = 64

_STEPS = [np.uint16(s) for s in poisson_steps()]


def _mix(x: np.ndarray, steps=MIX) -> np.ndarray:
    for shift, factor in steps:
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x


class _Draws:
    """Weights of a few items at a time, in arrays that are used again. Each 32-bit number gives two of them, the lower half
    first: replicate r is lane r ^ 1."""

    def __init__(self, b: int, seed: int, rows: int = DRAWN):
        self.half, self.seed, self.most = -(-b // 2), np.uint32(seed), rows
        self.steps = np.arange(self.half, dtype=np.uint32) * np.uint32(GOLDEN)
        self.y, self.t = (np.empty((rows, self.half), np.uint32) for _ in range(2))
        self.w, self.above = (np.empty((rows, 2 * self.half), kind) for kind in (np.uint8, bool))

    def hashes(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the draws of each item start from."""
        a = _mix((items & 0xFFFFFFFF).astype(np.uint32) ^ self.seed)
        return a, _mix(a ^ (items >> 32 & 0xFFFFFFFF).astype(np.uint32) ^ np.uint32(OTHER))

    def weights(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """(items, lanes), of at most `rows` items; the next call writes over it."""
        y, t, w, above = (x[: len(a)] for x in (self.y, self.t, self.w, self.above))
        np.add(a[:, None], self.steps, out=y)
        for shift, factor in MIX:
            y ^= np.right_shift(y, np.uint32(shift), out=t)
            if factor != 1:
                y *= np.uint32(factor)
        y ^= c[:, None]
        y ^= np.right_shift(y, np.uint32(LAST[0]), out=t)
        y *= np.uint32(LAST[1])
        u = y.view(np.uint16)
        np.greater_equal(u, _STEPS[0], out=w.view(bool))
        for step in _STEPS[1:]:
            w += np.greater_equal(u, step, out=above).view(np.uint8)
        return w


def weight_matrix(items: np.ndarray, b: int, seed: int) -> np.ndarray:
    """(items, replicates) weights."""
    unique, at = np.unique(items.astype(np.int64), return_inverse=True)
    draws, out = _Draws(b, seed, min(DRAWN, len(unique))), np.empty((len(unique), -(-b // 2), 2))
    a, c = draws.hashes(unique)
    for i in range(0, len(unique), DRAWN):
        own = draws.weights(a[i : i + DRAWN], c[i : i + DRAWN])
        out[i : i + DRAWN] = own.reshape(len(own), -1, 2)[:, :, ::-1]
    w = out.reshape(len(unique), 2 * draws.half)[:, :b]
    return w if len(unique) == len(items) and np.array_equal(unique, items) else w[at]


def bs_weights(items: DataFrame, b: int = B, seed: int = SEED) -> DataFrame:
    """item, b, w as rows, by built-in functions."""
    own = items.select("item", F.expr(f"(item & 4294967295L) ^ {seed}L").alias("a"))

    def mix(df: DataFrame, x: str, steps=MIX) -> DataFrame:
        for shift, factor in steps:
            df = df.withColumn(x, F.expr(f"(({x} ^ shiftright({x}, {shift})) * {factor}L) & 4294967295L"))
        return df

    own = mix(mix(own, "a").withColumn("c", F.expr(f"a ^ (shiftright(item, 32) & 4294967295L) ^ {OTHER}L")), "c")
    own = own.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(-(-b // 2) - 1))))
    own = mix(own.withColumn("y", F.expr(f"(a + g * {GOLDEN}L) & 4294967295L")), "y")
    own = mix(own.withColumn("y", F.expr("y ^ c")), "y", (LAST,))
    own = own.select("item", "g", F.explode(F.array(F.struct(F.lit(0).alias("j"), F.shiftright("y", 16).alias("u")), F.struct(F.lit(1).alias("j"), F.col("y").bitwiseAND(F.lit(65535)).alias("u")))).alias("d"))
    w = sum(((F.col("d.u") >= s).cast("int") for s in poisson_steps()), F.lit(0))
    return own.select("item", (2 * F.col("g") + F.col("d.j")).alias("b"), w.alias("w")).filter(F.col("b") < b)


def boot_sums(df: DataFrame, keys: list[str], values: list[str], b: int = B, seed: int = SEED, item: str = "item", plain: bool = False) -> DataFrame:
    """keys, b, sw and the weighted sum of each value (same name); plain: the sums without weights too, as b = -1, so that
    an estimate and its interval take one pass."""
    own = df.select(*keys, F.col(item).cast("long").alias("_item"), *[F.col(v).cast("double").alias(v) for v in values])
    schema = T.StructType([*(own.schema[k] for k in keys), T.StructField("b", T.IntegerType()), T.StructField("sw", T.DoubleType()), *[T.StructField(v, T.DoubleType()) for v in values]])
    n, first = len(keys), -1 if plain else 0

    def give(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, sums in held.items():
            fixed = [pa.repeat(k, b - first) for k in key]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(first, b, dtype=np.int32)), *map(pa.array, sums)], names=schema.names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for whole in it:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                unique, at = np.unique(batch.column(n).to_numpy(zero_copy_only=False), return_inverse=True)
                w = weight_matrix(unique, b, seed)
                x = np.column_stack([np.ones(batch.num_rows), *(batch.column(n + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(values)))])
                groups = _groups(batch, n)
                dense = len(groups) * len(unique) <= 2 * batch.num_rows  # the keys share items: their weights stand once
                if dense:
                    wide = np.zeros((len(unique), len(groups), x.shape[1]))
                    for i, (_, rows) in enumerate(groups):
                        np.add.at(wide, (at[rows], i), x[rows])
                    products = (wide.reshape(len(unique), -1).T @ w).reshape(len(groups), x.shape[1], b)
                for i, (key, rows) in enumerate(groups):
                    sums = products[i] if dense else x[rows].T @ w[at[rows]]
                    if plain:
                        sums = np.column_stack([x[rows].sum(axis=0), sums])
                    held[key] = held[key] + sums if key in held else sums
                if len(held) > KEYS:
                    yield from give(held)
                    held = {}
        yield from give(held)

    sums = own.mapInArrow(batches, schema)
    return sums.groupBy(*keys, "b").agg(*[F.sum(c).alias(c) for c in ("sw", *values)])


def _groups(batch: pa.RecordBatch, n: int) -> list[tuple[tuple, np.ndarray | slice]]:
    """The distinct values of the first n columns, as Arrow scalars, with their rows."""
    codes = np.zeros(batch.num_rows, np.int64)
    for i in range(n):
        own = pc.dictionary_encode(batch.column(i), null_encoding="encode")
        codes = codes * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    parts = np.split(order, cuts) if len(cuts) else [slice(0, batch.num_rows)]
    return [(tuple(batch.column(i)[0 if isinstance(rows, slice) else int(rows[0])] for i in range(n)), rows) for rows in parts]


@dataclass(frozen=True)
class Metric:
    """What the bootstrap can estimate: `columns` of an item; groups `by` within which they are summed; `statistic`, a
    Column over the weighted sums (same names) and `sw`, the sum of weights - an aggregate where `by` is given."""

    columns: dict[str, Column]
    statistic: Column
    by: dict[str, Column] = field(default_factory=dict)


METRICS: dict[str, Callable[[], Metric]] = {
    "accuracy": lambda: Metric({"v": F.col("correct")}, F.col("v") / F.col("sw")),
    "confidence": lambda: Metric({"v": F.col("confidence")}, F.col("v") / F.col("sw")),
    "overconfidence": lambda: Metric({"c": F.col("confidence"), "v": F.col("correct")}, (F.col("c") - F.col("v")) / F.col("sw")),
    "ece": lambda: Metric({"gap": F.col("confidence") - F.col("correct")}, F.sum(F.abs("gap")) / F.sum("sw"), {"bin": bin_of(F.col("confidence"))}),
}


def replicates(df: DataFrame, keys: list[str], metric: Metric, b: int = B, seed: int = SEED) -> DataFrame:
    """keys, b, value of a metric in every replicate."""
    own = df.select(*keys, "item", *[c.alias(n) for n, c in {**metric.by, **metric.columns}.items()])
    sums = boot_sums(own, [*keys, *metric.by], list(metric.columns), b, seed)
    return sums.groupBy(*keys, "b").agg(metric.statistic.alias("value")) if metric.by else sums.select(*keys, "b", metric.statistic.alias("value"))


def bootstrap(df: DataFrame, keys: list[str], metric: str | Metric, b: int = B) -> DataFrame:
    """keys, lo, hi of a registered metric, or of one's own."""
    return interval(replicates(df, keys, METRICS[metric]() if isinstance(metric, str) else metric, b), keys, F.col("value"))


def interval(df: DataFrame, keys: list[str], value: Column, level: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """keys, lo, hi: the percentile interval (linear interpolation) of the replicates' values."""
    p = F.percentile(value, F.array(*map(F.lit, level)))
    return df.groupBy(*keys).agg(p.alias("_p")).select(*keys, r9(F.col("_p")[0]).alias("lo"), r9(F.col("_p")[1]).alias("hi"))


def bs_mean_ci(df: DataFrame, keys: list[str], value: str, b: int = B) -> DataFrame:
    sums = written(df.sparkSession, boot_sums(df.select(*keys, "item", F.col(value).alias("x")), keys, ["x"], b, plain=True), "sums")
    means = sums.filter("b = -1").select(*keys, r9(F.col("x") / F.col("sw")).alias("value"), F.col("sw").cast("long").alias("n"))
    return means.join(interval(sums.filter("b >= 0"), keys, F.col("x") / F.col("sw")), keys)


def paired(df: DataFrame, a: Column, b: Column, on: list[str], value: str = "correct") -> DataFrame:
    """One row for each pairing of `on` with x = value of b minus value of a; a and b pick the rows of each side."""
    left = df.filter(a).select(*on, F.col(value).alias("_a"))
    right = df.filter(b).select(*on, F.col(value).alias("_b"))
    return left.join(right, on).withColumn("x", F.col("_b") - F.col("_a")).drop("_a", "_b")


def unpaired_items(df: DataFrame, a: Column, b: Column, on: list[str]) -> DataFrame:
    """Items that only one side has: pairing is refused where this has rows."""
    return df.filter(a).select(*on).join(df.filter(b).select(*on), on, "left_anti").union(df.filter(b).select(*on).join(df.filter(a).select(*on), on, "left_anti"))


def difference_ci(diff: DataFrame, keys: list[str], b: int = B) -> DataFrame:
    """keys, n, count (whole items), value, lo, hi, side."""
    sums = written(diff.sparkSession, boot_sums(diff, keys, ["x"], b, plain=True), "sums")
    point = sums.filter("b = -1").select(*keys, F.col("sw").cast("long").alias("n"), F.col("x").cast("long").alias("count"), r9(F.col("x") / F.col("sw")).alias("value"))
    return point.join(interval(sums.filter("b >= 0"), keys, F.col("x") / F.col("sw")), keys).withColumn("side", S.interval_side(F.col("lo"), F.col("hi")))


def bs_paired_diff(df: DataFrame, b: int = B) -> DataFrame:
    """Shrunk minus reference, correct answers on the same items, in each condition. One pass pairs the builds: items
    that only one of them has drop out."""
    side = lambda build: F.max(F.when(F.col("build") == build, F.col("correct")))
    both = df.groupBy("model", "cond_id", "item").agg((side("small") - side("ref")).alias("x")).filter("x is not null")
    return difference_ci(both, ["model", "cond_id"], b)


def bs_unpaired_diff(a: DataFrame, c: DataFrame, keys: list[str], value: str = "correct", b: int = B) -> DataFrame:
    """Mean of c minus mean of a on different items, each resampled on its own."""
    sums = boot_sums(a, keys, [value], b).select(*keys, "b", (F.col(value) / F.col("sw")).alias("va")).join(boot_sums(c, keys, [value], b).select(*keys, "b", (F.col(value) / F.col("sw")).alias("vc")), [*keys, "b"])
    point = a.groupBy(*keys).agg(F.avg(value).alias("va")).join(c.groupBy(*keys).agg(F.avg(value).alias("vc")), keys).select(*keys, r9(F.col("vc") - F.col("va")).alias("value"))
    return point.join(interval(sums, keys, F.col("vc") - F.col("va")), keys)


def ece_metric(confidence: str = "confidence") -> Metric:
    return Metric({"gap": F.col(confidence) - F.col("correct")}, F.sum(F.abs("gap")) / F.sum("sw"), {"bin": bin_of(F.col(confidence))})


def bs_ece_ci(df: DataFrame, b: int = B) -> DataFrame:
    return bootstrap(df, CELL, "ece", b)


def bs_ece_diff_ci(df: DataFrame, b: int = B) -> DataFrame:
    """ECE with the scaled confidence minus ECE with the raw one, on the same replicates."""
    raw, scaled_ = (replicates(df, CELL, ece_metric(c), b).withColumnRenamed("value", n) for c, n in (("confidence", "raw"), ("scaled", "ece")))
    return interval(raw.join(scaled_, [*CELL, "b"]), CELL, F.col("ece") - F.col("raw")).withColumn("side", S.interval_side(F.col("lo"), F.col("hi")))


def _harmonics(n: np.ndarray) -> np.ndarray:
    """Harmonic numbers of whole counts: summed up to 40, beyond by the asymptotic series."""
    x = np.maximum(n, 1.0)
    y = 1 / (x * x)  # whole powers would be taken one by one
    far = np.log(x) + 0.5772156649015329 + 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))
    if n.size and n.min() > 40:
        return far
    near = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, 41))])
    return np.where(n <= 40, near[np.minimum(n, 40).astype(np.int64)], far)


def _aurc_blocks(df: DataFrame, keys: list[str], b: int, seed: int, heavy: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The two kinds of rows of `aurc_blocks`, each written: items, and ties with their vectors. A mark stands for a tie while
    the rows are put in order, so that no vectors go through that."""
    spark = df.sparkSession
    own = written(spark, df.select(*keys, F.col("item").cast("long").alias("item"), "confidence", (1 - F.col("correct")).alias("wrong")), "aurc")
    tie, none = [*keys, "confidence"], F.lit(None)
    counted = own.groupBy(*tie).agg(F.count("*").alias("_n")).filter(F.col("_n") > heavy).drop("_n")
    for k in tie:  # a null equals none below
        counted = counted.filter(F.col(k).isNotNull())
    large = written(spark, counted, "ties")
    sums = boot_sums(own.join(large, tie, "left_semi"), tie, ["wrong"], b, seed)
    packed = sums.groupBy(*tie).agg(F.array_sort(F.collect_list(F.struct("b", "sw", "wrong"))).alias("p"))
    marks = large.select(*keys, none.cast("long").alias("item"), "confidence", none.cast("double").alias("wrong"), F.lit(True).alias("_tied"), F.lit(50).alias("_size"))
    single = own.join(large, tie, "left_anti").select(*keys, "item", "confidence", "wrong", F.lit(False).alias("_tied"), F.lit(1).alias("_size"))
    blocks = in_blocks(single.unionByName(marks), keys, "confidence", descending=True, rows=rows, size="_size").drop("_size")
    tied = blocks.filter("_tied").select(*tie, "_block").join(packed, tie)
    return blocks.filter("not _tied").drop("_tied"), written(spark, tied.select(*tie, "_block", F.col("p.sw").alias("ties"), F.col("p.wrong").alias("tie_errors")), "tied")


def aurc_blocks(df: DataFrame, keys: list[str], b: int = B, seed: int = SEED, heavy: int = HEAVY, rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, item, confidence, wrong, ties, tie_errors, `_block`: the items in blocks of the order of confidence. A tie of
    more than `heavy` items is one row without an item: its weights are summed beforehand, in all tasks that read it, to a
    vector of `b` sums of weights and one of weighted errors. Such a row counts for 50, so that a block holds about `rows`
    numbers of rows at most, and `heavy` more in its last tie, whatever share of the items is equal."""
    single, tied = _aurc_blocks(df, keys, b, seed, heavy, rows)
    return single.unionByName(tied, allowMissingColumns=True)


def aurc_replicates(df: DataFrame, keys: list[str], b: int = B, seed: int = SEED, heavy: int = HEAVY, rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, b, aurc and e_aurc: an item of weight w takes w places in its tie group.

    Items are dealt into blocks of the order of confidence (`aurc_blocks`). One pass sums the weights of each block, so that
    a block knows what lies before it in every replicate; a second walks each block, whose ties are whole.

    The area of a tie of m places, f errors and s places and e errors before it is f + (e - s f / m) (H(s + m) - H(s)).
    Summed up by parts, a block's area is its errors, and e H(s) at its end less that at its start, less f H(s + m) +
    s f / m (H(s + m) - H(s)) for each tie: nothing where no item is wrong, and (s + m) H(s + m) - s H(s) where all are.
    So neighbouring ties without right items, or without wrong ones, count as one, and only their ends are looked up.
    """
    blocks, tied = _aurc_blocks(df, keys, b, seed, heavy, rows)
    of = [*keys, "_block"]
    sums = boot_sums(blocks, of, ["wrong"], b, seed)
    each = tied.select(*of, F.posexplode(F.arrays_zip("ties", "tie_errors")).alias("b", "t"))
    sums = sums.unionByName(each.select(*of, "b", F.col("t.ties").alias("sw"), F.col("t.tie_errors").alias("wrong"))).groupBy(*of, "b").agg(F.sum("sw").alias("sw"), F.sum("wrong").alias("wrong"))
    w = Window.partitionBy(*keys, "b").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a cell
    before = sums.select(*of, "b", *[F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(c) for c in ("sw", "wrong")])
    packed = before.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("b", "sw", "wrong"))).alias("p"))
    starts = packed.select(*of, F.lit(None).cast("double").alias("confidence"), F.col("p.sw").alias("s"), F.col("p.wrong").alias("e"))
    known = starts.unionByName(tied.select(*of, "confidence", F.col("ties").alias("s"), F.col("tie_errors").alias("e")))
    schema = T.StructType([*(blocks.schema[k] for k in keys), T.StructField("b", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("a", "n", "e")]])

    def walk(group: pa.Table, known: pa.Table) -> pa.Table:
        vectors = [[np.array(v.values) for v in known.column(n)] for n in ("s", "e")]
        start = known.column("confidence").to_pylist().index(None)
        own = _Block(group.column("item"), group.column("confidence"), group.column("wrong"), known.column("confidence"), vectors, start, b, seed)
        fixed = [pa.repeat(known.column(k)[0], b) for k in keys]
        return pa.Table.from_arrays([*fixed, pa.array(np.arange(b, dtype=np.int32)), *map(pa.array, own.walked())], names=schema.names)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, they are not joined to a few: small rows, long work
    left, right = (x.repartition(parts, *of).groupBy(*of) for x in (blocks, known))
    sums = left.cogroup(right).applyInArrow(walk, schema).groupBy(*keys, "b").agg(*[F.sum(c).alias(c) for c in ("a", "n", "e")])
    n, c = F.col("n"), F.col("n") - F.col("e")
    best = (n - c) / n - (c / n) * (harmonic(n.cast("long")) - harmonic(c.cast("long")))
    return sums.select(*keys, "b", (F.col("a") / n).alias("aurc"), (F.col("a") / n - best).alias("e_aurc"))


class _Block:
    """A block of `aurc_replicates`: its items, the ties that are known by vectors, and what lies before it."""

    #: Kinds of segments besides 0 and 1: no item of theirs is wrong, or all are.
    MIXED, KNOWN = 2, 3

    def __init__(self, item: pa.ChunkedArray, confidence: pa.ChunkedArray, wrong: pa.ChunkedArray, ties: pa.ChunkedArray, vectors: list, start: int, b: int, seed: int):
        if item.null_count:
            raise ValueError("an item without a number has no weights")
        at = [i for i in range(len(ties)) if i != start]
        c = np.concatenate([confidence.to_numpy(), ties.to_numpy()[at]])
        order = np.argsort(-c, kind="stable")
        c = c[order]
        self.b, self.rows, self.draws = b, len(c), _Draws(b, seed)
        self.wrong = np.concatenate([wrong.fill_null(0).to_numpy(), np.full(len(at), np.nan)])[order]
        self.known = np.concatenate([np.full(len(item), -1), at]).astype(np.int64)[order]
        self.a, self.c = self.draws.hashes(np.concatenate([item.to_numpy(), np.zeros(len(at), np.int64)]).astype(np.int64)[order])
        self.lane = np.minimum(np.arange(2 * self.draws.half) ^ 1, b - 1)
        self.vectors = [[v[self.lane] for v in vs] for vs in vectors]
        self.s, self.e = (vs[start].copy() for vs in self.vectors)
        self._cut(c)

    def _cut(self, c: np.ndarray) -> None:
        """Segments: ties in which some items are right and some wrong, and runs of the others."""
        ties = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if self.rows else np.zeros(0, np.int64)
        low, high = (f.reduceat(self.wrong, ties) if self.rows else np.zeros(0) for f in (np.minimum, np.maximum))
        kind = np.where((low == high) & ((low == 0) | (low == 1)), low, self.MIXED).astype(np.int64)
        kind[self.known[ties] >= 0] = self.KNOWN
        new = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] >= self.MIXED))[: len(kind)]
        self.first, self.kind = ties[new], kind[new]
        self.last = np.append(self.first[1:], self.rows)[: len(self.first)]

    def _look_up(self, more: int) -> None:
        """Harmonic numbers, less the first one of the block, of all places from the least of `s` to `more` beyond the largest."""
        if self.s.max() + more < self.low + len(self.h):
            return
        self.low = int(self.s.min())
        x = np.arange(self.low, int(self.s.max()) + more + 2 * self.rows + 1, dtype=np.float64)
        self.h = np.concatenate([[0.0], np.cumsum(1 / x[1:])]) + (_harmonics(x[:1]) - self.base)
        self.xh = x * self.h

    def walked(self) -> list[np.ndarray]:
        """Area, places and errors of the block in each replicate."""
        self.low, self.h, self.base = 0, np.zeros(0), _harmonics(self.s.min(keepdims=True))
        s, e = self.s.copy(), self.e.copy()
        first, self.less = _harmonics(s) - self.base, np.zeros(len(s))
        at = segment = 0
        while at < self.rows:
            if self.kind[segment] == self.KNOWN:
                m, f = (vs[self.known[at]] for vs in self.vectors)
                h0, h1 = _harmonics(self.s) - self.base, _harmonics(self.s + m) - self.base
                self._add(m, f, f * h1 + f / np.maximum(m, 1) * self.s * (h1 - h0))
                to, end = at + 1, segment
            else:  # whole segments as far as they go; runs may be cut
                end = int(np.searchsorted(self.first, at + DRAWN)) - 1
                known = np.flatnonzero(self.kind[segment : end + 1] == self.KNOWN)
                end = segment + int(known[0]) - 1 if len(known) else end
                to = min(int(self.last[end]), at + DRAWN)
                if to < self.last[end] and self.kind[end] == self.MIXED:
                    to, end = (int(self.first[end]), end - 1) if end > segment else (int(self.last[end]), end)
                self._step(at, to, segment, end)
            at, segment = to, end + int(to == self.last[end])
        area = self.e - e + self.e * (_harmonics(self.s) - self.base) - e * first - self.less
        return [x[np.arange(self.b) ^ 1] for x in (area, self.s - s, self.e - e)]

    def _add(self, places: np.ndarray, errors: np.ndarray, less: np.ndarray) -> None:
        self.s, self.e, self.less = self.s + places, self.e + errors, self.less + less

    def _step(self, at: int, to: int, segment: int, end: int) -> None:
        """The rows at .. to, which are (parts of) the segments from `segment` to `end`."""
        self._look_up(len(_STEPS) * (to - at))
        w = np.concatenate([self.draws.weights(self.a[i : min(i + DRAWN, to)], self.c[i : min(i + DRAWN, to)]).astype(np.float32) for i in range(at, to, DRAWN)])
        kind, edges = self.kind[segment : end + 1], np.append(0, np.minimum(self.last[segment : end + 1], to) - at)
        upto = (np.arange(to - at) < edges[:, None]).astype(np.float32) @ w  # whole numbers far below 2**24: exact
        sign = np.append(0, kind == 1) - np.append(kind == 1, 0)
        here = np.add(upto, self.s - self.low).astype(np.intp)
        less, errors = sign.astype(np.float64) @ self.xh.take(here), (sign.astype(np.float32) @ upto).astype(np.float64)
        mixed = np.flatnonzero(kind == self.MIXED)
        if len(mixed):
            inside = (np.arange(to - at) >= edges[mixed, None]) & (np.arange(to - at) < edges[mixed + 1, None])
            f = np.where(inside, self.wrong[at:to], 0.0) @ w.astype(np.float64)
            m, h0, h1 = upto[mixed + 1] - upto[mixed], self.h.take(here[mixed]), self.h.take(here[mixed + 1])
            less = less + (f * h1 + f / np.maximum(m, 1) * (self.s + upto[mixed]) * (h1 - h0)).sum(axis=0)
            errors = errors + f.sum(axis=0)
        self._add(upto[-1], errors, less)


def bs_aurc_ci(df: DataFrame, b: int = B) -> DataFrame:
    reps = written(df.sparkSession, aurc_replicates(df, CELL, b), "replicates")
    e = interval(reps, CELL, F.col("e_aurc")).withColumnsRenamed({"lo": "e_lo", "hi": "e_hi"})
    return interval(reps, CELL, F.col("aurc")).join(e, CELL)


def bs_e_aurc_diff_ci(df: DataFrame, b: int = B) -> DataFrame:
    """Shrunk minus reference E-AURC on the same replicates."""
    side = lambda build: F.max(F.when(F.col("build") == build, F.col("e_aurc")))
    both = aurc_replicates(df, CELL, b).groupBy("model", "cond_id", "b").agg((side("small") - side("ref")).alias("x"))
    return interval(both, ["model", "cond_id"], F.col("x")).withColumn("side", S.interval_side(F.col("lo"), F.col("hi")))


def extra_gaps(df: DataFrame) -> DataFrame:
    """model, cond_id, item, x = (small - ref) under the condition minus (small - ref) on clean."""
    gap = df.groupBy("model", "cond_id", "item").agg(F.sum(F.when(F.col("build") == "small", F.col("correct")).otherwise(-F.col("correct"))).alias("g"))
    clean = F.max(F.when(F.col("cond_id") == "clean", F.col("g"))).over(Window.partitionBy("model", "item"))  # an item's few conditions
    return gap.withColumn("x", F.col("g") - clean).filter("cond_id <> 'clean' and x is not null").select("model", "cond_id", "item", "x")


def bs_extra_gap(df: DataFrame, b: int = B) -> DataFrame:
    return difference_ci(extra_gaps(df), ["model", "cond_id"], b)


def bs_extra_gap_diff(df: DataFrame, cond_a: str, cond_b: str, b: int = B) -> DataFrame:
    own = extra_gaps(df)
    both = own.filter(F.col("cond_id") == cond_a).select("model", "item", F.col("x").alias("xa")).join(own.filter(F.col("cond_id") == cond_b).select("model", "item", F.col("x").alias("xb")), ["model", "item"])
    return difference_ci(both.withColumn("x", F.col("xa") - F.col("xb")), ["model"], b)


def bs_variant_change(df: DataFrame, base: str, variant: str, cond: str, b: int = B) -> DataFrame:
    """A variant's extra gap minus the baseline's, and the share of the baseline's loss that it recovers."""
    own = extra_gaps(df).filter(F.col("cond_id") == cond)
    both = own.filter(F.col("model") == base).select("item", F.col("x").alias("xb")).join(own.filter(F.col("model") == variant).select("item", F.col("x").alias("xv")), "item")
    both = both.withColumns({"cond_id": F.lit(cond), "x": F.col("xv") - F.col("xb")})
    loss = both.groupBy("cond_id").agg(F.sum("xb").cast("long").alias("baseline"))
    return difference_ci(both, ["cond_id"], b).join(loss, "cond_id").withColumn("recovered", r9(F.when(F.col("baseline") < 0, -F.col("count") / F.col("baseline"))))


def average_rank(value: str, keys: list[str]) -> Column:
    """Ranks with ties averaged; windows over small dimension-sized groups."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def pearson(x: str, y: str) -> Column:
    """Correlation; null where one side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def stat_average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn("rank", average_rank(value, keys))


def stat_spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson of average ranks; null where one side is constant."""
    own = df.withColumns({"rx": average_rank(x, keys), "ry": average_rank(y, keys)})
    constant = (F.min("rx") == F.max("rx")) | (F.min("ry") == F.max("ry"))
    return own.groupBy(*keys).agg(F.count("*").alias("models"), r9(F.when(~constant, pearson("rx", "ry"))).alias("rho"))


def stat_corr_judged(df: DataFrame, keys: list[str], x: str, y: str, reference: str, least: int = 6, floor: float = 0.10) -> DataFrame:
    """Spearman over the models that are not near the floor, with the reason where there are too few."""
    own = df.groupBy(*keys).agg(F.count_if(F.col(reference) < floor).alias("near_floor"), F.count("*").alias("all_models"))
    rho = stat_spearman(df.filter(F.col(reference) >= floor), keys, x, y)
    joined = own.join(rho, keys, "left").withColumn("models", F.coalesce("models", F.lit(0)))
    few = F.col("models") < least
    return joined.select(*keys, "models", "near_floor", F.when(~few, F.col("rho")).alias("rho"), F.when(few, "too few models").when(F.col("rho").isNull(), "constant").otherwise("judged").alias("reason"))


def bs_corr_ci(df: DataFrame, x: str, y: str, b: int = B, most: int = 100, least: int = 4, seed: int = 0) -> DataFrame:
    """Spearman resampling the list of models (column `model`): replicates with fewer than `least` distinct models or a
    constant side are redrawn; the first b valid attempts count. Fails where `most` x b attempts give fewer. A handful
    of models, so windows are tiny."""
    spark = df.sparkSession
    listed = written(spark, df.select("model", x, y).withColumn("i", F.row_number().over(Window.orderBy("model")) - 1), "models")
    n = listed.count()
    valid, have, tried = None, 0, 0
    while have < b:
        if tried >= most * b:
            raise ValueError(f"{have} of {tried} attempts are valid, {b} are needed")
        draws = spark.range(tried, tried + 2 * b).select(F.col("id").cast("int").alias("b")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        index = F.conv(F.substring(F.md5(F.concat_ws("|", "b", "j", F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % n
        rows = draws.withColumn("i", index.cast("int")).join(listed, "i")
        ranked = rows.withColumns({"rx": average_rank(x, ["b"]), "ry": average_rank(y, ["b"])})
        constant = (F.min("rx") == F.max("rx")) | (F.min("ry") == F.max("ry"))
        each = ranked.groupBy("b").agg(F.count_distinct("i").alias("distinct"), F.when(~constant, pearson("rx", "ry")).alias("rho"))
        more = written(spark, each.filter((F.col("distinct") >= least) & F.col("rho").isNotNull()), "valid")
        valid, have, tried = more if valid is None else valid.union(more), have + more.count(), tried + 2 * b
    kept = valid.orderBy("b").limit(b)
    p = F.percentile("rho", F.array(F.lit(0.025), F.lit(0.975)))
    return kept.agg(F.count("*").alias("replicates"), (F.max("b") + 1 - F.count("*")).alias("redrawn"), p.alias("_p")).select("replicates", "redrawn", r9(F.col("_p")[0]).alias("lo"), r9(F.col("_p")[1]).alias("hi"))


def tops(spark: SparkSession, sf: str, models: int = 9, conds: tuple[str, ...] = ("clean", "demo/fade/3", "demo/jitter/5")) -> DataFrame:
    """A row for each model and condition: reference and shrunk top-1, their clean values, gap and extra gap. The counts they
    come from are written: a row for each cell, so that whatever joins them reads the items once."""
    return tops_of(written(spark, hits(spark, sf, models, list(conds)), "hits"))


def outcomes_fast(spark: SparkSession, sf: str, models: int, conds: list[str]) -> DataFrame:
    """Correctness only: what comparisons of top-1 need."""
    own = scores(spark, sf, models, conds)
    return own.select("model", "build", "split", "cond_id", "item", (S.first_best(F.col("z")) == F.col("label")).cast("double").alias("correct"))


def tops_of(counted: DataFrame) -> DataFrame:
    share = lambda build: F.max(F.when(F.col("build") == build, F.col("hits") / F.col("n")))
    wide = counted.groupBy("model", "cond_id").agg(share("ref").alias("ref"), share("small").alias("small"))
    clean = wide.filter("cond_id = 'clean'").select("model", F.col("ref").alias("ref0"), F.col("small").alias("small0"))
    gap = F.col("small") - F.col("ref")
    return wide.join(clean, "model").select("model", "cond_id", r9(F.col("ref")).alias("ref"), r9(F.col("small")).alias("small"), r9(F.col("ref0")).alias("ref0"), r9(gap).alias("gap"), r9(gap - (F.col("small0") - F.col("ref0"))).alias("extra"))


def scaled(spark: SparkSession, sf: str, t: float = 1.4) -> DataFrame:
    """Clean outcomes with the confidence at a temperature next to the raw one."""
    own = outcomes(scores(spark, sf, conds=["clean", "demo/fade/5"]))
    hot = S.with_probabilities(own.drop("p").withColumn("z", F.transform("z", lambda x: x / t))).select(*CELL, "item", F.array_max("p").alias("scaled"), "confidence", "correct")
    return hot


def q_unpaired(spark: SparkSession, sf: str) -> DataFrame:
    df = outcomes_fast(spark, sf, 1, ["clean", "demo/fade/3"])
    return bs_unpaired_diff(df.filter("split = 'tuning'"), df.filter("split = 'test'"), CELL)


QUERIES = {
    "bs_weights": lambda s, d: bs_weights(outcomes_fast(s, d, 1, ["clean"]).filter("build = 'ref'").select("item")).groupBy("b", "w").agg(F.count("*").alias("n")),
    "bs_mean_ci": lambda s, d: bs_mean_ci(set_rows(s, d), CELL, "covered"),
    "bs_paired_diff": lambda s, d: bs_paired_diff(scored(s, d)),
    "bs_unpaired_diff": q_unpaired,
    "bs_ece_ci": lambda s, d: bs_ece_ci(scored(s, d)),
    "bs_aurc_ci": lambda s, d: bs_aurc_ci(scored(s, d, conds=["clean"])),
    "bs_ece_diff_ci": lambda s, d: bs_ece_diff_ci(scaled(s, d)),
    "bs_e_aurc_diff_ci": lambda s, d: bs_e_aurc_diff_ci(scored(s, d, conds=["clean"])),
    "bs_extra_gap": lambda s, d: bs_extra_gap(scored(s, d)),
    "bs_extra_gap_diff": lambda s, d: bs_extra_gap_diff(scored(s, d), "demo/fade/5", "demo/jitter/3"),
    "bs_variant_change": lambda s, d: bs_variant_change(outcomes_fast(s, d, 2, ["clean", "demo/fade/5"]), "m0", "m1", "demo/fade/5"),
    "bs_corr_ci": lambda s, d: bs_corr_ci(tops(s, d, conds=("clean", "demo/fade/3")).filter("cond_id = 'demo/fade/3'"), "ref", "extra"),
    "stat_average_rank": lambda s, d: stat_average_rank(tops(s, d).withColumn("v", F.round("gap", 2)), ["cond_id"], "v").select("model", "cond_id", "v", "rank"),
    "stat_spearman": lambda s, d: stat_spearman(tops(s, d), ["cond_id"], "ref0", "gap"),
    "stat_corr_judged": lambda s, d: stat_corr_judged(tops(s, d), ["cond_id"], "ref", "extra", "ref"),
}

_C = "model, build, cond_id"
_Q = "round(quantile_cont(v, 0.025::double), 9) lo, round(quantile_cont(v, 0.975::double), 9) hi"
_SIDE = "case when lo > 0 then 'above zero' when hi < 0 then 'below zero' else 'includes zero' end side"
_FAST = "fast as materialized (select model, build, split, cond_id, item, case when list_position(z, list_max(z)) - 1 = label then 1.0::double else 0.0::double end correct from scores)"
_TOPS = f"""{_FAST}, wide as (select model, cond_id, avg(correct) filter (build = 'ref') r, avg(correct) filter (build = 'small') s from fast group by all),
tops as (select w.model, w.cond_id, round(w.r, 9) ref, round(w.s, 9) small, round(c.r, 9) ref0, round(w.s - w.r, 9) gap, round(w.s - w.r - (c.s - c.r), 9) extra from wide w join wide c on w.model = c.model and c.cond_id = 'clean')"""
_GAP = f"""gaps as (select model, cond_id, item, sum(case when build = 'small' then correct else -correct end) g from fast group by all),
extra as materialized (select a.model, a.cond_id, a.item, a.g - b.g x from gaps a join gaps b on a.model = b.model and a.item = b.item and b.cond_id = 'clean' where a.cond_id <> 'clean')"""


def _difference(rows: str, keys: str) -> str:
    """SQL of difference_ci over a relation with x."""
    reps = f"(select {keys}, b, sum(w * x) / sum(w) v from {rows} join weights using (item) group by all)"
    return f"select *, {_SIDE} from (select {keys}, count(*) n, sum(x)::bigint as count, round(avg(x), 9) as value from {rows} group by {keys}) join (select {keys}, {_Q} from {reps} group by {keys}) using ({keys})"


def _ece(confidence: str, rows: str) -> str:
    return f"(select {_C}, b, sum(abs(g)) / sum(sw) v from (select {_C}, b, greatest(0, least(14, ceil({confidence} * 15) - 1)) bin, sum(w * ({confidence} - correct)) g, sum(w) sw from {rows} join weights using (item) group by all) group by all)"


_REPS = f"""drawn as (select {_C}, b, confidence, sum(w) m, sum(w * (1 - correct)) e from outcomes join weights using (item) where w > 0 group by all),
wt as (select *, sum(m) over w - m s, sum(e) over w - e before from drawn window w as (partition by {_C}, b order by confidence desc)),
harm as materialized (select k, sum(case when k = 0 then 0 else 1.0::double / k end) over (order by k) h from range(0, (select max(s + m)::bigint + 1 from wt)) t(k)),
area as (select {_C}, b, sum(t.e + (t.before - t.s * t.e / t.m) * (y.h - x.h)) a, sum(t.m)::double n, sum(t.e) e from wt t join harm x on x.k = t.s join harm y on y.k = t.s + t.m group by all),
reps as (select {_C}, b, a / n aurc, a / n - ((n - c) / n - (c / n) * (hn.h - hc.h)) e_aurc from (select *, n - e c from area) z join harm hn on hn.k = z.n join harm hc on hc.k = z.c)"""
_SCALED = "hot as materialized (select model, build, cond_id, item, correct, confidence, list_max(list_transform(e, lambda v: round(v / list_sum(e), 12))) scaled from (select *, list_transform(z, lambda v: exp(v / 1.4::double - list_max(z) / 1.4::double)) e from outcomes))"


def _rank(v: str, keys: str) -> str:
    return f"rank() over (partition by {keys} order by {v}) + (count(*) over (partition by {keys}, {v}) - 1) / 2.0::double"


_RHO = "round(case when min(rx) < max(rx) and min(ry) < max(ry) then corr(rx, ry) end, 9)"
_NINE = {"models": 9, "conds": ["clean", "demo/fade/3", "demo/jitter/5"]}
ORACLE = {
    "bs_weights": duck("select b::int b, w, count(*) n from weights group by all", "weights"),
    "bs_mean_ci": duck(f"select * from (select {_C}, round(avg(covered), 9) as value, count(*) n from sets group by all) join (select {_C}, {_Q} from (select {_C}, b, sum(w * covered) / sum(w) v from sets join weights using (item) group by all) group by all) using ({_C})", "sets", "weights"),
    "bs_paired_diff": duck(_difference("pairs", "model, cond_id"), "scores", "weights", more=f"{_FAST}, pairs as materialized (select a.model, a.cond_id, a.item, b.correct - a.correct x from fast a join fast b using (model, cond_id, item) where a.build = 'ref' and b.build = 'small')"),
    "bs_unpaired_diff": duck(f"select {_C}, value, lo, hi from (select {_C}, round(avg(correct) filter (split = 'test') - avg(correct) filter (split = 'tuning'), 9) as value from fast group by all) join (select {_C}, {_Q} from (select {_C}, b, sum(w * correct) filter (split = 'test') / sum(w) filter (split = 'test') - sum(w * correct) filter (split = 'tuning') / sum(w) filter (split = 'tuning') v from fast join weights using (item) group by all) group by all) using ({_C})", "scores", "weights", more=_FAST, conds=["clean", "demo/fade/3"]),
    "bs_ece_ci": duck(f"select {_C}, {_Q} from {_ece('confidence', 'outcomes')} group by all", "outcomes", "weights"),
    "bs_aurc_ci": duck(f"select {_C}, round(quantile_cont(aurc, 0.025::double), 9) lo, round(quantile_cont(aurc, 0.975::double), 9) hi, round(quantile_cont(e_aurc, 0.025::double), 9) e_lo, round(quantile_cont(e_aurc, 0.975::double), 9) e_hi from reps group by all", "outcomes", "weights", more=_REPS, conds=["clean"]),
    "bs_ece_diff_ci": duck(f"select *, {_SIDE} from (select {_C}, {_Q} from (select {_C}, b, s.v - r.v v from {_ece('confidence', 'hot')} r join {_ece('scaled', 'hot')} s using ({_C}, b)) group by all)", "outcomes", "weights", more=_SCALED, conds=["clean", "demo/fade/5"]),
    "bs_e_aurc_diff_ci": duck(f"select *, {_SIDE} from (select model, cond_id, {_Q} from (select o.model, o.cond_id, n.e_aurc - o.e_aurc v from reps o join reps n using (model, cond_id, b) where o.build = 'ref' and n.build = 'small') group by all)", "outcomes", "weights", more=_REPS, conds=["clean"]),
    "bs_extra_gap": duck(_difference("extra", "model, cond_id"), "scores", "weights", more=f"{_FAST}, {_GAP}"),
    "bs_extra_gap_diff": duck(_difference("pairs", "model"), "scores", "weights", more=f"{_FAST}, {_GAP}, pairs as materialized (select a.model, a.item, a.x - b.x x from extra a join extra b using (model, item) where a.cond_id = 'demo/fade/5' and b.cond_id = 'demo/jitter/3')"),
    "bs_variant_change": duck(f"select d.*, baseline, round(case when baseline < 0 then -count / baseline::double end, 9) recovered from ({_difference('pairs', 'cond_id')}) d join (select cond_id, sum(xb)::bigint baseline from pairs group by 1) using (cond_id)", "scores", "weights", more=f"{_FAST}, {_GAP}, pairs as materialized (select a.cond_id, a.item, a.x xb, b.x - a.x x from extra a join extra b using (cond_id, item) where a.model = 'm0' and b.model = 'm1')", models=2, conds=["clean", "demo/fade/5"]),
    "bs_corr_ci": duck(f"""select count(*) replicates, max(b) + 1 - count(*) redrawn, round(quantile_cont(rho, 0.025::double), 9) lo, round(quantile_cont(rho, 0.975::double), 9) hi from (select *, row_number() over (order by b) k from (select b, count(distinct i) d, case when min(rx) < max(rx) and min(ry) < max(ry) then corr(rx, ry) end rho from (select b, i, {_rank('ref', 'b')} rx, {_rank('extra', 'b')} ry from draws join listed using (i)) group by b) where d >= 4 and rho is not null) where k <= 1000""", "scores", more=f"{_TOPS}, listed as (select *, row_number() over (order by model) - 1 i from tops where cond_id = 'demo/fade/3'), draws as (select b, ('0x' || substr(md5(b || '|' || j || '|0'), 1, 8))::bigint % 9 i from range(0, 10000) t(b) cross join range(0, 9) s(j))", models=9, conds=["clean", "demo/fade/3"]),
    "stat_average_rank": duck(f"select model, cond_id, v, {_rank('v', 'cond_id')} as rank from (select *, round(gap, 2) v from tops)", "scores", more=_TOPS, **_NINE),
    "stat_spearman": duck(f"select cond_id, count(*) models, {_RHO} rho from (select cond_id, {_rank('ref0', 'cond_id')} rx, {_rank('gap', 'cond_id')} ry from tops) group by 1", "scores", more=_TOPS, **_NINE),
    "stat_corr_judged": duck(f"select cond_id, coalesce(models, 0) models, near_floor, case when models >= 6 then rho end rho, case when coalesce(models, 0) < 6 then 'too few models' when rho is null then 'constant' else 'judged' end reason from (select cond_id, count(*) filter (ref < 0.1::double) near_floor from tops group by 1) left join (select cond_id, count(*) models, {_RHO} rho from (select cond_id, {_rank('ref', 'cond_id')} rx, {_rank('extra', 'cond_id')} ry from tops where ref >= 0.1::double) group by 1) using (cond_id)", "scores", more=_TOPS, **_NINE),
}

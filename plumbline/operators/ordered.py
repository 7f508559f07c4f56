"""Running totals of very large groups: no task sorts a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.shared import written

#: Rows of a range, about, and of a block, but for its last tie.
RANGE_ROWS, BLOCK_ROWS = 500_000, 20_000

#: Ties of a strip (`running_ties`), and strips that are spread at a time.
STRIP, STRIPS = 512, 64


def in_ranges(df: DataFrame, keys: list[str], order: str, descending: bool = False, rows: int = RANGE_ROWS) -> DataFrame:
    """df dealt into ranges of (keys, order) and sorted inside them. df is written first: Spark samples the ranges from it,
    and the number of rows says how many ranges there are, so that a range is bounded however many rows come."""
    own = written(df.sparkSession, df, "ordered")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // rows))
    by = [*map(F.asc, keys), F.desc(order) if descending else F.asc(order)]
    return own.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def _changes(batch: pa.RecordBatch, columns: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows that differ from the one before them in some column (`last` is the row before the batch), and the last row."""
    new = np.zeros(batch.num_rows, bool)
    for c in columns:
        codes = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = last != tuple(batch.column(c)[0].as_py() for c in columns)
    return new, tuple(batch.column(c)[-1].as_py() for c in columns)


def in_blocks(df: DataFrame, keys: list[str], order: str, descending: bool = False, rows: int = BLOCK_ROWS, size: str | None = None) -> DataFrame:
    """df with `_block`, written: rows of a block lie in order before those of the next one, and rows with equal keys
    and order share a block. A block ends with the tie that fills it: it holds fewer than `rows` rows (the sum of `size`
    over its rows, where that is given) besides its last tie."""
    own = in_ranges(df, keys, order, descending)
    schema = T.StructType([*own.schema.fields, T.StructField("_block", T.LongType())])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, upto, tie = TaskContext.get().partitionId(), None, 0, 0
        for batch in it:
            if not batch.num_rows:
                continue
            new, last = _changes(batch, [*keys, order], last)
            each = np.ones(batch.num_rows, np.int64) if size is None else batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            before = upto + np.cumsum(each) - each
            starts = np.where(new, before, -1)
            starts[0] = before[0] if new[0] else tie
            starts = np.maximum.accumulate(starts)  # what lies before the row's tie
            upto, tie = int(before[-1] + each[-1]), int(starts[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((part << 32) + starts // rows)], names=schema.names)

    return written(df.sparkSession, own.mapInArrow(cut, schema), "blocks")


def running(df: DataFrame, keys: list[str], order: str, totals: dict[str, str], descending: bool = False) -> DataFrame:
    """df with a column for each of `totals` (column -> name): the sum of the column over the rows of the same keys that
    come earlier in the order. (keys, order) names a row.

    One pass over each sorted range adds up what came earlier in it; the few ranges of a group are summed in a window, and
    joined. Only the ranges are shuffled, and a task holds one running total.
    """
    own = in_ranges(df, keys, order, descending)
    kinds = {c: T.LongType() if isinstance(own.schema[c].dataType, T.IntegralType) else T.DoubleType() for c in totals}
    own = own.withColumns({f"_own_{c}": F.coalesce(F.col(c), F.lit(0)).cast(k) for c, k in kinds.items()})
    schema = T.StructType([*own.schema.fields, T.StructField("_block", T.IntegerType()), *[T.StructField(f"_inside_{c}", k) for c, k in kinds.items()]])

    def add_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, dict.fromkeys(totals, 0)
        for batch in it:
            if not batch.num_rows:
                continue
            new, last = _changes(batch, keys, last)
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            goes_on = (first == 0) & ~new[0]
            inside = []
            for c in totals:
                x = batch.column(f"_own_{c}").to_numpy(zero_copy_only=False)
                before = np.cumsum(x) - x
                before = before - before[first] + np.where(goes_on, held[c], 0)
                held[c] = before[-1] + x[-1]
                inside.append(pa.array(before))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), *inside], names=schema.names)

    inner = written(df.sparkSession, own.mapInArrow(add_up, schema), "inside")
    sums = inner.groupBy(*keys, "_block").agg(*[F.sum(f"_own_{c}").alias(f"_earlier_{c}") for c in totals])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    before = sums.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_block").alias("_of_block"), *[F.coalesce(F.sum(f"_earlier_{c}").over(earlier), F.lit(0)).alias(f"_earlier_{c}") for c in totals])
    same = F.col("_block") == F.col("_of_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    both = inner.join(written(df.sparkSession, before, "earlier"), same)
    return both.select(*df.columns, *[(F.col(f"_earlier_{c}") + F.col(f"_inside_{c}")).alias(n) for c, n in totals.items()])


def running_ties(df: DataFrame, keys: list[str], order: str, totals: dict[str, str], descending: bool = False) -> DataFrame:
    """A row for each tie (equal keys and order): keys, the sum of each of `totals` (column -> name) over the tie under the
    column's name, and over the ties of the same keys that come earlier in the order under the other name.

    Ties are added up inside batches, so that a heavy one does not meet in a task row by row, and whole in the sorted
    ranges. What is written then are strips: arrays of the sums of neighbouring ties, without the order itself.
    """
    spark, values = df.sparkSession, list(totals)
    kinds = {c: T.LongType() if isinstance(df.schema[c].dataType, T.IntegralType) else T.DoubleType() for c in values}
    own = df.select(*keys, order, *[F.coalesce(F.col(c), F.lit(0)).cast(k).alias(c) for c, k in kinds.items()])
    names = own.columns
    fixed = [own.schema[k] for k in keys]

    def add_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sums = pa.Table.from_batches([batch]).group_by([*keys, order], use_threads=False).aggregate([(c, "sum") for c in values])
            yield from sums.select([*keys, order, *[f"{c}_sum" for c in values]]).rename_columns(names).to_batches()

    ranges = in_ranges(own.mapInArrow(add_up, own.schema), keys, order, descending)
    packed = T.StructType([*fixed, T.StructField("_part", T.IntegerType()), *[T.StructField(c, T.ArrayType(k)) for c, k in kinds.items()], *[T.StructField(f"_{p}_{c}", k) for p in ("inside", "sum") for c, k in kinds.items()]])

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, upto, held = TaskContext.get().partitionId(), None, dict.fromkeys(values, 0), None
        for batch in it:
            if not batch.num_rows:
                continue
            both = batch if held is None else pa.concat_batches([held, batch])
            starts = np.flatnonzero(_changes(both, [*keys, order], None)[0])
            ties = both.select([*keys, order]).take(pa.array(starts))
            sums = [np.add.reduceat(both.column(c).to_numpy(zero_copy_only=False), starts) for c in values]
            whole = pa.RecordBatch.from_arrays([*ties.columns, *map(pa.array, sums)], schema=batch.schema)
            held = whole.slice(whole.num_rows - 1)  # the next batch may go on with it
            if whole.num_rows > 1:
                strips, last = cut(whole.slice(0, whole.num_rows - 1), part, last, upto)
                yield strips
        if held is not None:
            yield cut(held, part, last, upto)[0]

    def cut(ties: pa.RecordBatch, part: int, last: tuple | None, upto: dict) -> tuple[pa.RecordBatch, tuple]:
        new, last = _changes(ties, keys, last)
        at = np.arange(len(new))
        first = np.maximum.accumulate(np.where(new, at, 0))
        goes_on = (first == 0) & ~new[0]
        starts = np.flatnonzero(new | ((at - first) % STRIP == 0))
        ends = pa.array(np.append(starts, len(new)).astype(np.int32))
        lists, inside, sums = [], [], []
        for c in values:
            x = ties.column(c).to_numpy(zero_copy_only=False)
            before = np.cumsum(x) - x
            before = before - before[first] + np.where(goes_on, upto[c], 0)
            upto[c] = before[-1] + x[-1]
            lists.append(pa.ListArray.from_arrays(ends, pa.array(x)))
            inside.append(pa.array(before[starts]))
            sums.append(pa.array(np.add.reduceat(x, starts)))
        fixed = ties.select(keys).take(pa.array(starts)).columns
        return pa.RecordBatch.from_arrays([*fixed, pa.array(np.full(len(starts), part, np.int32)), *lists, *inside, *sums], names=packed.names), last

    strips = written(spark, ranges.mapInArrow(pack, packed), "strips")
    sums = strips.groupBy(*keys, "_part").agg(*[F.sum(f"_sum_{c}").alias(f"_sum_{c}") for c in values])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    before = sums.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_earlier_{c}") for c in values])
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    both = strips.join(written(spark, before, "earlier"), same)
    both = both.select(*keys, *values, *[(F.col(f"_earlier_{c}") + F.col(f"_inside_{c}")).alias(f"_{c}") for c in values])
    out = T.StructType([*fixed, *[T.StructField(c, k) for c, k in kinds.items()], *[T.StructField(n, kinds[c]) for c, n in totals.items()]])

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start in range(0, batch.num_rows, STRIPS):
                rows = batch.slice(start, STRIPS)
                lengths = pc.list_value_length(rows.column(values[0])).to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(rows.num_rows), lengths)
                first = (np.cumsum(lengths) - lengths)[of]
                flat, before = [], []
                for c in values:
                    x = rows.column(c).flatten().to_numpy(zero_copy_only=False)
                    upto = np.cumsum(x) - x
                    flat.append(pa.array(x))
                    before.append(pa.array(upto - upto[first] + rows.column(f"_{c}").to_numpy(zero_copy_only=False)[of]))
                yield pa.RecordBatch.from_arrays([*rows.select(keys).take(pa.array(of)).columns, *flat, *before], names=out.names)

    return both.mapInArrow(spread, out)


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], name: str = "p") -> DataFrame:
    """keys and an array of percentiles, interpolated linearly and exact, of groups of any size: values are counted, and the
    ranks wanted are looked up in running counts. (Spark's own percentile holds all distinct values of a group.)"""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_m"))
    ranked = running(counted, keys, "_v", {"_m": "_before"})
    at = F.transform(F.array(*map(F.lit, shares)), lambda p: p * (F.sum("_m") - 1))
    wanted = written(df.sparkSession, ranked.groupBy(*keys).agg(at.alias("_at")), "ranks")
    near = ranked.join(wanted, keys).withColumn("_hit", F.filter("_at", lambda x: (F.ceil(x) >= F.col("_before")) & (F.floor(x) < F.col("_before") + F.col("_m")))).filter(F.size("_hit") > 0)
    ends = [F.max(F.when((F.col("_before") <= end(F.col("_at")[i])) & (end(F.col("_at")[i]) < F.col("_before") + F.col("_m")), F.col("_v"))) for i in range(len(shares)) for end in (F.floor, F.ceil)]
    part = [F.first(F.col("_at")[i] - F.floor(F.col("_at")[i])) for i in range(len(shares))]
    return near.groupBy(*keys).agg(F.array(*[ends[2 * i] + (ends[2 * i + 1] - ends[2 * i]) * part[i] for i in range(len(shares))]).alias(name))

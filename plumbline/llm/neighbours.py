"""Approximate nearest neighbours by an inverted file with product-quantised residuals (operator 3).

Fit.  Coarse centroids (about the square root of the number of vectors) and, for each of the subspaces, 256 code
words of the residuals are fitted by k-means on a bounded sample, chosen by a hash of the ids: 16 vectors a centroid, at
least `SAMPLE`. How many lists a query has to probe is measured on the sample: so many that they hold `coverage` of the
true neighbours of sampled queries. Nearly isotropic vectors need more than half of all lists, clustered ones a few.

Index.  Every vector goes to its nearest centroid's list, with the codes of its residual; the index is written.

Search.  A query goes to its nearest centroids' lists. A list is dealt into blocks of bounded size; the vectors of a
block are held, and the queries that probe it stream past them, so no vector is copied and no group outgrows a task.
The asymmetric distance (the query is not quantised) is what a vector's codes and list alone say, which the index
holds, less twice the sum of table entries of the query, one table for each subspace. The best are reranked by the
exact distance in double precision. A block gives its best `k` for each query; the best of those over all blocks are
the result, ties to the smaller id.

A higher coverage or more reranked vectors raise the recall, up to an exact search. Equal vectors of a block count as
one when the best are chosen, so copies neither fill the rerank nor hide one another: the copies with the smallest ids are
all there for the exact order.

Range.  Approximate work is done in single precision on vectors scaled by a power of two, so that the median vector's
largest component is about one, and clipped at `CLIP`: very large and very small tables lose nothing, and single vectors
of another size do no harm. Exact distances use the vectors as they are, scaled where squares would overflow or vanish.

Cases: vectors that are null, zero, not of the common dimension, or hold null or non-finite components take no part,
nor do null ids; of several rows of one id the one with the least vector counts, as candidate and as query; ties go to
the smaller id; fewer candidates than `k` give fewer rows; an empty table gives an empty table; other columns are read
by the choice of queries only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table, written

#: Vectors that centroids and code words are fitted on: 16 a list, at least so many.
SAMPLE = 20_000
#: Lists, at most (the fitting sample is 262,144 vectors then).
LISTS = 16_384
#: Bytes of the fitting sample, at most.
SAMPLE_BYTES = 256 << 20
#: Largest component of a scaled vector in approximate work.
CLIP = 1e6
#: Vectors of a block, about.
BLOCK = 4096
#: Sampled queries that the number of probed lists is measured with.
MEASURED = 300


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centroids; those that lose all their points stay where they are."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    square = (c**2).sum(axis=1)
    return np.concatenate([(square - 2 * (x[i : i + 4096] @ c.T)).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Quantiser:
    """Coarse centroids and code words (parts, 256, width of a part); of bounded size, fit to be broadcast."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int):
        self.parts = math.gcd(parts, sample.shape[1])
        self.coarse = kmeans(sample, lists)
        self.square = (self.coarse**2).sum(axis=1)
        rest = (sample - self.coarse[nearest(sample, self.coarse)]).reshape(len(sample), self.parts, -1)
        self.words = [kmeans(rest[:, m], 256, 6) for m in range(self.parts)]

    def codes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = (x - self.coarse[at]).reshape(len(x), self.parts, -1)
        return np.stack([nearest(rest[:, m], w) for m, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def known(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the distance to a coded vector holds besides the query: |r|^2 + 2 c.r of its centroid c and residual r."""
        r = np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], axis=1)
        return ((r + 2 * self.coarse[at]) * r).sum(axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(parts, queries, words): products of the queries' parts with the code words."""
        return np.stack([q.reshape(len(q), self.parts, -1)[:, m] @ w.T for m, w in enumerate(self.words)])

    def order(self, q: np.ndarray) -> np.ndarray:
        """All lists for each query, the nearest first."""
        return (self.square - 2 * (q.astype(np.float32) @ self.coarse.T)).argsort(axis=1, kind="stable")

    def probes(self, sample: np.ndarray, k: int, coverage: float) -> int:
        """Lists to probe, so that they hold the share `coverage` of the sampled queries' neighbours in the sample."""
        q, at = sample[:MEASURED], nearest(sample, self.coarse)
        places = self.order(q).argsort(axis=1)
        square, needed = (sample.astype(float) ** 2).sum(axis=1), []
        for i, x in enumerate(q.astype(float)):
            near = square - 2 * (sample @ x)
            near[i] = np.inf
            best = np.argpartition(near, min(k, len(near) - 1))[:k] if len(near) > k else np.flatnonzero(np.isfinite(near))
            needed += places[i, at[best]].tolist()
        return 1 + int(np.quantile(needed, coverage, method="higher")) if needed else 1


def valid(df: DataFrame, queries: str, id: str, vector: str) -> DataFrame:
    """id, vector and whether it is a query, of the rows that take part, but for the dimension; one row an id."""
    v = F.col("vector")
    own = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.coalesce(F.expr(queries), F.lit(False)).alias("asked"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = own.filter(F.col("id").isNotNull() & v.isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    return own.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _exact(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, dim)


def approximate(x: np.ndarray, scale: float) -> np.ndarray:
    """Vectors in single precision, scaled and clipped."""
    with np.errstate(over="ignore", under="ignore"):
        return np.clip(x * scale, -CLIP, CLIP).astype(np.float32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis, in double precision; scaled where squares overflow or vanish."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = np.sqrt(((a - b) ** 2).sum(axis=-1))
        odd = ~((out > 1e-140) & (out < np.inf))
        if odd.any():
            a, b = np.broadcast_arrays(a, b)
            half = a[odd] / 2 - b[odd] / 2  # no overflow
            most = np.abs(half).max(axis=-1)
            unit = np.where(most > 0, most, 1.0)
            out[odd] = np.sqrt(((half / unit[..., None]) ** 2).sum(axis=-1)) * unit * 2
    return out


def search(df: DataFrame, queries: str, id: str = "vec_id", vector: str = "embedding", k: int = 10, coverage: float = 0.97, parts: int = 32, rerank: int = 40, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance); queries: SQL over df, the rows to take as queries."""
    spark = df.sparkSession
    rows = written(spark, valid(df, queries, id, vector), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]
    rows = rows.filter(F.size("vector") == dim)
    lists = max(1, min(LISTS, math.isqrt(n)))
    size = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scale = 2.0 ** -math.frexp(rows.agg(F.percentile_approx(size, 0.5)).first()[0])[1]
    most = min(max(SAMPLE, 16 * lists), max(1, SAMPLE_BYTES // (8 * dim)))
    sample = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(most).select("vector").toArrow().column("vector").combine_chunks()
    sample = approximate(_matrix(sample, dim), scale)
    model = Quantiser(sample, lists, parts)
    least, enough = model.probes(sample, k, coverage), 4 * k
    shared = spark.sparkContext.broadcast(model)

    def quantise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            exact = _matrix(batch.column(1), dim)
            x = approximate(exact, scale)
            at = nearest(x, shared.value.coarse)
            codes = shared.value.codes(x, at) if len(x) else np.zeros((0, 1), np.uint8)
            known = shared.value.known(codes, at) if len(x) else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(known.astype(np.float32)), pa.array([v.tobytes() for v in exact], pa.binary())],
                names=["id", "asked", "list", "codes", "known", "exact"],
            )

    index = written(spark, rows.mapInArrow(quantise, "id long, asked boolean, list int, codes binary, known float, exact binary"), "index")
    filled = {r.list: r.n for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    size = np.array([filled.get(i, 0) for i in range(len(model.coarse))], np.int64)
    blocks = np.maximum(1, -(-size // block)).astype(np.int32)

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of each list that a query probes."""
        for batch in it:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                order = shared.value.order(approximate(_exact(part.column("exact"), dim), scale))
                reach = np.cumsum(size[order], axis=1) - size[order]
                row, col = np.nonzero(((np.arange(len(size)) < least) | (reach <= enough)) & (size[order] > 0))
                at = order[row, col]
                times = blocks[at]
                row, at = np.repeat(row, times), np.repeat(at, times)
                number = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                for j in range(0, len(at), 50_000):
                    own = part.take(pa.array(row[j : j + 50_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(at[j : j + 50_000].astype(np.int32)), pa.array(number[j : j + 50_000].astype(np.int32)), own.column("id"), own.column("exact")], names=["list", "block", "id", "exact"])

    asked = index.filter("asked").select("id", "exact").mapInArrow(ask, "list int, block int, id long, exact binary")
    counts = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "list int, blocks int")  # LISTS rows at most
    held = index.join(F.broadcast(counts), "list").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    both = held.select("list", "block", F.lit(0).alias("side"), "id", "exact", "codes", "known").unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("list", "block").sortWithinPartitions("list", "block", "side")

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: the vectors of a block, then the queries that probe it."""
        now, vectors, ready = None, [], None
        for batch in it:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if tuple(keys[a, :2]) != now:
                    now, vectors, ready = tuple(keys[a, :2]), [], None
                if keys[a, 2] == 0:
                    vectors.append(batch.slice(a, b - a))
                elif vectors:
                    ready = ready or Held(pa.Table.from_batches(vectors), dim, scale, k)
                    yield ready.best(batch.slice(a, b - a), shared.value, k, rerank)

    found = both.mapInArrow(runs, "query_id long, vec_id long, score double")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Held:
    """The vectors of a block: each different one once, with the smallest ids of its copies. k of them and one more (the
    query may be a copy itself) are all that a result can hold."""

    def __init__(self, rows: pa.Table, dim: int, scale: float, k: int):
        rows = rows.sort_by("id")
        self.dim, self.scale, ids = dim, scale, rows.column("id").to_numpy()
        exact = _exact(rows.column("exact"), dim) + 0.0  # -0 is 0
        _, first, own = np.unique(exact.view(np.dtype((np.void, 8 * dim)))[:, 0], return_index=True, return_inverse=True)
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=len(first))
        starts = np.cumsum(counts) - counts
        width = int(min(k + 1, counts.max()))
        place = np.arange(width)[None] + starts[:, None]
        self.ids = np.where(np.arange(width)[None] < counts[:, None], ids[order[np.minimum(place, len(ids) - 1)]], -1)
        self.none = np.arange(width)[None] >= counts[:, None]
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[first]
        self.known, self.exact = rows.column("known").to_numpy()[first], exact[first]

    def best(self, queries: pa.RecordBatch, model: Quantiser, k: int, rerank: int) -> pa.RecordBatch:
        """The k nearest of the block for each query, but the query's own row."""
        q, q_ids = _exact(queries.column("exact"), self.dim), queries.column("id").to_numpy()
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(0, len(q), 64):
            part, own = q[i : i + 64], q_ids[i : i + 64]
            near = np.zeros((len(part), len(self.ids)), np.float32)
            for m, t in enumerate(model.tables(approximate(part, self.scale))):
                near += t[:, self.codes[:, m]]
            near = self.known - 2 * near
            few = min(rerank + 1, len(self.ids))  # the query itself may be among them
            top = np.argpartition(near, few - 1, axis=1)[:, :few]
            dist = np.repeat(distances(self.exact[top], part[:, None])[:, :, None], self.ids.shape[1], axis=2)
            ids = self.ids[top]
            gone = self.none[top] | (ids == own[:, None, None])
            dist, ids, gone = (x.reshape(len(part), -1) for x in (dist, ids, gone))
            order = np.lexsort((ids, dist, gone), axis=1)[:, :k]
            row, col = np.nonzero(~np.take_along_axis(gone, order, 1))
            found.append((own[row], np.take_along_axis(ids, order, 1)[row, col], np.take_along_axis(dist, order, 1)[row, col]))
        out = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "vec_id", "score"])


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


QUERIES = {"op3_neighbours": op3_neighbours}
ORACLE: dict[str, str] = {}

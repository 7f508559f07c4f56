"""Phrase collocations from a weighted de Bruijn graph (operator 11).

Texts (A-Z lower-cased) are split into pieces at `[.,;:!?]` and line ends, pieces into words at blanks and tabs.

Graph.  Nodes are two-word grams, edges the three-word grams that overlap two of them, weighted by their occurrences
within pieces. Every word of a text begins exactly one edge; where a piece ends early the edge leads to the piece's end
and is the two words or the one word that are left. Tasks count edges of bounded chunks and send them packed, dealt into
buckets by a hash of the whole edge, so a frequent node is spread over all of them. Only these longest grams are counted:

    f(x y) = flow out of node x y = edges x y *, and pieces that end in x y
    f(x)   = flow out of the nodes x *, and pieces that end in x
    n      = the sum of all f(x)

so each shorter count needs one more sum over what is already summed, with partial sums before each shuffle.

Paths.  Of the edges that are frequent enough to be candidates, chains in which every inner node has one edge in and one
out are compacted into paths by pointer doubling (cycles are opened at their least edge); long paths are cut into parts
of `PART` edges. An inner node's strongest edge is then known inside its path; only path ends are grouped by node.

Scores.  A two-word candidate is a node, a three-word one an edge; l and r of the cuts are flows of their nodes and words.
All arithmetic is in whole numbers of up to 38 digits (counts below 10**15).

Cases: a null text is empty and has no words; a null language is `und`; texts of any length are counted whole (a chunk
takes very long ones in parts, cut at the ends of pieces); repeated rows count each time; ties are ranked by phrase; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import clean_text, table, written

#: Bytes of text that a task counts at a time.
CHUNK_BYTES = 4_000_000
#: Words coded at a time: fewer than 2**21.
CODED = 1_000_000
#: Bytes of text for each bucket, about.
BUCKET_BYTES = 4_000_000
#: Edges of a compacted path's part.
PART = 512
#: Groups that a language's candidates are dealt into before the first ones are chosen.
DEALT = 64

#: The end of a piece: a byte that no UTF-8 text holds.
END = b"\xff"
_BYTES = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def chunks(texts: list[bytes]) -> Iterator[bytes]:
    """Texts joined by ends of pieces, in parts of about CHUNK_BYTES that are cut at ends of pieces."""
    data, start = END.join([x.translate(_BYTES) for x in texts]), 0
    while len(data) - start > CHUNK_BYTES and (cut := data.find(END, start + CHUNK_BYTES)) >= 0:
        yield data[start:cut]
        start = cut + 1
    yield data[start:] if start else data


def _array(lengths: np.ndarray, data: np.ndarray | bytes) -> pa.Array:
    """Binary values of these lengths, end to end."""
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(data)])


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of binary values."""
    _, offsets, data = values.buffers()
    own = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    return own.astype(np.int64), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def tokens_of(data: bytes) -> pa.Array:
    """Words and ends of pieces, in order."""
    raw = np.frombuffer(data, np.uint8)
    end, inside = raw == 255, raw != 32
    first = inside & (end | np.append(True, (~inside | end)[:-1]))[: len(raw)]
    starts = np.flatnonzero(first[inside])
    return _array(np.diff(np.append(starts, inside.sum())), raw[inside])


def hashed(values: pa.Array, step: int = 1 << 16) -> np.ndarray:
    """64 bits of each value, to deal values out by: a polynomial in the bytes, mixed."""
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse, out = np.uint64(pow(int(base), -1, 1 << 64)), [np.zeros(0, np.uint64)]
    for i in range(0, len(values), step):
        offsets, data = _buffers(values.slice(i, step))
        own = data[int(offsets[0]) : int(offsets[-1])].astype(np.uint64) + np.uint64(1)
        offsets = offsets - offsets[0]
        with np.errstate(over="ignore"):
            own *= np.cumprod(np.full(len(own), base, np.uint64))
            upto = np.concatenate([[np.uint64(0)], np.cumsum(own, dtype=np.uint64)])
            back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(own), inverse, np.uint64))])
            x = (upto[offsets[1:]] - upto[offsets[:-1]]) * back[offsets[:-1]]
            x = (x ^ x >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(x ^ x >> np.uint64(29))
    return np.concatenate(out)


def edges_of(data: bytes) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Different edges, sorted, with their occurrences and hashes."""
    tokens = tokens_of(data)
    for s in range(0, len(tokens), CODED):
        coded = tokens.slice(s, CODED + 2).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        names, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        if len(names) and names[-1].as_py() == END:  # the greatest of all, as no word holds this byte
            rank[order[-1]] = 0
        ids = np.concatenate([rank[coded.indices.to_numpy()], [0, 0]])
        n = min(CODED, len(tokens) - s)
        x, y, z = ids[:n], ids[1 : n + 1], ids[2 : n + 2]
        z = np.where(y == 0, 0, z)
        key, times = np.unique((x << 42 | y << 21 | z)[x > 0], return_counts=True)
        x, y, z = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        code = np.concatenate([[np.uint64(0)], hashed(names)])
        with np.errstate(over="ignore"):
            mixed = (code[x] * np.uint64(0x9E3779B97F4A7C15) ^ code[y]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ code[z]
        parts = [names.take(pa.array(np.maximum(i - 1, 0), mask=i == 0)) for i in (x, y, z)]
        yield pc.binary_join_element_wise(*parts, b" ", null_handling="skip"), times, mixed


def packed(grams: pa.Array, times: np.ndarray, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Buckets, their numbers of grams, and grams and counts of each as one compressed value."""
    to = ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    own, cuts = to[order], np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
    offsets, data = _buffers(grams.take(pa.array(order)))
    counts, lengths, press = np.asarray(times, np.int64)[order], np.diff(offsets).astype(np.int32), zstandard.ZstdCompressor(level=1).compress
    blobs = [press(counts[a:b].tobytes() + lengths[a:b].tobytes() + data[offsets[a] : offsets[b]].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return own[cuts[:-1]], np.diff(cuts), blobs


def summed(grams: list[pa.Array], times: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Different grams with the sums of their counts."""
    both = pa.table({"g": pa.chunked_array(grams, pa.binary()), "n": pa.array(np.concatenate(times))}).group_by("g").aggregate([("n", "sum")])
    own = both.column("g").combine_chunks()
    return own.chunk(0) if isinstance(own, pa.ChunkedArray) else own, both.column("n_sum").to_numpy()


def unpacked(blob: bytes, n: int) -> tuple[pa.Array, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    return _array(np.frombuffer(data, np.int32, n, 8 * n), data[12 * n :]), np.frombuffer(data, np.int64, n)


def without_last(grams: pa.Array, words: int) -> tuple[pa.Array, np.ndarray]:
    """Grams of `words` words without their last one, others as they are; and the numbers of words."""
    offsets, data = _buffers(grams)
    blanks = np.flatnonzero(data == 32)
    upto = np.searchsorted(blanks, offsets)
    count = np.diff(upto) + 1
    cut = np.flatnonzero(count == words)
    last, stop = blanks[upto[cut + 1] - 1], offsets[cut + 1]
    change = np.zeros(len(data) + 1, np.int8)
    change[last] += 1
    change[stop] -= 1
    lengths = np.diff(offsets)
    lengths[cut] -= stop - last
    stays = np.cumsum(change[:-1], dtype=np.int8) == 0
    return _array(lengths, data[: offsets[-1]][stays[: offsets[-1]]]), count


_PACKED = "lang string, bucket int, size int, blob binary"
_COUNTED = f"{_PACKED}, gram string, f long"


def _rows(lang: str, numbers: np.ndarray, sizes: np.ndarray, blobs: list[bytes]) -> list[pa.Array]:
    return [pa.array([lang] * len(blobs), pa.string()), pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())]


def _sums(df: DataFrame, buckets: int, least: int, longest: bool) -> DataFrame:
    """Sums packed grams by bucket. Rows with `gram`: those of at least `least` occurrences, and all single words if not
    `longest`; rows with `blob`: the flow into the next shorter grams, if `longest`."""
    words = 3 if longest else 2

    def done(lang: str, blobs: list[bytes], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        grams, times = summed(*map(list, zip(*map(unpacked, blobs, sizes), strict=True)))
        shorter, count = without_last(grams, words)
        own = np.flatnonzero((times >= least) & (count == words))
        keep, kept = grams.take(pa.array(own)), times[own]
        flow, flows = summed([shorter], [times])
        if not longest:
            keep, kept = pa.concat_arrays([keep, flow]), np.concatenate([kept, flows])
        none = pa.nulls(len(keep), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keep), pa.string()), none, none, pa.nulls(len(keep), pa.binary()), keep.cast(pa.string(), safe=False), pa.array(kept, pa.int64())], names=_names)
        if longest:
            numbers, n, blobs = packed(flow, flows, hashed(flow), buckets)
            yield pa.RecordBatch.from_arrays([*_rows(lang, numbers, n, blobs), pa.nulls(len(blobs), pa.string()), pa.nulls(len(blobs), pa.int64())], names=_names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, sizes = None, [], []
        for batch in it:
            for lang, bucket, size, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (lang, bucket) != now:
                    if blobs:
                        yield from done(now[0], blobs, sizes)
                    now, blobs, sizes = (lang, bucket), [], []
                blobs.append(blob)
                sizes.append(size)
        if blobs:
            yield from done(now[0], blobs, sizes)

    return df.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(run, _COUNTED)


_names = ["lang", "bucket", "size", "blob", "gram", "f"]


def graph(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges and nodes of at least `least` occurrences, and all words: (lang, gram, f) each."""
    spark = df.sparkSession
    docs = df.select(clean_text(F.col(f"`{text}`")).alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for data in chunks(texts):
                    for edges in edges_of(data):
                        yield pa.RecordBatch.from_arrays(_rows(lang, *packed(*edges, buckets)), names=_names[:4])
            held.clear()

        n = 0
        for batch in it:
            for x, own in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(own, []).append(x)
                n += len(x)
                if n > CHUNK_BYTES:
                    yield from sent()
                    n = 0
        yield from sent()

    first = written(spark, _sums(docs.mapInArrow(count, _PACKED), buckets, least, True), "edges")
    second = written(spark, _sums(first.filter("blob is not null").select(*_names[:4]), buckets, least, False), "nodes")
    edges = first.filter("gram is not null").select("lang", "gram", "f")
    nodes = second.filter("instr(gram, ' ') > 0").select("lang", "gram", "f")
    words = second.filter("instr(gram, ' ') = 0").groupBy("lang", "gram").agg(F.sum("f").alias("f"))
    return edges, nodes, written(spark, words, "words")


def _start(gram: str = "gram") -> Column:
    return F.substring_index(gram, " ", 2)


def _end(gram: str = "gram") -> Column:
    return F.substring_index(gram, " ", -2)


def compact(edges: DataFrame, part: int = PART) -> DataFrame:
    """(lang, words, counts): unary paths, in parts of at most `part` edges; counts[i] is that of words i to i + 2."""
    spark = edges.sparkSession
    ends = edges.select("lang", _start().alias("node"), F.col("gram").alias("out"), F.lit(None).cast("string").alias("into"))
    ends = ends.unionByName(edges.select("lang", _end().alias("node"), F.lit(None).cast("string").alias("out"), F.col("gram").alias("into")))
    unary = ends.groupBy("lang", "node").agg(F.count("out").alias("outs"), F.count("into").alias("ins"), F.max("out").alias("gram"), F.max("into").alias("before")).filter("outs = 1 and ins = 1 and gram <> before")
    state = edges.join(unary.select("lang", "gram", "before"), ["lang", "gram"], "left")
    state = state.select("lang", "gram", "f", F.coalesce("before", "gram").alias("up"), F.col("before").isNotNull().cast("long").alias("far"), F.col("before").isNull().alias("done"), F.col("gram").alias("low"), F.lit(0).cast("long").alias("low_far"))
    state, reach = written(spark, state, "paths"), 1
    while (n := state.filter("not done").count()) and reach < 2 * n:  # a cycle is as long as what is left at most
        above = state.select("lang", F.col("gram").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("done").alias("done2"), F.col("low").alias("low2"), F.col("low_far").alias("low_far2"))
        led = state.filter("not done").join(above, ["lang", "up"])
        lower = F.col("low2") < F.col("low")
        led = led.select("lang", "gram", "f", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"), F.when(lower, F.col("low2")).otherwise(F.col("low")).alias("low"), F.when(lower, F.col("far") + F.col("low_far2")).otherwise(F.col("low_far")).alias("low_far"))
        state, reach = written(spark, state.filter("done").unionByName(led), "paths"), 2 * reach
    placed = state.select("lang", "gram", "f", F.when(F.col("done"), F.col("up")).otherwise(F.col("low")).alias("head"), F.when(F.col("done"), F.col("far")).otherwise(F.col("low_far")).alias("at"))
    parts = placed.groupBy("lang", "head", F.floor(F.col("at") / part).alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "gram", "f"))).alias("own"))
    words = F.concat(F.split(F.col("own")[0]["gram"], " ", -1), F.transform(F.slice("own", 2, part), lambda e: F.substring_index(e["gram"], " ", -1)))
    return parts.select("lang", words.alias("words"), F.col("own.f").alias("counts"))


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = [x.cast("decimal(15,0)") for x in (a, left, right)]
    return F.call_function("div", whole[0] * whole[0] * F.lit(1_000_000).cast("decimal(7,0)"), whole[1] * whole[2])


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = df.sparkSession
    edges, nodes, words = graph(df, text, lang, least)
    paths = written(spark, compact(edges), "compacted")
    size = F.size("counts")
    inside = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.array_join(F.slice("words", i + 1, 3), " ").alias("gram"), F.get("counts", i).alias("a")))
    triples = paths.select("lang", F.explode(inside).alias("x")).select("lang", "x.gram", "x.a")
    inner = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.struct(F.array_join(F.slice("words", i + 1, 2), " ").alias("gram"), F.greatest(F.get("counts", i - 1), F.get("counts", i)).alias("most")))
    inner = paths.filter(size > 1).select("lang", F.explode(inner).alias("x")).select("lang", "x.gram", "x.most")
    outer = F.array(F.struct(F.array_join(F.slice("words", 1, 2), " ").alias("gram"), F.get("counts", F.lit(0)).alias("most")), F.struct(F.array_join(F.slice("words", -2, 2), " ").alias("gram"), F.get("counts", size - 1).alias("most")))
    outer = paths.select("lang", F.explode(outer).alias("x")).groupBy("lang", "x.gram").agg(F.max("x.most").alias("most"))
    frequent = words.filter(F.col("f") >= least)
    with_words = nodes.withColumns({"first": F.substring_index("gram", " ", 1), "second": F.substring_index("gram", " ", -1)})
    with_words = with_words.join(frequent.select("lang", F.col("gram").alias("first"), F.col("f").alias("f_first")), ["lang", "first"])
    with_words = with_words.join(frequent.select("lang", F.col("gram").alias("second"), F.col("f").alias("f_second")), ["lang", "second"])
    flows = written(spark, with_words.select("lang", "gram", "f", "f_first", "f_second"), "flows")
    strongest = written(spark, inner.unionByName(outer), "strongest")
    pairs = flows.join(strongest, ["lang", "gram"], "left").filter("most is null or 100 * most < 50 * f")
    pairs = pairs.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.col("f_first").alias("l"), F.col("f_second").alias("r"))
    source = flows.select("lang", F.col("gram").alias("from"), F.col("f").alias("l2"), F.col("f_first").alias("l1"))
    target = flows.select("lang", F.col("gram").alias("to"), F.col("f").alias("r1"), F.col("f_second").alias("r2"))
    triples = triples.withColumns({"from": _start(), "to": _end()}).join(source, ["lang", "from"]).join(target, ["lang", "to"])
    later = _score(F.col("a"), F.col("l2"), F.col("r2")) < _score(F.col("a"), F.col("l1"), F.col("r1"))
    triples = triples.select("lang", F.col("gram").alias("phrase"), "a", F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"))
    scored = pairs.unionByName(triples).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    totals = written(spark, words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    return scored.join(totals, "lang").select("lang", "rank", "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")])


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLE = {
    "op11_collocations": r"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
m as (select lang, row_number() over () piece, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
w as (select lang, piece, unnest(w) x, generate_subscripts(w, 1) i from m),
t as (select lang, x, lead(x) over o y, lead(x, 2) over o z from w window o as (partition by piece order by i)),
f as (select lang, k, g, count(*) f from (select lang, 1 k, x g from t union all select lang, 2, x || ' ' || y from t where y is not null union all select lang, 3, x || ' ' || y || ' ' || z from t where z is not null) group by all),
n as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
c as (select lang, k, g, f a, string_split(g, ' ') w from f where k > 1 and f >= 10),
s as (select c.*, j, l.f l, r.f r, (1000000::hugeint * a * a // (l.f::hugeint * r.f))::bigint score from c, (values (1), (2)) v(j)
  join f l on l.lang = c.lang and l.g = array_to_string(w[1 : j], ' ') join f r on r.lang = c.lang and r.g = array_to_string(w[j + 1 :], ' ') where j < c.k),
b as (select * from s qualify row_number() over (partition by lang, g order by score, j) = 1),
x as (select lang, g, max(a) most from (select lang, array_to_string(w[1:2], ' ') g, a from c where k = 3 union all select lang, array_to_string(w[2:3], ' '), a from c where k = 3) group by all),
y as (select b.* from b left join x using (lang, g) where b.k = 3 or x.most is null or 100 * x.most < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, g) rank, g phrase, a, l, r, n, score from y join n using (lang)
qualify rank <= 2000
"""
}

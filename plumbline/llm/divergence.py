"""Divergence of sources by sparse merges of term counts (operator 13).

Terms are runs of letters (A-Z lower-cased) and of signs beyond ASCII. Each language keeps the terms that at least
`least` of its documents hold. A group (language, source), and the language as a whole, gives each kept term
p = 1 + floor(10**9 (count + 5) / (N + 5 V)), N the group's occurrences of kept terms, V the number of kept terms.

Counts.  Tasks count terms for each group in bounded dictionaries, Spark adds them up. A language's kept terms are
dealt into blocks of about `BLOCK` terms by a hash and numbered inside a block, so that no array outgrows a task however
many terms there are. A group's entry in a block is an array of (term number, count), sorted.

Pairs.  The sources of a language are dealt into tiles of about `TILE`; a task gets one block of two tiles and prices
each unordered pair in it: the shorter array is looked up in the longer by a galloping search, terms that both have cost
|p - q|, terms that one has cost its p against the other's p of an absent term, both ways, and all the others cost the
same. The blocks' costs add up to the pair's value, which is given to both sources.

Terms.  A group's terms with p above the language's, the largest differences first; the best of each block, then of all.

All arithmetic is in whole numbers: the quotient is formed in three steps of three digits, exact for languages of up to
9 * 10**15 occurrences.

Cases: null text, language and source count as empty; a text of any length is one document; each row is a document,
repeated rows too; groups without terms and languages without kept terms have pairs (of value 0 where no term is kept)
and no terms; a language of one source has no pairs; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import clean_text, table, written

#: Terms of a block, about.
BLOCK = 16_384
#: Sources of a tile, about.
TILE = 24
#: Counts that a task holds before it sends them.
HELD = 1_000_000
#: Added to every count.
EXTRA = 5

#: Bytes of terms stay, A-Z as a-z; all others are blanks.
_TERM_BYTES = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def term_counts(df: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents; a row with an empty term for each group."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                own = list(n)
                columns = [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string(), safe=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.values(), pa.int64()), pa.array([d[w] for w in own], pa.int64())], names=["lang", "source", "term", "n", "d"])
            held.clear()

        since = 0
        for batch in it:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for text, lang, source in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, d = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                before, words = len(n), terms(text)
                n.update(words)
                d.update(set(words))
                since += len(n) - before + 1
                if since > HELD:
                    yield from sent()
                    since = 0
        yield from sent()

    own = df.select(clean_text("text").alias("text"), clean_text("lang").alias("lang"), clean_text("source").alias("source"))
    found = own.mapInArrow(count, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 count / total), in three exact steps."""
    out, rest = F.lit(0).cast("long"), count.cast("long")
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return out + 1


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """The same over an array."""
    out, rest = np.zeros(len(count), np.int64), count.astype(np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted arrays of what both hold: the shorter is looked up in the longer, each search beginning where
    the one before ended."""
    at = np.searchsorted(long, short)
    hit = np.flatnonzero(at < len(long))
    hit = hit[long[at[hit]] == short[hit]]
    return hit, at[hit]


class Priced:
    """A group's entry in a block: term numbers, their p, and the p of terms that it lacks."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, total: int):
        self.ids, self.p, self.absent = ids, shares(counts + EXTRA, total), int(shares(np.array([EXTRA]), total)[0])

    def cost(self, other: Priced, terms: int) -> int:
        """The sum of |p - q| over the block's terms."""
        a, b = (self, other) if len(self.ids) <= len(other.ids) else (other, self)
        i, j = gallop(a.ids, b.ids)
        one_a, one_b = np.abs(a.p - b.absent), np.abs(b.p - a.absent)
        both = np.abs(a.p[i] - b.p[j]).sum() + one_a.sum() - one_a[i].sum() + one_b.sum() - one_b[j].sum()
        return int(both) + (terms - len(a.ids) - len(b.ids) + len(i)) * abs(a.absent - b.absent)


def priced_pairs(rows: pa.Table) -> pa.Table:
    """(lang, a, b, value) for the pairs of one block of two tiles."""
    lang, i, j, terms = (rows.column(c)[0].as_py() for c in ("lang", "i", "j", "terms"))
    own = sorted(zip(rows.column("source").to_pylist(), rows.column("tile").to_pylist(), range(rows.num_rows), strict=True))
    held = []
    for source, tile, k in own:
        ids, counts = (np.array(rows.column(c)[k].values.to_numpy(zero_copy_only=False), np.int64) for c in ("ids", "counts"))
        held.append((source, tile, Priced(ids, counts, rows.column("total")[k].as_py())))
    out = [(a, b, x.cost(y, terms)) for n, (a, s, x) in enumerate(held) for b, t, y in held[n + 1 :] if i == j or s != t]
    first, second, value = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array(first, pa.string()), "b": pa.array(second, pa.string()), "value": pa.array(value, pa.int64())})


def audit(df: DataFrame, least: int = 30, top: int = 50, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part ('pair', 'term'), item, value and rank."""
    spark = df.sparkSession
    counts = written(spark, term_counts(df), "counts")
    known = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).filter(F.col("d") >= least)
    known = written(spark, known, "known")
    langs = counts.select("lang").distinct().join(known.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n")), "lang", "left").fillna(0)
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block)).cast("int"))
    langs = written(spark, langs.withColumn("lang_total", F.greatest(F.lit(1), F.col("lang_n") + EXTRA * F.col("v"))), "langs")
    dealt = known.join(langs, "lang").withColumn("block", F.expr("cast(pmod(xxhash64(term), blocks) as int)"))
    dealt = dealt.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
    dealt = written(spark, dealt.select("lang", "term", "block", "id", share(F.col("n") + EXTRA, F.col("lang_total")).alias("q")), "dealt")
    entries = written(spark, counts.filter("n > 0").join(dealt, ["lang", "term"]).select("lang", "source", "block", "id", "term", "n", "q"), "entries")
    groups = counts.filter("term = ''").select("lang", "source").join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0)
    groups = groups.join(langs.select("lang", "v", "blocks"), "lang").withColumn("total", F.greatest(F.lit(1), F.col("total") + EXTRA * F.col("v")))
    groups = written(spark, groups, "groups")

    above = entries.join(groups.select("lang", "source", "total"), ["lang", "source"]).withColumn("value", share(F.col("n") + EXTRA, F.col("total")) - F.col("q")).filter("value > 0")
    for keys in (["lang", "source", "block"], ["lang", "source"]):
        above = above.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "term"))).filter(F.col("rank") <= top)
    best = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = dealt.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    every = groups.join(tiles, "lang").select("lang", "source", "total", "tiles", F.expr("cast(pmod(xxhash64(source), tiles) as int)").alias("tile"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    own = entries.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("own"))  # a block's terms at most
    every = every.join(own, ["lang", "source", "block"], "left").join(sizes, ["lang", "block"], "left")
    none = F.array().cast("array<struct<id:int,n:long>>")
    every = every.withColumn("own", F.coalesce("own", none)).withColumn("pair", F.explode(F.expr("transform(sequence(0, tiles - 1), x -> struct(least(x, tile) as i, greatest(x, tile) as j))")))
    every = every.select("lang", "block", "pair.i", "pair.j", "source", "tile", "total", F.coalesce("terms", F.lit(0)).alias("terms"), F.col("own.id").alias("ids"), F.col("own.n").alias("counts"))
    priced = every.groupBy("lang", "block", "i", "j").applyInArrow(priced_pairs, "lang string, a string, b string, value long")
    pairs = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    both = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return both.unionByName(best)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_divergence": op13_divergence}
ORACLE = {
    "op13_divergence": r"""
with d as (select coalesce(text, '') text, coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () r from documents),
w as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term from d),
k as (select lang, term, count(*) n from w group by all having count(distinct r) >= 30),
l as (select lang, count(k.term) v, coalesce(sum(k.n), 0) lang_n from (select distinct lang from d) left join k using (lang) group by lang),
c as (select lang, source, term, count(*) n from w semi join k using (lang, term) group by all),
g as (select lang, source, coalesce(sum(n), 0) total from (select distinct lang, source from d) left join c using (lang, source) group by all),
e as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v))::bigint p,
  (1 + (1000000000::hugeint * (k.n + 5)) // (l.lang_n + 5 * l.v))::bigint q
  from g join l using (lang) join k using (lang) left join c using (lang, source, term)),
pairs as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from e a join e b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
x as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint "value" from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all select lang, source, 'term', term, p - q from e where n > 0 and p > q),
y as (select *, row_number() over (partition by lang, source, part order by "value" desc, item)::int rank from x)
select * from y where part = 'pair' or rank <= 50
"""
}

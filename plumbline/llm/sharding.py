"""Sharding by a permutation-filled lookup table (operator 7).

Every shard has a preference order over the slots of a prime-sized table: an offset and a stride hashed from its name.
Shards take turns; at its turn a shard claims the first slot of its order that is still free, until none is. Shards
get equal numbers of slots, give or take one, and a shard that comes or goes moves few slots of the others. A key's
slot is its hash modulo the table's size. The table has `SLOTS` rows whatever the data's size, so it is broadcast:
placement takes constant time and moves nothing.

Cases: a null key is placed as the empty string; keys of any length and repeated keys are hashed alike and go to one
shard; hot keys do not matter to placement, and `write` lets Spark split large shards; an empty table gives an empty
table; other columns pass
through and `slot` and `shard` replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

#: Slots of the table: a prime, far above the number of shards.
SLOTS = 65537
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be there and differ")
    if slots < len(shards) or slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, and not below the number of shards")

    def number(name: str, salt: str) -> int:
        return int(hashlib.md5(f"{salt}|{name}".encode()).hexdigest()[:13], 16)

    at = [number(s, "offset") % slots for s in shards]
    stride = [number(s, "stride") % (slots - 1) + 1 for s in shards]
    holder, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while holder[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % slots
            holder[at[i]] = i
            left -= 1
            if not left:
                break
    return holder


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the slot and the shard of each key."""
    lookup = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(fill(shards, slots))], "slot long, shard string")
    rest = [c for c in df.columns if c not in ("slot", "shard")]
    slot = f"pmod(cast(conv(substr(md5(coalesce(cast(`{key}` as string), '')), 1, 13), 16, 10) as bigint), {slots})"
    keyed = df.select(*[F.col(f"`{c}`") for c in rest], F.expr(slot).alias("slot"))
    return keyed.join(F.broadcast(lookup), "slot").select(*[F.col(f"`{c}`") for c in rest], "slot", "shard")  # `slots` rows, by construction


def write(df: DataFrame, path: str, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """Writes a folder for each shard. Rows are rebalanced by shard: adaptive execution splits a shard that is larger than
    spark.sql.adaptive.advisoryPartitionSizeInBytes over several tasks and puts small ones together."""
    place(df, key, shards, slots).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return place(docs, "doc_id")


QUERIES = {"op7_sharding": op7_sharding}
ORACLE = {
    "op7_sharding": f"""
with slots as (select unnest(range(0, {SLOTS}))::bigint slot, unnest(string_split('{",".join(map(str, fill(SHARDS)))}', ',')) i),
d as (select doc_id, source, strlen(coalesce(text, ''))::bigint n_bytes, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint % {SLOTS} slot from documents)
select doc_id, source, n_bytes, slot, 'shard-' || lpad(i, 4, '0') shard from d join slots using (slot)
"""
}

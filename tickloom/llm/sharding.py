"""Sharding by a permutation-filled lookup table, with SQL functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.columns import md5_bits

#: Prime, and over 100 slots for each of the shards below, so that shares differ by under 1 %.
SLOTS = 65537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Which shard owns each slot; ``slots`` is prime.

    Each shard prefers the slots in an order of its own: it starts at a slot and steps by a width,
    both hashed from its name, and as the number of slots is prime it meets each slot once. The
    shards take turns, and in its turn a shard claims the first free slot in its order. Shares
    differ by one slot at most, and if a shard leaves, few slots of the others change hands.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime of at least {len(shards)}")
    at = [_number(f"start:{name}") % slots for name in shards]
    step = [_number(f"step:{name}") % (slots - 1) + 1 for name in shards]
    owner, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The key's slot; a null key counts as the empty string."""
    return md5_bits(F.coalesce(key.cast("string"), F.lit("")), 15) % slots


def table_rows(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows (slot, shard): ``slots`` rows, whatever the input's size."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*[F.lit(name) for name in shards])
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select(
        F.col("slot").cast("long").alias("slot"),
        F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"),
    )


def place(
    docs: DataFrame, shards: Sequence[str], key_col: str = "doc_id", slots: int = SLOTS
) -> DataFrame:
    """The input's rows as (row, slot, shard); ``row`` is a struct of all input columns.

    One map-side pass: a hash, and a lookup in the broadcast table, whose size is fixed by
    ``slots``. Rows are not moved, so hot keys and copies cost nothing. Equal keys meet in one
    shard; null keys do so in the shard of the empty string.
    """
    table = F.broadcast(table_rows(docs.sparkSession, shards, slots))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    keyed = rows.withColumn("slot", slot_of(F.col("row").getField(key_col), slots))
    return keyed.join(table, "slot").select("row", "slot", "shard")

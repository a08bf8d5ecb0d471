"""Sharding by a permutation-filled lookup table (native).

Each shard has a preference order of the slots of a prime-sized table: (offset + turn * skip) modulo
the size, with offset and skip from a hash of the shard's name. The shards take turns and claim
their next free preferred slot until the table is full, so shards of equal weight hold equal
numbers of slots (within one), and when a shard goes, few slots of the others change hands. A row
goes to the shard in slot hash(key) modulo size; the table has a fixed number of rows (SIZE), is
broadcast, and each placement is one lookup: no shuffle, whatever the skew of the keys.

A weight w lets a shard claim in w of max(w) turns. The keys' hash is md5, so that placement can be
repeated by any other system.

Nulls and edge cases: a null key part counts as an empty string and a mark, apart from the empty
string itself; equal keys go to one shard, so a key that holds a third of all rows fills its shard
(add a column to the key to spread it); repeated rows stay; an empty table gives an empty result;
columns named slot or shard give way to the result's.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import free_name, table

#: Slots; a prime, over a hundred times SHARDS.
SIZE = 65_537
SHARDS = 256


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = SIZE, weights: dict[str, int] | None = None) -> list[str]:
    """The shard of each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    weight = {s: (weights or {}).get(s, 1) for s in shards}
    heaviest = max(weight.values())
    if min(weight.values()) < 0 or heaviest < 1:
        raise ValueError("weights must not be negative, nor all zero")
    at = {s: _number(s, "offset") % size for s in shards}
    skip = {s: _number(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in shards}
    credit = dict.fromkeys(shards, 0)
    slots: list[str | None] = [None] * size
    free = size
    while True:
        for s in shards:
            credit[s] += weight[s]
            if credit[s] < heaviest:
                continue
            credit[s] -= heaviest
            while slots[at[s]] is not None:
                at[s] = (at[s] + skip[s]) % size
            slots[at[s]] = s
            free -= 1
            if not free:
                return slots


def slot_of(keys: list[Column], size: int = SIZE) -> Column:
    """Slot of a key: the first 60 bits of the md5 of its parts, modulo the size."""
    parts = [F.concat(F.when(k.isNull(), F.lit("n:")).otherwise(F.lit("v:")), F.coalesce(k.cast("string"), F.lit(""))) for k in keys]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: list[str], shards: list[str], size: int = SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with slot and shard."""
    slots = df.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, size, weights))), "slot int, shard string")
    df = df.select(*[c for c in df.columns if c in key or c not in ("slot", "shard")])
    at = free_name(df, "__slot")
    placed = df.withColumn(at, slot_of([F.col(k) for k in key], size)).drop(*[c for c in ("slot", "shard") if c in df.columns])
    return placed.join(F.broadcast(slots), placed[at] == slots["slot"]).drop(at)


def write_shards(df: DataFrame, path: str, key: list[str], shards: list[str], files_each: int = 8, **options) -> None:
    """``df`` as Parquet, a folder for each shard; a shard's rows are dealt to several files, so no
    task writes a whole shard."""
    placed = assign_shards(df, key, shards, **options)
    deal = F.pmod(F.xxhash64(*[c for c in placed.columns if c not in ("slot", "shard")]), F.lit(files_each))
    placed.repartition("shard", deal).write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, ["doc_id"], shard_names()).select("doc_id", "slot", "shard")

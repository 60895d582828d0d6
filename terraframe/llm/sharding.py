"""Placing rows on shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table:
start ``offset`` and step ``skip`` come from the shard's name, and since the
size is prime every step visits all slots. Shards take turns; each claims the
first slot on its list that is free. The table then gives a shard for any key
in constant time, shares differ by at most one slot, and removing a shard
moves few rows that it did not hold.

The table has ``size`` rows whatever the data: it is sent to all executors and
rows never move. Keys are hashed from their text, so a row's place does not
depend on the number of partitions, the machine or the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table; a prime, well above 100 slots a shard for up to 600 shards.
TABLE_SIZE = 65_537
MOST_SLOTS = 5_000_011


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str, salt: str) -> int:
    return int(hashlib.sha256(f"{salt}\x00{text}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number (position in ``shards``) of each slot.

    Raises for an empty or repeated list of shards, a size that is not prime,
    above ``MOST_SLOTS`` (the bound of what is broadcast) or below the number of shards.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a non-empty list of distinct names")
    if not _is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"size must be a prime from the number of shards to {MOST_SLOTS}")
    # turns go by name, so that the order of the list does not matter
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    place = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for i in turns:
            slot = place[i]
            while table[slot] >= 0:
                slot = (slot + skip[i]) % size
            table[slot] = i
            place[i] = (slot + skip[i]) % size
            free -= 1
            if not free:
                break
    return table


def slot_of(*keys: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its texts. A null key column differs from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("v"), k.cast("string")), F.lit("n")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("\x00", *parts)), 1, 15), 16, 10).cast("long") % F.lit(size)


def place(
    df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard"
) -> DataFrame:
    """All rows and columns of ``df`` with ``slot`` (long) and ``shard`` (name) of their ``keys``.

    Rows with equal keys, repeated rows and null keys (one more key value) go
    to one shard each; an empty table stays empty. Columns of ``df`` called
    like the two new ones are replaced. A key that holds a large part of the
    rows fills its shard: add a second key column to spread it.
    """
    spark = df.sparkSession
    table = pa.array(lookup_table(shards, size), pa.int32())
    names = spark.createDataFrame(
        pa.table({"__slot": pa.array(range(size), pa.int64()), "__shard": pa.array(shards, pa.string()).take(table)})
    )
    keyed = df.withColumn("__slot", slot_of(*[F.col(f"`{k}`") for k in keys], size=size))
    out = keyed.join(F.broadcast(names), "__slot", "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot, shard)]
    return out.select(*kept, F.col("__slot").alias(slot), F.col("__shard").alias(shard))


def write_shards(placed: DataFrame, path: str, shard: str = "shard", files: int = 1) -> None:
    """One folder a shard, ``files`` files each; rows of a shard are dealt by a hash of the whole row.

    Shards hold even shares of the keys, so no task gets more than a shard's
    share divided by ``files``.
    """
    cells = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns]), F.lit(files))
    placed.withColumn("__file", cells).repartition(F.col(f"`{shard}`"), F.col("__file")).drop("__file").write.partitionBy(
        shard
    ).parquet(path)

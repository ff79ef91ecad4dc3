"""Shard placement by a permutation-filled lookup table (native: DataFrame functions only).

Each shard has its own order of preference over the slots of a table of prime size: a
permutation given by an offset and a step. Shards take turns; each claims its first slot that
is still free. All shards end with the same number of slots, give or take one, and adding or
removing a shard moves few of the others' slots. A key is placed by one look-up: its hash
modulo the table size. The table has a fixed size, whatever the data's, and is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseloom.llm._tables import fresh

#: A prime of over a hundred slots for each of some hundred shards.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def filled(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The table: for each slot the index of the shard that holds it. Repeated names count once, at their first place."""
    if not _is_prime(size):
        raise ValueError(f"{size} slots: the table size must be prime")
    shards = list(dict.fromkeys(shards))
    if not 0 < len(shards) <= size:
        raise ValueError(f"{len(shards)} shards for {size} slots")
    number = lambda salt, name: int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")
    at = [number("offset", s) % size for s in shards]
    step = [number("step", s) % (size - 1) + 1 for s in shards] if size > 2 else [1] * len(shards)
    table, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def key_slot(key: Column, size: int) -> Column:
    """The slot of a key: the first 60 bits of its MD5 as text, modulo the table size; a null key has slot 0."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % size, F.lit(0).cast("long"))


def lookup(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``slot`` (long), ``shard`` (string): ``size`` rows."""
    names = list(dict.fromkeys(shards))
    table = F.split(F.lit(",".join(map(str, filled(names, size)))), ",")
    name = F.element_at(F.array(*map(F.lit, names)), F.col("col").cast("int") + 1)
    return spark.range(1).select(F.posexplode(table)).select(F.col("pos").cast("long").alias("slot"), name.alias("shard"))


def placed(frame: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """All rows and columns of the frame with ``slot`` and ``shard`` (columns of these names, in any case, are replaced).

    Equal keys go to one shard, whatever their order; a null key goes to the shard of slot 0.
    Other columns may have any names. The broadcast side has ``size`` short rows, fixed by the parameter.
    """
    kept = [c for c in frame.columns if c.lower() not in (slot.lower(), shard.lower())]
    at, name = (fresh(f"{c}_of_table", [*frame.columns, slot, shard]) for c in ("slot", "shard"))
    table = lookup(frame.sparkSession, shards, size).select(F.col("slot").alias(at), F.col("shard").alias(name))
    own = [F.col(f"`{c}`") for c in kept]
    keyed = frame.select(*own, key_slot(F.col(f"`{key}`"), size).alias(slot))
    return keyed.join(F.broadcast(table), F.col(slot) == F.col(at)).select(*own, slot, F.col(name).alias(shard))

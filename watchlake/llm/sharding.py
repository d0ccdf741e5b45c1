"""Sharding by a lookup table that shards fill in turns.

Each shard has a permutation of the slots of a table of prime size, made of an offset and a step.
Shards take turns; each claims the first free slot of its own permutation. The table has as many
entries as `slots` says, whatever the data, and is broadcast; a row's slot is its key's hash modulo
the size. When a shard goes, the slots of the others mostly stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import Masked

#: A prime, about a hundred times the number of shards or more.
SLOTS = 65_537
#: The largest table that is broadcast: 16 bytes an entry.
MAX_SLOTS = 2_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For every slot the position of its shard in `shards`.

    `shards` must be different and fewer than `slots`, and `slots` prime, so that every step
    reaches every slot.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) >= slots:
        raise ValueError("shards must be named, different and fewer than slots")
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}")
    table = np.full(slots, -1, np.int32)
    place = [_number(f"offset:{name}") % slots for name in shards]
    step = [_number(f"step:{name}") % (slots - 1) + 1 for name in shards]
    left = slots
    while True:
        for shard in range(len(shards)):
            at = place[shard]
            while table[at] >= 0:
                at = (at + step[shard]) % slots
            table[at] = shard
            place[shard] = (at + step[shard]) % slots
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 52 bits of its md5 modulo the size; null counts as ""."""
    text = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") % slots


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """`rows` with `slot` and `shard`; columns of these names are replaced.

    Null keys share a slot, repeated keys too. Rows are neither moved nor lost.
    """
    spark = rows.sparkSession
    table = lookup_table(shards, slots)
    names = np.array(shards, dtype=object)
    frame = pd.DataFrame({"slot": np.arange(slots, dtype=np.int64), "shard": names[table]})
    lookup = F.broadcast(spark.createDataFrame(frame, "slot bigint, shard string"))
    own = Masked(rows, replaced=("slot", "shard"))
    placed = own.df.withColumn("__slot", slot_of(F.col(own.at(key)), slots))
    return own.back(placed.join(lookup, F.col("__slot") == F.col("slot"), "left"), "slot", "shard")


def write_shards(rows: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS) -> None:
    """Write `rows` as Parquet with one folder per shard; tasks write what they read."""
    place(rows, key, shards, slots).write.mode("overwrite").partitionBy("shard").parquet(path)

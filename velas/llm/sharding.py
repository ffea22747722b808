"""Shard placement by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime
size: slots ``(offset + j * skip) mod size``, offset and skip being hashes of
the shard's name.  The shards take turns, each claiming the first slot of its
order that is still free, until the table is full.  Shards thus hold nearly
equal numbers of slots, and when a shard leaves or joins, few slots change
hands.  A row's slot is the hash of its key modulo the table size.

The table has ``table_size`` rows whatever the data, so it is broadcast; the
placement is one broadcast join without a shuffle, in constant time per row.

Defined cases: a null key is placed like the empty string; rows with the same
key share a shard; an empty table gives an empty result; input columns named
like the added ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """(offset, skip) of a shard's permutation; skip is never 0 modulo a prime size."""
    digest = hashlib.sha256(shard.encode()).digest()
    return (int.from_bytes(digest[:8], "big") % size,
            int.from_bytes(digest[8:16], "big") % (size - 1) + 1)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index into ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("table size must be a prime not below the number of shards")
    at = []
    skips = []
    for s in shards:
        offset, skip = preference(s, size)
        at.append(offset)
        skips.append(skip)
    owner = np.full(size, -1, dtype=np.int32)
    left = size
    while True:
        for i, skip in enumerate(skips):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + skip) % size
            owner[slot] = i
            at[i] = slot
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size)).cast("int")


def place(rows: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """``rows`` with the columns ``slot`` and ``shard`` (the shard's name)."""
    spark = rows.sparkSession
    owner = lookup_table(shards, size)
    table = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owner.tolist())],
                                  "_slot int, _shard string")
    names = [c for c in rows.columns if c not in ("slot", "shard")]
    keyed = rows.select(slot_of(F.col(key), size).alias("_slot"), F.struct(*names).alias("_row"))
    return keyed.join(F.broadcast(table), "_slot").select(
        "_row.*", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))


def write_shards(rows: DataFrame, path: str, shards: list[str], key: str = "doc_id",
                 size: int = TABLE_SIZE) -> None:
    """Write one folder per shard, ``shard=<name>/``."""
    place(rows, shards, key, size).write.partitionBy("shard").parquet(path)

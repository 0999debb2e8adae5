"""Sharding by a permutation-filled lookup table.

Each shard has a preference order of the slots of a prime-sized table: offset + i * skip, both
drawn from a digest of its name. Shards take turns (a shard of weight w takes w turns a round) and
claim the next free slot they prefer, until the table is full. A document's slot is a hash of its
key, so that a lookup places it; adding or removing a shard moves few documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: dict[str, int], size: int = TABLE_SIZE) -> np.ndarray:
    """The index of the shard (in name order) that owns each slot.

    shards: name to whole weight of at least 1. Raises ValueError without shards, with more shards
    than slots, with a weight below 1 or with a size that is not prime.
    """
    names = sorted(shards)
    if not names or len(names) > size or min(shards.values()) < 1 or not is_prime(size):
        raise ValueError("needs 1 to size shards, weights of 1 or more and a prime size")
    owner, free = np.full(size, -1, np.int32), size
    digests = [hashlib.sha256(x.encode()).digest() for x in names]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    turns = [i for i, x in enumerate(names) for _ in range(shards[x])]
    while free:
        for i in turns[:free]:
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            free -= 1
    return owner


def lookup_table(spark: SparkSession, shards: dict[str, int], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard): one row per slot, so its size is fixed by `size` alone."""
    names = np.array(sorted(shards), object)
    return spark.createDataFrame(pd.DataFrame({"__slot": np.arange(size), "__shard": names[fill(shards, size)]}), "__slot long, __shard string")


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size))


def place(docs: DataFrame, shards: dict[str, int], key: str = "doc_id", size: int = TABLE_SIZE, slot_column: str | None = None, shard_column: str = "shard") -> DataFrame:
    """docs with each row's shard (and slot, if a column is named for it).

    Rows of equal key share a shard. A null key is placed by the hash of the whole row. Columns
    of docs that have the names of the new ones are replaced. The broadcast table has `size` rows.
    """
    row = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    slot = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*row), F.lit(size))).otherwise(slot_of(F.col(key), size))
    placed = docs.withColumn("__slot", slot).join(F.broadcast(lookup_table(docs.sparkSession, shards, size)), "__slot", "left")
    placed = placed.withColumn(shard_column, F.col("__shard"))
    return (placed.withColumn(slot_column, F.col("__slot")) if slot_column else placed).drop("__slot", "__shard")


def write_shards(docs: DataFrame, path: str, shards: dict[str, int], files: int = 8, **options) -> None:
    """Write one folder per shard. Rows are dealt by shard and a salt of `files` values, so that a hot shard fills several tasks."""
    placed = place(docs, shards, **options)
    shard = options.get("shard_column", "shard")
    row = [F.col(f"`{c}`") for c, kind in placed.dtypes if "map<" not in kind]
    placed = placed.withColumn("__salt", F.pmod(F.xxhash64(*row), F.lit(files))).repartition(F.col(shard), F.col("__salt"))
    placed.drop("__salt").write.partitionBy(shard).parquet(path)

"""Placement of rows on shards through a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, given by an offset and a skip that are hashed from
its name.  Shards take turns; at its turn a shard claims the first free slot of its order, until the table is full.  Every
shard so gets an equal share of slots (to one), and few slots change hands when shards come or go.  A row's key hashes to a
slot, and the broadcast table tells the shard: one look-up per row, no shuffle, whatever the keys' skew.

The table has `slots` rows whatever the data's size (65,537 by default), so the broadcast is bounded.  A null key is placed
as the empty key.  Equal keys, in repeated rows too, go to one shard.  Texts are not read, so their length plays no part.
Ties cannot arise: shards take their turns in the order of their names, which differ.  An empty table gives an empty table; no
shard at all is an error.  All columns of the input stay; where it has columns slot or shard, the added ones get an underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import free_names


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = 65_537) -> list[int]:
    """The number of the shard that owns each slot.  Shards are taken in the order of their names."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime that is not below the number of shards")
    names = sorted(shards)
    digest = [hashlib.sha256(s.encode()).digest() for s in names]
    place = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digest]
    owner, filled = [-1] * slots, 0
    while True:
        for k in range(len(names)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % slots
            owner[place[k]] = k
            filled += 1
            if filled == slots:
                return owner


def table(spark: SparkSession, shards: Sequence[str], slots: int = 65_537) -> DataFrame:
    names = sorted(shards)
    return spark.createDataFrame([(i, names[k]) for i, k in enumerate(lookup_table(shards, slots))], "slot long, shard string")


def place(docs: DataFrame, shards: Sequence[str], key_col: str = "doc_id", slots: int = 65_537) -> DataFrame:
    """docs and, last, columns slot (long) and shard (string)."""
    at, name = free_names(docs.columns, "slot", "shard")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    placed = docs.withColumn(at, F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots)
    owners = table(docs.sparkSession, shards, slots).toDF(at, name)
    return placed.join(F.broadcast(owners), at).select(*docs.columns, at, name)  # as many rows as slots

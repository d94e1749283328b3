"""Exact deduplication by an extendible-hash index on shared files, by Spark's own functions.

Texts are equal when identical after deleting white space ([\\x20\\x09-\\x0D]).  An entry stands for the rows of one text: the
64-bit hash of the normalised text is its key, and its SHA-256 tells it from other texts in the chain of that key.

The directory has a slot for each combination of the first `depth` bits of a key, and each slot points to a bucket, which is a
range of keys.  A bucket with more than `capacity` entries is split by the next bit; where the directory has no bit left for
that, it doubles.  Splitting goes on until every bucket fits or holds a single key, at whatever depth.  (The directory starts
with as many slots as an even spread over full buckets needs, so few doublings remain.)

Every bucket has one owner task, to which the directory routes its entries.  Where rows share a digest the owner also gets
their texts, copies merged before, and compares them byte by byte; texts of one key form a chain.  Owners write the chains to
the shared folder.  A document finds its bucket through the directory and its entry in the chain of its key.

A null text counts as empty; empty texts form one group.  Ties for the longest original go to the smallest id (nulls last),
then to the earliest row, so one row of a group stays even where rows are repeated.  Very long texts are hashed and compared
whole.  An empty table gives an empty table.  Only the id and text columns (and row_col) are read, so further columns cannot
clash.  Different bytes under one SHA-256 end the job with an error.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import WS, save, text_or_empty

BITS = 64


def _norm(text: Column) -> Column:
    return F.regexp_replace(text, WS + "+", "")


def hash_file(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, id, size, key, sha) for each row, written to the shared folder; row_col: a value of its own that each row has."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    base = docs.select(row.alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    base = base.select("row", "id", F.length("text").alias("size"), _norm(F.col("text")).alias("norm"))
    return save(base.select("row", "id", "size", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")), "hashes")


def slot_of(key: Column, depth: int) -> Column:
    """The directory's slot of a key: its first `depth` bits."""
    return F.shiftrightunsigned(key, BITS - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = 4096) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) for each slot in use, written to the shared folder, and the directory's depth.

    entries: one row for each different text, by column key.  bucket: the start of its range of keys.
    """
    n = entries.count()
    depth, fitting = max(0, math.ceil(math.log2(n / capacity))) if n else 0, []
    unsplit = entries
    while True:
        held = save(unsplit.groupBy(slot_of(F.col("key"), depth).alias("prefix")).agg(F.count("*").alias("n")), "slots")
        fits = (F.col("n") <= capacity) | F.lit(depth == BITS)
        fitting.append(held.filter(fits).select(F.lit(depth).alias("local_depth"), "prefix"))
        full = save(held.filter(~fits).select("prefix"), "full")
        if full.isEmpty():
            break
        unsplit = entries.join(full, slot_of(F.col("key"), depth) == full.prefix, "left_semi")
        depth += 1
    buckets = reduce(DataFrame.unionByName, fitting)
    depths = range(depth - len(fitting) + 1, depth + 1)
    pointed = F.explode(F.array(*(F.struct(F.lit(d).alias("local_depth"), (F.shiftrightunsigned("slot", depth - d) if d else F.lit(0).cast("long")).alias("prefix")) for d in depths)))
    slots = entries.select(slot_of(F.col("key"), depth).alias("slot")).distinct().select("slot", pointed.alias("p")).select("slot", "p.*")
    start = F.expr(f"if(local_depth = 0, 0L, shiftleft(prefix, {BITS} - local_depth))")
    return save(slots.join(buckets, ["local_depth", "prefix"]).select("slot", start.alias("bucket"), "local_depth"), "directory"), depth


def _routed(rows: DataFrame, pointers: DataFrame, depth: int) -> DataFrame:
    """rows and their bucket.  Spark broadcasts the directory while it is small, and joins by slot beyond that."""
    return rows.withColumn("slot", slot_of(F.col("key"), depth)).join(pointers.select("slot", "bucket"), "slot").drop("slot")


def index(held: DataFrame, docs: DataFrame, text_col: str = "text", capacity: int = 4096) -> tuple[DataFrame, DataFrame, int]:
    """The chains (bucket, key, chain, sha, first, group_size, owner), in the shared folder; the directory; its depth.

    held: the hash file of docs.  first: (-size, id is null, id, row) of the row that stays.  owner: the task that held the bucket.
    """
    first = F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    entries = save(held.groupBy("key", "sha").agg(first, F.count("*").alias("group_size")), "entries")
    pointers, depth = directory(entries, capacity)
    again = save(entries.filter("group_size > 1").select("key").distinct(), "again")  # a table, so that Spark knows how small it is
    texts = docs.select(_norm(text_or_empty(text_col)).alias("norm")).select(F.xxhash64("norm").alias("key"), "norm").join(again, "key", "left_semi")
    texts = texts.select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "norm", (F.spark_partition_id() % 16).alias("salt"))
    texts = texts.groupBy("key", "sha", "salt").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).drop("salt")
    both = _routed(entries, pointers, depth).unionByName(_routed(texts, pointers, depth), allowMissingColumns=True)
    own = both.repartition("bucket").withColumn("owner", F.spark_partition_id())
    compared = own.groupBy("bucket", "key", "sha").agg(*(F.max(c).alias(c) for c in ("first", "group_size", "high", "owner")), F.min("low").alias("low"))
    same = F.when(F.col("low") == F.col("high"), F.col("sha")).when(F.col("group_size") == 1, F.col("sha")).otherwise(F.raise_error(F.lit("different texts have one SHA-256")).cast("binary"))
    entry = F.struct(same.alias("sha"), "first", "group_size", "owner")
    chained = compared.groupBy("bucket", "key").agg(F.sort_array(F.collect_list(entry)).alias("c"))  # texts of one 64-bit key: few
    chains = chained.select("bucket", "key", F.posexplode("c").alias("chain", "c")).select("bucket", "key", "chain", "c.*")
    return save(chains, "index"), pointers, depth


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, row_col: str | None = None) -> DataFrame:
    """(id_col, keep_id, group_size long, kept boolean, text_sha256) for every row, after row_col if that is given."""
    held = hash_file(docs, id_col, text_col, row_col)
    chains, pointers, depth = index(held, docs, text_col, capacity)
    found = _routed(held, pointers, depth).join(chains, ["bucket", "key", "sha"])
    kept = (F.col("row") == F.col("first.row")).alias("kept")
    return found.select(*([F.col("row").alias(row_col)] if row_col else []), F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256"))

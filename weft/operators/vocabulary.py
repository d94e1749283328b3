"""Vocabularies: counts of tokens, a threshold, and texts as numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.text import strip
from weft.session import scratch, ship

#: Numbers below this stand for padding, start, end and unknown.
FIRST = 4
UNKNOWN = 3


def token_counts(rows: DataFrame, text_col: str = "text", side: str | None = None) -> DataFrame:
    """(token, freq), or (side, token, freq).  Tasks add up their own counts before the shuffle, so frequent tokens do no harm."""
    tokens = rows.select(F.explode(F.split(strip(F.col(text_col)), " ", -1)).alias("token")).filter("token <> ''")
    counted = tokens.groupBy("token").agg(F.count("*").alias("freq"))
    return counted if side is None else counted.select(F.lit(side).alias("side"), "token", "freq")


def numbered(vocab: DataFrame, least: int = 5) -> DataFrame:
    """(token, freq, id): tokens counted `least` times or more, the most frequent first.

    Each token's number is its rank.  Rows are ranked within ranges of (freq, token) and shifted by the sizes of the ranges
    before, so no task holds the vocabulary.
    """
    kept, at = vocab.filter(F.col("freq") >= least), scratch(vocab.sparkSession, "vocabulary")
    kept.select("token", "freq").write.parquet(at)  # ranges are sought first: tokens are not to be counted for that and again
    kept = vocab.sparkSession.read.schema(kept.select("token", "freq").schema).parquet(at)
    ranged = kept.repartitionByRange(F.col("freq").desc(), "token").withColumn("part", F.spark_partition_id())
    ranged = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.col("freq").desc(), "token")))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row for each range
    return ranged.join(before, "part").select("token", "freq", (F.col("before") + F.col("rank") - 1 + FIRST).cast("int").alias("id"))


#: Bytes of text that are taken apart at a time.
MOST_BYTES = 4 << 20


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, token, at): the different tokens of each text and where they are."""
    for whole in batches:
        most = max(1, whole.num_rows * MOST_BYTES // max(1, whole.nbytes))
        for i in range(0, whole.num_rows, most):
            part = whole.slice(i, most)
            lists = pc.split_pattern(part.column("text"), " ")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            tokens = lists.flatten().dictionary_encode()
            text = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            some = np.flatnonzero(pc.not_equal(tokens.dictionary, "").to_numpy(zero_copy_only=False)[tokens.indices.to_numpy()])
            if not len(some):
                continue
            code = tokens.indices.to_numpy()[some].astype(np.int64)
            order = np.argsort(text[some] * len(tokens.dictionary) + code, kind="stable")
            text, place, code = text[some][order], place[some][order], code[order]
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (code[1:] != code[:-1])])
            at = pa.ListArray.from_arrays(pa.array(np.r_[new, len(code)].astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(text[new])), tokens.dictionary.take(pa.array(code[new])), at], ["key", "token", "at"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids): the numbers of each text's tokens, in the order of their places."""
    for part in batches:
        lists = part.column("s")
        own = lists.flatten()
        at, each = own.field(0), pc.list_value_length(own.field(0)).to_numpy()
        text = np.repeat(np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), each)
        order = np.lexsort((at.flatten().to_numpy(), text))
        ids = np.repeat(own.field(1).to_numpy(), each)[order]
        ends = np.r_[0, np.cumsum(np.bincount(text, minlength=len(lists)))].astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], ["key", "ids"])


def encode(rows: DataFrame, vocab: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, ids): each text's tokens as numbers of the vocabulary, in order; others are UNKNOWN; a blank text has none.

    A text's token is looked up once, however often it is there: what is shuffled is a row for each different token of each text.
    """
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("token", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))])
    tokens = rows.select(F.col(key).alias("key"), strip(F.col(text_col)).alias("text")).mapInArrow(_places, schema)
    known = tokens.join(vocab.select("token", "id"), "token", "left").select("key", "at", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))
    together = known.groupBy("key").agg(F.collect_list(F.struct("at", "id")).alias("s"))
    ids = together.mapInArrow(_in_order, T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return rows.select(F.col(key).alias("__key")).join(ids, F.col("__key") == F.col("key"), "left").select(F.col("__key").alias(key), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

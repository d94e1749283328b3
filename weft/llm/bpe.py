"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to `chunk` code points are one chunk and are encoded where they are read.  Longer ones are cut into chunks that
overlap; chunks are pre-tokenised in parallel; two neighbours are stitched at the first place in their overlap at which both
begin a pre-token (after a character that is not white space, so that the piece before ends alike with or without what
follows); the pieces between stitches are encoded in parallel and their ids concatenated.  Where an overlap has no such
place (one pre-token longer than the overlap) the chunks on both sides are joined and pre-tokenised again as one, which is
then stitched to its neighbours like any chunk; so a long pre-token joins the chunks that it lies in and no others.

Nulls: a null text counts as empty; a null id is kept.  Empty texts give no ids.  Repeated rows each give a row; there is
nothing to tie.  An empty table gives an empty table.  Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.llm.common import save, slices, text_or_empty

#: Code points before a chunk's end from which a match may still change when more text follows (the longest contraction).
MARGIN = 3


@functools.lru_cache(2)
def _encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _encode(rank_path: str, pattern: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(rank_path, pattern)
        for part in slices(batches, "piece"):
            ids = [np.asarray(encoding.encode_to_numpy(x), "<u4").tobytes() if x else b"" for x in part.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(ids, pa.binary())], [*keys, "ids"])

    return run


def _cut(chunk: int, overlap: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for row, key, text in zip(part.column("row").to_pylist(), part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                n = -(-len(text) // chunk)
                for first in range(0, n, 64):
                    ks = range(first, min(n, first + 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(ks), pa.int64()), pa.array([key] * len(ks), id_type), pa.array(ks, pa.int64()), pa.array([n] * len(ks), pa.int64()), pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in ks], pa.string())],
                        ["row", "id", "k", "n", "part"],
                    )

    return run


def _boundaries(chunk: int, overlap: int, pattern: str):
    """Starts of pre-tokens of each part, which holds chunks k to last: heads, counted from its start, and tails, from where the next chunk starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        for part in slices(batches, "part"):
            heads, tails = [], []
            for text, k, last in zip(*(part.column(c).to_pylist() for c in ("part", "k", "last")), strict=True):
                next_ = chunk * (last - k + 1)
                sure = len(text) if len(text) < next_ + overlap else len(text) - MARGIN  # the text ends in this part, or goes on
                starts = [m.start() for m in compiled.finditer(text) if m.start() == 0 or not text[m.start() - 1].isspace()]
                heads.append([x for x in starts if 0 < x < overlap])
                tails.append([x - next_ for x in starts if next_ < x <= sure])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "k", "last")), *lists], ["row", "k", "last", "heads", "tails"])

    return run


def _runs(cut: DataFrame, chunk: int, overlap: int, pattern: str) -> DataFrame:
    """(row, k, start) for each chunk k that begins a run which can be encoded on its own, start code points into it, but the first.

    cut: chunks (row, k, part).
    """
    bounds = "row long, k long, last long, heads array<int>, tails array<int>"
    starts = _boundaries(chunk, overlap, pattern)
    told = save(cut.select("row", "k", F.col("k").alias("last"), "part").repartition("row", "k").mapInArrow(starts, bounds), "boundaries")
    order = Window.partitionBy("row").orderBy("k")  # a few numbers for each chunk of one text
    while True:
        stitched = told.withColumn("start", F.array_min(F.array_intersect(F.lag("tails").over(order), F.col("heads"))))
        open_ = (F.col("k") > 0) & F.col("start").isNull()
        joined = stitched.withColumn("unit", F.sum(F.when(open_, 0).otherwise(1)).over(order)).groupBy("row", "unit")
        units = save(joined.agg(F.min("k").alias("k"), F.max("last").alias("last"), F.min_by("heads", "k").alias("heads"), F.max_by("tails", "k").alias("tails"), F.min_by("start", "k").alias("start"), F.count("*").alias("n")), "units")
        again = units.filter("n > 1").select("row", F.col("k").alias("first"), "last")
        if again.isEmpty():
            return units.filter("k > 0").select("row", "k", "start")
        # pre-tokenise what was joined; every part but the last gives way to the next where that starts
        held = cut.join(again, (cut.row == again.row) & F.col("k").between(F.col("first"), F.col("last"))).drop(again.row)
        own = F.when(F.col("k") == F.col("last"), F.col("part")).otherwise(F.left("part", F.lit(chunk)))
        grown = held.select("row", "first", "last", "k", own.alias("own")).groupBy("row", "first", "last").agg(_joined("k", "own").alias("part"))
        new = grown.select("row", F.col("first").alias("k"), "last", "part").repartition("row", "k").mapInArrow(starts, bounds)
        told = save(units.filter("n = 1").select("row", "k", "last", "heads", "tails").unionByName(new), "boundaries")


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32768, overlap: int = 1024) -> DataFrame:
    """(id_col, n_tokens long, ids binary: little-endian unsigned 32-bit integers) for every row of docs."""
    id_type = docs.schema[id_col].dataType
    named, ids = T.StructField("id", id_type), T.StructField("ids", T.BinaryType())
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    short = base.filter(F.length("text") <= chunk).select("id", F.col("text").alias("piece")).mapInArrow(_encode(rank_path, pattern, ["id"]), T.StructType([named, ids]))

    chunks = T.StructType([T.StructField("row", T.LongType()), named, T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("part", T.StringType())])
    long = base.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    cut = save(long.mapInArrow(_cut(chunk, overlap, to_arrow_schema(T.StructType([named])).field(0).type), chunks), "chunks")
    runs = _runs(cut.select("row", "k", "part"), chunk, overlap, pattern)
    order = Window.partitionBy("row").orderBy("k")  # a few numbers for each chunk of one text
    told = cut.select("row", "k", "n").join(runs, ["row", "k"], "left").withColumn("stop", F.lead("start").over(order))
    told = told.withColumn("run", F.sum(F.when(F.col("start").isNotNull(), 1).otherwise(0)).over(order)).withColumn("chunks", F.count("*").over(Window.partitionBy("row", "run")))
    told = save(told.select("row", "k", "run", "chunks", "start", "stop"), "runs")
    from_ = F.coalesce("start", F.lit(0))
    to = F.when(F.col("k") == F.col("n") - 1, F.length("part")).otherwise(F.lit(chunk) + F.coalesce("stop", F.lit(0)))
    # the texts are dealt out once, as the join asks for it; only runs of several chunks are brought together
    owned = cut.repartition("row", "k").join(told, ["row", "k"]).select("row", "id", "run", "k", "chunks", F.col("part").substr(from_ + 1, to - from_).alias("own"))
    joined = owned.filter("chunks > 1").groupBy("row", "run").agg(F.first("id").alias("id"), _joined("k", "own").alias("piece"))
    pieces = owned.filter("chunks = 1").select("row", "run", "id", F.col("own").alias("piece")).unionByName(joined)
    spread = pieces.mapInArrow(_encode(rank_path, pattern, ["row", "run", "id"]), T.StructType([T.StructField("row", T.LongType()), T.StructField("run", T.LongType()), named, ids]))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("run", "ids"))), lambda x: x["ids"])
    joined = spread.groupBy("row").agg(F.first("id").alias("id"), F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")).select("id", "ids")
    return short.unionByName(joined).select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def _joined(by: str, text: str) -> Column:
    return F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(by, text))), lambda x: x[text]))


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """encoded (with a binary column ids, as encode() gives) and a binary column decoded: the concatenated raw bytes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _encoding(rank_path, pattern)._mergeable_ranks
        raw = [b""] * (max(table.values()) + 1)
        for k, v in table.items():
            raw[v] = k
        for part in slices(batches, "ids"):
            texts = [b"".join(map(raw.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))

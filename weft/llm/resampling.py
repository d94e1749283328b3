"""Importance resampling towards a target: documents are weighed by how much more often their n-grams are the target's.

Features are all runs of one to `longest` consecutive words, counted with repeats; a feature's bucket is the crc32 of its string
modulo `buckets`.  The distinct-feature dictionary: each task counts the strings of its texts, a lot of words at a time, and deals
each different string out once a lot, with its count, by a hash of its first two words.  Their owner adds up the counts of all lots,
so every string of the corpus stands there once; there it is hashed once, and its count goes to its bucket.  Strings are dealt
out as a tree of words, so a beginning that many share is listed once, and lists are compressed.  Strings that begin with one word,
however common it is, have several owners.

A bucket's gain compares its share of the target's features with its share of all: floor(1000 * ln(ratio)), with one added to
each bucket.  Gains (`buckets` numbers, whatever the data) are joined to the feature counts of each document, by bucket: a second
pass tells the bucket of every feature from the crc32 of its words (crc32 is linear: that of a run follows from that of its parts),
adds up the gains and gives a document's weight.  A document's score is its weight and Gumbel noise drawn from its id, and the
`percent` of the documents with `least_words` words or more that have the highest scores are drawn.

A null text has no words, no features and weight 0; a null id draws its noise as an empty one and comes last among equals.  Very
long texts are read whole.  Ties go to the smaller id.  Repeated rows are drawn each for itself.  Empty tables give an empty
table, or gains of the one that is not empty.  Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.llm.common import save, slices, text_or_empty

BUCKETS, LONGEST = 10_000, 3
#: Words of a lot.
MOST = 500_000
#: Owners of strings that begin with one word, and how far they are apart.
SPREAD, _STEP = 16, 0x9E3779B1
#: Rows in which a task gives its sums.
PARTS = 32
#: A-Z in lower case; whatever is not a letter, a digit or beyond ASCII becomes a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
DEALT = "bucket int, lists binary, sizes array<binary>, counts array<binary>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _numbers() -> defaultdict[bytes, int]:
    """Words as numbers, in the order in which they are met."""
    return defaultdict(count().__next__)


# The dictionary of features


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 as bytes, as few a number as the largest needs; the first byte tells how many."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) < 1 << 8 * np.dtype(k).itemsize)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _lists(numbers: dict[bytes, int], texts: list[np.ndarray], longest: int, owners: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The different strings of a lot with their counts: for each owner a tree of words, level by level.

    Level n has the last words of strings of n words, in the order of their parents, their counts and how many children each has.  A
    first word stands in the tree of each owner that has strings which begin with it, and is counted in one of them.
    """
    import zstandard

    names = np.empty(len(numbers), object)
    names[:] = sorted(numbers)
    rank = np.empty(len(names), np.int64)
    rank[np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
    word = rank[np.concatenate(texts)]
    room = np.concatenate([np.arange(len(t), 0, -1) for t in texts])  # words from here to the end of the text
    own = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    levels, run, owner = [], word, None
    total = np.bincount(word, minlength=len(names))
    for n in range(2, longest + 1):
        at = np.flatnonzero(room >= n)
        key, inverse, times = np.unique(run[at] << 32 | word[at + n - 1], return_inverse=True, return_counts=True)
        parent, last = key >> 32, key & 0xFFFFFFFF
        owner = (own[parent] + own[last] % SPREAD * _STEP) % owners if n == 2 else owner[parent]
        levels.append((owner, parent, last, times))
        run = np.full(len(word), -1)
        run[at] = inverse
    home = own % owners
    first = levels[0][:2] if levels else (home[:0], home[:0])
    both = np.unique(np.r_[home * len(names) + np.arange(len(names)), first[0] * len(names) + first[1]])
    owner, last = both // len(names), both % len(names)
    levels.insert(0, (owner, None, last, np.where(owner == home[last], total[last], 0)))
    packed, sorted_ = zstandard.ZstdCompressor(level=3), []
    for k, (owner, _, last, times) in enumerate(levels):
        order = np.argsort(owner, kind="stable")  # nodes are in the order of their paths
        if k + 1 < len(levels):
            below = levels[k + 1][1] if k else np.searchsorted(both, levels[1][0] * len(names) + levels[1][1])
            sizes = np.bincount(below, minlength=len(owner))[order]
        else:
            sizes = np.zeros(0, np.int64)
        sorted_.append((np.searchsorted(owner[order], np.arange(owners + 1)), last[order], times[order], sizes))
    out = {f.name: [] for f in schema}
    for i in np.unique(levels[0][0]).tolist():
        parts = [(last[c[i] : c[i + 1]], times[c[i] : c[i + 1]], sizes[c[i] : c[i + 1]]) for c, last, times, sizes in sorted_]
        out["bucket"].append(i)
        out["lists"].append(packed.compress(b"\0".join(b"\n".join(names[last].tolist()) for last, _, _ in parts)))
        out["counts"].append([packed.compress(_narrow(times)) for _, times, _ in parts])
        out["sizes"].append([packed.compress(_narrow(sizes)) for _, _, sizes in parts[:-1]])
    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def _dealt(longest: int, owners: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, texts, held = _numbers(), [], 0
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                if own := words_of(text):
                    texts.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
                    held += len(own)
            if held >= MOST:
                yield from _lists(numbers, texts, longest, owners, schema)
                numbers, texts, held = _numbers(), [], 0
        if held:
            yield from _lists(numbers, texts, longest, owners, schema)

    return run


def _strings(held: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The crc32 and the count of each different string of an owner, each hashed once, level by level."""
    import zstandard

    unpacked, ids, levels = zstandard.ZstdDecompressor(), _numbers(), []
    for x in held:
        for k, listed in enumerate(unpacked.decompress(x["lists"]).split(b"\0")):
            if k == len(levels):
                levels.append(([], [], []))
            own = listed.split(b"\n") if listed else []
            levels[k][0].append(np.fromiter(map(ids.__getitem__, own), np.int64, len(own)))
            levels[k][1].append(_wide(unpacked.decompress(x["counts"][k])))
            if k < len(x["sizes"]):
                levels[k][2].append(_wide(unpacked.decompress(x["sizes"][k])))
    table, crc, node, sizes = Crc(list(ids)), None, None, None
    for words, counts, below in levels:
        word = np.concatenate(words)
        key, inverse = np.unique(word if node is None else np.repeat(node, sizes) << 32 | word, return_inverse=True)
        crc = table.own[key] if node is None else table.then(crc[key >> 32], key & 0xFFFFFFFF)
        yield crc, np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)
        node, sizes = inverse, np.concatenate(below) if below else None


def _hashed(buckets: int):
    """(part, sums): counts of the different strings of each owner by bucket, a part of the buckets a row; rows come sorted by owner."""
    size = -(-buckets // PARTS)

    def added(sums: np.ndarray, held: list[dict]) -> None:
        for crc, n in _strings(held):
            sums[:buckets] += np.bincount(crc % np.uint32(buckets), n, buckets).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held, sums = None, [], np.zeros(size * PARTS, np.int64)
        for batch in batches:
            for x in batch.to_pylist():
                if x["bucket"] != owner and held:
                    added(sums, held)
                    held = []
                owner = x["bucket"]
                held.append(x)
        if held:
            added(sums, held)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in sums.reshape(PARTS, size)], pa.binary())], ["part", "sums"])

    return run


def _summed(buckets: int):
    """(bucket, n) for buckets that have features, of the sums of all tasks; a part's rows are in one task."""
    size = -(-buckets // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in batch.to_pylist():
                own = np.frombuffer(x["sums"], np.int64)
                sums[x["part"]] = sums[x["part"]] + own if x["part"] in sums else own
        for part, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at + part * size, pa.int32()), pa.array(n[at])], ["bucket", "n"])

    return run


def feature_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, for buckets that have some."""
    schema = T._parse_datatype_string(DEALT)
    owners = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    lists = texts.mapInArrow(_dealt(longest, owners, to_arrow_schema(schema)), schema)
    sums = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_hashed(buckets), "part int, sums binary")
    return sums.repartition("part").mapInArrow(_summed(buckets), "bucket int, n long")


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain long) for every bucket, of the counts (bucket, n) of all documents and of the target."""
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    rows = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(1).alias("one"))
    rows = rows.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    for df, name in ((own, "all_s"), (target, "all_t")):
        rows = rows.join(F.broadcast(total(df, name).withColumn("one", F.lit(1))), "one")  # one row
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in "st")
    ratio = (t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


# Weights of documents


@lru_cache(1)
def _doubling() -> list[np.ndarray]:
    """For 1, 2, 4, ... bytes of zero: what becomes of each bit of a crc32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = [table[bits & 0xFF] ^ (bits >> 8)]
    for _ in range(40):
        out.append(_applied(out[-1], out[-1]))
    return out


def _applied(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    bit = (x[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(columns * bit, axis=1)


@lru_cache(4096)
def _moved(size: int) -> np.ndarray:
    """For each byte of a crc32 and each value of it: what becomes of it behind `size` more bytes."""
    x = (np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)).reshape(-1)
    for k, columns in enumerate(_doubling()):
        if size >> k & 1:
            x = _applied(columns, x)
    return x.reshape(4, 256)


def _over(crc: np.ndarray, tables: np.ndarray, row: np.ndarray | int) -> np.ndarray:
    """What becomes of each crc32, by the table that begins at its row."""
    moved = tables[row + (crc & np.uint32(0xFF))]
    for b in range(1, 4):
        moved = moved ^ tables[row + 256 * b + ((crc >> np.uint32(8 * b)) & np.uint32(0xFF))]
    return moved


class Crc:
    """The crc32 of words, and of strings to which a blank and a word are added."""

    def __init__(self, words: list[bytes]):
        self.own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        sizes, row = np.unique(size, return_inverse=True)
        self._row = row * 1024
        self._tables = np.concatenate([_moved(n + 1).reshape(-1) for n in sizes.tolist()] or [np.zeros(0, np.uint32)])
        blank = np.array([zlib.crc32(b" ")], np.uint32)
        moved = np.concatenate([_over(blank, _moved(n).reshape(-1), 0) for n in sizes.tolist()] or [blank])
        self._behind = moved[row] ^ self.own  # of a blank and the word

    def then(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The crc32 of each string with a blank and the word behind it."""
        return _over(crc, self._tables, self._row[word]) ^ self._behind[word]


def crc32s(words: list[bytes], word: np.ndarray, room: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to `longest`: the places at which a feature of that many words begins, and the features' crc32.

    words: the different ones; word: the number of that at each place; room: words from each place to the end of its text.
    """
    table = Crc(words)
    at, crc = np.arange(len(word)), table.own[word]
    yield at, crc
    for n in range(2, longest + 1):
        kept = room[at] >= n
        at, crc = at[kept], crc[kept]
        crc = table.then(crc, word[at + n - 1])
        yield at, crc


def _weighed(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            numbers = _numbers()
            texts = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in map(words_of, part.column("text").to_pylist())]
            sizes = np.array([len(t) for t in texts], np.int64)
            weight = np.zeros(len(texts), np.int64)
            if numbers:
                doc = np.repeat(np.arange(len(texts)), sizes)
                room = np.concatenate([np.arange(len(t), 0, -1) for t in texts])
                for at, crc in crc32s(list(numbers), np.concatenate(texts), room, longest):
                    value = np.zeros(len(doc) + 1, np.int64)
                    np.cumsum(np.bincount(at, gain[crc % np.uint32(len(gain))], len(doc)).astype(np.int64), out=value[1:])
                    ends = np.r_[0, np.cumsum(sizes)]
                    weight += value[ends[1:]] - value[ends[:-1]]
            features = sum(np.maximum(sizes - n, 0) for n in range(longest))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gained: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id_col, n_words, n_features, weight: long) for every row; gained: (bucket, gain), a row for each bucket."""
    gain = np.array([r["gain"] for r in gained.orderBy("bucket").collect()], np.int64)  # a number for each bucket
    id_ = T.StructField("id", docs.schema[id_col].dataType)
    schema = T.StructType([id_, *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    texts = docs.select(F.col(id_col).alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    return texts.mapInArrow(_weighed(gain, longest), schema).withColumnRenamed("id", id_col)


def scored(weighed: DataFrame, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """weighed and score: the weight and Gumbel noise in thousandths, drawn from seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "utf-8"), 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, longest: int = LONGEST, buckets: int = BUCKETS
) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank: long) for every row; rank is null where a document is not drawn.

    target: a table with a column text.  Ranks are counted within ranges of scores and moved by the sizes of the ranges before,
    so no task holds all documents.
    """
    own, wanted = (save(feature_counts(df, c, longest, buckets), "features") for df, c in ((docs, text_col), (target, "text")))
    held = save(scored(weights(docs, gains(own, wanted, buckets), id_col, text_col, longest), id_col, seed), "scores")
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last()]
    able = held.filter(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    ranged = save(able.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row for each range
    ranked = ranged.join(before, "part").filter(F.col("before") < most)
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    rank = F.when(F.col("rank") <= most, F.col("rank"))
    drawn = ranked.select(*held.columns, rank.cast("long").alias("rank"))
    others = ranged.join(before, "part").filter(F.col("before") >= most).select(*held.columns).unionByName(held.filter(F.col("n_words") < least_words))
    return drawn.unionByName(others.withColumn("rank", F.lit(None).cast("long")))

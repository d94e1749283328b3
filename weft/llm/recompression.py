"""Long repeats of words by recompression: what a window of `width` words repeats is removed where it does not come first.

A text is a sequence of symbols, at first its words.  A round of recompression names runs of one symbol and then pairs of
neighbours: each name tells a symbol's side, and a symbol of the left side followed by one of the right side becomes one.
Names are hashes of what they stand for, so every task in the cluster gives equal tokens equal names, and whether two symbols
stay apart depends on the two alone.  A boundary that is left after some rounds therefore depends on a few words around it (its
context), and equal texts have equal symbols, boundaries and contexts but at their ends.

Round 1.  Every window has an anchor: of the boundaries of the highest level whose context it holds, the one with the least name,
so equal windows have equal anchors, and neighbouring windows mostly share theirs.  An anchor is dealt out by the name of its
context, together with the name of its block, the words of all of its windows.  Owners of names see where a context occurs:
  - in one place: nothing in its windows is repeated;
  - always with the same block: all windows of all places but the first are repeats, however long the repeat is;
  - with different blocks (where repeats begin and end): its windows go to round 2.
Round 2.  These windows are named themselves, and all places of a window but its first are repeats.
Names that are compared have 100 bits or more beside the bucket.  Tasks deal each (context, block) and each window once, the
first place that they have, so a passage that a third of all rows hold comes to its owner once a task; contexts with many
blocks in a task need no owner to tell that they are repeated.  Texts are moved twice at most: all of them to what round 1
tells of them, and those with windows in doubt to what round 2 tells.

First is the place with the smallest id (nulls last), then the earlier row, then the earlier word.  A null text counts as
empty; texts of fewer than `width` words have no window.  Very long texts are read whole, runs of one word included (their
windows have no boundary; the word is the anchor).  Repeated rows are copies: the first stays whole.  An empty table gives an
empty table.  Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.llm.common import numbered, save, slices, text_or_empty

LEVELS = 3
#: Further than any word: a boundary that depends on where a text begins or ends is in no window.
FAR = 1 << 40
#: Entries that a task holds before it deals them out, and blocks of one context that it deals out.
MOST, BLOCKS = 1_500_000, 8
#: Entries in a row of what a task knows by itself.
KNOWN = 2048
#: Bytes of each of the two names that are dealt out.
BYTES = 6
ALIVE, REPEAT = 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _named(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return _stir(a * _ODD + _stir(b + np.uint64(salt)))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse."""
    base, inverse = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (base, inverse))


class Content:
    """Names of any stretch of words: the words' hashes as digits of a number."""

    def __init__(self, lane: np.ndarray):
        up, self.down = _powers(1 << max(16, len(lane).bit_length()))
        self.sums = np.r_[np.uint64(0), np.cumsum(lane * up[: len(lane)], dtype=np.uint64)]

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _stir((self.sums[hi] - self.sums[lo]) * self.down[lo])


def compressed(name: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, end: int, round_: int) -> tuple:
    """One round.  Symbols: their names, first words, the words [lo, hi) on which the boundary at their start depends, and which are a text's first.

    end: hi of the boundary behind the last symbol.  Nothing depends on the words outside a text at first; later, its ends are in no window.
    """
    same = np.r_[False, name[1:] == name[:-1]] & ~first
    right = (name >> np.uint64(7 + round_)) & np.uint64(1) == 1
    pair = np.r_[False, right[1:] & ~right[:-1]] & ~first & ~same
    runs = np.flatnonzero(~same)
    size = np.diff(np.r_[runs, len(name)])
    run = np.where(size > 1, _named(name[runs], size.astype(np.uint64), 1), name[runs])
    two = pair[runs]
    groups = np.flatnonzero(~two)
    joined = np.r_[two[1:], False][groups]
    after = np.r_[run[1:], np.uint64(0)][groups]
    kept = runs[groups]
    new_lo, new_hi = np.r_[-FAR, lo[:-1]], np.r_[hi[1:], end]
    new_lo[first], new_hi[first] = -FAR, FAR
    return np.where(joined, _named(run[groups], after, 2), run[groups]), at[kept], new_lo[kept], new_hi[kept], first[kept], FAR


class Anchors:
    """The windows of some texts and their anchors.

    windows: first words, in order; of: each window's anchor; doc and nth of each anchor: its text and its number there;
    context and block: the names that are dealt out.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray, width: int, levels: int = LEVELS):
        """a, b: two hashes of each word; starts: where each text starts, and where the last one ends."""
        n = len(a)
        sizes = np.diff(starts)
        room = np.repeat(starts[1:], sizes) - np.arange(n)
        self.windows = np.flatnonzero(room >= width)
        own = Content(a)
        places = np.arange(n)
        edge = np.zeros(n, bool)
        edge[starts[:-1][sizes > 0]] = True
        symbols = (a, places, places, places, edge, n)
        found = []
        for r in range(levels if n else 0):
            symbols = compressed(*symbols, r)
            _, at, lo, hi, *_ = symbols
            seen = (lo >= 0) & (hi - lo <= width)
            found.append((at[seen], lo[seen], hi[seen]))
        code, context = np.full(len(self.windows), -1, np.int64), np.zeros(len(self.windows), np.uint64)
        todo = np.arange(len(self.windows))
        for level, (at, lo, hi) in reversed(list(enumerate(found, 1))):
            if not len(at) or not len(todo):
                continue
            name = own(lo, hi)
            p = self.windows[todo]
            low = np.r_[0, np.cumsum(np.bincount(lo, minlength=n + 1))][p]
            high = np.cumsum(np.bincount(hi, minlength=n + 1))[p + width]
            some = high > low
            best = _least(name, low[some], high[some])
            code[todo[some]], context[todo[some]] = at[best] * 8 + level, name[best]
            todo = todo[~some]
        code[todo], context[todo] = self.windows[todo] * 8, _stir(a[self.windows[todo]] + _ODD)  # one word throughout
        order = np.argsort(code, kind="stable")
        new = np.flatnonzero(np.diff(code[order], prepend=-1))
        count = np.diff(np.r_[new, len(order)])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(new)), count)
        first, last = self.windows[order[new]], self.windows[order[new + count - 1]] if len(new) else self.windows[:0]
        self.context = context[order[new]]
        self.block = _named(Content(b)(first, last + width), (code[order[new]] // 8 - first).astype(np.uint64), 3)
        self.doc = np.searchsorted(starts, first, "right") - 1
        self.base = np.searchsorted(self.doc, np.arange(len(sizes)))
        self.nth = np.arange(len(new)) - self.base[self.doc]


def _least(name: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the least name of each range [low, high) is, the first of equal ones."""
    bits = max(1, len(name).bit_length())
    key = (name >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(name), dtype=np.uint64)
    tables, reach = [key], 1
    size = high - low
    while reach * 2 <= size.max(initial=1):
        t = tables[-1]
        tables.append(np.r_[np.minimum(t[:-reach], t[reach:]), t[-reach:]] if len(t) > reach else t)
        reach *= 2
    power = np.log2(np.arange(1, size.max(initial=1) + 1)).astype(np.int64)[size - 1]
    best = np.empty(len(low), np.uint64)
    for k, t in enumerate(tables):
        own = power == k
        best[own] = np.minimum(t[low[own]], t[high[own] - (1 << k)])
    return (best & np.uint64((1 << bits) - 1)).astype(np.int64)


class Slice:
    """Words of some texts: the words, two hashes of each, and where each text starts."""

    def __init__(self, texts: list[bytes]):
        import xxhash

        self.words = [t.split() for t in texts]
        self.starts = np.r_[0, np.cumsum([len(w) for w in self.words], dtype=np.int64)]
        hashes = np.frombuffer(b"".join([b"".join(map(xxhash.xxh3_128_digest, w)) for w in self.words]), "<u8").reshape(-1, 2)
        self.a, self.b = (np.ascontiguousarray(hashes[:, i]) for i in range(2))

    def anchors(self, width: int) -> Anchors:
        return Anchors(self.a, self.b, self.starts, width)


# What is dealt out, and what its owners tell


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 as bytes, as few a number as the largest needs; the first byte tells how many."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) < 1 << 8 * np.dtype(k).itemsize)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _cut(name: np.ndarray) -> bytes:
    return np.ascontiguousarray(name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()


def _uncut(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(x, np.uint8).reshape(-1, BYTES)
    return out.reshape(-1).view("<u8")


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs in any column from the one before; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _batch(schema: pa.Schema, n: int, values: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in schema], schema=schema)


def _told(schema: pa.Schema, num: np.ndarray, at: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    return _batch(schema, len(num), {"num": num, "mark": at * 4 + state})


class Lot:
    """Entries (two names, a text and a place in it) that a task gathers and deals out to buckets."""

    def __init__(self, buckets: int, dealt: pa.Schema):
        self.buckets, self.dealt = buckets, dealt
        self.clear()

    def clear(self) -> None:
        self.parts, self.ords, self.nums, self.held = [], [], [], 0

    def add(self, x: np.ndarray, y: np.ndarray, doc: np.ndarray, at: np.ndarray, ords: np.ndarray, nums: np.ndarray) -> Iterator[pa.RecordBatch]:
        """doc: the text's place in ords and nums, which tell its order among all texts."""
        self.parts.append((x, y, doc + sum(map(len, self.nums)), at))
        self.ords.append(ords)
        self.nums.append(nums)
        self.held += len(x)
        if self.held >= MOST:
            yield from self.deal()

    def deal(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        x, y, doc, at = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        ords, nums = np.concatenate(self.ords), np.concatenate(self.nums)
        self.clear()
        rank = np.empty(len(nums), np.int64)
        rank[np.lexsort((nums, ords))] = np.arange(len(nums))
        order = np.lexsort((at, rank[doc], y, x))
        x, y, doc, at = x[order], y[order], doc[order], at[order]
        once = _new(x, y)
        copies = np.flatnonzero(~once)
        kept = np.flatnonzero(once)
        x, y = x[kept], y[kept]
        head = np.flatnonzero(_new(x))
        among = np.arange(len(x)) - np.repeat(head, np.diff(np.r_[head, len(x)]))
        many = kept[among >= BLOCKS]
        alone, state = np.r_[copies, many], np.r_[np.full(len(copies), REPEAT), np.full(len(many), ALIVE)]
        owner = ((x >> np.uint64(8 * BYTES)) ^ (x * _ODD >> np.uint64(40))).astype(np.int64) % self.buckets
        spread = np.random.default_rng(int(nums[0]) % (1 << 32)).integers(0, self.buckets)
        for k, i in enumerate(range(0, len(alone), KNOWN)):  # what the task knows by itself goes on to where all is gathered
            own = alone[i : i + KNOWN]
            yield _batch(self.dealt, 1, {"bucket": [int(spread + k) % self.buckets], "nums": [nums[doc[own]].astype("<i8").tobytes()], "ats": [_narrow(at[own] * 4 + state[i : i + KNOWN])]})
        few = np.flatnonzero(among < BLOCKS)
        doc, at, x, y, owner = doc[kept[few]], at[kept[few]], x[few], y[few], owner[few]
        order = np.lexsort((at, doc, owner))
        doc, at, x, y, owner = (c[order] for c in (doc, at, x, y, owner))
        cuts = np.flatnonzero(_new(owner))
        out = {"bucket": owner[cuts].tolist(), "x": [], "y": [], "ords": [], "nums": [], "ats": [], "base": []}
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)], strict=True):
            o, n = ords[doc[i:j]], nums[doc[i:j]]
            out["base"].append([int(o.min()), int(n.min())])
            for name, value in (("x", _cut(x[i:j])), ("y", _cut(y[i:j])), ("ords", _narrow(o - o.min())), ("nums", _narrow(n - n.min())), ("ats", _narrow(at[i:j]))):
                out[name].append(value)
        for i in range(0, len(cuts), 4096):
            part = {k: v[i : i + 4096] for k, v in out.items()}
            yield _batch(self.dealt, len(part["bucket"]), part)


def _owners(schema: pa.Schema):
    """What is known of each place: (num, mark), mark = 4 * place + ALIVE or REPEAT; rows come sorted by bucket, others pass."""

    def decided(held: list[dict]) -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate([_uncut(r[k]) for r in held]) for k in "xy")
        ords, nums = (np.concatenate([_wide(r[k]) + r["base"][i] for r in held]) for i, k in enumerate(("ords", "nums")))
        at = np.concatenate([_wide(r["ats"]) for r in held])
        order = np.lexsort((at, nums, ords, y, x))
        x, y, nums, at = x[order], y[order], nums[order], at[order]
        new, group = _new(x, y), np.cumsum(_new(x)) - 1
        blocks = np.bincount(group, new)[group]
        state = np.where(~new, REPEAT, np.where(blocks > 1, ALIVE, 0))
        known = np.flatnonzero(state)
        if len(known):
            yield _told(schema, nums[known], at[known], state[known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for part in batch.to_pylist():
                if part["x"] is not None:
                    if part["bucket"] != bucket and held:
                        yield from decided(held)
                        held = []
                    bucket = part["bucket"]
                    held.append(part)
                elif part["nums"] is not None:
                    mark = _wide(part["ats"])
                    yield _batch(schema, len(mark), {"num": np.frombuffer(part["nums"], "<i8"), "mark": mark})
                else:
                    yield _batch(schema, len(part["docs"]), {"num": [d["num"] for d in part["docs"]], "doc": part["docs"]})
        if held:
            yield from decided(held)

    return run


# The rounds


def _schemas(id_type: T.DataType) -> tuple[T.StructType, T.StructType]:
    long, binary = T.LongType(), T.BinaryType()
    doc = T.StructType([T.StructField("num", long), T.StructField("row", T.StringType()), T.StructField("id", id_type), T.StructField("ord", long), T.StructField("n_words", long), T.StructField("sha256", T.StringType())])
    dealt = [T.StructField("bucket", T.IntegerType()), *(T.StructField(c, binary) for c in ("x", "y", "ords", "nums", "ats")), T.StructField("base", T.ArrayType(long)), T.StructField("docs", T.ArrayType(doc))]
    return T.StructType(dealt), T.StructType([T.StructField("num", long), T.StructField("mark", long), T.StructField("doc", doc)])


def _first_round(width: int, buckets: int, dealt: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = Lot(buckets, dealt)
        for part in slices(batches, "text"):
            own = Slice(part.column("text").to_pylist())
            heads = [{"num": n, "row": r, "id": i, "ord": o, "n_words": len(w), "sha256": hashlib.sha256(b" ".join(w)).hexdigest()} for n, r, i, o, w in zip(*(part.column(c).to_pylist() for c in ("num", "row", "id", "ord")), own.words, strict=True)]
            if heads:
                yield _batch(dealt, 1, {"bucket": [heads[0]["num"] % buckets], "docs": [heads]})
            found = own.anchors(width)
            yield from lot.add(found.context, found.block, found.doc, found.nth, part.column("ord").to_numpy(), part.column("num").to_numpy())
        yield from lot.deal()

    return run


def _states(found: Anchors, marks: list[list[int]]) -> np.ndarray:
    """What round 1 tells of each window."""
    state = np.zeros(len(found.doc), np.int64)
    for k, own in enumerate(marks):
        m = np.array(own, np.int64)
        np.maximum.at(state, found.base[k] + m // 4, m % 4)
    return state[found.of]


def _second_round(width: int, buckets: int, dealt: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = Lot(buckets, dealt)
        for part in slices(batches, "text"):
            own = Slice(part.column("text").to_pylist())
            found = own.anchors(width)
            p = found.windows[_states(found, part.column("marks").to_pylist()) == ALIVE]
            doc = np.searchsorted(own.starts, p, "right") - 1
            yield from lot.add(Content(own.a)(p, p + width), Content(own.b)(p, p + width), doc, p - own.starts[doc], part.column("ord").to_numpy(), part.column("num").to_numpy())
        yield from lot.deal()

    return run


def _results(width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own = Slice(part.column("text").to_pylist())
            found = own.anchors(width)
            p = found.windows[_states(found, part.column("marks").to_pylist()) == REPEAT]
            more = [own.starts[k] + m // 4 for k, m in enumerate(np.array(x or [], np.int64) for x in part.column("more").to_pylist())]
            p = np.concatenate([p, *more])
            n = own.starts[-1]
            gone = np.cumsum(np.bincount(p, minlength=n + 1) - np.bincount(p + width, minlength=n + 1))[:n] > 0
            out = {"id": part.column("id"), "n_words": [len(w) for w in own.words], "spans": [], "sha256": []}
            for k, w in enumerate(own.words):
                mine = gone[own.starts[k] : own.starts[k + 1]]
                turns = np.flatnonzero(np.diff(np.r_[False, mine, False])).reshape(-1, 2).tolist()
                out["spans"].append([{"start": i, "stop": j} for i, j in turns])
                out["sha256"].append(hashlib.sha256(b" ".join(compress(w, (~mine).tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([out["id"], *(pa.array(out[f.name], f.type) for f in list(schema)[1:])], schema=schema)

    return run


def _met(dealt: DataFrame, told: T.StructType) -> DataFrame:
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_owners(to_arrow_schema(told)), told)


def _ordered(docs: DataFrame, id_type: T.DataType) -> DataFrame:
    """docs (row, id, text) and ord: a whole number in the order of ids, nulls last."""
    if isinstance(id_type, T.IntegralType):
        return docs.withColumn("ord", F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1)))
    ids = docs.select("id").filter("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
    told = save(ids.withColumn("ord", F.monotonically_increasing_id()), "order")  # ranges and rows in them are in the order of ids
    return docs.join(told, "id", "left").withColumn("ord", F.coalesce("ord", F.lit((1 << 63) - 1)))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """(id_col, n_words long, spans, sha256) for every row.

    spans: the ranges of words, array<struct<start:long,stop:long>>, that are repeats of an earlier place; sha256: of the words
    that are left, joined by one blank, in UTF-8 (lowercase hex).
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    held, row = numbered(docs)
    texts = held.select(F.col(row).alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    dealt, told = _schemas(id_type)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = _ordered(texts, id_type).select(F.monotonically_increasing_id().alias("num"), "row", "id", "ord", F.encode("text", "utf-8").alias("text"))
    known = save(_met(base.mapInArrow(_first_round(width, buckets, to_arrow_schema(dealt)), dealt), told), "contexts")

    heads = known.filter("doc is not null").select("doc.*")
    marks = known.filter("doc is null").groupBy("num").agg(F.collect_list("mark").alias("marks"))
    heads = save(heads.join(marks, "num", "left"), "marks")
    doubt = texts.select("row", F.encode("text", "utf-8").alias("text")).join(heads.filter("marks is not null").select("num", "row", "id", "ord", "marks"), "row")
    doubt = save(doubt.drop("row"), "doubt")
    again = doubt.filter(F.exists("marks", lambda m: m % 4 == ALIVE)).select("num", "ord", "marks", "text")
    windows = save(_met(again.mapInArrow(_second_round(width, buckets, to_arrow_schema(dealt)), dealt), told).filter(F.col("mark") % 4 == REPEAT).select("num", "mark"), "windows")

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    out = T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("sha256", T.StringType())])
    more = windows.groupBy("num").agg(F.collect_list("mark").alias("more"))
    cut = doubt.join(more, "num", "left").select("id", "marks", "more", "text").mapInArrow(_results(width, to_arrow_schema(out)), out)
    whole = heads.filter("marks is null").select("id", "n_words", F.array().cast(T.ArrayType(span)).alias("spans"), "sha256")
    return whole.unionByName(cut).withColumnRenamed("id", id_col)


def kept_words(text, spans):
    """The words of a text without those in spans, joined by one blank (a column)."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.array_join(F.filter(words, lambda _, i: ~F.exists(spans, lambda s: (s["start"] <= i) & (i < s["stop"]))), " ")

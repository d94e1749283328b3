"""SimHash near-duplicates: fingerprints, a binary trie self-join under a Hamming budget, and components.

The trie join looks for pairs of fingerprints that differ in at most `budget` bits.  It walks pairs of trie nodes together,
adds up the bits in which their paths differ and drops a pair of nodes as soon as the sum exceeds the budget.  To spread the
walk, the bits are cut into budget + 1 blocks: two fingerprints within the budget agree in one block at least.  For each
block the fingerprints are turned so that this block comes first; every node at that depth is then paired with itself alone,
and the subtrees below are walked independently.  Pairs of subtrees with more than `heavy` fingerprints are split by the next
eight bits into pairs of smaller subtrees, with the bits in which the two differ counted so far, again and again until none
is heavy, so that no task gets all of a crowded part of the trie.  Tasks read subtrees in order, a bounded number of rows at a time.

near_duplicates() links fingerprints of 64 bits.  similar_groups() finds documents by the Jaccard similarity of their word
shingles: fingerprints of word pairs, 32 bits in each of several tables, are joined in every table; what meets is narrowed
by all bits together and then confirmed on the shingle sets themselves.  similar_groups(whole=True) then finds the similar pairs
that no table has: sets so similar share one of their first shingles in whatever order all sets are held, so documents meet at
these, with frequent shingles ordered last, and only documents of different groups are compared.  Where they meet, sets too far
apart are told by their parities: of the shingles whose hashes end alike, whether a set has an odd number.  Each shingle that only
one of two sets has changes one parity, so as many shingles at least are not shared as parities differ.

Components: links are contracted by rounds of large-star and small-star with a checkpoint after each, in Spark throughout.

Nulls and empty texts have fingerprint zero and are linked like any other; fewer words than a shingle give one shingle.  Very
long texts are read whole.  Ties: the smallest id names a component, a null id only one that has no other.  Repeated rows each
give a row (similar_groups needs ids of their own).  An empty table gives an empty table.  Only the id and text columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import save, slices, text_or_empty

SEED = 42
BITS = 64
#: Bits by which a heavy pair of subtrees is split at a time.
SPLIT = 8
#: Edge-disjoint spanning forests of what meets in a lot that are compared: all pairs of a few documents, a few pairs a document of many.
FORESTS = 4
#: The most frequent shingles that are ordered last, at most; they are sent to the tasks.
FREQUENT = 50_000
#: Bits of a set's parities; sets of up to twice as many shingles can be told apart by them.
PARITIES = 1024
PAIR = ["table", "turn", "deep", "a", "b", "piece"]


def _hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, repeats included, A-Z lower-cased."""
    import xxhash

    own = text.lower().split()
    if not own:
        return np.zeros(0, "<u8")
    shingles = [b" ".join(x) for x in zip(*(own[i:] for i in range(words)), strict=False)] or [b" ".join(own)]
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), "<u8", len(shingles))


def _majority(h: np.ndarray) -> np.ndarray:
    """The bits that more than half of the hashes have set, as one number."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0]


def _stirred(h: np.ndarray, lane: int) -> np.ndarray:
    """Other hashes made of the hashes, for a further 64 bits of a fingerprint: multiply, fold, multiply."""
    odd = np.uint64(2 * int.from_bytes(f"lane{lane:04d}".encode(), "big") + 1)
    x = (h ^ (h >> np.uint64(32))) * odd
    return (x ^ (x >> np.uint64(29))) * odd


def fingerprint_of(text: bytes, words: int, lanes: int = 1) -> list[int]:
    """The SimHash of a UTF-8 text over word shingles, 64 bits a lane; the first lane is made of the hashes themselves."""
    h = _hashes(text, words)
    return [int(_majority(_stirred(h, k) if k else h)) for k in range(lanes)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1) -> DataFrame:
    """(id_col, fp0 long, ... one for each lane: 64 bits as a signed number) for every row."""
    names = [f"fp{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = np.array([fingerprint_of(x, words, lanes) for x in part.column("text").to_pylist()], "<u8").reshape(-1, lanes).view("<i8")
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(lanes))], ["id", *names])

    base = docs.select(F.col(id_col).alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names)])
    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)


# The walk over pairs of trie nodes, in one task


def walk(a: np.ndarray, pairs: np.ndarray, budget: int, width: int = BITS, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk pairs of trie nodes over a, whose ranges hold sorted, different numbers; gives index arrays (i, j) of pairs within the budget.

    pairs: columns lo1, hi1, lo2, hi2, differing bits, depth; a node is a range of a.  A pair of a node with itself has
    lo1 == lo2.  Pairs are handled in lots of `most`, the deepest lot first, so memory stays bounded.
    """
    todo = [pairs]
    while todo:
        p = todo.pop()
        if len(p) > most:
            todo += [p[:most], p[most:]]
            p = todo.pop(-2)
        if not len(p):
            continue
        one = (p[:, 1] - p[:, 0] == 1) & (p[:, 3] - p[:, 2] == 1)
        leaf = p[one]
        if len(leaf):
            leaf = leaf[leaf[:, 0] != leaf[:, 2]]
            near = np.bitwise_count(a[leaf[:, 0]] ^ a[leaf[:, 2]]) <= budget
            yield leaf[near, 0], leaf[near, 2]
        p = p[~one]
        if not len(p):
            continue
        shift = (width - 1 - p[:, 5]).astype(np.uint64)
        mid1, mid2 = (_middle(a, p[:, i], p[:, i + 1], shift) for i in (0, 2))
        self_ = p[:, 0] == p[:, 2]
        made = []
        for left1, left2 in ((1, 1), (0, 0), (1, 0), (0, 1)):
            take = ~self_ if (left1, left2) == (0, 1) else np.ones(len(p), bool)  # a node with itself has one mixed pair of children
            q = p.copy()
            q[:, 0], q[:, 1] = (p[:, 0], mid1) if left1 else (mid1, p[:, 1])
            q[:, 2], q[:, 3] = (p[:, 2], mid2) if left2 else (mid2, p[:, 3])
            q[:, 4] += left1 != left2
            q[:, 5] += 1
            take &= (q[:, 1] > q[:, 0]) & (q[:, 3] > q[:, 2]) & (q[:, 4] <= budget)
            take &= ~((q[:, 0] == q[:, 2]) & (q[:, 1] - q[:, 0] == 1))
            made.append(q[take])
        todo.append(np.concatenate(made))


def _middle(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """For each range of a, whose numbers agree above bit `shift`: the first place at which that bit is set."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        set_ = ((a[np.minimum(mid, len(a) - 1)] >> shift) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)
    return lo


def _lots(batches: Iterator[pa.RecordBatch], most: int = 60_000, key: list[str] = PAIR) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by key, about `most` rows at a time, cut where one key (a pair of subtrees) ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < most:
            continue
        lot = pa.Table.from_batches(held).combine_chunks()
        new = _changes([lot.column(c).to_numpy() for c in key])
        if new[-1]:
            yield {c: lot.column(c).to_numpy()[: new[-1]] for c in lot.column_names}
        held = lot.slice(new[-1]).to_batches()
    if held:
        lot = pa.Table.from_batches(held)
        yield {c: lot.column(c).to_numpy() for c in lot.column_names}


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before; the first row does."""
    return np.flatnonzero(np.r_[True, reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))])


def _joined(lot: dict[str, np.ndarray], budget: int, width: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Rows of a lot in order, where in that order each different number of a side of a pair starts, and pairs of these numbers within the budget."""
    pair = np.zeros(len(lot["a"]), np.int64)
    pair[_changes([lot[c] for c in PAIR])[1:]] = 1
    pair = np.cumsum(pair)
    order = np.lexsort((lot["turned"].view(np.uint64), lot["side"], pair))
    pair, side, a = pair[order], lot["side"][order], lot["turned"].view(np.uint64)[order]
    first = _changes([pair, side, a])
    pair, side, a = pair[first], side[first], a[first]
    diff, deep = lot["diff"][order][first], lot["deep"][order][first]
    cut = _changes([pair, side])
    nodes = np.stack([cut, np.r_[cut[1:], len(a)]], 1)
    two = np.flatnonzero(pair[cut][1:] == pair[cut][:-1])  # the second side follows its first
    alone = np.ones(len(cut), bool)
    alone[two] = alone[two + 1] = False
    alone &= (diff[cut] == 0) & (nodes[:, 1] - nodes[:, 0] > 1)
    own, cross = (np.column_stack([nodes[x], nodes[y], diff[cut][x], deep[cut][x]]) for x, y in ((alone, alone), (two, two + 1)))
    return order, first, walk(a, np.concatenate([own, cross]).astype(np.int64), budget, width)


# Subtrees for the tasks


def _widths(budget: int, width: int) -> tuple[list[int], list[int]]:
    n = budget + 1
    offsets = [width * t // n for t in range(n)]
    return offsets, [(offsets[1:] + [width])[t] - offsets[t] for t in range(n)]


def _turned(value: Column, offset: int, width: int) -> Column:
    """A number of `width` bits turned to the left."""
    if offset == 0:
        return value
    both = F.shiftleft(value, offset).bitwiseOR(F.shiftrightunsigned(value, width - offset))
    return both if width == BITS else both.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _split(rows: DataFrame, budget: int, width: int) -> DataFrame:
    """Each row in all pairs of the smaller subtrees, `SPLIT` bits below, that its own one forms within the budget."""
    flips = F.array(*(F.lit(sum(1 << b for b in c)).cast("long") for k in range(budget + 1) for c in combinations(range(SPLIT), k)))
    rows = rows.withColumn("more", F.least(F.lit(SPLIT), F.lit(width) - F.col("deep")).cast("int"))
    rows = rows.withColumn("own", F.expr(f"shiftrightunsigned(turned, {width} - deep - more) & (shiftleft(1L, more) - 1)"))
    rows = rows.withColumn("flip", F.explode(F.filter(flips, lambda f: (f < F.expr("shiftleft(1L, more)")) & (F.bit_count(f) + F.col("diff") <= budget))))
    below = lambda node, bits: F.call_function("shiftleft", F.col(node), F.col("more")).bitwiseOR(bits)
    own, other, self_ = F.col("own"), F.col("own").bitwiseXOR(F.col("flip")), F.col("a") == F.col("b")
    second = F.when(self_, own > other).otherwise(F.col("side") == 1)
    made = {
        "a": below("a", F.when(second, other).otherwise(own)), "b": below("b", F.when(second, own).otherwise(other)), "side": second.cast("int"),
        "diff": (F.col("diff") + F.bit_count("flip")).cast("int"), "deep": (F.col("deep") + F.col("more")).cast("int"),
    }
    return rows.withColumns(made).drop("more", "own", "flip")


def _subtrees(values: DataFrame, budget: int, width: int, heavy: int, every: bool = False) -> DataFrame:
    """Rows of values (table, value, ...) in every pair of subtrees to be walked, dealt by pair and sorted; value becomes turned.

    every: all documents of a crowded leaf are to meet, not only the first of it and each other one.
    """
    offsets, widths = _widths(budget, width)
    turns = F.explode(F.array(*(F.struct(F.lit(t).alias("turn"), F.lit(widths[t]).alias("deep"), _turned(F.col("value"), offsets[t], width).alias("turned")) for t in range(budget + 1))))
    rows = values.withColumn("t", turns).select(*(c for c in values.columns if c != "value"), "t.*").withColumn("a", F.expr(f"shiftrightunsigned(turned, {width} - deep)"))
    rows = rows.withColumns({"b": F.col("a"), "side": F.lit(0), "diff": F.lit(0), "piece": F.lit(0)})
    node = F.col("node") if "node" in values.columns else F.lit(None).cast("long")  # without nodes numbers are different, and leaves small
    first = [F.min(F.when(F.col("side") == i, node)).alias(f"first{i}") for i in range(2)]
    ready, now = [], rows
    while True:
        sizes = now.groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum("side").alias("n1"), *first).filter("if(a = b, n > 1, n1 > 0 and n1 < n)")
        sizes = save(sizes.withColumn("kind", F.when(F.col("n") <= heavy, "light").when(F.col("deep") < width, "heavy").otherwise("leaf")), "sizes")
        kinds = {r["kind"] for r in sizes.select("kind").distinct().collect()}
        ready.append(now.join(sizes.filter("kind = 'light'").select(*PAIR), PAIR, "left_semi"))
        if "leaf" in kinds:
            ready.append(_pieces(now.join(sizes.filter("kind = 'leaf'").select(*PAIR, "n", "first0", "first1"), PAIR), heavy, every).select(now.columns))
        if "heavy" not in kinds:
            break
        now = save(_split(now.join(sizes.filter("kind = 'heavy'").select(*PAIR), PAIR, "left_semi"), budget, width), "subtrees")
    return reduce(DataFrame.unionByName, ready).repartition(*PAIR).sortWithinPartitions(*PAIR)


def _pieces(rows: DataFrame, heavy: int, every: bool) -> DataFrame:
    """Rows of leaves with too many documents: a leaf on its own in pieces that share its first document, of a pair of leaves the first document of each.

    every: in pairs of pieces, so that any two documents are together in one.
    """
    pieces = F.ceil(F.col("n") / heavy).cast("int")
    own, all_ = F.pmod(F.xxhash64("node"), pieces).cast("int"), F.sequence(F.lit(0), pieces - 1)
    if every:
        pair = lambda k: F.when(F.col("a") == F.col("b"), F.least(own, k) * pieces + F.greatest(own, k)).when(F.col("side") == 0, own * pieces + k).otherwise(k * pieces + own)
        return rows.withColumn("piece", F.explode(F.transform(all_, pair)))
    alone = rows.filter("a = b").withColumn("piece", F.explode(F.when(F.col("node") == F.col("first0"), all_).otherwise(F.array(own))))
    return alone.unionByName(rows.filter("a <> b and node = if(side = 0, first0, first1)"))


def links(distinct: DataFrame, budget: int = 2, heavy: int = 50_000) -> DataFrame:
    """(a, b) with a < b for all pairs of the distinct fingerprints in column fp that differ in at most `budget` bits."""
    offsets, _ = _widths(budget, BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            order, _, found = _joined(lot, budget, BITS)  # numbers of a side are different: each is one row
            turned, turn = lot["turned"].view(np.uint64)[order], lot["turn"][order]
            back = np.array(offsets)[turn].astype(np.uint64)
            fp = np.where(back == 0, turned, (turned >> back) | (turned << ((np.uint64(BITS) - back) % np.uint64(BITS)))).view(np.int64)
            for i, j in found:
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[i], fp[j])), pa.array(np.maximum(fp[i], fp[j]))], ["a", "b"])

    values = distinct.select(F.lit(0).alias("table"), F.col("fp").alias("value"))
    return _subtrees(values, budget, BITS, heavy).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable for each node of the edges (a, b).

    Rounds of large-star (every larger neighbour is linked to the smallest) and small-star (every smaller neighbour, and the
    node, is linked to the smallest) until nothing changes.  Each round's edges are checkpointed to the shared folder.
    """
    now = save(edges.select("a", "b"), "edges")
    total = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = save(small.filter("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == total:
            break
        total = tuple(seen)
    nodes = now.groupBy("a").agg(F.min("b").alias("b"))
    return nodes.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """(id_col, fp long, component_id, n_links long) for every row.

    component_id: the smallest id reachable over links; n_links: of the row's fingerprint with other fingerprints.
    """
    held = save(fingerprints(docs, id_col, text_col, words).select(F.col(id_col).alias("id"), F.col("fp0").alias("fp")), "fingerprints")
    classes = save(held.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    edges = save(links(classes.select("fp"), budget), "links")
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    rooted = classes.join(roots, classes.fp == roots.node, "left").drop("node").join(degree, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = save(rooted.join(names, "root").select("fp", "component_id", "n_links"), "classes")
    return held.join(by_class, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "n_links")


# Similarity of shingle sets


def set_of(text: bytes, words: int) -> np.ndarray:
    """The sorted hashes of a UTF-8 text's distinct word shingles; a text without words has one, of nothing."""
    h = _hashes(text, words)
    return np.unique(h if len(h) else np.zeros(1, "<u8")).view("<i8")


def forest(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which of the edges (x, y) make a spanning forest of least cost."""
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b, top, taken = at[: len(x)].tolist(), at[len(x) :].tolist(), list(range(len(names))), []
    for e in np.argsort(cost, kind="stable").tolist():
        i, j = a[e], b[e]
        while top[i] != i:
            top[i] = i = top[top[i]]
        while top[j] != j:
            top[j] = j = top[top[j]]
        if i != j:
            top[j] = i
            taken.append(e)
    return np.array(taken, np.int64)


def _distance(full: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(full[i] ^ full[j]).sum(axis=1, dtype=np.int64)


def _classes(full: np.ndarray, ends: np.ndarray, spread: int) -> tuple[list[np.ndarray], list[tuple]]:
    """Rows [ends[k], ends[k + 1]) have one number in a table: those that no earlier one of them is near, and edges from these to the others."""
    stand, edges = [], []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        left, own = np.arange(lo, hi), []
        while len(left):
            own.append(left[0])
            d = _distance(full, left[:1], left)
            near = d <= spread
            edges.append((np.full(near.sum() - 1, left[0]), left[near][1:], d[near][1:]))
            left = left[~near]
        stand.append(np.array(own))
    return stand, edges


def _candidates(lanes: int, budget: int, width: int, spread: int) -> Callable:
    """Pairs of documents (a, b): FORESTS tightest spanning forests of those in a lot that meet and differ in `spread` bits of all at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            order, first, found = _joined(lot, budget, width)
            node = lot["node"][order]
            full = np.stack([lot[f"fp{k}"][order].view(np.uint64) for k in range(lanes)], 1)
            ends = np.r_[first, len(order)]
            many = np.flatnonzero(np.diff(ends) > 1)
            stand, edges = {}, []
            if len(many):
                runs = np.stack([ends[many], ends[many + 1]], 1)
                for k, (lo, hi) in zip(many.tolist(), runs.tolist(), strict=True):
                    (stand[k],), more = _classes(full, np.array([lo, hi]), spread)
                    edges += more
            crowded = np.zeros(len(first), bool)
            crowded[[k for k, s in stand.items() if len(s) > 1]] = True
            for i, j in found:
                plain = ~(crowded[i] | crowded[j])
                pairs = [(first[i[plain]], first[j[plain]])]
                for p, q in zip(i[~plain].tolist(), j[~plain].tolist(), strict=True):
                    s, t = stand.get(p, first[p : p + 1]), stand.get(q, first[q : q + 1])
                    pairs.append((np.repeat(s, len(t)), np.tile(t, len(s))))
                x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
                d = _distance(full, x, y)
                edges.append((x[d <= spread], y[d <= spread], d[d <= spread]))
                if sum(len(e[0]) for e in edges) > 500_000:
                    edges = [_tight(edges, node)]
            if edges:
                x, y, _ = _tight(edges, node)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], ["a", "b"])

    return run


def _remaining(lanes: int, budget: int, width: int, spread: int) -> Callable:
    """Pairs of documents (a, b) that meet, differ in `spread` bits of all at most and are in different components (column root) so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            order, first, found = _joined(lot, budget, width)
            node, root = lot["node"][order], lot["root"][order]
            full = np.stack([lot[f"fp{k}"][order].view(np.uint64) for k in range(lanes)], 1)
            ends = np.r_[first[1:], len(order)]

            def kept(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
                apart = root[x] != root[y]  # noqa: B023
                x, y = x[apart], y[apart]
                near = _distance(full, x, y) <= spread  # noqa: B023
                a, b = node[x[near]], node[y[near]]  # noqa: B023
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

            for k in np.flatnonzero(ends - first > 1).tolist():
                for x in range(first[k], ends[k] - 1):
                    yield from kept(np.full(ends[k] - x - 1, x), np.arange(x + 1, ends[k]))
            for i, j in found:
                one = (ends[i] - first[i] == 1) & (ends[j] - first[j] == 1)
                yield from kept(first[i[one]], first[j[one]])
                for p, q in zip(i[~one].tolist(), j[~one].tolist(), strict=True):
                    other = np.arange(first[q], ends[q])
                    for x in range(first[p], ends[p]):
                        yield from kept(np.full(len(other), x), other)

    return run


def _tight(edges: list[tuple], node: np.ndarray, forests: int = FORESTS) -> tuple:
    """The edges of a tightest spanning forest, of another one of the edges left, and so on; each pair of documents once."""
    x, y, d = (np.concatenate(c) for c in zip(*edges, strict=True))
    _, once = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]), axis=1, return_index=True)
    left, kept = once, []
    for _ in range(forests):
        own = forest(node[x[left]], node[y[left]], d[left])
        kept.append(left[own])
        left = np.delete(left, own)
    keep = np.concatenate(kept)
    return x[keep], y[keep], d[keep]


def _sets(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(node, own): the shingle set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [set_of(x, words) for x in part.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype("i4")
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "own"])

    return docs.select("node", F.encode(text_or_empty(text_col), "utf-8").alias("text")).mapInArrow(run, "node long, own array<long>")


def similar_groups(
    docs: DataFrame, id_col: str, text_col: str = "text", words: int = 5, similarity: float = 0.8, lanes: int = 3, width: int = 32, budget: int = 3, spread: float = 0.15, heavy: int = 50_000, every: bool = False, whole: bool = False
) -> DataFrame:
    """(id_col, component long) for every row; rows have the same component if similar pairs lead from one to the other.

    Two rows are similar if the Jaccard similarity of their sets of `words`-word shingles is `similarity` or more.  Candidates
    are documents whose SimHash over word pairs differs in `budget` bits at most in one of its tables of `width` bits, and in a
    share of `spread` of all its bits.  Of many candidates that meet, those of FORESTS edge-disjoint spanning forests are
    compared, the tightest first, so a large group costs no more a document than a small one.  At a similarity of 0.8 or more
    few documents escape (the README has the figures).
    every: all candidates that the forests have left in different components are then compared too, so the result is that of
    comparing all candidates.  It costs as many comparisons as there are documents that meet without being similar.
    whole: similar pairs that were no candidates are found by their shingles and added, so no similar pair is left apart.
    id_col: a value of its own that each row has.
    """
    held = fingerprints(docs, id_col, text_col, 2, lanes).select(F.monotonically_increasing_id().alias("node"), F.col(id_col).alias("name"), *(f"fp{k}" for k in range(lanes)))
    held = save(held, "fingerprints")
    per, most = BITS // width, int(spread * BITS * lanes)
    cell = lambda t: F.shiftrightunsigned(F.col(f"fp{t // per}"), width * (t % per)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("table"), cell(t).alias("value")) for t in range(lanes * per))))
    bits = [f"fp{k}" for k in range(lanes)]
    classes = save(held.groupBy(*bits).agg(F.min("node").alias("node")), "classes")  # documents with all bits alike meet the first of them
    alike = held.join(classes.withColumnRenamed("node", "a"), bits).filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    values = classes.withColumn("t", tables).select("node", *bits, "t.*")
    met = _subtrees(values, budget, width, heavy).mapInArrow(_candidates(lanes, budget, width, most), "a long, b long")
    pairs = save(met.distinct().unionByName(alike), "pairs")
    near = _confirmed(docs, id_col, text_col, held, pairs, words, similarity)
    if every:
        near = save(near, "near")
        rooted = held.join(save(components(near), "roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        again = rooted.withColumn("t", tables).select("node", "root", *bits, "t.*")
        left = _subtrees(again, budget, width, heavy, True).mapInArrow(_remaining(lanes, budget, width, most), "a long, b long").distinct()
        left = save(left.join(pairs, ["a", "b"], "left_anti"), "pairs")
        near = near.unionByName(_confirmed(docs, id_col, text_col, held, left, words, similarity))
    if whole:
        near = save(near, "near")
        rooted = held.select("node", "name").join(save(components(near), "roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        left = save(_apart(docs, id_col, text_col, save(rooted, "rooted"), words, similarity, heavy), "pairs")
        near = near.unionByName(_confirmed(docs, id_col, text_col, held, left, words, similarity))
    roots = save(components(near), "roots")
    return held.join(roots, "node", "left").select(F.col("name").alias(id_col), F.coalesce("root", "node").alias("component"))


def _confirmed(docs: DataFrame, id_col: str, text_col: str, held: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of which both texts' shingle sets are as similar as asked."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = save(held.select("node", "name").join(wanted, "node", "left_semi"), "wanted")
    asked = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(wanted, "name")
    sets = save(_sets(asked, "text", words), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


# Similar sets by their first shingles


def _parities(own: np.ndarray) -> bytes:
    """For each ending of PARITIES endings of hashes, as a bit: whether an odd number of a set's hashes have it."""
    counts = np.bincount(own & (PARITIES - 1), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _fronts(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, late: np.ndarray) -> DataFrame:
    """(name, same, n, front, odd): of each row's shingle set a hash, the size, its first shingles, those in `late` ordered last, and parities.

    Two sets that are similar share one of these: of n shingles they have similarity * n in common at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches, "text"):
            same, sizes, fronts, odd = [], [], [], []
            for text in part.column("text").to_pylist():
                own = set_of(text, words)
                same.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                odd.append(_parities(own))
                if len(late):
                    last = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own
                    own = np.concatenate([own[~last], own[last]])
                fronts.append(own[: len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1])
            ends = np.cumsum([0, *map(len, fronts)]).astype("i4")
            front = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(fronts)))
            yield pa.RecordBatch.from_arrays([part.column("name"), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), front, pa.array(odd, pa.binary())], ["name", "same", "n", "front", "odd"])

    base = docs.select(F.col(id_col).alias("name"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    kinds = {"name": docs.schema[id_col].dataType, "same": T.BinaryType(), "n": T.LongType(), "front": T.ArrayType(T.LongType()), "odd": T.BinaryType()}
    return base.mapInArrow(run, T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]))


def _apart(docs: DataFrame, id_col: str, text_col: str, rooted: DataFrame, words: int, similarity: float, heavy: int, often: int = 16) -> DataFrame:
    """Pairs of documents (a, b) of different groups (rooted: name, node, root) that may be similar; all that are similar, or a chain of them.

    Which shingles are ordered last only spares comparisons: they are those that more than `often` documents have in front without
    it, FREQUENT at most.  Of equal sets one document stands for all.  A shingle with more than `heavy` documents goes to several
    tasks, so that each two of its documents meet in one.
    """
    none = np.zeros(0, np.int64)
    seen = _fronts(docs, id_col, text_col, words, similarity, none).select(F.explode("front").alias("shingle"))
    often_ = seen.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") > often).orderBy(F.col("n").desc(), "shingle").limit(FREQUENT)
    late = np.sort(np.array([r["shingle"] for r in often_.select("shingle").collect()], np.int64))
    held = save(_fronts(docs, id_col, text_col, words, similarity, late).join(rooted, "name").drop("name"), "fronts")
    first = held.groupBy("same").agg(F.min(F.struct("node", "root")).alias("first"))
    alike = held.select("same", "node", "root").join(first, "same").filter("root <> first.root").select(F.col("first.node").alias("a"), F.col("node").alias("b"))
    stand = held.join(first.select(F.col("first.node").alias("node")), "node", "left_semi")
    rows = stand.select("node", "root", "n", F.posexplode("front").alias("at", "shingle"))
    own = Window.partitionBy("shingle")
    met = rows.withColumns({"lo": F.min("root").over(own), "hi": F.max("root").over(own), "docs": F.count("*").over(own)}).filter("lo < hi")
    pieces = F.ceil(F.col("docs") / heavy).cast("int")
    mine = F.pmod(F.xxhash64("node"), pieces).cast("int")
    met = met.withColumns({"pieces": pieces, "mine": mine}).drop("lo", "hi", "docs")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("piece", F.least("mine", "other") * F.col("pieces") + F.greatest("mine", "other"))
    met = met.select("shingle", "piece", "node", "root", "n", "at").join(held.select("node", "odd"), "node")
    return met.repartition("shingle", "piece").sortWithinPartitions("shingle", "piece").mapInArrow(_meeting(similarity), "a long, b long").distinct().unionByName(alike)


def _meeting(similarity: float) -> Callable:
    """Pairs (a, b) of different groups that meet at a shingle and may be similar by their sizes, by what follows the shingle in both and by their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, key=["shingle", "piece"]):
            group = np.zeros(len(lot["node"]), np.int64)
            group[_changes([lot["shingle"], lot["piece"]])[1:]] = 1
            group = np.cumsum(group)
            order = np.lexsort((lot["root"], group))
            group, (node, root, n, at) = group[order], (lot[c][order] for c in ("node", "root", "n", "at"))
            odd = np.frombuffer(b"".join(lot["odd"][order]), np.uint64).reshape(len(node), -1)
            left = n - at
            found: list[np.ndarray] = []
            for i, j in _later(group, root):
                needed = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6)
                may = np.minimum(left[i], left[j]) >= needed
                i, j, unlike = i[may], j[may], (n[i] + n[j] - 2 * needed)[may]
                for k in range(0, len(i), 100_000):
                    x, y = i[k : k + 100_000], j[k : k + 100_000]
                    may = _distance(odd, x, y) <= unlike[k : k + 100_000]
                    a, b = node[x[may]], node[y[may]]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                if sum(f.shape[1] for f in found) > 500_000:
                    yield _pairs(found)
                    found = []
            if found:
                yield _pairs(found)

    return run


def _later(group: np.ndarray, root: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows sorted by group and root, for each two with the same group and different roots, about `most` at a time."""
    ends = lambda cut: np.repeat(np.r_[cut[1:], len(group)], np.diff(np.r_[cut, len(group)]))
    begin, end = ends(_changes([group, root])), ends(_changes([group]))
    total = np.cumsum(end - begin)
    lo = 0
    while lo < len(group):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
        many = (end - begin)[lo:hi]
        i = np.repeat(np.arange(lo, hi), many)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + begin[i]
        lo = hi


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    """Each pair once."""
    a, b = np.concatenate(found, axis=1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = _changes([a, b]) if len(a) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])

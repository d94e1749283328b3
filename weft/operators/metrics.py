"""Corpus-level translation metrics from n-gram statistics that add up over rows.

Input rows: (group columns..., row id, hyp, ref).  Statistics are computed per row, beside the scan; what is shuffled is a row's
few counts, and scores and resamples come from their sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.punctuation import apply_steps
from weft.functions.text import strip
from weft.session import ship

#: Bytes of text that are counted at a time.
MOST_BYTES = 1 << 20

#: Takes sources, hypotheses and references; gives as many numbers.
Scorer = Callable[[Sequence[str], Sequence[str], Sequence[str]], Sequence[float]]

# The steps of the mteval-v13a tokeniser, on a text with a blank at both ends.
V13A = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    (r"re:([\x20-\x26\x28-\x2B\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])", " $1 "),
    (r"re:([^0-9])([.,])", "$1 $2 "),
    (r"re:([.,])([^0-9])", " $1 $2"),
    (r"re:([0-9])(-)", "$1 $2 "),
]

# The marks that chrF++ takes off a word.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(x: Column) -> Column:
    return F.filter(F.split(strip(x), r"(?U)\s+"), lambda t: t != "")


def v13a_tokens(x: Column) -> Column:
    return tokens(apply_steps(F.concat(F.lit(" "), x, F.lit(" ")), V13A))


def words_and_marks(x: Column) -> Column:
    """Words, each with the mark at its end (or else the one at its start) as a word of its own."""
    mark = lambda c: F.contains(F.lit(MARKS), c)

    def parts(w: Column) -> Column:
        first, last = F.left(w, F.lit(1)), F.right(w, F.lit(1))
        off_end = F.array(w.substr(F.lit(1), F.length(w) - 1), last)
        off_start = F.array(first, w.substr(F.lit(2), F.length(w) - 1))
        return F.when(F.length(w) == 1, F.array(w)).when(mark(last), off_end).when(mark(first), off_start).otherwise(F.array(w))

    return F.flatten(F.transform(tokens(x), parts))


def _codes(hyp: pa.Array, ref: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each item of all texts, hypotheses first, and how many items each text has; items are characters, or a list's words."""
    both = pa.concat_arrays([hyp, ref])
    if pa.types.is_list(both.type):
        return both.flatten().dictionary_encode().indices.to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(both), 0).to_numpy().astype(np.int64)
    texts = "".join(pc.fill_null(both, "").to_pylist())
    return np.frombuffer(texts.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), pc.fill_null(pc.utf8_length(both), 0).to_numpy().astype(np.int64)


def _row_counts(hyp: pa.Array, ref: pa.Array, orders: range) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order n: n, and each row's clipped matches, n-grams of the hypothesis and of the reference.

    An n-gram's number is that of its row, the n-gram before it less its first item, and its last item: equal numbers, equal n-grams.
    """
    rows = len(hyp)
    items, sizes = _codes(hyp, ref)
    text = np.repeat(np.arange(2 * rows), sizes)
    left = np.cumsum(sizes)[text] - np.arange(len(items))  # items from here to the text's end
    base = int(items.max(initial=0)) + 1
    gram, at = (text % rows).astype(np.int64) if rows else text, np.arange(len(items))
    for n in range(1, orders.stop):
        at = at[left[at] >= n]
        key = gram[at] * base + items[at + n - 1]
        order = np.argsort(key)  # no stable sort: equal n-grams are of one row, whichever comes first
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        named, first, gram_at = key[new], order[new], np.empty(len(key), np.int64)
        gram_at[order] = np.cumsum(new) - 1
        gram = np.zeros(len(items), np.int64)
        gram[at] = gram_at
        if n not in orders:
            continue
        mine = text[at] < rows
        counts = [np.bincount(gram_at[side], minlength=len(named)) for side in (mine, ~mine)]
        row = text[at[first]] % rows if rows else first
        yield n, *(np.bincount(row, weights=c, minlength=rows).astype(np.int64) for c in (np.minimum(*counts), *counts))


def overlaps(rows: DataFrame, keys: list[str], hyp: Column, ref: Column, orders: range, kind: str) -> DataFrame:
    """(keys, n, matched, hyp_n, ref_n, kind): clipped matches and totals of each order for each row, worked out where the row is.

    hyp, ref: texts, whose items are their characters, or arrays of words.
    """
    ship(rows.sparkSession)
    given = rows.select(*keys, hyp.alias("__hyp"), ref.alias("__ref"))
    counts = [T.StructField(c, T.LongType()) for c in ("matched", "hyp_n", "ref_n")]
    schema = T.StructType([*(given.schema[k] for k in keys), T.StructField("n", T.IntegerType()), *counts])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = max(1, batch.num_rows * MOST_BYTES // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                for n, *found in _row_counts(part.column("__hyp"), part.column("__ref"), orders):
                    some = np.flatnonzero(found[1] + found[2])
                    own = [part.column(k).take(pa.array(some)) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(some), n, np.int32)), *(pa.array(c[some]) for c in found)], names)

    return given.mapInArrow(run, schema).withColumn("kind", F.lit(kind))


def bleu_statistics(rows: DataFrame, keys: list[str], tokenize: str = "none") -> DataFrame:
    """tokenize: none for texts whose tokens stand between white space, 13a for plain English."""
    split = {"none": tokens, "13a": v13a_tokens}[tokenize]
    return overlaps(rows, keys, split(F.col("hyp")), split(F.col("ref")), range(1, 5), "word")


def chrf_statistics(rows: DataFrame, keys: list[str], word_order: int = 0) -> DataFrame:
    own = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    chars = overlaps(rows, keys, own(F.col("hyp")), own(F.col("ref")), range(1, 7), "char")
    if not word_order:
        return chars
    return chars.unionByName(overlaps(rows, keys, words_and_marks(F.col("hyp")), words_and_marks(F.col("ref")), range(1, word_order + 1), "word"))


def bleu(statistics: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, bleu) from sums of statistics; an order without a match halves an imagined one at each such order."""
    sums = statistics.groupBy(*groups, "n").agg(*(F.sum(c).cast("double").alias(c) for c in ("matched", "hyp_n", "ref_n")))
    by = sums.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("n", "matched", "hyp_n", "ref_n"))).alias("s"))  # four rows a group
    zero = F.struct(F.lit(1.0).alias("smooth"), F.lit(0.0).alias("log"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        smooth = F.when(x["matched"] == 0, a["smooth"] * 2).otherwise(a["smooth"])
        p = F.when(x["matched"] == 0, 100.0 / (smooth * x["hyp_n"])).otherwise(100.0 * x["matched"] / x["hyp_n"])
        return F.struct(smooth.alias("smooth"), (a["log"] + F.log(p)).alias("log"), (a["n"] + 1).alias("n"))

    used = F.filter("s", lambda x: x["hyp_n"] > 0)
    folded = F.aggregate(used, zero, step)
    one = F.get(F.col("s"), 0)
    short = F.when(one["hyp_n"] < one["ref_n"], F.exp(1 - one["ref_n"] / one["hyp_n"])).otherwise(1.0)
    score = F.when((F.size(used) < 4) | (one["matched"] == 0), 0.0).otherwise(short * F.exp(folded["log"] / 4))
    return by.select(*groups, score.alias("bleu"))


def chrf(statistics: DataFrame, groups: list[str], beta: float = 2.0) -> DataFrame:
    """(groups, chrf): F-score of precision and recall averaged over the orders that both sides have; a group without one gives no row."""
    return _chrf(statistics, groups, beta).filter("chrf is not null")


def _chrf(statistics: DataFrame, groups: list[str], beta: float) -> DataFrame:
    """chrf(), and null for groups whose sides share no order."""
    sums = statistics.groupBy(*groups, "kind", "n").agg(*(F.sum(c).cast("double").alias(c) for c in ("matched", "hyp_n", "ref_n")))
    share = lambda c: F.avg(F.when((F.col("hyp_n") > 0) & (F.col("ref_n") > 0), F.col("matched") / F.col(c)))
    both = sums.groupBy(*groups).agg(share("hyp_n").alias("__p"), share("ref_n").alias("__r"))
    score = F.when(F.col("__p").isNull(), None).when(F.col("__p") + F.col("__r") > 0, 100 * (1 + beta**2) * F.col("__p") * F.col("__r") / (beta**2 * F.col("__p") + F.col("__r"))).otherwise(0.0)
    return both.select(*groups, score.alias("chrf"))


#: Distribution function of the Poisson law with mean 1, up to 8.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402]


def draws(key: Column, sample: Column) -> Column:
    """How often a row is drawn into a resample: a Poisson number from a hash, so every run and every task draws alike."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", sample.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = F.lit(0)
    for limit in POISSON:
        times = times + F.when(u > limit, 1).otherwise(0)
    return times


def _times(key: str | None, first: int, samples: int) -> np.ndarray:
    """draws() of a row for each sample from first on; sample 0 has each row once."""
    tail = b"" if key is None else b":" + key.encode()
    u = np.fromiter((int.from_bytes(hashlib.md5(b"%d%b" % (s, tail)).digest()[:4], "big") for s in range(first, samples + 1)), np.int64, samples + 1 - first) / 4294967296.0
    times = np.searchsorted(POISSON, u, "left")
    times[: max(0, 1 - first)] = 1
    return times


def _weighted(first: int, samples: int, names: list[str]) -> Callable:
    """Sums of a task's statistics by system, kind and order for each sample, rows weighted by how often they are drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                part = whole.slice(at, 2000)
                times = np.array([_times(k, first, samples) for k in part.column("row").to_pylist()], np.float64)
                lists = part.column("s")
                flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
                own = {f: flat.field(i) for i, f in enumerate(names)}
                group = pa.table([own[c] for c in names[:3]], names[:3]).to_pandas()
                for key, places in group.groupby(names[:3], dropna=False, sort=False).indices.items():
                    values = np.stack([own[c].to_numpy(zero_copy_only=False)[places] for c in names[3:]] + [np.ones(len(places))], 1)
                    got = times[row[places]].T @ values  # whole numbers, exact below 2 ** 53
                    sums[key] = sums[key] + got if key in sums else got
        for key, got in sums.items():
            drawn = np.flatnonzero(got[:, 3])
            columns = [pa.array(drawn + first, pa.int32()), *(pa.array([v] * len(drawn), t) for v, t in zip(key, (pa.string(), pa.string(), pa.int32()), strict=True))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(got[drawn, i].astype(np.int64)) for i in range(3))], ["sample", *names])

    return run


def chrf_score(statistics: DataFrame, groups: list[str]) -> DataFrame:
    """chrf(), and 0 for groups whose hypotheses and references share no order."""
    return _chrf(statistics, groups, 2.0).select(*groups, F.coalesce("chrf", F.lit(0.0)).alias("chrf"))


def paired_bootstrap(statistics: DataFrame, row: str, system: str, samples: int = 200, first: int = 1, score: Callable[[DataFrame, list[str]], DataFrame] = bleu) -> DataFrame:
    """(sample, system, bleu) for resamples of rows, the same rows for each system; sample 0, if first is 0, has each row once.

    score: bleu, or chrf_score for statistics of chrF, whose column is then chrf.

    A row's statistics are brought together (a few numbers for each system), so a draw is made once a row and sample.  They are
    multiplied by draws() and summed per sample, as products of matrices, before they are shuffled: samples x systems x orders rows a task.
    """
    ship(statistics.sparkSession)
    held = statistics.groupBy(row).agg(F.collect_list(F.struct(F.col(system).cast("string").alias(system), "kind", "n", "matched", "hyp_n", "ref_n")).alias("s"))
    # few bytes, but each row is drawn for every sample: Spark is not to put them all in one task
    held = held.repartition(int(statistics.sparkSession.conf.get("spark.sql.shuffle.partitions")), row)
    names = [system, "kind", "n", "matched", "hyp_n", "ref_n"]
    schema = T.StructType([T.StructField("sample", T.IntegerType()), *(T.StructField(c, t) for c, t in zip(names, (T.StringType(), T.StringType(), T.IntegerType(), *[T.LongType()] * 3), strict=True))])
    weighted = held.select(F.col(row).cast("string").alias("row"), "s").mapInArrow(_weighted(first, samples, names), schema)
    return score(weighted, ["sample", system])


def significance(statistics: DataFrame, row: str, system: str, baseline: str, samples: int = 200, score: Callable[[DataFrame, list[str]], DataFrame] = bleu, metric: str = "bleu") -> DataFrame:
    """(system, metric, mean, p_value): each system's score, its mean over resamples, and how likely a difference to the baseline as
    large as that seen is by chance: the share of resamples (with one added to both) whose difference lies further from the
    mean difference than the difference seen is large.  The baseline has no p_value.

    score and metric: bleu for its statistics; chrf_score and chrf for those of chrF and chrF++."""
    scores = paired_bootstrap(statistics, row, system, samples, 0, score).withColumnRenamed(system, "system").withColumnRenamed(metric, "__score")
    base = F.max(F.when(F.col("system") == baseline, F.col("__score"))).over(Window.partitionBy("sample"))  # a row for each system
    own = Window.partitionBy("system")  # a row for each sample
    told = scores.withColumn("diff", F.abs(F.col("__score") - base))
    told = told.withColumn("middle", F.avg(F.when(F.col("sample") > 0, F.col("diff"))).over(own)).withColumn("seen", F.max(F.when(F.col("sample") == 0, F.col("diff"))).over(own))
    beyond = F.count_if((F.col("sample") > 0) & (F.abs(F.col("diff") - F.col("middle")) > F.col("seen")))
    p = F.when(F.col("system") != baseline, (beyond + 1) / F.lit(samples + 1)).alias("p_value")
    whole, mean = F.max(F.when(F.col("sample") == 0, F.col("__score"))), F.avg(F.when(F.col("sample") > 0, F.col("__score")))
    return told.groupBy("system").agg(whole.alias(metric), mean.alias("mean"), p)


# Scores of segments, by whatever scorer is plugged in


def score_segments(rows: DataFrame, scorer: Scorer, src_col: str = "src", hyp_col: str = "hyp", ref_col: str = "ref", to: str = "score") -> DataFrame:
    """rows and the scorer's score of each."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            scores = scorer(*(part.column(c).to_pylist() for c in (src_col, hyp_col, ref_col)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, to])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(to, T.DoubleType())]))


def t_probability(t: float | None, n: int) -> float | None:
    """How likely a mean difference of n pairs is at least t standard errors from zero, on either side, if there is none (Student)."""
    if t is None or n < 2:
        return None
    a, b = (n - 1) / 2, 0.5
    x = (n - 1) / (n - 1 + t * t)
    if x in (0.0, 1.0):
        return x
    if x >= (a + 1) / (a + b + 2):  # the fraction converges faster on the other side
        a, b, x, flip = b, a, 1 - x, True
    else:
        flip = False
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 0.0
    for m in range(300, 0, -1):  # the incomplete beta function's continued fraction, from the inside out
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = odd / (1 + even / (1 + value))
    share = front / (1 + value)
    return 1 - share if flip else share


def compare_systems(scores: DataFrame, row: str, system: str = "system", score: str = "score") -> DataFrame:
    """(a, b, n, mean_a, mean_b, diff, t, p_value) for each two systems: a paired t-test over the rows that both have scored.

    A row's scores are brought together (a few numbers); moments of the differences of all pairs of systems are then added up in
    one pass, in each task first.  Equal scores throughout give no t and no p_value.  Of several scores of a system for a row the
    least counts.
    """
    held = scores.filter(F.col(score).isNotNull()).groupBy(row, system).agg(F.min(score).alias("v"))
    by_row = held.groupBy(row).agg(F.sort_array(F.collect_list(F.struct(F.col(system).alias("s"), "v"))).alias("x"))  # systems are few
    pairs = F.flatten(F.transform("x", lambda p, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda q: F.struct(p["s"].alias("a"), q["s"].alias("b"), p["v"].alias("v"), q["v"].alias("w")))))
    both = by_row.select(F.explode(pairs).alias("p")).select("p.*").withColumn("d", F.col("v") - F.col("w"))
    sums = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("v").alias("mean_a"), F.avg("w").alias("mean_b"), F.avg("d").alias("diff"), F.stddev_samp("d").alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("diff") / (F.col("sd") / F.sqrt("n")))
    return sums.withColumn("t", t).select("a", "b", "n", "mean_a", "mean_b", "diff", "t", F.udf(lambda t, n: t_probability(t, n), "double")("t", "n").alias("p_value"))  # a row for each two systems

"""Quality rules with thresholds learned per language and source, by Spark's own functions.

measure() gives the base statistics of each text; sketches() gathers a mergeable quantile (KLL) sketch of every ratio per
language and source; thresholds() merges them per language and for all and reads fences off them: a ratio is out of line if it
exceeds the upper quantile of its group by `reach` times the distance from the median to that quantile, and at least by the
sketch-independent SLACK (zero spread would else make any value an outlier).  A group's fence is blended with its language's,
and that with the fence of all documents: with n documents its own part is n / (n + `prior`), at every size.  judge() joins the
fences to the statistics, and documents are joined to the verdicts.

A null text, and an empty one, has no words and fails the base rules.  Null languages and sources are groups of their own.
Very long texts are measured whole.  A ratio that equals its fence passes.  Repeated rows are measured and judged each.  An
empty table gives an empty table.  All columns of the input stay; where it has a column named as an added one, the added one
gets an underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import WS, free_names, numbered, save, text_or_empty
from weft.llm.spans import let

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbol_ratio", "dup_line_ratio", "long_word_ratio"]
#: Least distance from the upper quantile at which a ratio may be out of line.
SLACK = {"symbol_ratio": 0.1, "dup_line_ratio": 0.3, "long_word_ratio": 6.0}


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of `width` words which the text has twice or more.

    Windows with different hashes differ.  Only where a text has equal hashes are the windows behind them compared.
    """
    window = lambda i: F.slice(words, i + 1, F.lit(width))
    hashed = F.transform(words, lambda _, i: F.xxhash64(window(i)))  # the last width - 1 are shorter, so they repeat none

    def alike(s: Column, key: str) -> Column:
        """Entries of the sorted list s that share their key with a neighbour."""
        same = lambda i, k: F.coalesce(F.get(s, i)[key] == F.get(s, i + k)[key], F.lit(False))
        return F.filter(s, lambda x, i: same(i, -1) | same(i, 1))

    def packed(h: Column, bits: Column) -> Column:
        """Places whose hash, as far as it fits into a number beside the place, is that of another place."""
        up, down = (lambda x, f=f: F.call_function(f, x, bits) for f in ("shiftleft", "shiftrightunsigned"))
        one = F.lit(1).cast("long")
        near = lambda s: F.filter(s, lambda x, i: F.coalesce(down(x) == down(F.get(s, i - 1)), F.lit(False)) | F.coalesce(down(x) == down(F.get(s, i + 1)), F.lit(False)))
        numbers = F.sort_array(F.transform(h, lambda x, i: up(x).bitwiseOR(i.cast("long"))))
        return F.transform(let(numbers, near), lambda x: x.bitwiseAND(up(one) - 1).cast("int"))

    def exact(h: Column) -> Column:
        whole = F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0)))
        bits = F.ceil(F.log2(F.size(h) + 1.0)).cast("int")
        by_hash = F.transform(let(F.struct(whole.alias("h"), bits.alias("b")), lambda x: packed(x["h"], x["b"])), lambda i: F.struct(i.alias("i")))
        windows = F.transform(by_hash, lambda x: F.struct(F.concat_ws(" ", window(x["i"])).alias("w"), x["i"].alias("i")))
        at = F.sort_array(F.transform(let(F.sort_array(windows), lambda s: alike(s, "w")), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(width), x - a["last"])).alias("n"), x.alias("last"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h)))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WS + "+"), "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def _stats(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.concat_ws("", words)).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


def measure(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns in keep and the five base statistics (long)."""
    words, lines = free_names(docs.columns, "words", "lines")
    text = text_or_empty(text_col)
    parts = docs.withColumn(words, _words(text)).withColumn(lines, _lines(text))
    return parts.select(*keep, *(c.alias(k) for k, c in _stats(text, F.col(words), F.col(lines)).items()))


def ratios() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {"symbol_ratio": F.col("n_symbols") / words, "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_words") / 10, F.lit(1.0)), "long_word_ratio": F.col("word_chars") / words}


def sketches(measured: DataFrame) -> DataFrame:
    """One row per language and source (columns lang, source): a KLL sketch of each ratio and the number of documents."""
    keyed = measured.select("lang", "source", *(c.alias(k) for k, c in ratios().items()))
    return keyed.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(k).alias(k) for k in RATIOS))


def thresholds(sketched: DataFrame, prior: int = 200, upper: float = 0.9, reach: float = 6.0) -> DataFrame:
    """(lang, source, max_ of each ratio): the group's fence, blended with its language's and that of all documents."""

    def fence(k: str) -> Column:
        mid, high = (F.kll_sketch_get_quantile_double(F.col(k), F.lit(q)) for q in (0.5, upper))
        return (high + F.greatest(reach * (high - mid), F.lit(SLACK[k]))).alias(f"max_{k}")

    merged = lambda df: df.agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(k).alias(k) for k in RATIOS))
    own = sketched.select("lang", "source", "n", *(fence(k) for k in RATIOS))
    by_lang = merged(sketched.groupBy("lang")).select("lang", "n", *(fence(k) for k in RATIOS))
    all_ = merged(sketched.groupBy()).filter("n > 0").select(*(fence(k) for k in RATIOS))
    names = [f"max_{k}" for k in RATIOS]
    wide = own.join(by_lang.select(F.col("lang").alias("l"), F.col("n").alias("ln"), *(F.col(c).alias(f"l_{c}") for c in names)), F.col("lang").eqNullSafe(F.col("l")))
    one = all_.select(F.struct(*names).alias("all_"), F.lit(1).alias("one"))
    wide = wide.withColumn("one", F.lit(1)).join(F.broadcast(one), "one")  # one row
    blend = lambda n, mine, wider: (F.col(n) * mine + prior * wider) / (F.col(n) + prior)
    return wide.select("lang", "source", *(blend("n", F.col(c), blend("ln", F.col(f"l_{c}"), F.col(f"all_.{c}"))).alias(c) for c in names))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured, which is a table, and booleans base_failed and kept."""
    told = limits.select(F.struct("lang").alias("__lang"), F.struct("source").alias("__source"), *(f"max_{k}" for k in RATIOS))
    same = (F.struct("lang") == F.col("__lang")) & (F.struct("source") == F.col("__source"))
    bad = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    calm = reduce(lambda a, b: a & b, (F.coalesce(ratio <= F.col(f"max_{k}"), F.lit(True)) for k, ratio in ratios().items()))
    joined = measured.join(told, same, "left")
    return joined.withColumn("base_failed", bad).withColumn("kept", ~F.col("base_failed") & calm).select(*measured.columns, "base_failed", "kept")


def apply_rules(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without its text if keep_text is false) and, last, the statistics, base_failed and kept.

    Each text is measured once: the statistics are written to the shared folder, by row where texts are kept.
    """
    added = [*STATS, "base_failed", "kept"]
    if keep_text:
        docs, row = numbered(docs)
        columns, own = [c for c in docs.columns if c != row], [row]
    else:
        columns = own = [c for c in docs.columns if c != text_col]
    keys = [F.struct(*own).alias("own"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    slim = save(measure(docs, keys, text_col), "measured")
    judged = judge(slim, save(thresholds(sketches(slim)), "limits"))
    told = judged.select("own.*", *(F.col(c).alias(n) for c, n in zip(added, free_names(docs.columns, *added), strict=True)))
    return docs.join(told, row).select(*columns, *told.columns[1:]) if keep_text else told

"""Relational operators on parallel text: rows (pair, split, domain, line_no, src_lang, tgt_lang, src_text, tgt_text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import loose_key, pieces_of, squeeze, strict_key, strip


def union_distinct(domains: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of all domains, each combination of keys once."""
    return reduce(DataFrame.unionByName, domains).dropDuplicates(keys)


def distinct_pairs(bitext: DataFrame, by: str = "pair", order: str = "line_no") -> DataFrame:
    """The first row of each exact (source, target) of a pair."""
    rows = [c for c in bitext.columns if c not in (by, "src_text", "tgt_text")]
    first = bitext.groupBy(by, "src_text", "tgt_text").agg(F.min_by(F.struct(*rows), order).alias("row"))
    return first.select(by, "src_text", "tgt_text", "row.*").select(bitext.columns)


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two sides with the same line; lines that one side lacks are left out."""
    return left.join(right, keys)


def anti_join_any(df: DataFrame, pools: list[tuple[list[Column], DataFrame]]) -> DataFrame:
    """df without rows for which any pool holds the row's keys.

    One anti-join a pool: a single one with OR between the keys would compare all rows with all keys.  A pool's columns are
    taken in the order of the keys.  Whether a pool is broadcast is left to Spark, which knows its size.
    """
    for i, (keys, pool) in enumerate(pools):
        names = [f"__k{i}_{j}" for j in range(len(keys))]
        pool = pool.toDF(*names).distinct()
        df = df.join(pool, reduce(lambda a, b: a & b, (k == F.col(n) for k, n in zip(keys, names, strict=True))), "left_anti")
    return df


def flagged(df: DataFrame, keys: list[Column], pool: DataFrame, flag: str) -> DataFrame:
    """df and whether the pool, whose columns are taken in the order of the keys, holds the row's keys.  df is read once."""
    names = [f"__k{j}" for j in range(len(keys))]
    held = pool.toDF(*names).distinct().withColumn("__in", F.lit(True))
    joined = df.join(held, reduce(lambda a, b: a & b, (k == F.col(n) for k, n in zip(keys, names, strict=True))), "left")
    return joined.select(*df.columns, F.coalesce("__in", F.lit(False)).alias(flag))


def decontaminate_loose(bitext: DataFrame, benchmark: DataFrame) -> DataFrame:
    """bitext without rows whose source or target has the loose key of a benchmark text in its language; texts on one line, in single blanks.

    benchmark: (lang, text); blank texts are no keys.
    """
    pool = benchmark.filter(strip(F.col("text")) != "").select("lang", loose_key(F.col("text")).alias("key"))
    clean = bitext.withColumn("src_text", squeeze(F.col("src_text"))).withColumn("tgt_text", squeeze(F.col("tgt_text")))
    return anti_join_any(clean, [([F.col("src_lang"), loose_key(F.col("src_text"))], pool), ([F.col("tgt_lang"), loose_key(F.col("tgt_text"))], pool)])


def decontaminate_strict(bitext: DataFrame, devtest: DataFrame) -> DataFrame:
    """bitext without rows whose source has the strict key of any held-out source, or whose target one of its own pair's.

    devtest: (benchmark, pair, split, src_text, tgt_text); a pair of a benchmark counts only if it has both dev and test rows.
    """
    # both kinds of key in one column, so that what is held out is read once and both joins share what is made of it
    own = lambda side, pair, key: F.concat_ws("\u0001", F.lit(side), pair, key)
    source, target = own("src", F.lit(""), strict_key(F.col("src_text"))), own("tgt", F.col("pair"), strict_key(F.col("tgt_text")))
    keys = devtest.select("benchmark", "pair", "split", F.explode(F.array(F.when(F.col("src_text").isNotNull(), source), F.when(F.col("tgt_text").isNotNull(), target))).alias("key")).distinct()
    whole = keys.groupBy("benchmark", "pair").agg(F.count_distinct("split").alias("n")).filter("n = 2").select("benchmark", "pair")
    pool = keys.join(whole, ["benchmark", "pair"], "left_semi").select("key").distinct()
    rows = bitext
    for text, key in (("src_text", source), ("tgt_text", target)):
        rows = rows.join(pool.withColumnRenamed("key", "__key"), F.when(F.col(text).isNotNull(), key) == F.col("__key"), "left_anti")
    return rows


def pivot_join(first: DataFrame, second: DataFrame) -> DataFrame:
    """New pairs (src_text, tgt_text) over equal pivot sentences.

    first, second: (pivot_text, text, line_no).  Of the first side's rows for a pivot sentence the last counts; of the second
    side's all do.  Each new pair comes once.
    """
    last = first.groupBy(strip(F.col("pivot_text")).alias("pivot_text")).agg(F.max_by("text", "line_no").alias("src_text"))
    return second.select(strip(F.col("pivot_text")).alias("pivot_text"), F.col("text").alias("tgt_text")).join(last, "pivot_text").select("src_text", "tgt_text").distinct()


def length_filter(bitext: DataFrame, most: int = 200) -> DataFrame:
    """Rows of which neither side has more than `most` pieces."""
    return bitext.filter((F.size(pieces_of(F.col("src_text"))) <= most) & (F.size(pieces_of(F.col("tgt_text"))) <= most))


def pair_stats(bitext: DataFrame) -> DataFrame:
    return bitext.groupBy("src_lang", "tgt_lang").agg(F.count("*").alias("cnt"))


def mirrored(stats: DataFrame) -> DataFrame:
    """Counts of pairs in both directions; a pair of a language with itself once."""
    turned = stats.filter("src_lang <> tgt_lang").select(F.col("tgt_lang").alias("src_lang"), F.col("src_lang").alias("tgt_lang"), "cnt")
    return stats.unionByName(turned)


def offsets(stats: DataFrame) -> DataFrame:
    """Where each pair starts when pairs are concatenated in order.  One row for each pair of languages, so one window is small."""
    order = Window.orderBy("src_lang", "tgt_lang").rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn("start", F.coalesce(F.sum("cnt").over(order), F.lit(0)).cast("long"))


def expand_runs(stats: DataFrame) -> DataFrame:
    """One row (src_lang, tgt_lang) for each counted line: blocks of lines are dealt out, and each is spread where it lands."""
    block = 1 << 16
    blocks = stats.filter("cnt > 0").select("src_lang", "tgt_lang", "cnt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cnt") - 1, F.lit(block).cast("long"))).alias("from"))
    dealt = blocks.repartition("src_lang", "tgt_lang", "from")
    return dealt.select("src_lang", "tgt_lang", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.col("cnt") - F.col("from")))).alias("i")).drop("i")


def language_pairs(languages: DataFrame, ordered: bool = True) -> DataFrame:
    """Pairs of different languages (column lang), each once (ordered) or in both directions.  Languages are few."""
    a, b = languages.select(F.col("lang").alias("l1")), languages.select(F.col("lang").alias("l2"))
    return a.join(b, F.col("l1") < F.col("l2") if ordered else F.col("l1") != F.col("l2"))


def add_tags(bitext: DataFrame, text_col: str = "src_text") -> DataFrame:
    """Source text led by the codes of both languages."""
    return bitext.withColumn(text_col, F.concat_ws(" ", "src_lang", "tgt_lang", strip(F.col(text_col))))


def _ranked(df: DataFrame, by: str, order: str, to: str, block: int = 1 << 20) -> DataFrame:
    """df and each row's place from 0 within its pair, in the order of a whole number.

    Rows are ranked within blocks of that number and shifted by the sizes of the blocks before, so no task holds a large pair.
    """
    held = df.withColumn("__block", F.floor(F.col(order) / block))
    sizes = held.groupBy(by, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sizes = sizes.select(by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = held.join(sizes, [by, "__block"]).withColumn("__place", F.col("__before") + F.row_number().over(Window.partitionBy(by, "__block").orderBy(order)) - 1)
    return placed.withColumn(to, F.col("__place").cast("long")).select(*df.columns, *([] if to in df.columns else [to]))


def renumber(df: DataFrame, by: str = "pair", order: str = "line_no") -> DataFrame:
    """Line numbers from 0 within each pair, in the old order."""
    return _ranked(df, by, order, order)


def batches(df: DataFrame, size: int, by: str = "pair", order: str = "line_no") -> DataFrame:
    """df and batch: consecutive rows of a pair, `size` a batch."""
    return _ranked(df, by, order, "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def to_full_codes(bitext: DataFrame, isos: DataFrame) -> DataFrame:
    """bitext with full codes of its languages in place of short ones, also in its pairs; other codes stay. isos: (iso, flores), a row each language."""
    for c in ("src_lang", "tgt_lang"):
        told = isos.select(F.col("iso").alias(c), F.col("flores").alias("__full"))
        bitext = bitext.join(F.broadcast(told), c, "left").withColumn(c, F.coalesce("__full", c)).select(bitext.columns)
    return bitext.withColumn("pair", F.concat_ws("-", "src_lang", "tgt_lang"))


def pivot_first(bitext: DataFrame, pivot: str = "eng_Latn") -> DataFrame:
    """Pairs with the pivot language, with it as their source."""
    turn = F.col("tgt_lang") == pivot
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    turned = {"src_lang": "tgt_lang", "tgt_lang": "src_lang", "src_text": "tgt_text", "tgt_text": "src_text"}
    kept = bitext.filter((F.col("src_lang") == pivot) | turn).select(*(swap(c, turned[c]) if c in turned else F.col(c) for c in bitext.columns))
    return kept.withColumn("pair", F.concat_ws("-", "src_lang", "tgt_lang"))


def complete_pairs(files: DataFrame) -> DataFrame:
    """Of files (pair, lang, ...) those of pairs that have both of their languages."""
    both = files.filter(F.col("lang").isin(F.substring_index("pair", "-", 1), F.substring_index("pair", "-", -1))).groupBy("pair").agg(F.count_distinct("lang").alias("n"))
    return files.join(both.filter("n = 2").select("pair"), "pair", "left_semi")


def sample(df: DataFrame, n: int = 10, seed: int | None = None) -> DataFrame:
    """n rows drawn at random."""
    return df.orderBy(F.rand(seed)).limit(n)


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """df in an order drawn by seed, the same at every run."""
    return df.orderBy(_drawn(seed, key), key)


def _drawn(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def shuffled_places(df: DataFrame, seed: int, key: str, to: str = "place") -> DataFrame:
    """df and each row's place from 0 in the order of shuffled(), so that parts of that order can be taken without sorting all rows.

    Rows are ranked among those whose draw begins alike (65,536 parts) and shifted by the sizes of the parts before.
    """
    held = df.withColumn("__draw", _drawn(seed, key)).withColumn("__part", F.left("__draw", F.lit(4)))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__draw", key)) - 1
    return held.join(sizes, "__part").withColumn(to, (F.col("__before") + own).cast("long")).select(*df.columns, to)


def strict_bitext(bitext: DataFrame) -> DataFrame:
    """Rows of different languages; a line that lacks a side is an error."""
    both = F.assert_true(F.col("src_text").isNotNull() & F.col("tgt_text").isNotNull(), F.lit("source and target differ in length")).isNull()
    return bitext.filter("src_lang <> tgt_lang").filter(both)


def supported(bitext: DataFrame, systems: DataFrame) -> DataFrame:
    """(system, src_code, tgt_code) for each row of bitext whose languages a system both supports."""
    a = systems.select("system", F.col("flores").alias("src_lang"), F.col("sys_code").alias("src_code"))
    b = systems.select("system", F.col("flores").alias("tgt_lang"), F.col("sys_code").alias("tgt_code"))
    return bitext.join(F.broadcast(a), "src_lang").join(F.broadcast(b), ["system", "tgt_lang"])  # a few rows for each system

"""Reading line-aligned text into tables and writing it back.

Files are read once into Parquet with a line number on every row; all later work is on tables.  Files are split: a task reads a
block of a file, and a line's number is its place in the block and the number of lines in the blocks before.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import strip
from weft.sources.tables import Files

LINES = "path string, line_no long, text string"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, text) for each line of each file; paths that match nothing give no rows.

    Only a line feed ends a line.  Bytes that are no UTF-8 are left out.
    """
    try:
        files = spark.read.option("lineSep", "\n").text(paths)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], LINES)
    # a block's lines are read in order by one task, so these numbers rise by one within it
    placed = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = placed.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a file
    blocks = blocks.select("path", "block", (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("first")).alias("shift"))
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")))
    return placed.join(blocks, ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("line_no"), text.alias("text"))


def read_bitext(spark: SparkSession, root: str, split: str = "train", domain: str | None = None) -> DataFrame:
    """Bitext rows from {root}/{src}-{tgt}/{split}.{lang}; a line that only one side has is left out, as are other folders."""
    name = re.escape(split)
    at = r"([^/]+)-([^/-]+)/" + name + r"\.([^/]+)$"
    lines = read_lines(spark, f"{root}/*-*/{split}.*").select(
        F.regexp_extract("path", at, 1).alias("src_lang"), F.regexp_extract("path", at, 2).alias("tgt_lang"), F.regexp_extract("path", at, 3).alias("lang"), "line_no", "text"
    )
    side = lambda lang, text: lines.filter(F.col("lang") == F.col(lang)).select("src_lang", "tgt_lang", "line_no", F.col("text").alias(text))
    both = side("src_lang", "src_text").join(side("tgt_lang", "tgt_text"), ["src_lang", "tgt_lang", "line_no"])
    return both.select(F.concat_ws("-", "src_lang", "tgt_lang").alias("pair"), F.lit(split).alias("split"), F.lit(domain).cast("string").alias("domain"), "line_no", "src_lang", "tgt_lang", "src_text", "tgt_text")


def read_domains(spark: SparkSession, root: str, domains: list[str], split: str = "train") -> DataFrame:
    """Bitext of several domains; a domain without files adds nothing."""
    return reduce(DataFrame.unionByName, (read_bitext(spark, f"{root}/{d}", split, d) for d in domains))


def read_benchmark(spark: SparkSession, root: str) -> DataFrame:
    """(lang, line_no, text) from {root}/{lang}; lines of nothing but white space, by Unicode's meaning, are left out."""
    lines = read_lines(spark, f"{root}/*").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("lang"), "line_no", "text")
    return lines.filter(strip(F.col("text")) != "")


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """(id, score, hyp, at) from the H lines of a decoder's log."""
    return hypotheses(read_lines(spark, path))


def hypotheses(lines: DataFrame) -> DataFrame:
    """(id, score, hyp, at) from log lines (line_no, text): `H-<id>`, score and text between tabs; what is no number is null."""
    part = F.split("text", "\t", -1)
    own = lines.filter(F.col("text").startswith("H-"))
    return own.select(F.substring_index(F.get(part, F.lit(0)), "-", -1).try_cast("int").alias("id"), F.get(part, F.lit(1)).try_cast("double").alias("score"), F.get(part, F.lit(2)).alias("hyp"), F.col("line_no").alias("at"))


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows (token, freq, text) of a `token count` file, and the other lines."""
    return vocabulary(read_lines(spark, path))


def vocabulary(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of two fields as (token, freq, text), freq being null where the second field is no number, and the other lines."""
    part = F.split(F.regexp_replace("text", "^[\r\n ]+|[\r\n ]+$", ""), " ", -1)
    valid = F.size(part) == 2
    good = lines.filter(valid).select(F.get(part, F.lit(0)).alias("token"), F.get(part, F.lit(1)).try_cast("long").alias("freq"), "text")
    return good, lines.filter(~valid).withColumn("points", F.hex(F.encode("text", "UTF-32")))


def read_lookup(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A lookup table of tab-separated fields, as texts, under the given names; fields that a line lacks are null."""
    return spark.read.csv(path, sep="\t", schema=", ".join(f"`{n}` string" for n in names))


def read_pair_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="src_lang string, tgt_lang string, cnt long")


def write_pair_counts(stats: DataFrame, path: str) -> None:
    stats.select("src_lang", "tgt_lang", "cnt").write.mode("overwrite").csv(path, sep="\t")


def write_bitext(bitext: DataFrame, path: str) -> None:
    """Parquet by pair and split, in files of line ranges: a large pair goes to many tasks, and files hold their lines in order."""
    keys = ["pair", "split", "line_no"]
    bitext.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("pair", "split").parquet(path)


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of a file to be translated, stripped: empty lines are left out before, so one of blanks alone stays, as an empty text."""
    return read_lines(spark, path).filter(F.col("text") != "").select("line_no", strip(F.col("text")).alias("text"))


def read_bitext_strict(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    """As read_bitext(); a pair of different languages whose sides differ in length, or of which one is missing, is an error."""
    at = r"([^/]+)-([^/-]+)/" + re.escape(split) + r"\.([^/]+)$"
    sides = read_lines(spark, f"{root}/*-*/{split}.*").select(F.regexp_extract("path", at, 1).alias("s"), F.regexp_extract("path", at, 2).alias("t"), F.regexp_extract("path", at, 3).alias("lang")).filter("s <> t and lang in (s, t)")
    sizes = sides.groupBy("s", "t").agg(F.count_if(F.col("lang") == F.col("s")).alias("n"), F.count_if(F.col("lang") == F.col("t")).alias("m"))
    uneven = sizes.filter("n <> m").first()
    if uneven:
        raise ValueError("source and target differ in length: {s}-{t} {n} {m}".format(**uneven.asDict()))
    return read_bitext(spark, root, split).filter("src_lang <> tgt_lang")


def write_joint(bitext: DataFrame, path: str, src_lang: str = "SRC", tgt_lang: str = "TGT", split: str = "train", block: int = 1 << 20) -> None:
    """All pairs one after the other, in their order and that of their lines, as one source and one target text, and the counts of
    pairs: {path}/{split}.{SRC or TGT}/part-* and {path}/{split}.metadata.  The parts of both sides hold the same lines.

    A part is a block of line numbers of one pair, and its name tells where in the whole text it starts: sums of the blocks' sizes
    place it, so nothing is sorted as a whole and the texts are shuffled once, for both sides.
    """
    spark, keys = bitext.sparkSession, ["src_lang", "tgt_lang", "block"]
    held = bitext.select("src_lang", "tgt_lang", F.floor(F.col("line_no") / block).alias("block"), "line_no", *(F.coalesce(c, F.lit("")).alias(c) for c in ("src_text", "tgt_text")))
    sizes = held.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    placed = sizes.select(*keys, F.format_string("%020d", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("place"))
    rows = held.repartition(*keys).join(placed, keys)
    sides = F.explode(F.array(*(F.struct(F.lit(name).alias("side"), F.col(c).alias("text")) for name, c in ((src_lang, "src_text"), (tgt_lang, "tgt_text")))))
    parked = f"{path}/{split}.parts"
    ordered = rows.select("place", "line_no", sides.alias("s")).select("place", "line_no", "s.*").sortWithinPartitions("side", "place", "line_no")
    ordered.select("side", "place", "text").write.mode("overwrite").partitionBy("side", "place").option("maxRecordsPerFile", 0).text(parked)
    files = Files(spark, path)
    for name in (src_lang, tgt_lang):
        files.remove(f"{path}/{split}.{name}")
        files.make(f"{path}/{split}.{name}")
        for place in files.names(f"{parked}/side={name}"):
            (part,) = (x for x in files.names(f"{parked}/side={name}/{place}") if x.startswith("part-"))  # one task wrote the block
            files.move(f"{parked}/side={name}/{place}/{part}", f"{path}/{split}.{name}/part-{place.removeprefix('place=')}.txt")
    files.remove(parked)
    counts = sizes.groupBy("src_lang", "tgt_lang").agg(F.sum("n").alias("cnt"))
    counts.orderBy("src_lang", "tgt_lang").write.mode("overwrite").csv(f"{path}/{split}.metadata", sep="\t")


def write_scores(scores: DataFrame, path: str) -> None:
    """A report of scores (pair, system, metric, value), one line each, in order; a few lines for each pair."""
    scores.select("pair", "system", "metric", "value").orderBy("pair", "system", "metric").write.mode("overwrite").csv(path, sep="\t", header=True)


def export_lines(bitext: DataFrame, path: str, text_col: str) -> None:
    """One column as text files, part files in the order of the lines: their concatenation is the aligned file."""
    bitext.repartitionByRange("line_no").sortWithinPartitions("line_no").select(F.coalesce(text_col, F.lit(""))).write.mode("overwrite").text(path)


def write_sides(bitext: DataFrame, root: str, split: str = "train") -> None:
    """Each pair's two aligned files, {root}/{src}-{tgt}/{split}.{src} and .{tgt}, in the order of the lines; line feeds in texts
    become blanks.  A file is written by one task: large pairs belong into Parquet (write_bitext) or parts (export_lines)."""
    files = Files(bitext.sparkSession, root)
    one = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    sides = F.explode(F.array(*(F.struct(F.col(f"{s}_lang").alias("lang"), one(f"{s}_text").alias("text")) for s in ("src", "tgt"))))
    rows = bitext.select("src_lang", "tgt_lang", "line_no", sides.alias("s")).select(F.concat_ws("-", "src_lang", "tgt_lang").alias("pair"), "s.lang", "s.text", "line_no")
    parked = f"{root}/{split}.parts"
    rows.repartition("pair", "lang").sortWithinPartitions("pair", "lang", "line_no").select("pair", "lang", "text").write.mode("overwrite").partitionBy("pair", "lang").option("maxRecordsPerFile", 0).text(parked)
    for pair in (x for x in files.names(parked) if x.startswith("pair=")):
        files.make(f"{root}/{pair.removeprefix('pair=')}")
        for lang in files.names(f"{parked}/{pair}"):
            (part,) = (x for x in files.names(f"{parked}/{pair}/{lang}") if x.startswith("part-"))
            files.move(f"{parked}/{pair}/{lang}/{part}", f"{root}/{pair.removeprefix('pair=')}/{split}.{lang.removeprefix('lang=')}")
    files.remove(parked)


def write_missing(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the table at path lacks, one for each combination of keys; gives what was appended.  A second run
    so appends nothing."""
    spark, rows = rows.sparkSession, rows.dropDuplicates(keys)
    try:
        done = spark.read.parquet(path).select(*keys)
        rows = rows.join(done, keys, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
    rows.write.mode("append").parquet(path)
    return rows

"""Whole jobs: preparing a corpus for training, and scoring systems.  One lazy plan each, from table to table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.languages import punctuation_language
from weft.functions.punctuation import normalize_corpus
from weft.functions.text import strip, unwrap, wrap_common
from weft.operators import corpus, metrics
from weft.operators.translation import Translator, translate


def _punctuated(df: DataFrame, code_col: str, text_col: str) -> DataFrame:
    told = punctuation_language(df, code_col)
    text = F.col(text_col)
    by_lang = F.when(F.col("punct_lang") == "en", normalize_corpus(text, "en")).otherwise(normalize_corpus(text, "hi"))  # hi and ar share their rules
    return told.withColumn(text_col, by_lang).drop("punct_lang")


def prepare(bitext: DataFrame, benchmark: DataFrame | None = None, most_pieces: int | None = None) -> DataFrame:
    """Bitext made ready: decontaminated, punctuation and digits normalised, entities tagged on the source side, language tags.

    Only decontamination and the distinct step shuffle; all text steps run beside the scan.
    """
    rows = corpus.decontaminate_loose(bitext, benchmark) if benchmark is not None else bitext
    rows = corpus.distinct_pairs(rows)
    rows = _punctuated(_punctuated(rows, "src_lang", "src_text"), "tgt_lang", "tgt_text")
    rows = rows.withColumn("__w", wrap_common(F.col("src_text"), F.col("tgt_text")))
    rows = rows.withColumn("src_text", strip(F.col("__w.src"))).withColumn("tgt_text", unwrap(F.col("__w.tgt"))).drop("__w")
    if most_pieces is not None:
        rows = corpus.length_filter(rows, most_pieces)
    return corpus.add_tags(rows)


def evaluate(predictions: DataFrame, references: DataFrame, keys: list[str] | None = None, tokenize: str = "none") -> DataFrame:
    """(pair, system, metric, value) of predictions (pair, system, line_no, text) against references (pair, line_no, text)."""
    rows = predictions.withColumnRenamed("text", "hyp").join(references.withColumnRenamed("text", "ref"), ["pair", "line_no"])
    return _scored(rows, keys or ["pair", "system"], tokenize)


def _scored(rows: DataFrame, groups: list[str], tokenize: str) -> DataFrame:
    on = [*groups, "line_no"]
    scored = [
        metrics.bleu(metrics.bleu_statistics(rows, on, tokenize), groups).select(*groups, F.lit("bleu").alias("metric"), F.col("bleu").alias("value")),
        metrics.chrf(metrics.chrf_statistics(rows, on), groups).select(*groups, F.lit("chrf").alias("metric"), F.col("chrf").alias("value")),
        metrics.chrf(metrics.chrf_statistics(rows, on, 2), groups).select(*groups, F.lit("chrf++").alias("metric"), F.col("chrf").alias("value")),
    ]
    return reduce(DataFrame.unionByName, scored)


def evaluate_translator(bitext: DataFrame, translator: Translator, pivot: str, tokenize: str = "none") -> DataFrame:
    """(pair, system, metric, value): a translator's scores on bitext from source to target (system forward), from target to source
    (reversed), and, for pairs without the pivot language, from source over the pivot to target (pivoted)."""
    sides = lambda src, tgt: [F.concat_ws("-", f"{src}_lang", f"{tgt}_lang").alias("pair"), "line_no", F.col(f"{src}_lang").alias("src"), F.col(f"{tgt}_lang").alias("tgt"), F.col(f"{src}_text").alias("text"), F.col(f"{tgt}_text").alias("ref")]
    forward, back = bitext.select(*sides("src", "tgt")), bitext.select(*sides("tgt", "src"))
    over = forward.filter((F.col("src") != pivot) & (F.col("tgt") != pivot))
    first = translate(over.withColumn("end", F.col("tgt")).withColumn("tgt", F.lit(pivot)), translator)
    second = translate(first.withColumn("src", F.lit(pivot)).withColumn("tgt", F.col("end")).drop("end"), translator)
    done = {"forward": translate(forward, translator), "reversed": translate(back, translator), "pivoted": second}
    rows = reduce(DataFrame.unionByName, (df.select("pair", F.lit(name).alias("system"), "line_no", F.col("text").alias("hyp"), "ref") for name, df in done.items()))
    return _scored(rows, ["pair", "system"], tokenize)

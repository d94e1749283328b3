"""Sentences by two splitters, whichever finds fewer: one by marks alone, one that knows abbreviations, which are learned from the corpus.

A word that mostly stands before a full stop is an abbreviation.  The evidence is a likelihood ratio: that the stop belongs to the
word (it follows nearly always) against that it is the end of a sentence as it is behind any word.  Long words, and words that often
stand without the stop, need more evidence; stops inside the word lend some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import let, sentences, strip

#: How often the stop follows an abbreviation, and the least evidence for one.
SURE, LEAST = 0.99, 0.3
#: A stop, question or exclamation mark, marks that close a quotation or bracket, and white space: a sentence may end here.
END = r"""(?U)(?<=[.!?]["')\]]{0,3})\s+|\n+"""


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, with_stop, without): how often each word (in lower case, its last full stop off) stands before a full stop and not.

    A word has a letter at its start, and letters, stops and hyphens after it.
    """
    words = texts.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?U)\s+")).alias("token"))
    own = words.select(F.lower(F.regexp_replace("token", r"\.$", "")).alias("word"), F.endswith("token", F.lit(".")).alias("stop"))
    kept = own.filter(F.rlike("word", F.lit(r"^\p{L}[\p{L}.-]*$")))
    return kept.groupBy("word").agg(F.count_if("stop").alias("with_stop"), F.count_if(~F.col("stop")).alias("without"))


def abbreviations(counts: DataFrame, least: float = LEAST) -> DataFrame:
    """(word, evidence) for words that are abbreviations, of word_counts()."""
    all_ = counts.agg(F.sum("with_stop").cast("double").alias("stops"), F.sum(F.col("with_stop") + F.col("without")).cast("double").alias("words")).withColumn("one", F.lit(1))
    rows = counts.filter("with_stop > 0").withColumn("one", F.lit(1)).join(F.broadcast(all_), "one")  # one row
    n, k = (F.col("with_stop") + F.col("without")).cast("double"), F.col("with_stop").cast("double")
    log = lambda p: k * F.log(p) + (n - k) * F.log(1 - p)
    usual = F.least(F.col("stops") / F.col("words"), F.lit(SURE))
    stops = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.length("word") - stops).cast("double")
    evidence = 2 * (log(F.lit(SURE)) - log(usual)) * F.exp(-letters) * (stops + 1) * F.pow(letters, -F.col("without").cast("double"))
    return rows.select("word", evidence.alias("evidence")).filter(F.col("evidence") >= least)


def _parts(text: Column) -> Column:
    """Parts of a text between the places at which a sentence may end, stripped, with soft hyphens taken out."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit("­"), F.lit("")), END), strip), lambda s: s != "")


def _last_word(part: Column) -> Column:
    return F.lower(F.regexp_extract(part, r"(\p{L}[\p{L}.-]*)\.$", 1))


def split_knowing(texts: DataFrame, known: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, sentences): as _parts(), but a part that ends with an abbreviation, or one letter and a stop, goes on with the next one.

    known: abbreviations (word).  They are joined to the last words of parts; how, Spark decides by their size.
    """
    parts = texts.select(*keys, F.posexplode_outer(_parts(F.coalesce(F.col(text_col), F.lit("")))).alias("at", "part")).withColumn("__last", _last_word(F.col("part")))
    open_ = parts.join(known.select(F.col("word").alias("__last")).distinct().withColumn("__known", F.lit(True)), "__last", "left")
    goes_on = (F.coalesce("__known", F.lit(False)) | (F.length("__last") == 1)) & (F.col("__last") != "")
    rows = open_.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("at", "part", goes_on.alias("on"))))).alias("p"))  # of one text
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, x: Column) -> Column:
        own = F.when(a["open"] == "", x["part"]).otherwise(F.concat(a["open"], F.lit(" "), x["part"]))
        return F.struct(F.when(x["on"], a["done"]).otherwise(F.concat(a["done"], F.array(own))).alias("done"), F.when(x["on"], own).otherwise("").alias("open"))

    ended = lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
    return rows.select(*keys, F.aggregate("p", empty, step, ended).alias("sentences"))


def split_fewer(texts: DataFrame, keys: list[str], text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(keys, by, sentences): of both splitters' sentences the fewer, by marks where they are as many.  by: marks or words.

    keys tell the rows apart.  known: abbreviations (word); those of the texts themselves unless given.
    """
    told = known if known is not None else abbreviations(word_counts(texts, text_col))
    second = split_knowing(texts, told, keys, text_col).withColumnRenamed("sentences", "__second")
    both = texts.select(*keys, sentences(F.coalesce(F.col(text_col), F.lit(""))).alias("__first")).join(second, keys)
    chosen = let(F.size("__second") < F.size("__first"), lambda less: F.struct(F.when(less, "words").otherwise("marks").alias("by"), F.when(less, F.col("__second")).otherwise(F.col("__first")).alias("sentences")))
    return both.select(*keys, chosen.alias("c")).select(*keys, "c.by", "c.sentences")

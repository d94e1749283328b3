"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob, named by the SHA-256 of its UTF-8 bytes.  The ledger is a Parquet table of (blob, rules,
spans) in a folder the cluster shares: one row for each blob that was scanned under a rule version.  A scan takes the
distinct blobs of its documents, leaves out those that the ledger holds for this rule version, scans the rest, appends their
findings in one commit, and joins the ledger's findings back to all documents (all paths and versions) with that content.

Documents in which no rule can match are told by a cheap test while they are read (may_match).  Their blobs go to the ledger
with an empty list, and their texts are not moved; only the others are brought together by blob and joined to findings.

A null text counts as empty; empty and very long texts are blobs like any other and are scanned whole.  Documents without
findings are in the ledger too, with an empty list.  Repeated rows and copies share one blob and each get its findings.  Ties:
findings that start alike are in the order of their kinds.  An empty table gives an empty table and leaves the ledger as it
was.  All columns of the input pass through scan() under their own names; where it has columns blob or spans, the added ones
get an underscore.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.spans import SPAN, spans_of
from weft.llm.common import free_names, save, text_or_empty

KINDS = ["assign", "access", "hex"]
RULES = "secrets-1"
#: The patterns of the three kinds.  Minimum lengths that a longest match fails or passes as a whole are in
#: the pattern; the value of an assignment is measured afterwards, as a match that is too short still uses up its text.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"


def find(text: Column) -> Column:
    """All findings of a text, by start and kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12
    return F.sort_array(F.concat(spans_of(text, 0, ASSIGN, value), spans_of(text, 1, ACCESS, hint=F.contains(text, F.lit("AKIA"))), spans_of(text, 2, HEX)))


def ledger(spark, path: str) -> DataFrame:
    """The ledger's rows; empty where nothing was written yet."""
    schema = f"blob string, rules string, spans {SPAN}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def may_match(text: Column) -> Column:
    """What every text with a finding fulfils: plain searches first, which spare most texts the patterns."""
    low = F.lower(text)
    named = reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in ("password", "passwd", "secret", "token", "api_key", "apikey")))
    assigned = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
    return (named & F.rlike(text, F.lit(assigned))) | F.contains(text, F.lit("AKIA")) | F.rlike(text, F.lit("(?<![0-9a-f])[0-9a-f]{16}"))


def scan(docs: DataFrame, path: str, rules: str = RULES, text_col: str = "text", finder: Callable[[Column], Column] = find, may: Callable[[Column], Column] = may_match) -> DataFrame:
    """docs and, last, columns blob and spans; the ledger at path holds their blobs afterwards.

    finder, may: the rules, and a test that every text with a finding passes.
    """
    spark, (blob, spans) = docs.sparkSession, free_names(docs.columns, "blob", "spans")
    named = docs.withColumn(blob, F.sha2(text_or_empty(text_col), 256))
    open_, clean = named.filter(may(text_or_empty(text_col))), named.filter(~may(text_or_empty(text_col)))
    seen = ledger(spark, path).filter(F.col("rules") == rules).select("blob")
    # one pass: the texts of documents in which no rule can match stay behind, and their blobs have no findings
    texts = named.select(F.col(blob).alias("blob"), F.when(may(text_or_empty(text_col)), text_or_empty(text_col)).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    spans_ = F.when(F.col("text").isNull(), F.array().cast(SPAN)).otherwise(finder(F.col("text"))).cast(SPAN)
    texts.join(seen, "blob", "left_anti").select("blob", F.lit(rules).alias("rules"), spans_.alias("spans")).write.mode("append").parquet(path)
    held = ledger(spark, path).filter(F.col("rules") == rules)
    # a commit that was repeated after a lost driver may have left a blob twice
    once = held.filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    found = save(once.toDF(blob, spans), "findings")  # a table of its own, so that Spark can split the rows of a blob with many copies in the join
    told = open_.join(found, blob, "left").select(*docs.columns, blob, F.coalesce(spans, F.array().cast(SPAN)).alias(spans))
    return told.unionByName(clean.select(*docs.columns, blob, F.array().cast(SPAN).alias(spans)))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal run of overlapping spans replaced by mark."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(a["out"], text.substr(a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.when(s["start"] >= a["at"], mark).otherwise(""))
        return F.struct(F.when(s["stop"] > a["at"], new).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["stop"]).alias("at"))

    done = F.aggregate(F.sort_array(spans), zero, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)

"""A training corpus from raw documents: quality rules, exact and near deduplication, secret redaction, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; run() writes each
result as Parquet and rereads it as the next stage's docs, and removes what the stage before it wrote.  All but the last return
the columns of documents, whatever further columns and names these have.

Null and empty texts fail the quality rules.  Should a later stage meet them (stages may be called on any documents) they count
as equal, hold no secrets and are packed as an end token.  Very long texts are read whole in every stage.  Repeated rows are
copies: one stays.  Ties between copies go to the longest original, then to the smallest id; of near copies the smallest id
stays, null ids last.  An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import exact_dedup, packing, quality, secrets, simhash
from weft.llm.common import discard, numbered, scratch_path, settle
from weft.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    judged = quality.apply_rules(docs)
    return judged.filter(F.col(judged.columns[-1])).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    held, row = numbered(docs)
    stays = exact_dedup.exact_groups(held, row_col=row).filter("kept").select(row)
    return held.join(stays, row, "left_semi").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles with a similarity of 0.8 or more."""
    ship(spark)
    held, row = numbered(docs)
    groups = simhash.similar_groups(held, row, whole=True).join(held.select(row, F.col("doc_id").alias("id")), row)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(row).alias("at"))).alias("least")
    stays = groups.groupBy("component").agg(least).select(F.col("least.at").alias(row))
    return held.join(stays, row, "left_semi").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted again."""
    found = secrets.scan(docs, scratch_path(spark, "ledger"))
    spans = F.col(found.columns[-1])
    clean = F.when(F.size(spans) > 0, secrets.redact(F.col("text"), spans)).otherwise(F.col("text"))
    count = F.when(F.size(spans) > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*(clean.alias(c) if c == "text" else count.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens placed in sequences."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("simhash near-dedup", near), ("secret scans", secret_scan), ("packing", pack)]

#: Learned thresholds, fingerprints and tokenizers are out of SQL's reach: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs, path = settle(spark, lambda: stage(spark, docs, sf_dir), "stage")
        discard(spark, [last] if last else [])
        last = path
    return docs

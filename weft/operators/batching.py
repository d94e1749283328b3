"""Batches under a budget of tokens: texts of like length together, and none padded beyond the budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.corpus import _ranked

#: Tokens of a batch with its padding: as many as its texts, times those of its longest text.
BUDGET = 9216


def _cuts(by: str, budget: int):
    """Where batches begin, for a table of lengths: of each length its first rank, the rank at which the first batch that begins among
    its texts does, that batch's number, and how many texts such a batch takes."""

    def run(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("__size", ascending=False)
        rank = begins = number = 0
        out = []
        for key, size, n in lengths[[by, "__size", "__n"]].itertuples(index=False):
            fits = max(1, budget // max(1, size))
            out.append((key, size, rank, begins, number, fits))
            rank += n
            if begins < rank:
                more = -(-(rank - begins) // fits)
                begins, number = begins + more * fits, number + more
        return pd.DataFrame(out, columns=[by, "__size", "__rank", "__begins", "__number", "__fits"])

    return run


def token_batches(rows: DataFrame, size: str, budget: int = BUDGET, by: str = "pair", order: str = "line_no") -> DataFrame:
    """rows and batch: consecutive numbers within each value of `by`, the longest texts first, as many as the budget takes with padding.

    A batch begins with its longest text, which tells how many texts it takes: so the batches follow from how many texts of each
    length there are, a row for each length, and a text's batch from its rank among the texts of its length.  Texts are ranked by
    blocks of `order` (a whole number; what is equal in it comes in any order), so no task holds all texts of a common length.  A
    text longer than the budget is a batch of its own.
    """
    held = rows.withColumn("__size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))).withColumn("__class", F.concat_ws(" ", F.col("__size"), F.col(by)))
    lengths = held.groupBy(by, "__size").agg(F.count("*").alias("__n"))
    kind = dict(rows.dtypes)[by]
    cuts = lengths.groupBy(by).applyInPandas(_cuts(by, budget), f"`{by}` {kind}, __size long, __rank long, __begins long, __number long, __fits long")  # rows: lengths
    placed = _ranked(held, "__class", order, "__place").withColumnRenamed(by, "__by")
    same = F.col("__by").eqNullSafe(F.col(by)) & (F.col("__own") == F.col("__size"))
    told = placed.withColumnRenamed("__size", "__own").join(cuts, same)
    rank = F.col("__rank") + F.col("__place")
    batch = F.when(rank < F.col("__begins"), F.col("__number") - 1).otherwise(F.col("__number") + F.floor((rank - F.col("__begins")) / F.col("__fits")))
    return told.select(*(F.col("__by").alias(by) if c == by else F.col(c) for c in rows.columns), batch.cast("long").alias("batch"))


def padding(batched: DataFrame, size: str, by: str = "pair") -> DataFrame:
    """(by, batch, texts, tokens, padded, waste): of each batch its texts, their tokens, those with padding, and the share of padding."""
    own = F.coalesce(F.col(size).cast("long"), F.lit(0))
    sums = batched.groupBy(by, "batch").agg(F.count("*").alias("texts"), F.sum(own).alias("tokens"), (F.count("*") * F.max(own)).alias("padded"))
    return sums.withColumn("waste", F.when(F.col("padded") > 0, 1 - F.col("tokens") / F.col("padded")).otherwise(0.0))

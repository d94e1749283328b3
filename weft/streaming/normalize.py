"""Streams of lines: normalising, decontamination against a fixed benchmark, and translation by micro-batch.

None of them keeps state, so no watermark is needed and a stream may run forever.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.functions.punctuation import normalize_request
from weft.functions.text import loose_key, wrap
from weft.operators.translation import Translator, translate_routed


def normalized(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines with punctuation and digits normalised and entities tagged."""
    return lines.withColumn(text_col, wrap(normalize_request(F.col(text_col))))


def decontaminated(lines: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines whose loose key no text of the static benchmark (column text) has."""
    pool = benchmark.select(loose_key(F.col("text")).alias("__key")).distinct()
    keyed = lines.withColumn("__own", loose_key(F.coalesce(text_col, F.lit(""))))
    return keyed.join(pool, F.col("__own") == F.col("__key"), "left_anti").drop("__own")


def translated(requests: DataFrame, translator: Translator, direct: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Translate each micro-batch of requests (src, tgt, text) and hand it to sink(batch, number)."""

    def each(batch: DataFrame, number: int) -> None:
        sink(translate_routed(batch, translator, direct), number)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

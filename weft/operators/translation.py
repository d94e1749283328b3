"""Translation around a pluggable batch translator: split, chunk, translate, put together again."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.languages import hops
from weft.functions.text import chunks, placeholders, restore, sentences
from weft.operators.batching import BUDGET, token_batches

#: Takes texts, source and target language; gives as many texts.
Translator = Callable[[Sequence[str], str, str], Sequence[str]]


def echo(texts: Sequence[str], src: str, tgt: str) -> list[str]:
    """A translator for tests: the target language in front."""
    return [f"{tgt}: {t}" for t in texts]


def _by_direction(texts: pd.Series, src: pd.Series, tgt: pd.Series, translator: Translator, batch: int) -> pd.Series:
    done = pd.Series(index=texts.index, dtype=object)
    for (a, b), own in texts.groupby([src, tgt], sort=False):
        order = own.str.len().sort_values(kind="stable").index
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            done.loc[at] = list(translator(own.loc[at].tolist(), a, b))
    return done


def translate(rows: DataFrame, translator: Translator, batch: int = 128, text_col: str = "text") -> DataFrame:
    """rows with text_col translated from column src to column tgt; the translator gets up to `batch` texts of one direction.

    Within an Arrow batch texts of like length go together, and results return to their rows.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:  # other columns, lists among them, stay in Arrow
            done = _by_direction(*(part.column(c).to_pandas() for c in (text_col, "src", "tgt")), translator, batch)
            yield part.set_column(part.schema.get_field_index(text_col), text_col, pa.array(done, pa.string(), from_pandas=True))

    return rows.mapInArrow(run, rows.schema)


def explode_paragraphs(paragraphs: DataFrame, text_col: str = "text", words: int = 256) -> DataFrame:
    """One row (…, sentence_no, chunk_no, text) for each chunk of at most `words` words of each sentence."""
    keep = [c for c in paragraphs.columns if c != text_col]
    by_sentence = paragraphs.select(*keep, F.posexplode(sentences(F.col(text_col))).alias("sentence_no", "sentence"))
    parts = F.transform(chunks(F.split("sentence", " ", -1), words), lambda c: F.array_join(c, " "))
    return by_sentence.select(*keep, "sentence_no", F.posexplode(parts).alias("chunk_no", text_col))


def reassemble(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Texts of each key joined by blanks, in the order of sentence and chunk."""
    ordered = F.sort_array(F.collect_list(F.struct("sentence_no", "chunk_no", text_col)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[text_col]), " ").alias(text_col))


def translate_paragraphs(paragraphs: DataFrame, translator: Translator, keys: list[str], text_col: str = "text") -> DataFrame:
    """Paragraphs (keys, src, tgt, text) translated; entities travel as placeholders.  A paragraph without text stays so."""
    rows = explode_paragraphs(paragraphs.select(*keys, "src", "tgt", text_col), text_col)
    rows = rows.withColumn("__p", placeholders(F.col(text_col))).withColumn(text_col, F.col("__p.text")).withColumn("__e", F.col("__p.entities")).drop("__p")
    done = translate(rows, translator, text_col=text_col)
    done = done.withColumn(text_col, restore(F.col(text_col), F.col("__e"))).drop("__e")
    joined = reassemble(done, keys, text_col).withColumnRenamed(text_col, "__done")
    return paragraphs.select(*keys).join(joined, keys, "left").select(*keys, F.coalesce("__done", F.lit("")).alias(text_col))


def translate_routed(requests: DataFrame, translator: Translator, direct: list[str], text_col: str = "text", batch: int = 128) -> DataFrame:
    """Requests translated by the model that covers them, or over the pivot in two steps; a pair no model covers is an error."""
    step = hops(F.col("src"), F.col("tgt"), direct)
    names = requests.columns
    rows = requests.select(*names, *(F.get(step, i)[side].alias(f"__{side}{i}") for i in range(2) for side in ("src", "tgt")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(2):  # both hops in one pass, so nothing is translated twice
                active = part[part[f"__src{i}"].notna()]
                part = part.assign(**{text_col: part[text_col].where(part[f"__src{i}"].isna(), _by_direction(active[text_col], active[f"__src{i}"], active[f"__tgt{i}"], translator, batch))})
            yield part[names]

    return rows.mapInPandas(run, requests.schema)


def translate_in_batches(rows: DataFrame, translator: Translator, size: str, budget: int = BUDGET, text_col: str = "text", order: str = "line_no") -> DataFrame:
    """rows with text_col translated from column src to column tgt; the translator gets batches under a budget of tokens (column size).

    Batches are cut over the whole table, not within what a task happens to hold, and each is one call.
    """
    directed = rows.withColumn("__way", F.concat_ws(" ", "src", "tgt"))
    batched, names = token_batches(directed, size, budget, "__way", order), rows.columns

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return batch[names]
        return batch.assign(**{text_col: list(translator(batch[text_col].tolist(), batch["src"].iloc[0], batch["tgt"].iloc[0]))})[names]

    return batched.groupBy("__way", "batch").applyInPandas(run, rows.schema)  # a group has `budget` tokens at most


def split_constraints(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines with the phrases that stand behind their text, between tabs, in column constraints."""
    part = F.split(F.coalesce(F.col(text_col), F.lit("")), "\t", -1)
    return lines.withColumn("constraints", F.slice(part, 2, F.size(part))).withColumn(text_col, F.get(part, F.lit(0)))


def met_constraints(rows: DataFrame, text_col: str = "text", constraints_col: str = "constraints", to: str = "met") -> DataFrame:
    """rows and, of each row's constraint phrases, those that its text holds, in their order.

    The phrases of all rows of an Arrow batch make one trie with failure links, so a text is read once however many phrases there
    are.  A phrase that is empty or null is never met; a null text meets none.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for part in parts:
            asked = [[c for c in x or [] if c] for x in part.column(constraints_col).to_pylist()]
            trie = ahocorasick.Automaton()
            for phrase in {c for x in asked for c in x}:
                trie.add_word(phrase, phrase)
            if len(trie):
                trie.make_automaton()
            held = [{phrase for _, phrase in trie.iter(t)} if x and t else set() for t, x in zip(part.column(text_col).to_pylist(), asked, strict=True)]
            met = pa.array([[c for c in x if c in own] for x, own in zip(asked, held, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns, met], [*part.schema.names, to])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(to, T.ArrayType(T.StringType()))]))


def best_hypotheses(hypotheses: DataFrame, n: int = 1) -> DataFrame:
    """The n hypotheses (id, score, hyp) of highest score for each sentence; ties by text."""
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "hyp")
    return hypotheses.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def fill_missing(ids: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(id, hyp) for every id; a sentence without a hypothesis is blank, of several the last (column at) counts."""
    last = hypotheses.groupBy("id").agg(F.max_by("hyp", "at").alias("hyp"))
    return ids.join(last, "id", "left").select("id", F.coalesce("hyp", F.lit("")).alias("hyp"))

"""Language identification by unigrams over a fixed vocabulary, marginalised over segmentations.

A language is a probability for every piece of a public vocabulary, in lower case.  The probability of a word is the sum, over
all ways to cut it into pieces, of the products of their probabilities: a forward pass over its characters.  The probabilities
are learned by expectation-maximisation: Spark counts words per language, tasks run forward-backward passes over words and give
expected piece counts, and Spark adds these up per language and piece.  A text's score for a language is the sum of its
words' log probabilities, each word being worked out once a task.  All pieces and whole words are used, however long.

Bounds: about `per_lang` labelled documents of each language are learned from (taken by a hash of their id), and the model has
one row for each piece and language: what is broadcast and collected grows with the number of labels, not with the documents.
Prediction reads whole texts of all documents.

A word is a run of letters.  A null text, or one without a letter, gives `und` and score 0.  Documents without a language are
not learned from.  Ties go to the first language in order of name.  Repeated rows each give a row.  An empty table gives an
empty table; if nothing can be learned all predictions are `und`.  Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.llm.common import save, slices, text_or_empty

#: Words that a task keeps; longest word that a pass over many words at once takes, and by what each character scales it up.
MOST_KNOWN, LONG_WORD, SCALE = 300_000, 60, 256.0
LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"


class Vocabulary:
    """Pieces that words can use, by number; number 0 stands for any other single character, -1 for no piece.

    Pieces of k characters are looked up by a hash of their code points among the sorted hashes of that length; a hit is
    compared with the piece itself.
    """

    def __init__(self, numbers: dict[str, int]):
        self.sizes = np.ones(len(numbers) + 1)
        self.most = max(map(len, numbers), default=1)
        self.by_size = []
        for k in range(1, self.most + 1):
            own = [p for p in numbers if len(p) == k]
            number, points = np.array([numbers[p] for p in own], np.int64), _points(own, k)
            hashes = functools.reduce(lambda h, j: _extended(h, points[:, j]), range(k), np.zeros(len(own), np.uint64))
            order = np.argsort(hashes)
            self.by_size.append((hashes[order], points[order], number[order]))
            self.sizes[number] = k

    def __len__(self) -> int:
        return len(self.sizes) - 1

    def cells(self, own: list[str]) -> np.ndarray:
        """For words of one length m: the piece at [start, start + k), as (word, start, k - 1)."""
        m = len(own[0])
        points = _points(own, m)
        out = np.full((len(own), m, min(m, self.most)), -1, np.int32)
        h = np.zeros((len(own), m), np.uint64)
        for k in range(1, out.shape[2] + 1):
            h = _extended(h[:, : m - k + 1], points[:, k - 1 :])
            hashes, known, numbers = self.by_size[k - 1]
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                word, start = np.nonzero(hashes[at] == h)
                at = at[word, start]
                same = np.logical_and.reduce([known[at, j] == points[word, start + j] for j in range(k)])
                out[word[same], start[same], k - 1] = numbers[at[same]]
            if k == 1:
                out[:, :, 0] = np.maximum(out[:, :, 0], 0)
        return out


def _points(texts: list[str], size: int) -> np.ndarray:
    """Code points (text, character) of texts of one length."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), size)


def _extended(h: np.ndarray, point: np.ndarray) -> np.ndarray:
    return (h + point + np.uint64(1)) * np.uint64(6364136223846793005)


@functools.lru_cache(1)
def pieces(model: str) -> Vocabulary:
    """All pieces of the tokenizer's vocabulary but its control, unknown and byte pieces."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model)
    names = {own.id_to_piece(i).lower() for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))}
    return Vocabulary({p: i + 1 for i, p in enumerate(sorted(names - {""}))})


def words(text: str) -> list[str]:
    """Words of letters in lower case, each with the vocabulary's mark for a word's start."""
    out = []
    for w in LETTERS.findall(text.lower()):
        if w.isalpha():
            out.append("▁" + w)
        else:  # numbers that are no digits, as ² and Ⅷ
            out += ["▁" + x for x in "".join(c if c.isalpha() else " " for c in w).split()]
    return out


def _forward(cells: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """Forward sums (word, position, language), SCALE times larger for each character.

    scaled: (piece, language) times SCALE by the piece's length, a last row of zeros for no piece.
    """
    n, m, most = cells.shape
    alpha = np.zeros((n, m + 1, scaled.shape[1]))
    alpha[:, 0] = 1.0
    for i in range(m):
        for k in range(1, min(most, m - i) + 1):
            own = cells[:, i, k - 1]
            if k <= 2:
                alpha[:, i + k] += alpha[:, i] * scaled[own]
            elif len(hit := np.flatnonzero(own >= 0)):  # longer pieces are few
                alpha[hit, i + k] += alpha[hit, i] * scaled[own[hit]]
    return alpha


def _log_forward(cells: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Logarithms of the forward sums (position, language) of one word of any length. logs: (piece, language), minus infinity for no piece."""
    m, most = cells.shape
    alpha = np.full((m + 1, logs.shape[1]), -np.inf)
    alpha[0] = 0.0
    for j in range(1, m + 1):
        ks = np.arange(1, min(most, j) + 1)
        alpha[j] = np.logaddexp.reduce(alpha[j - ks] + logs[cells[j - ks, ks - 1]], axis=0)
    return alpha


def _scaled(probability: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    return probability * SCALE ** np.r_[vocabulary.sizes, 0.0][:, None]


def _logs(probability: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(probability)


def by_length(own: list[str]) -> Iterator[list[int]]:
    """Places of words of one length, so many that the arrays over them stay small."""
    groups = defaultdict(list)
    for i, w in enumerate(own):
        groups[len(w)].append(i)
    for m, at in groups.items():
        most = 1 if m > LONG_WORD else max(1, 400_000 // (m * 16))
        yield from (at[i : i + most] for i in range(0, len(at), most))


def log_probabilities(own: list[str], probability: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """(word, language): log of the summed probability of all segmentations."""
    out, scaled, logs = np.empty((len(own), probability.shape[1])), _scaled(probability, vocabulary), _logs(probability)
    for lot in by_length(own):
        m = len(own[lot[0]])
        cells = vocabulary.cells([own[i] for i in lot])
        out[lot] = np.log(_forward(cells, scaled)[:, -1]) - m * np.log(SCALE) if m <= LONG_WORD else _log_forward(cells[0], logs)[-1]
    return out


def _word_counts(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def given() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own)), pa.array(list(own.values()), pa.int64())], schema=schema)

        for part in slices(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                held[lang].update(words(text))
            if sum(map(len, held.values())) > MOST_KNOWN:
                yield from given()
                held.clear()
        yield from given()

    return run


def _expected(model: str, langs: list[str], probability, schema: pa.Schema):
    """Expected piece counts of (lang, word, n) rows under the present probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, p = pieces(model), probability.value
        total = np.zeros((len(langs), len(vocabulary) + 1))
        for part in batches:
            groups = defaultdict(lambda: ([], []))
            for lang, word, n in zip(*(part.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                groups[lang][0].append(word)
                groups[lang][1].append(n)
            for lang, (own, n) in groups.items():
                at = langs.index(lang)
                total[at] += expected(own, np.array(n, float), p[:, [at]], vocabulary)
        lang, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in lang], pa.string()), pa.array(piece.astype(np.int32)), pa.array(total[lang, piece])], schema=schema)

    return run


def expected(own: list[str], n: np.ndarray, probability: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """How often each piece is expected in words that occur n times each, over all segmentations. probability: (piece, 1)."""
    total, scaled, logs = np.zeros(len(vocabulary) + 1), _scaled(probability, vocabulary), _logs(probability)
    for lot in by_length(own):
        cells = vocabulary.cells([own[i] for i in lot])
        m, most = cells.shape[1:]
        if m > LONG_WORD:
            # a word from its end is a word whose pieces end where they begin
            ends = np.full_like(cells[0], -1)
            for k in range(1, most + 1):
                ends[: m - k + 1, k - 1] = cells[0, m - k :: -1, k - 1]
            alpha, beta = (_log_forward(c, logs)[:, 0] for c in (cells[0], ends))
            start, k = np.nonzero(cells[0] >= 0)
            own_piece = cells[0, start, k]
            gain = np.exp(alpha[start] + logs[own_piece, 0] + beta[m - start - k - 1] - alpha[m])
            total += np.bincount(own_piece, n[lot[0]] * gain, len(total))
            continue
        alpha = _forward(cells, scaled)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[:, m] = 1.0
        for a in range(m - 1, -1, -1):
            for k in range(1, min(most, m - a) + 1):
                beta[:, a] += scaled[cells[:, a, k - 1], 0] * beta[:, a + k]
        word, start, k = np.nonzero(cells >= 0)
        own_piece = cells[word, start, k]
        gain = (n[lot] / alpha[:, m])[word] * alpha[word, start] * scaled[own_piece, 0] * beta[word, start + k + 1]
        total += np.bincount(own_piece, gain, len(total))
    return total


def fit(labelled: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 3000, rounds: int = 2) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and probabilities (piece, language) with a last row of zeros."""
    base = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in base.groupBy(lang_col).agg(F.count("*")).collect()}  # a row for each language
    langs = sorted(sizes)
    vocabulary = pieces(model)
    n, width = len(langs), len(vocabulary) + 1
    p = np.vstack([np.full((width, n), 1.0 / width), np.zeros((1, n))])
    if not langs:
        return langs, p
    share = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    bound = F.lit(0.0)
    for lang, size in sizes.items():
        bound = F.when(F.col(lang_col) == lang, min(1.0, per_lang / size)).otherwise(bound)
    counts = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    sample = base.filter(share < bound).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = save(sample.mapInArrow(_word_counts(to_arrow_schema(counts)), counts).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    gained = T.StructType([T.StructField("lang", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("n", T.DoubleType())])
    spark = labelled.sparkSession
    number = {x: i for i, x in enumerate(langs)}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)
        rows = counted.mapInArrow(_expected(model, langs, shared, to_arrow_schema(gained)), gained).groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        p = np.full((width, n), 0.05)  # every piece keeps a little
        p[rows["piece"].to_numpy(), rows["lang"].map(number).to_numpy()] += rows["n"].to_numpy()
        p = np.vstack([p / p.sum(axis=0), np.zeros((1, n))])
    return langs, p


def _predict(model: str, langs: list[str], probability, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, p = pieces(model), probability.value
        number: dict[str, int] = {}
        known = np.zeros((0, len(langs)))
        for part in slices(batches, "text"):
            texts = [Counter(words(t)) for t in part.column("text").to_pylist()]
            new = list({w for t in texts for w in t if w not in number})
            if len(number) + len(new) > MOST_KNOWN:
                number, known, new = {}, known[:0], list({w for t in texts for w in t})
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            known = np.vstack([known, log_probabilities(new, p, vocabulary)]) if new else known
            best, score = [], []
            for t in texts:
                if not t or not langs:
                    best.append(UND)
                    score.append(0.0)
                    continue
                total = np.fromiter(t.values(), float, len(t)) @ known[np.fromiter(map(number.__getitem__, t), np.int64, len(t))]
                at = int(total.argmax())
                best.append(langs[at])
                score.append(float(1.0 / np.exp(total - total[at]).sum()))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, fitted: tuple[list[str], np.ndarray], model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row; score: the posterior of lang_pred under equal priors."""
    langs, p = fitted
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(p)
    return base.mapInArrow(_predict(model, langs, shared, None), schema).withColumnRenamed("id", id_col)

"""Spelling variants: words that one edit turns into another word, found by their rarest bigrams.

A word is a maximal run of letters (A-Z in lower case).  Two words are near if they differ by exactly one inserted, deleted or
replaced code point.  One edit touches two bigrams of a word at most.  In one order for all words (by the bigram's frequency among
words, the bigram, its place) the first bigram that the edit leaves alone is therefore among the three first of both words, so
only the three rarest of each word are joined.  The places of that bigram differ by one at most, and the edit is before or behind
it, in the first or the second half of what is there.  Entries are joined by the bigram, what is the same in each of these four
cases (the other side, which fixes the place, and the other half) and the shorter word's length; so only words that are alike in
half of their letters meet, however common their bigrams are.  What meets is verified by its edit distance.

A word's form is its near word of the largest count, if that is `times` the word's own count or more; its root is the end of the
chain of forms.  Counts grow along a chain, so it ends, and rounds of pointer doubling follow it.

Each task adds up its own words before the shuffle, so frequent words do no harm.  The order of bigrams is sent to the tasks: with
90 letters it has 8,100 entries at most, whatever the data.  A null text has no words; a null id counts as an empty one.  Very
long texts and runs are taken whole.  Ties for the form go to the smallest word by code points.  Repeated rows each count.  An
empty table gives an empty table.  Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import save, slices, text_or_empty

#: Bigrams of a word that one edit leaves alone are among so many of its rarest.
RAREST = 3
#: Words that a task holds before it gives their counts.
MOST = 400_000


def _runs(chars: int, drop_every: int | None):
    run_ = re.compile(f"[A-Za-zÀ-ÿ]{{{chars},}}")

    def given(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in slices(batches, "text"):
            for name, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                head = zlib.crc32(f"{name}:".encode())
                for word, k in Counter(run_.findall(text.lower().decode())).items():  # bytes in lower case: A-Z only
                    if drop_every and not (h := zlib.crc32(word.encode(), head)) % drop_every:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < chars:
                            continue
                    counts[word] += k
            if len(counts) >= MOST:
                yield given(counts)
                counts = Counter()
        if counts:
            yield given(counts)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = 7, least: int = 2, drop_every: int | None = None) -> DataFrame:
    """(word, n): words of `chars` code points or more that occur `least` times or more.

    drop_every: of a run whose crc32 of `<id>:<run>` it divides, the code point at that crc32 modulo the length is left out.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    counted = base.mapInArrow(_runs(chars, drop_every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


def bigrams(words: DataFrame) -> DataFrame:
    """(gram, n): in how many places of the words each bigram is."""
    letters = F.split("word", "", -1)
    both = words.select(F.filter(letters, lambda c: c != "").alias("c")).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.concat(F.get("c", i), F.get("c", i + 1)))).alias("gram"))
    return both.groupBy("gram").agg(F.count("*").alias("n"))


def halves(word: str, i: int) -> Iterator[tuple[int, str, bool]]:
    """(key, whether the word is the longer one of its pair) for the bigram at place i: what is alike in words that one edit, away from it, turns into another.

    The shorter word of a pair (either, if both are as long) has `size` code points.  The edit is before the bigram or behind it,
    and in the first or in the second half of what is there; the other half, the bigram and the other side are the same.
    """
    for size in (len(word), len(word) - 1):
        behind, before = size - i - 2, size - (len(word) - i)
        longer = size < len(word)
        if behind >= 0:
            half = behind // 2
            yield size, f"1{word[: i + 2 + half]}", longer
            yield size, f"2{word[: i + 2]} {word[len(word) - behind + half :]}", longer
        if before >= 0:
            half = before // 2
            yield size, f"3{word[:half]} {word[i:]}", longer
            yield size, f"4{word[i - (before - half) if longer else half :]}", longer


def _entries(rank: dict[str, int]):
    """(key, word, longer): each word with its rarest bigrams, each together with what an edit may have left alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches, "word", 1 << 18):
            keys, at, longer = [], [], []
            for k, word in enumerate(part.column("word").to_pylist()):
                rarest = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))[:RAREST]
                own = {(f"{size}:{x}", more) for _, i in rarest for size, x, more in halves(word, i)}
                keys += [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x, _ in own]
                longer += [more for _, more in own]
                at += [k] * len(own)
            words = part.column("word").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), words, pa.array(longer, pa.bool_())], ["key", "word", "longer"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) for all near words a < b of the table words (word, n)."""
    order = bigrams(words).orderBy("n", "gram").collect()  # 8,100 rows at most
    ranks = {r["gram"]: k for k, r in enumerate(order)}
    entries = save(words.mapInArrow(_entries(ranks), "key long, word string, longer boolean"), "entries")
    a, b = (entries.select("key", F.col("word").alias(x), F.col("longer").alias(f"longer_{x}")) for x in "ab")
    met = a.filter("not longer_a").join(b, "key").filter(F.col("longer_b") | (F.col("a") < F.col("b")))
    near = met.filter(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form: the last word of its chain."""
    now = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = save(now.select("word", "root").join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = 7, least: int = 2, times: int = 10, drop_every: int | None = None) -> DataFrame:
    """(word, form, root string; n, n_near, form_n long) for each word."""
    words = save(vocabulary(docs, id_col, text_col, chars, least, drop_every), "words")
    pairs = save(near_pairs(words), "pairs")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    best = sides.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    told = words.join(best, "word", "left")
    has = -F.col("best.m") >= times * F.col("n")
    told = save(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")), "forms")
    roots = _roots(told.filter("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

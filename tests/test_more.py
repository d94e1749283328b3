"""Batches under a budget, sentences, scripts, constraints and comparisons against plain versions, and odd rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from weft.functions import scripts
from weft.functions import text as tx
from weft.operators import batching, corpus, metrics, sentences, translation


def greedy(rows, budget):
    """rows: (pair, line_no, size); {line_no: batch}, longest first, a batch as large as its first text allows."""
    out, heads = {}, {}
    for pair, n, size in sorted(rows, key=lambda r: (str(r[0]), -max(r[2] or 0, 0), r[1])):
        batch, left = heads.get(pair, (-1, 0))
        if not left:
            batch, left = batch + 1, max(1, budget // max(1, size or 0))
        out[n] = batch
        heads[pair] = (batch, left - 1)
    return out


@pytest.mark.parametrize("budget", [1, 7, 100, 9216])
def test_token_batches(spark, budget):
    r = random.Random(budget)
    rows = [(r.choice(["a", "b", "b", None]), n, r.choice([0, 1, 2, 3, 3, 3, 9, 40, 300, None])) for n in range(400)]
    got = batching.token_batches(spark.createDataFrame(rows, "pair string, line_no long, size int").repartition(5), "size", budget)
    assert got.columns == ["pair", "line_no", "size", "batch"]
    held = got.collect()
    assert {x["line_no"]: x["batch"] for x in held} == greedy(rows, budget) and len(held) == 400
    for x in batching.padding(got, "size").collect():
        assert x["padded"] <= max(budget, max(s or 0 for *_, s in rows)) and (x["texts"] == 1 or x["padded"] <= budget) and x["tokens"] <= x["padded"]
    assert batching.token_batches(spark.createDataFrame([], "pair string, line_no long, size int"), "size").collect() == []


def test_batches_of_many_texts_of_one_length(spark, monkeypatch):
    """Ranks are shifted by the blocks before, so batches run on from block to block."""
    import functools

    monkeypatch.setattr(batching, "_ranked", functools.partial(corpus._ranked, block=16))
    rows = [("a", 3 * n, 5 if n % 9 else 6) for n in range(200)]
    got = batching.token_batches(spark.createDataFrame(rows, "pair string, line_no long, size int"), "size", 35)
    assert {x["line_no"]: x["batch"] for x in got.collect()} == greedy(rows, 35)


def test_a_translator_gets_whole_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(texts, src, tgt):
        calls.add(1)
        return [f"{tgt}: {t}" for t in texts]

    rows = [(n, "en", "hi" if n % 3 else "ta", "w " * (n % 10), n % 10) for n in range(90)]
    df = spark.createDataFrame(rows, "line_no long, src string, tgt string, text string, size int").repartition(7)
    got = {x["line_no"]: x["text"] for x in translation.translate_in_batches(df, counted, "size", 60).collect()}
    assert got == {n: f"{t}: {x}" for n, _, t, x, _ in rows}
    wanted = {(t, b) for (n, _, t, *_), b in ((x, greedy([(f"en {y[2]}", y[0], y[4]) for y in rows], 60)[x[0]]) for x in rows)}
    assert calls.value == len(wanted)


def test_constraints(spark):
    lines = spark.createDataFrame([(0, "he saw her\ther\tshe\t\tHer"), (1, "no phrases"), (2, None), (3, "ab\tabc\tb")], "n int, text string")
    asked = translation.split_constraints(lines)
    assert {x["n"]: (x["text"], x["constraints"]) for x in asked.collect()} == {0: ("he saw her", ["her", "she", "", "Her"]), 1: ("no phrases", []), 2: ("", []), 3: ("ab", ["abc", "b"])}
    r = random.Random(2)
    rows = [(n, "".join(r.choices("ab ", k=r.randrange(12))) if n % 7 else None, [r.choice(["a", "ab", "ba b", "", "bbb", None]) for _ in range(r.randrange(4))] if n % 5 else None) for n in range(200)]
    got = translation.met_constraints(spark.createDataFrame(rows, "n int, text string, constraints array<string>"))
    assert {x["n"]: x["met"] for x in got.collect()} == {n: [c for c in cs or [] if c and t and c in t] for n, t, cs in rows}


def test_abbreviations_and_sentences(spark):
    body = ["Dr. Smith met Mr. Jones etc. at noon. He left.", "Mr. Jones ran. Dr. Who sat. It rained."] * 30 + ["They met at noon. We ran! Who sat? Dr. No."] + ["at noon he ran and sat as it rained and left"] * 40
    docs = spark.createDataFrame([*enumerate(body), (200, None), (201, ""), (202, "one\n\ntwo"), (203, "J. R. Smith said “No.” Then left."), (204, "Dr.")], "i int, text string")
    counts = sentences.word_counts(docs)
    known = {x["word"]: x["evidence"] for x in sentences.abbreviations(counts).collect()}
    assert {"dr", "mr"} <= set(known) and not {"noon", "ran", "left"} & set(known)
    held = {x["word"]: (x["with_stop"], x["without"]) for x in counts.collect()}
    k = sum(a for a, _ in held.values())
    usual = min(k / sum(a + b for a, b in held.values()), 0.99)
    a, b = held["mr"]
    want = 2 * (a * math.log(0.99) + b * math.log(0.01) - a * math.log(usual) - b * math.log(1 - usual)) * math.exp(-2) * 2.0**-b
    assert known["mr"] == pytest.approx(want)
    split = {x["i"]: (x["by"], x["sentences"]) for x in sentences.split_fewer(docs, ["i"], known=spark.createDataFrame([("dr",), ("mr",), ("etc",)], "word string")).collect()}
    assert split[0] == ("words", ["Dr. Smith met Mr. Jones etc. at noon.", "He left."])
    assert split[60] == ("words", ["They met at noon.", "We ran!", "Who sat?", "Dr. No."])
    assert split[200] == split[201] == ("marks", []) and split[202] == ("marks", ["one", "two"])  # ties go to the first
    assert split[204] == ("marks", ["Dr."]) and split[203][0] == "words" and split[203][1][0].startswith("J. R. Smith")
    assert len(split) == docs.count()


@pytest.mark.parametrize("src", list(scripts.BLOCKS))
def test_scripts_there_and_back(spark, src):
    """Letters that both scripts have come back; those that a script lacks, digits of others, dandas and Latin letters stay."""
    own = "".join(chr(c) for c in range(scripts.BLOCKS[src], scripts.BLOCKS[src] + 0x70) if scripts.has(src, c - scripts.BLOCKS[src]))
    x = F.lit(own + "।॥ abc 12")
    there = {t: scripts.to_script(x, src, t) for t in scripts.BLOCKS}
    row = spark.range(1).select(*(there[t].alias(f"a{t}") for t in there), *(scripts.to_script(there[t], t, src).alias(f"b{t}") for t in there)).first()
    for t in scripts.BLOCKS:
        moved, back = row[f"a{t}"], row[f"b{t}"]
        assert back == own + "।॥ abc 12" and moved.endswith("।॥ abc 12")
        for c, m in zip(own, moved, strict=False):
            place = ord(c) - scripts.BLOCKS[src]
            common = scripts.has(t, place) and place not in scripts.SHARED
            assert m == (chr(scripts.BLOCKS[t] + place) if common else c)


def test_letters_of_their_own_script(spark):
    row = spark.range(1).select(scripts.to_common(F.lit("ৰৱ"), F.lit("asm_Beng")), scripts.to_common(F.lit("ਸੰ"), F.lit("pan_Guru")), scripts.to_common(F.lit("abc"), F.lit("eng_Latn")), scripts.from_common(F.lit("नमः"), F.lit("tel_Telu"))).first()
    assert tuple(row) == ("रव", "सं", "abc", "నమః")


def test_long_addresses(spark):
    """Labels are not matched by recursion: 20,000 of them are found, and so is nothing where an address ends in a stop."""
    long = ["http://" + "a." * 20_000 + "com", "a." * 20_000 + "b c", "-" * 20_000 + " x", "x" + "-" * 20_000 + ".com"]
    rows = spark.createDataFrame(list(enumerate(long)), "i int, t string")
    assert {x["i"]: x["m"] for x in rows.select("i", tx.matches(F.col("t"), tx.URL).alias("m")).collect()} == {0: [long[0]], 1: [long[1][:-2]], 2: [], 3: [long[3]]}
    got = spark.createDataFrame([("see http://a.b.co/x?y=1. or www.x.org, a..b",)], "t string").select(tx.matches(F.col("t"), tx.URL)).first()[0]
    assert got == ["http://a.b.co/x?y=1", "www.x.org"]
    assert spark.createDataFrame([(long[0],)], "t string").select(tx.unwrap(tx.wrap(F.col("t"))), tx.placeholders(F.col("t"))["text"]).first() is not None


def test_compared_systems(spark):
    r = random.Random(3)
    rows = [(i, s, round(r.random() + d, 6)) for i in range(40) for s, d in (("x", 0.0), ("y", 0.05), ("z", 1.0)) if not (s == "y" and i % 10 == 0)] + [(99, "x", None), (99, "same", 1.0), (98, "same", 2.0), (99, "also", 1.0), (98, "also", 2.0)]
    got = {(x["a"], x["b"]): x for x in metrics.compare_systems(spark.createDataFrame(rows, "i int, system string, score double"), "i").collect()}
    value = {(i, s): v for i, s, v in rows}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        d = [value[i, a] - value[i, b] for i in range(40) if (i, a) in value and (i, b) in value]
        mean = sum(d) / len(d)
        t = mean / math.sqrt(sum((x - mean) ** 2 for x in d) / (len(d) - 1) / len(d))
        assert got[a, b]["n"] == len(d) and got[a, b]["diff"] == pytest.approx(mean) and got[a, b]["t"] == pytest.approx(t)
        assert got[a, b]["p_value"] == pytest.approx(student(t, len(d) - 1), abs=1e-6)
    assert got["also", "same"]["t"] is None and got["also", "same"]["p_value"] is None


def student(t, v, steps=200_000):
    """Two-sided tail of Student's t by the trapezoid rule, over the inner part."""
    c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
    h = abs(t) / steps
    f = lambda x: c * (1 + x * x / v) ** (-(v + 1) / 2)
    return 1 - 2 * h * (sum(f(i * h) for i in range(1, steps)) + (f(0) + f(abs(t))) / 2)


@pytest.mark.parametrize("t,n", [(0.0, 5), (0.3, 2), (1.5, 3), (-2.2, 11), (3.0, 400), (0.01, 100_000), (40.0, 9)])
def test_t_probability(t, n):
    assert metrics.t_probability(t, n) == pytest.approx(student(t, n - 1), abs=1e-6)
    assert metrics.t_probability(None, n) is None and metrics.t_probability(t, 1) is None


def test_shuffled_places(spark):
    rows = spark.range(300).repartition(4)
    order = [x["id"] for x in corpus.shuffled(rows, 5, "id").collect()]
    assert [x["id"] for x in sorted(corpus.shuffled_places(rows, 5, "id").collect(), key=lambda x: x["place"])] == order
    assert sorted(x["place"] for x in corpus.shuffled_places(rows, 5, "id").collect()) == list(range(300))


def test_log_lines_with_broken_numbers(spark):
    from weft.sources import bitext

    got = bitext.hypotheses(spark.createDataFrame([(0, "H-x\tnone\thi"), (1, "H-3\t-0.5\thello")], "line_no long, text string")).collect()
    assert [tuple(x) for x in got] == [(None, None, "hi", 0), (3, -0.5, "hello", 1)]

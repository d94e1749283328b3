"""Recompression, spelling variants and resampling: whole tables against plain versions, odd rows, and their parts."""

from __future__ import annotations

import random
import zlib

import brute as B
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import queries, recompression, resampling, spelling
from weft.session import ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def frame(spark, rows_, schema="doc_id long, text string"):
    return ship(spark).createDataFrame(rows_, schema)


# Recompression


def repeats(spark, rows_, width=20, schema="doc_id long, text string"):
    got = recompression.repeats(frame(spark, rows_, schema), width=width).collect()
    return [(r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["sha256"]) for r in got]


def mixed(seed, n, vocabulary=(1, 2, 3, 5, 30, 1000)):
    """Texts of few and of many different words, with passages of one another."""
    r, out = random.Random(seed), []
    for _ in range(n):
        v = r.choice(vocabulary)
        own = [f"w{r.randrange(v)}" for _ in range(r.choice([0, 5, 19, 20, 21, 40, 100, 300]))]
        if out and r.random() < 0.5:
            other = r.choice(out).split()
            a = r.randrange(len(other) + 1)
            c = r.randrange(len(own) + 1)
            own[c:c] = other[a : a + r.choice([10, 19, 20, 21, 25, 60])]
        out.append(r.choice([" ", "\n", "\t ", " \x0b"]).join(own))
    return out


def test_op11(spark, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.queries()["op11_recompression"](spark, SF).collect()}
    assert got == {i: tuple(x) for i, *x in B.repeats(rows)}


@pytest.mark.parametrize("seed,width", [(1, 20), (2, 6), (3, 2)])
def test_repeats_of_mixed_texts(spark, seed, width):
    rows_ = list(zip(random.Random(seed).sample(range(10**6), 150), mixed(seed, 150), strict=True))
    assert sorted(repeats(spark, rows_, width)) == sorted(B.repeats(rows_, width))


def test_repeats_in_small_lots(spark, monkeypatch):
    """Tasks that deal out after every few texts, and contexts with many blocks."""
    monkeypatch.setattr(recompression, "MOST", 50)
    passage = " ".join(f"p{i}" for i in range(30))
    rows_ = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(60)] + [(100 + i, t) for i, t in enumerate(mixed(9, 40))]
    assert sorted(repeats(spark, rows_)) == sorted(B.repeats(rows_))


def test_repeats_of_one_word_and_of_long_texts(spark):
    long = " ".join(f"x{i % 977}" for i in range(30_000))
    rows_ = [(1, "same " * 500), (2, "same " * 30), (3, "ab ab " * 40), (4, long), (5, "y " + long), (6, "ü " * 25 + "z" * 50_000)]
    assert sorted(repeats(spark, rows_)) == sorted(B.repeats(rows_))


def test_repeats_of_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(25))
    got = recompression.repeats(frame(spark, [(None, text, "x", 1), (7, text, "y", 2), (7, text, "z", 3), (8, None, None, 4), (9, "", "", 5)], "doc_id long, text string, spans string, num long"))
    assert got.columns == ["doc_id", "n_words", "spans", "sha256"]
    told = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"])) for r in got.collect())
    assert told == [(False, 7, 25, 0), (False, 7, 25, 25), (False, 8, 0, 0), (False, 9, 0, 0), (True, 0, 25, 25)]
    named = repeats(spark, [("b", text), ("a", text), (None, text)], schema="doc_id string, text string")
    assert {(i, n) for i, _, n, _ in named} == {("a", 0), ("b", 25), (None, 25)}
    assert repeats(spark, []) == []


def test_kept_words(spark):
    docs = frame(spark, [(1, " a  b\tc d "), (2, None)])
    spans = F.when(F.col("doc_id") == 1, F.expr("array(named_struct('start', 1L, 'stop', 3L))")).otherwise(F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"))
    assert {r[0]: r[1] for r in docs.select("doc_id", recompression.kept_words(F.col("text"), spans)).collect()} == {1: "a d", 2: ""}


def test_equal_texts_have_equal_boundaries_inside():
    """Boundaries whose context lies in a passage are the same wherever the passage is."""
    r = random.Random(5)
    passage = [f"w{r.randrange(4)}".encode() for _ in range(200)]
    found = []
    for _ in range(6):
        left, right = ([f"v{r.randrange(9)}".encode() for _ in range(r.randrange(30))] for _ in range(2))
        own = recompression.Slice([b" ".join(left + passage + right)])
        places = np.arange(len(own.a))
        symbols, edge, at = None, np.zeros(len(places), bool), len(left)
        edge[0] = True
        symbols = (own.a, places, places, places, edge, len(places))
        sets = []
        for k in range(3):
            symbols = recompression.compressed(*symbols, k)
            _, where, lo, hi, *_ = symbols
            sets.append({(int(w) - at, int(a) - at, int(b) - at) for w, a, b in zip(where, lo, hi, strict=True) if a >= at and b <= at + 200})
        found.append(sets)
    assert all(s == found[0] for s in found) and all(found[0])


# Spelling variants


def test_op12(spark, rows):
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in queries.queries()["op12_spelling"](spark, SF).collect()}
    assert got == B.variants(rows)


def test_variants_of_odd_rows(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(6, 9))) for _ in range(60)]
    chain = ["mississippi"] * 300 + ["misissippi"] * 30 + ["misisippi"] * 3 + ["aaaaaaaa"] * 40 + ["aaaaaaa"] * 2 + ["aaaaaaaaa"] * 3 + ["abababab"] * 30 + ["babababa"] * 2 + ["bababab"] * 2
    rows_ = [(i, " ".join(r.choices(words, k=30)) + "-MISSISSIPPI×÷") for i in range(40)] + [(100, " ".join(chain)), (100, "Zzzzzzzz ZZZZZZZZ ÉÉÉÉÉÉÉÉ éééééééé"), (None, "nullable nullable"), (5, None), (6, ""), (7, "y" * 30_000 + " " + "y" * 30_000)]
    got = {x["word"]: tuple(x[c] for c in ("form", "root", "n", "n_near", "form_n")) for x in spelling.variants(frame(spark, rows_), drop_every=31).collect()}
    assert got == B.variants(rows_)
    assert got["misisippi"][:2] == ("misissippi", "mississippi")
    plain = {x["word"]: x["root"] for x in spelling.variants(frame(spark, [(*x, 1) for x in rows_], "doc_id long, text string, word int")).collect()}
    assert plain == {w: x[1] for w, x in B.variants(rows_, drop_every=None).items()}
    assert spelling.variants(frame(spark, [])).collect() == []


# Resampling


def test_op13(spark, rows):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_features", "weight", "score", "rank")) for r in queries.queries()["op13_resampling"](spark, SF).collect()}
    assert got == B.resampled(rows, [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()])


def test_resampling_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "MOST", 100)
    r = random.Random(6)
    texts = [" ".join(r.choices(["the", "OF", "a-b", "ünïcode", "x" * 300, "42", "&", "日本語"], k=r.choice([1, 2, 3, 19, 20, 60]))) for _ in range(120)] + ["", None, "...", "w " * 5000]
    rows_ = list(enumerate(texts))
    target = ["the of the 42", None, "日本語 ünïcode the"]
    docs, wanted = frame(spark, [(*x, "clash") for x in rows_], "doc_id long, text string, weight string"), frame(spark, [(t,) for t in target], "text string")
    got = {x["doc_id"]: tuple(x[c] for c in ("n_features", "weight", "score", "rank")) for x in resampling.resample(docs, wanted, percent=20).collect()}
    assert got == B.resampled(rows_, target, percent=20) and sum(x[3] is not None for x in got.values()) > 5
    empty = frame(spark, [])
    assert resampling.resample(empty, wanted).collect() == []
    assert {x["doc_id"]: x["weight"] for x in resampling.resample(docs, frame(spark, [], "text string")).collect()} == {i: v[1] for i, v in B.resampled(rows_, []).items()}
    twice = resampling.resample(frame(spark, [(None, "w " * 30), (None, "w " * 30), (3, "w " * 30)]), wanted, percent=100).collect()
    assert sorted(x["rank"] for x in twice) == [1, 2, 3]


def test_crc32_of_runs():
    r = random.Random(7)
    words = sorted({bytes(r.choices(b"abcdefgh", k=r.choice([1, 2, 7, 64, 300]))) for _ in range(50)})
    word = np.array(r.choices(range(len(words)), k=400))
    room = np.r_[np.arange(300, 0, -1), np.arange(100, 0, -1)]
    n = 0
    for size, (at, crc) in enumerate(resampling.crc32s(words, word, room, 4), 1):
        assert at.tolist() == [i for i in range(400) if room[i] >= size]
        assert crc.tolist() == [zlib.crc32(b" ".join(words[k] for k in word[i : i + size])) for i in at.tolist()]
        n += 1
    assert n == 4


def test_every_string_has_one_owner():
    """Lots give each of their strings once, a string goes to the same owner from every lot, and owners hash what they add up."""
    import pyarrow as pa

    schema = pa.schema([("bucket", pa.int32()), ("lists", pa.binary()), ("sizes", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])
    for longest in (1, 2, 3, 4):
        owner, held, want = {}, {}, {}
        for text in (b"a b a b c d", b"a b c a b e", b"b", b"x y"):
            words = text.split()
            numbers = resampling._numbers()
            for batch in resampling._lists(numbers, [np.array([numbers[w] for w in words])], longest, 7, schema):
                for x in batch.to_pylist():
                    held.setdefault(x["bucket"], []).append(x)
                    for crc, n in resampling._strings([x]):
                        for c in crc[n > 0].tolist():
                            assert owner.setdefault(c, x["bucket"]) == x["bucket"]
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    c = zlib.crc32(b" ".join(words[i : i + n]))
                    want[c] = want.get(c, 0) + 1
        got = {}
        for rows_ in held.values():
            for crc, n in resampling._strings(rows_):
                for c, k in zip(crc.tolist(), n.tolist(), strict=True):
                    if k:
                        assert c not in got
                        got[c] = k
        assert got == want

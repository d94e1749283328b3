"""The registered queries over whole tables against plain versions, and how they treat what the tables rarely hold."""

from __future__ import annotations

import math
import random
import zlib

import brute as B
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_operators import clean_up, words

from weft.llm import langid, pii, queries, secrets, simhash
from weft.llm.common import save

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def result(spark, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, SF).collect()}


def test_op1(spark, rows):
    got = result(spark, "op1_bpe")
    for (i, *_), want in zip(rows, B.bpe([t for _, t, *_ in rows]), strict=True):
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_op2(spark, rows):
    got, fps = result(spark, "op2_simhash"), [B.fingerprint(t) for _, t, *_ in rows]
    for (i, *_), fp, c in zip(rows, fps, B.components([r[0] for r in rows], fps), strict=True):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fp:016x}", c)
        near = {g for g in fps if g != fp and (g ^ fp).bit_count() <= 2}
        assert got[i]["n_links"] == len(near)


def test_op3(spark, rows):
    got, table = result(spark, "op3_sharding"), B.lookup_table([f"shard-{i:03d}" for i in range(64)], 65_537)
    for i, *_ in rows:
        slot = B.slot(str(i), 65_537)
        assert (got[i]["slot"], got[i]["shard"]) == (slot, f"shard-{table[slot]:03d}")


def test_op4(spark, rows):
    got = result(spark, "op4_pii")
    for (i, t, *_), spans in zip(rows, B.pii_spans([r[1] for r in rows]), strict=True):
        base = B.pii(t)
        assert tuple(got[i][f"n_{k}"] for k in pii.KINDS) == tuple(sum(s[1] == n for s in base) for n in range(4))
        assert got[i]["base_sha256"] == B.sha(B.as_text(base, pii.KINDS).encode())
        assert got[i]["spans"] == B.as_text(spans, pii.KINDS)


def test_op5(spark, rows):
    got = result(spark, "op5_quality")
    for (i, t, *_), kept in zip(rows, B.kept([r[1:] for r in rows]), strict=True):
        n, chars, symbols, lines, repeats = B.quality(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == (n, chars, symbols, lines, repeats)
        assert (got[i]["base_failed"], got[i]["kept"]) == (n < 10 or 100 * repeats > 20 * n, kept)


def test_op6(spark, rows):
    got = result(spark, "op6_exact_dedup")
    for i, *want in B.exact([r[:2] for r in rows]):
        assert [got[i][c] for c in ("keep_id", "group_size", "kept", "text_sha256")] == want


def test_op7(spark, rows):
    got = result(spark, "op7_secrets")
    for i, t, *_ in rows:
        spans = B.secrets(t)
        assert tuple(got[i][f"n_{k}"] for k in secrets.KINDS) == tuple(sum(s[1] == n for s in spans) for n in range(3))
        assert (got[i]["base_sha256"], got[i]["spans"]) == (B.sha(B.as_text(spans, secrets.KINDS).encode()), B.as_text(spans, secrets.KINDS))


def test_op8(spark, rows):
    got = result(spark, "op8_token_counts")
    for (i, t, *_), n in zip(rows, B.token_count([r[1] for r in rows]), strict=True):
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096)


def test_op9(spark, rows):
    got = result(spark, "op9_langid")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    langs, p = B.language_model([(t, lang) for i, t, lang, _ in rows if not held[i] and lang is not None and t is not None], P.path("piece_bpe_32k.model"))
    known, right = {}, []
    for i, t, lang, _ in rows:
        own = B.plain_words(t)
        logs = []
        for x in langs:
            for w in set(own) - {w for y, w in known if y == x}:
                known[x, w] = math.log(B.sums(w, p[x])[-1])
            logs.append(sum(known[x, w] for w in own))
        best = max(range(len(langs)), key=lambda k: (logs[k], -k))
        want = ("und", 0.0) if not own else (langs[best], 1 / sum(math.exp(v - logs[best]) for v in logs))
        assert got[i]["held_out"] == held[i] and got[i]["lang_pred"] == want[0] and got[i]["score"] == pytest.approx(want[1], abs=1e-6)
        if held[i] and lang and own:
            right.append(want[0] == lang)
    assert np.mean(right) >= 0.95


def test_op10(spark, rows):
    ids = dict(zip([r[0] for r in rows], B.word_ids([r[1] for r in rows]), strict=True))
    filled, cover = {}, {}
    for r in queries.queries()["op10_packing"](spark, SF).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        cover.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for spans in [*filled.values(), *cover.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
    assert all(sum(n for _, n in x) <= 4096 for x in filled.values()) and {i: sum(n for _, n in x) for i, x in cover.items()} == {i: len(x) for i, x in ids.items()}
    assert len(filled) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_pipeline_query(spark, rows):
    out = queries.queries()["pipeline"](spark, SF).collect()
    want = clean_up(rows)
    tokens = dict(zip([i for i, _ in want], map(len, B.word_ids([t for _, t in want])), strict=True))
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == tokens


# Edges


def test_langid_uses_all_pieces_whole_words_and_letters_only(spark):
    model = P.path("piece_bpe_32k.model")
    assert langid.pieces(model).most > 6
    assert langid.words("½ ² Ⅷ ³") == [] and langid.words("a²b Ⅷx") == ["▁a", "▁b", "▁x"]
    r = random.Random(4)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(60)} | {"▁", "abcabcabcabcabca"})
    own = langid.Vocabulary({x: i + 1 for i, x in enumerate(names)})
    p = np.array([r.random() for _ in range(len(names) + 1)])
    p /= p.sum()
    plain = {None: p[0]} | {x: p[i + 1] for i, x in enumerate(names)}
    texts = ["".join(r.choice("abcd") for _ in range(n)) for n in (1, 2, 30, 59, 60, 61, 90, 90)]
    got = langid.log_probabilities(texts, np.r_[p, 0.0][:, None], own)[:, 0]
    assert np.allclose(got, [math.log(B.sums(w, plain)[-1]) for w in texts])
    n = np.arange(1.0, len(texts) + 1)
    want = np.zeros(len(p))
    for w, times in zip(texts, n, strict=True):
        a, b = B.sums(w, plain), B.sums(w[::-1], plain, True)
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 16) + 1):
                x = B.piece_in(w[i:j], plain)
                if x is not False:
                    want[0 if x is None else names.index(x) + 1] += times * a[i] * plain[x] * b[len(w) - j] / a[-1]
    assert np.allclose(langid.expected(texts, n, np.r_[p, 0.0][:, None], own), want)
    docs = spark.createDataFrame([(1, "½ ² Ⅷ"), (2, "x" * 5000), (3, "")], "doc_id long, text string")
    told = {x["doc_id"]: x["lang_pred"] for x in langid.predict(docs, (["aa"], np.r_[np.full(len(langid.pieces(model)) + 1, 1e-5), 0.0][:, None]), model).collect()}
    assert told == {1: "und", 2: "aa", 3: "und"}


def test_bpe_joins_only_the_chunks_of_a_long_pretoken(spark):
    from weft.llm import bpe

    text = words(5, 500) + " " + "q" * 300 + " " + words(6, 900)
    docs = save(spark.createDataFrame([(1, text), (2, "z" * 2500), (3, " " * 1500 + "end"), (4, words(7, 600))], "doc_id long, text string"), "docs")
    cut = docs.select("doc_id", "text")
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    got = {r["doc_id"]: (r["n_tokens"], B.sha(bytes(r["ids"]))) for r in bpe.encode(cut, ranks, P.PATTERN, chunk=256, overlap=64).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [x[:2] for x in B.bpe([text, "z" * 2500, " " * 1500 + "end", words(7, 600)])]
    parts = spark.createDataFrame([(1, k, text[k * 256 : (k + 1) * 256 + 64]) for k in range(-(-len(text) // 256))], "row long, k long, part string")
    starts = {r["k"] for r in bpe._runs(parts, 256, 64, P.PATTERN).collect()}
    assert len(starts) >= -(-len(text) // 256) - 4  # all but the chunks that the long pre-token runs over


def test_pii_bootstraps(spark):
    r = random.Random(8)
    number = lambda: f"{r.randint(100, 999)}-{r.randint(1000, 9999)}"
    seen = [f"mobile +1 (212) 555-01{i:02d} anytime" for i in range(10)]
    # found beside a pattern of seeds, and so bringing in "extension", which no seed is beside
    second = [f"mobile {v} extension" for v in (number() for _ in range(8))]
    third = ["dial 7 555-0199-55 extension", "mobile 7 555-0177-55 anytime", "mobile 7 times", "mobile x7y 555-0166-55 now", "room 555-0188-44 is free", "version 3 of it"]
    right = [f"{i} fax 555-01{i:02d}-99 anytime soon" for i in range(3)]
    texts = [*seen, *second, *third, *right, None, "", "mobile ,(555-0144-22); anytime", "mobile  4111 1111 1111 1112 anytime"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: {tuple(s) for s in x["spans"]} for x in pii.find(docs).collect()}
    want = B.pii_spans(texts)
    assert [got[i] for i in range(len(texts))] == want
    told = lambda i: {texts[i][a:b] for a, _, b in got[i]}
    n = len(seen) + len(second)
    assert all(told(10 + i) == {second[i].split()[1]} for i in range(8))
    assert [told(n + i) for i in range(6)] == [{"7 555-0199-55"}, {"7 555-0177-55"}, set(), {"555-0166-55"}, set(), set()]
    assert told(n + 6) == {"555-0100-99"} and told(len(texts) - 2) == {"555-0144-22"}


def test_pii_word_far_before_a_seed(spark):
    texts = [f"reach{' ' * 400}+1 (212) 555-01{i:02d} x" for i in range(6)] + ["reach 555-0199-88 y"]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("doc_id = 6").first()
    assert [tuple(s) for s in got["spans"]] == [(6, 3, 17)]


def test_recall_of_similar_groups(spark):
    r = random.Random(12)
    texts = []
    for i in range(120):
        own = words(2000 + i, 250).split(" ")
        other = list(own)
        for k in r.sample(range(len(own)), 4):
            other[k] = f"w{i}x{k}"
        texts += [" ".join(own), " ".join(other)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    assert all(len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1]) for i in range(120))
    docs = save(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), "docs")
    got = {x["n"]: x["component"] for x in simhash.similar_groups(docs, "n").collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(120)) >= 0.98 * 120
    assert len(set(got.values())) >= 120


@pytest.mark.parametrize("heavy", [50_000, 8])
def test_similar_groups_of_many_copies(spark, heavy):
    """A third of the rows are copies, a third differ in case alone, and leaves with too many documents are dealt out in pieces."""
    base = words(41, 80)
    texts = [base] * 40 + [base.replace("x", "X") + " " * i for i in range(40)] + [words(600 + i, 80) for i in range(40)] + [None, "", " "]
    docs = save(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), "docs")
    got = {x["n"]: x["component"] for x in simhash.similar_groups(docs, "n", heavy=heavy).collect()}
    assert len({got[i] for i in range(80)}) == 1 and len({got[i] for i in range(80, 120)} - {got[0]}) == 40
    assert got[120] == got[121] == got[122] not in {got[i] for i in range(120)}


@pytest.mark.parametrize("heavy", [50_000, 4])
def test_similar_groups_by_every_candidate(spark, heavy, monkeypatch):
    """Documents on both sides of the threshold that meet in crowds: the forests are cut to nothing, and what they leave is compared."""
    r = random.Random(21)
    base = [words(5000 + k, 120).split(" ") for k in range(3)]
    texts = []
    for i in range(90):
        own = list(base[i % 3])
        for k in r.sample(range(len(own)), r.choice([0, 1, 3, 4, 5])):
            own[k] = f"w{i}x{k}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    top = list(range(90))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(90):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    docs = save(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), "docs")
    kept = simhash._tight
    monkeypatch.setattr(simhash, "_tight", lambda edges, node, forests=1: tuple(x[:2] for x in kept(edges, node, 1)))
    links = lambda c: {(i, j) for i in range(90) for j in range(i) if c(i) == c(j)}
    few = {x["n"]: x["component"] for x in simhash.similar_groups(docs, "n", heavy=heavy).collect()}
    got = {x["n"]: x["component"] for x in simhash.similar_groups(docs, "n", heavy=heavy, every=True).collect()}
    want = links(root)
    assert links(got.get) <= want and len(links(got.get)) >= 0.98 * len(want) > len(links(few.get))


@pytest.mark.parametrize("heavy", [50_000, 4])
def test_similar_groups_whole(spark, heavy):
    """Similar sets whose fingerprints are far apart, as words are repeated, are linked too: groups are those of brute force."""
    r = random.Random(33)
    texts = []
    for i in range(12):
        own = words(7000 + i, 120).split(" ")
        texts += [" ".join(own + [f"a{i}{k}", f"b{i}{k}"] * 400) for k in range(3)]
    for i in range(60):
        own = words(7100 + i % 6, r.choice([6, 9, 30])).split(" ")
        texts.append(" ".join(own[: r.choice([5, 6, 8, 30])] + ["end"] * r.choice([0, 0, 1, 5, 9, 200])))
    shared = words(7200, 40)
    texts += [f"{shared} {words(7300 + i, 8)}" for i in range(20)] + ["x y " * n for n in (3, 4, 9, 80)] + ["x", "x", "", None]
    own = [(t or "").split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in own]
    n, top = len(texts), list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(n):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                top[root(i)] = root(j)
    docs = save(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), "docs")
    links = lambda c: {(i, j) for i in range(n) for j in range(i) if c(i) == c(j)}
    few = {x["n"]: x["component"] for x in simhash.similar_groups(docs, "n", heavy=heavy).collect()}
    got = {x["n"]: x["component"] for x in simhash.similar_groups(docs, "n", heavy=heavy, whole=True).collect()}
    assert links(got.get) == links(root) > links(few.get)


@pytest.mark.parametrize("heavy", [50_000, 40])
def test_a_crowd_that_meets_gives_few_pairs(spark, heavy):
    """Documents that share most of a passage without being similar are told apart where they meet; no similar pair is lost, long texts included."""
    r = random.Random(44)
    base, long_ = words(8000, 200).split(" "), words(8001, 4000).split(" ")

    def edited(own, n, i):
        own = list(own)
        for k in r.sample(range(len(own)), n):
            own[k] = f"w{i}x{k}"
        return " ".join(own)

    texts = [edited(base, 12, i) for i in range(150)] + [edited(base, n, 200 + 10 * n + i) for n in (1, 2, 4) for i in range(4)] + [edited(long_, n, 300 + n) for n in (20, 30, 200)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    n = len(texts)
    want = {(i, j) for j in range(n) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    docs = save(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), "docs")
    rooted = docs.select(F.col("n").alias("name"), F.col("n").alias("node"), F.col("n").alias("root"))
    got = {(x["a"], x["b"]) for x in simhash._apart(docs, "n", "text", rooted, 5, 0.8, heavy).collect()}
    assert got >= want and len(want) > 20 and len(got) <= 2 * len(want) + 10


def test_pairs_of_rows_with_different_roots():
    r = random.Random(45)
    rows_ = sorted((r.randrange(6), r.randrange(4)) for _ in range(60)) + [(9, 1), (10, 0), (10, 0)]
    group, root = (np.array(c) for c in zip(*rows_, strict=True))
    for most in (1, 7, 1000):
        got = [(i, j) for x, y in simhash._later(group, root, most) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert sorted(got) == [(i, j) for i in range(len(rows_)) for j in range(i, len(rows_)) if group[i] == group[j] and root[i] != root[j]]


def test_crowded_leaves_in_pairs_of_pieces(spark):
    rows_ = spark.createDataFrame([(0, i, i, 0, 5 if i < 50 else 1 << 20) for i in range(60)], "table int, node long, root long, fp0 long, value long")
    got = simhash._subtrees(rows_, 0, 32, 8, True).collect()
    held = {}
    for x in got:
        held.setdefault((x["a"], x["b"], x["piece"]), set()).add(x["node"])
    together = {(i, j) for s in held.values() for i in s for j in s if i < j}
    assert {(i, j) for i in range(50) for j in range(i + 1, 50)} <= together


def test_leaves_in_pieces(spark):
    rows_ = spark.createDataFrame([(0, i, i % 7, 5 if i < 50 else 6 if i < 60 else 1 << 20) for i in range(80)], "table int, node long, fp0 long, value long")
    got = simhash._subtrees(rows_, 0, 32, 8).collect()
    held = {}
    for r in got:
        held.setdefault((r["a"], r["b"], r["piece"]), set()).add(r["node"])
    leaf = {k: v for k, v in held.items() if k[0] == k[1] == 5}
    assert set().union(*leaf.values()) == set(range(50)) and len(leaf) == 7 and all(0 in v for v in leaf.values())


def test_ledger_used_twice(spark):
    from weft.llm.common import scratch_path

    path = scratch_path(spark, "ledger")
    first = save(spark.createDataFrame([(i, f"AKIA0123456789ABCD{i:02d} v1") for i in range(10)], "doc_id long, text string"), "docs")
    second = save(spark.createDataFrame([(i, f"AKIA0123456789ABCD{i:02d} v{1 + i % 2}") for i in range(12)], "doc_id long, text string"), "docs")
    secrets.scan(first, path)
    assert secrets.ledger(spark, path).count() == 10
    got = secrets.scan(second, path)
    assert secrets.ledger(spark, path).count() == 10 + 7  # five new versions of old documents, two new documents
    assert got.filter(F.size("spans") == 1).count() == 12


def test_op7_keeps_the_ledger_that_the_session_names(spark):
    from weft.llm.common import scratch_path

    path = scratch_path(spark, "ledger")
    spark.conf.set("spark.weft.ledger", path)
    try:
        first = result(spark, "op7_secrets")
        held = secrets.ledger(spark, path).count()
        assert result(spark, "op7_secrets") == first and secrets.ledger(spark, path).count() == held == len({r["blob"] for r in secrets.ledger(spark, path).collect()})
    finally:
        spark.conf.unset("spark.weft.ledger")


def test_rows_of_any_table_are_numbered(spark, tmp_path):
    from weft.llm.common import free_names, numbered

    rows_ = [(i, "own") for i in range(20)]
    made = spark.createDataFrame(rows_, "n long, row string").repartition(3)
    made.write.json(f"file://{tmp_path}/json")
    made.write.parquet(f"file://{tmp_path}/parquet")
    kinds = [made, made.groupBy("n", "row").count().drop("count"), spark.read.schema("n long, row string").json(f"file://{tmp_path}/json"), spark.read.parquet(f"file://{tmp_path}/parquet").filter("n < 90")]
    for df in kinds:
        held, name = numbered(df)
        assert name == "row_" and held.columns == [*df.columns, name] and held.select(name).distinct().count() == 20
        assert sorted((r["n"], r["row"]) for r in held.collect()) == rows_ and held.collect() == held.collect()
    assert free_names(["Blob", "x"], "blob", "blob_") == ["blob_", "blob__"]


def test_pii_of_long_runs_of_marks(spark):
    tokens = ["." * 100_000, ":" * 100_000, "1 " * 50_000, "@" * 100_000, "a@b. " * 20_000, "1." * 50_000, "+1 " * 30_000, "(" * 100_000]
    texts = [t for x in tokens for t in (f"0{x}2", f"at {x} mail a@b.cc end")]
    got = {x["doc_id"]: [tuple(s) for s in x["base"]] for x in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [sorted(B.pii(t)) for t in texts]


def test_secrets_that_may_match(spark):
    """The cheap test lets every text with a finding through, and texts without any reach the ledger."""
    from weft.llm.common import scratch_path

    texts = ["x" * 50, "", None, "Password : 'abcdefghijkl'", "api_key=short", "AKIA" + "A" * 14, "f" * 16, "f" * 15, "TOKEN==========================", "apikey   :\"aaaaaaaaaaaaaaa", "secret is abcdefghijklmn"]
    docs = save(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    path = scratch_path(spark, "ledger")
    got = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in secrets.scan(docs, path).collect()}
    assert [got[i] for i in range(len(texts))] == [sorted(B.secrets(t)) for t in texts]
    assert secrets.ledger(spark, path).count() == len({t or "" for t in texts})
    plan = secrets.scan(docs, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") >= 1
    every = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in secrets.scan(docs, scratch_path(spark, "ledger"), may=lambda t: F.lit(True)).collect()}
    assert every == got

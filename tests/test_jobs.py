"""Sources, writers, whole jobs and streams on small files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.functions.punctuation import normalize_request
from weft.operators import corpus, metrics, translation
from weft.plans import prepare
from weft.sources import bitext
from weft.streaming import normalize

BITEXT = "pair string, split string, line_no long, src_lang string, tgt_lang string, src_text string, tgt_text string"


def files(root, named):
    for name, body in named.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body if isinstance(body, bytes) else body.encode())
    return f"file://{root}"


def pairs(spark, rows):
    """rows: (line_no, src_lang, tgt_lang, src_text, tgt_text)"""
    return spark.createDataFrame([(f"{s}-{t}", "train", n, s, t, a, b) for n, s, t, a, b in rows], BITEXT)


def parts(path):
    """Lines of the part files at path, in their order."""
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().split("\n")[:-1]]


def test_lines_of_a_split_file(spark, tmp_path):
    r = random.Random(1)
    lines = ["".join(r.choice("ab é") for _ in range(r.randint(0, 90))) for _ in range(3000)]
    root = files(tmp_path, {"in/a.txt": "\n".join(lines), "in/b.txt": b"x\xff\xfey\nz\r\n\n\xef\xbf\xbd\n", "in/c.txt": ""})
    own = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        read = bitext.read_lines(spark, f"{root}/in/*.txt")
        assert read.select("path").rdd.getNumPartitions() > 1
        got = {}
        for p, n, t in read.collect():
            got.setdefault(p[-5], []).append((n, t))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got["a"]) == list(enumerate(lines))
    assert sorted(got["b"]) == [(0, "xy"), (1, "z\r"), (2, ""), (3, "�")] and "c" not in got


def test_domains_benchmarks_and_inputs(spark, tmp_path):
    root = files(tmp_path, {"one/en-hi/train.en": "a\nb\n", "one/en-hi/train.hi": "x\ny\n", "two/en-ta/train.en": "c\n", "two/en-ta/train.ta": "z\n", "bench/en": "q\n \n \nr\n", "ask": "a \n\n  \nb\n"})
    got = bitext.read_domains(spark, root, ["one", "two", "none"])
    assert sorted((r["domain"], r["pair"], r["line_no"], r["src_text"], r["tgt_text"]) for r in got.collect()) == [("one", "en-hi", 0, "a", "x"), ("one", "en-hi", 1, "b", "y"), ("two", "en-ta", 0, "c", "z")]
    assert sorted(tuple(r) for r in bitext.read_benchmark(spark, f"{root}/bench").collect()) == [("en", 0, "q"), ("en", 3, "r")]
    assert sorted(tuple(r) for r in bitext.read_inputs(spark, f"{root}/ask").collect()) == [(0, "a"), (2, ""), (3, "b")]


def test_lookup_table(spark, tmp_path):
    root = files(tmp_path, {"map.tsv": "asm_Beng\thi\neng_Latn\ten\n"})
    assert sorted(map(tuple, bitext.read_lookup(spark, f"{root}/map.tsv", ["code", "to"]).collect())) == [("asm_Beng", "hi"), ("eng_Latn", "en")]


def test_strict_reader(spark, tmp_path):
    root = files(tmp_path, {"good/en-hi/train.en": "a\nb\n", "good/en-hi/train.hi": "x\ny\n", "good/en-en/train.en": "s\n", "uneven/en-hi/train.en": "a\nb\n", "uneven/en-hi/train.hi": "x\n", "lone/en-hi/train.en": "a\n"})
    assert bitext.read_bitext_strict(spark, f"{root}/good").count() == 2
    for bad in ("uneven", "lone"):
        with pytest.raises(Exception, match="differ in length"):
            bitext.read_bitext_strict(spark, f"{root}/{bad}").collect()


def test_writers(spark, tmp_path):
    rows = [(n, s, t, f"{s} {n}", None if n == 4 else f"{t} {n}") for s, t in (("hi", "en"), ("en", "ta")) for n in range(7)]
    own = pairs(spark, rows).repartition(3)
    bitext.write_bitext(own, f"file://{tmp_path}/corpus")
    assert sorted(map(str, spark.read.parquet(f"file://{tmp_path}/corpus").select(own.columns).collect())) == sorted(map(str, own.collect()))
    bitext.export_lines(own.filter("pair = 'hi-en'"), f"file://{tmp_path}/side", "tgt_text")
    assert parts(tmp_path / "side") == [f"en {n}" if n != 4 else "" for n in range(7)]
    bitext.write_joint(own, f"file://{tmp_path}/joint")
    order = [r for r in rows if r[1] == "en"] + [r for r in rows if r[1] == "hi"]
    assert parts(tmp_path / "joint/train.SRC") == [r[3] for r in order] and parts(tmp_path / "joint/train.TGT") == [r[4] or "" for r in order]
    assert parts(tmp_path / "joint/train.metadata") == ["en\tta\t7", "hi\ten\t7"]
    bitext.write_pair_counts(corpus.pair_stats(own), f"file://{tmp_path}/counts")
    assert sorted(tuple(r) for r in bitext.read_pair_counts(spark, f"file://{tmp_path}/counts").collect()) == [("en", "ta", 7), ("hi", "en", 7)]
    scores = spark.createDataFrame([("en-hi", "b", "bleu", 1.5), ("en-hi", "a", "bleu", 2.0)], "pair string, system string, metric string, value double")
    bitext.write_scores(scores, f"file://{tmp_path}/scores")
    assert parts(tmp_path / "scores") == ["pair\tsystem\tmetric\tvalue", "en-hi\ta\tbleu\t2.0", "en-hi\tb\tbleu\t1.5"]


def test_vocabulary_lines_without_a_number(spark):
    good, bad = bitext.vocabulary(spark.createDataFrame([("foo bar",), ("tok 12",), ("tok",), ("a b c",), (" x 9 ",)], "text string"))
    assert sorted(map(tuple, good.collect())) == [("foo", None, "foo bar"), ("tok", 12, "tok 12"), ("x", 9, " x 9 ")] and bad.count() == 2


def test_places_in_blocks(spark):
    rows = spark.createDataFrame([(p, n) for p in "ab" for n in range(5, 300, 7 if p == "a" else 3)], "pair string, line_no long").repartition(5)
    got = corpus._ranked(rows, "pair", "line_no", "place", block=16).collect()
    for p in "ab":
        own = sorted((r["line_no"], r["place"]) for r in got if r["pair"] == p)
        assert [x[1] for x in own] == list(range(len(own)))
    assert sorted(r["batch"] for r in corpus.batches(rows.filter("pair = 'a'"), 20).collect()) == sorted(i // 20 for i in range(43))
    assert sorted(r["line_no"] for r in corpus.renumber(rows.filter("pair = 'a'")).collect()) == list(range(43))


def test_expanded_runs(spark):
    stats = spark.createDataFrame([("a", "b", 70_000), ("a", "c", 0), ("c", "d", 1)], "src_lang string, tgt_lang string, cnt long")
    got = corpus.expand_runs(stats).groupBy("src_lang", "tgt_lang").count().collect()
    assert sorted(map(tuple, got)) == [("a", "b", 70_000), ("c", "d", 1)]


def test_loose_decontamination_by_language(spark):
    own = pairs(spark, [(0, "en", "hi", "Known  line!", "x"), (1, "en", "hi", "x", "known line"), (2, "hi", "en", "known line", "a  b"), (3, "hi", "en", "y", "KNOWN LINE"), (4, "en", "hi", "", "z")])
    bench = spark.createDataFrame([("en", "known line"), ("en", "  ")], "lang string, text string")
    got = sorted((r["line_no"], r["src_text"], r["tgt_text"]) for r in corpus.decontaminate_loose(own, bench).collect())
    assert got == [(1, "x", "known line"), (2, "known line", "a b"), (4, "", "z")]


def test_renamed_pairs(spark):
    own = pairs(spark, [(0, "hi", "en", "h", "e"), (1, "xx", "ta", "q", "t")])
    isos = spark.createDataFrame([("hi", "hin_Deva"), ("en", "eng_Latn"), ("ta", "tam_Taml")], "iso string, flores string")
    full = corpus.to_full_codes(own, isos)
    assert sorted((r["pair"], r["src_lang"]) for r in full.collect()) == [("hin_Deva-eng_Latn", "hin_Deva"), ("xx-tam_Taml", "xx")]
    assert [(r["pair"], r["src_text"], r["tgt_text"]) for r in corpus.pivot_first(full).collect()] == [("eng_Latn-hin_Deva", "e", "h")]
    some = spark.createDataFrame([("en-hi", "en"), ("en-hi", "hi"), ("en-ta", "en"), ("en-ta", "xx")], "pair string, lang string")
    assert sorted(map(tuple, corpus.complete_pairs(some).collect())) == [("en-hi", "en"), ("en-hi", "hi")]
    assert corpus.sample(spark.range(30), 10).count() == 10
    assert [r["id"] for r in corpus.shuffled(spark.range(9), 3, "id").collect()] == [r["id"] for r in corpus.shuffled(spark.range(9).repartition(4), 3, "id").collect()] != list(range(9))


def test_digits_of_any_script(spark):
    row = spark.createDataFrame([("९५ % x ३ ४",)], "t string")
    assert row.select(normalize_request(F.col("t"))).first()[0] == "९५% x ३.४"


def test_mended_scripts(spark):
    rows = spark.createDataFrame([("a ؟ b ۔", "urd_Arab"), ("a ؟", "eng_Latn"), ("xଯ଼", "ory_Orya")], "t string, c string")
    assert [r[0] for r in rows.select(tx.mend_script(F.col("t"), F.col("c"))).collect()] == ["a؟ b۔", "a ؟", "xୟ"]


def test_two_hops_translate_each_text_twice(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(texts, src, tgt):
        calls.add(len(texts))
        return [f"{tgt}: {t}" for t in texts]

    rows = spark.createDataFrame([(i, "hi", "ta", f"t{i}") for i in range(10)] + [(10, "en", "hi", "t10")], "i int, src string, tgt string, text string")
    got = {r["i"]: (r["src"], r["tgt"], r["text"]) for r in translation.translate_routed(rows, counted, ["en-indic", "indic-en"]).collect()}
    assert got == {i: ("hi", "ta", f"ta: en: t{i}") for i in range(10)} | {10: ("en", "hi", "hi: t10")} and calls.value == 21


def test_significance(spark):
    r = random.Random(2)
    refs = [" ".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(60)]
    rows = [(i, s, " ".join(w for k, w in enumerate(x.split()) if k % d != d - 1), x) for i, x in enumerate(refs) for s, d in (("good", 12), ("same", 12), ("bad", 3))]
    stats = metrics.bleu_statistics(spark.createDataFrame(rows, "i int, system string, hyp string, ref string"), ["i", "system"])
    got = {x["system"]: x for x in metrics.significance(stats, "i", "system", "good", 100).collect()}
    assert got["good"]["p_value"] is None and got["good"]["bleu"] == got["same"]["bleu"] > got["bad"]["bleu"]
    assert got["bad"]["p_value"] == pytest.approx(1 / 101) and got["same"]["p_value"] == pytest.approx(1 / 101)  # no resample differs from no difference


@pytest.mark.parametrize("hyp, ref", [(None, "a b"), ("", ""), ("a a a b", "a a b b c"), ("x", "a b"), ("\U0001f600é \U0001f600", "\U0001f600é")])
def test_overlaps_by_brute_force(spark, hyp, ref):
    from collections import Counter

    rows = spark.createDataFrame([(0, hyp, ref), (1, ref, hyp), (2, "a b", "a b")], "r int, hyp string, ref string")
    got = {(x["r"], x["n"]): (x["matched"], x["hyp_n"], x["ref_n"]) for x in metrics.overlaps(rows, ["r"], metrics.tokens(F.col("hyp")), metrics.tokens(F.col("ref")), range(1, 4), "word").collect()}
    chars = {(x["r"], x["n"]): (x["matched"], x["hyp_n"], x["ref_n"]) for x in metrics.chrf_statistics(rows, ["r"]).collect()}
    grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    for r, (a, b) in enumerate(((hyp, ref), (ref, hyp), ("a b", "a b"))):
        for found, of, most in ((got, str.split, 4), (chars, lambda t: list("".join(t.split())), 7)):
            for n in range(1, most):
                h, g = grams(of(a or ""), n), grams(of(b or ""), n)
                want = (sum((h & g).values()), sum(h.values()), sum(g.values()))
                assert found.get((r, n), (0, 0, 0)) == want


def test_jobs(spark):
    own = pairs(spark, [(0, "eng_Latn", "hin_Deva", "Call 10:30 ( now )", "बजे १०:३०"), (1, "eng_Latn", "hin_Deva", "held out", "x"), (2, "eng_Latn", "hin_Deva", "Call 10:30 ( now )", "बजे १०:३०")])
    bench = spark.createDataFrame([("eng_Latn", "Held out!")], "lang string, text string")
    got = prepare.prepare(own, bench).select("line_no", "src_text", "tgt_text").collect()
    assert [tuple(r) for r in got] == [(0, "eng_Latn hin_Deva Call <dnt> 10:30 </dnt> (now)", "बजे 10:30")]
    told = spark.createDataFrame([("p", "s", 0, "a b c d"), ("p", "t", 0, "a b c x")], "pair string, system string, line_no long, text string")
    refs = spark.createDataFrame([("p", 0, "a b c d")], "pair string, line_no long, text string")
    scores = {(r["system"], r["metric"]): r["value"] for r in prepare.evaluate(told, refs).collect()}
    assert scores["s", "bleu"] == pytest.approx(100) and scores["s", "chrf++"] == pytest.approx(100) and 0 < scores["t", "chrf"] < 100


def test_translated_stream(spark, tmp_path):
    spark.createDataFrame([("en", "hi", "one"), ("hi", "ta", "two")], "src string, tgt string, text string").write.parquet(f"{tmp_path}/in")
    asked = spark.readStream.schema("src string, tgt string, text string").parquet(f"{tmp_path}/in")
    sink = lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out")
    normalize.translated(asked, translation.echo, ["en-indic", "indic-en"], sink, f"file://{tmp_path}/check").awaitTermination(60)
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["hi: one", "ta: en: two"]

"""Literal cases of the text functions, sources and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import languages as lang
from weft.functions import text as tx
from weft.functions.punctuation import normalize_corpus, normalize_request
from weft.operators import corpus, metrics, translation, vocabulary
from weft.session import dealt
from weft.sources import bitext
from weft.streaming import normalize


def value(spark, make, *texts):
    row = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return row.select(make(*(F.col(f"c{i}") for i in range(len(texts)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (tx.loose_key, "Hi .", "hi "),
        (tx.loose_key, "किताबें, हैं।", "किताबें हैं"),
        (tx.strict_key, "Hello, World!", "helloworld"),
        (tx.strict_key, "यह है।", "यहहै"),
        (tx.ascii_digits, "९५% ٠٣ ౦౧", "95% 0٣ ౦1"),
        (normalize_request, "wait...", "wait."),
        (normalize_request, " ’x", "'x"),
        (normalize_corpus, " ’x", ' "x'),
        (tx.join_pieces, "▁he llo ▁wor ld", "hello world"),
        (tx.clean_output, " a\n\tb  c ", "a b c"),
        (lambda x: tx.placeholders(x)["text"], "mail bob@site.co", "mail <ID1>"),
        (lambda x: tx.let(tx.placeholders(x), lambda s: tx.restore(F.replace(s["text"], F.lit("<ID1>"), F.lit("< आईडी 1 >")), s["entities"])), "mail bob@site.co", "mail bob@site.co"),
        (lambda x: tx.placeholders(x)["text"], "J.K Rowling", "J.K Rowling"),
        (lambda x: tx.unwrap(tx.wrap(x)), "call 10:30 now", "call 10:30 now"),
    ],
)
def test_text(spark, make, text, want):
    assert value(spark, make, text) == want


def test_wrap_common(spark):
    both = value(spark, tx.wrap_common, "Call 10:30 now", "Ruf 10:30 an")
    assert tuple(both) == ("Call <dnt> 10:30 </dnt> now", "Ruf <dnt> 10:30 </dnt> an")
    assert tuple(value(spark, tx.wrap_common, "at 10:30", "um 11:30")) == ("at 10:30", "um 11:30")


def test_mend_tags(spark):
    assert value(spark, tx.mend_tags, "x < dnt > 10 : 30 < / dnt > y", "x <dnt> 10:30 </dnt> y") == "x <dnt> 10:30 </dnt> y"


def test_chunks(spark):
    made = lambda trailing: value(spark, lambda x: F.transform(tx.chunks(F.split(x, " "), 256, trailing), F.size), " ".join("w" * 512))
    assert made(False) == [256, 256] and made(True) == [256, 256, 0]


def test_languages(spark):
    codes = spark.createDataFrame([("hin_Deva",), ("xyz_Abcd",), ("kas_Latn",)], "code string")
    assert dict(lang.punctuation_language(codes).collect()) == {"hin_Deva": "hi", "xyz_Abcd": "en", "kas_Latn": "ar"}
    for src, tgt, want in (("en", "hi", "en-indic"), ("hi", "en", "indic-en"), ("hi", "ta", "indic-indic"), ("en", "en", "en-indic"), ("hi", "zz", None)):
        assert value(spark, lang.direction, src, tgt) == want
    with pytest.raises(Exception, match="not supported"):
        value(spark, lambda a, b: lang.hops(a, b, ["en-indic"]), "hi", "zz")


def test_pivot_and_fill(spark):
    side = lambda rows: spark.createDataFrame(rows, "pivot_text string, text string, line_no long")
    got = corpus.pivot_join(side([("a", "h1", 0), ("a", "h2", 1)]), side([("a", "t1", 0), ("a", "t2", 1)]))
    assert sorted(map(tuple, got.collect())) == [("h2", "t1"), ("h2", "t2")]
    log = spark.createDataFrame([(0, "H-0\t-0.5\tx"), (1, "D-1\t-0.5\ty"), (2, "H-2\t-0.1\tz")], "line_no long, text string")
    filled = translation.fill_missing(spark.range(3).select(F.col("id").cast("int").alias("id")), bitext.hypotheses(log))
    assert dict(filled.collect()) == {0: "x", 1: "", 2: "z"}


def test_metrics_of_equal_texts(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat")], "r int, hyp string, ref string")
    assert metrics.bleu(metrics.bleu_statistics(rows, ["r"]), ["r"]).first()["bleu"] == pytest.approx(100)
    assert metrics.chrf(metrics.chrf_statistics(rows, ["r"], 2), ["r"]).first()["chrf"] == pytest.approx(100)


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (metrics.words_and_marks, "(a) café don't. _ x", ["(a", ")", "café", "don't", ".", "_", "x"]),
        (metrics.words_and_marks, "«q» (b", ["«q»", "(", "b"]),
        (metrics.v13a_tokens, "Hello, world! 1,000.5 a-b 3-4 &quot;x&quot; it's", ["Hello", ",", "world", "!", "1,000.5", "a-b", "3", "-", "4", '"', "x", '"', "it's"]),
        (metrics.v13a_tokens, "", []),
    ],
)
def test_metric_tokens(spark, make, text, want):
    assert value(spark, make, text) == want


def test_sources(spark, tmp_path):
    for name, body in {"en-hi/train.en": "a\nb\nc\n", "en-hi/train.hi": "x\ny\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = bitext.read_bitext(spark, f"file://{tmp_path}")
    assert sorted((r["line_no"], r["src_text"], r["tgt_text"]) for r in got.collect()) == [(0, "a", "x"), (1, "b", "y")]
    assert bitext.read_lines(spark, f"file://{tmp_path}/none/*.x").count() == 0
    out = f"file://{tmp_path}/pred"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    bitext.write_missing(rows, out, ["id"])
    bitext.write_missing(rows, out, ["id"])
    assert spark.read.parquet(out).count() == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([("Known line.",), ("new line 10:30",)], "text string").write.parquet(f"{tmp_path}/in")
    pool = spark.createDataFrame([("known  LINE",)], "text string")
    lines = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
    q = normalize.normalized(normalize.decontaminated(lines, pool)).drop("__key").writeStream.format("memory").queryName("out_lines").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r[0] for r in spark.table("out_lines").collect()] == ["new line <dnt> 10:30 </dnt>"]


def test_patterns_with_and_without_their_quick_tests(spark):
    """Quick tests and beginnings change no match, stripping and collapsing know all of Unicode's white space."""
    spaces = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    r = random.Random(5)
    parts = ["a.b", "x@y.co", "a@b.co%x@y.org", "~5%", "3 % 4", "1-2-3", "٣:٤", "10.5", "#x", "|y", "..", ".a", "A@", "http://a.b/c", "w", "é.ü", "~", "１.２", " ", "  ", "\t", "\u2003", "\x85", "\n"]
    texts = ["".join(r.choices(parts, k=r.randrange(9))) for _ in range(600)] + [f"{c}a{c}b {c} d{c}" for c in spaces] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "x string").repartition(4)
    plain = [F.regexp_extract_all("x", F.lit("(?U)" + p), F.lit(0)).eqNullSafe(tx.matches(F.col("x"), p)) for p in tx.ENTITIES.values()]
    plain += [F.regexp_replace("x", r"(?U)^\s+|\s+$", "").eqNullSafe(tx.strip(F.col("x"))), F.regexp_replace("x", r"(?U)\s+", " ").eqNullSafe(tx._collapse(F.col("x")))]
    assert df.select(*(F.count_if(~c) for c in plain)).first() == (0,) * len(plain)
    assert all("RLIKE" in str(tx.matches(F.col("x"), p)).upper() for p in (tx.EMAIL, tx.URL, tx.OTHER))  # before, each pattern was tried at each place


def test_resampled_in_one_pass_and_encoded_as_places_say(spark):
    """Draws in tasks are those of draws(), chrF of resamples reads statistics once (twice before), tokens are numbered by their places."""
    rows = spark.createDataFrame([(k,) for k in range(50)], "k long")
    want = rows.select("k", F.array(*(metrics.draws(F.col("k"), F.lit(i)) for i in range(1, 9))).alias("t")).collect()
    assert all(list(metrics._times(str(x["k"]), 1, 8)) == x["t"] for x in want)
    stats = spark.createDataFrame([(1, "a", "char", 1, 2, 3, 4), (2, "b", "char", 1, 0, 0, 4)], "row long, system string, kind string, n int, matched long, hyp_n long, ref_n long")
    boot = metrics.paired_bootstrap(stats, "row", "system", 5, 0, metrics.chrf_score)
    assert boot._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    texts = [(1, "b a  b c"), (2, None), (3, " "), (4, "é b"), (5, "b")]
    ids = vocabulary.encode(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([("a", 5), ("b", 4)], "token string, id int"), "k")
    assert {x["k"]: x["ids"] for x in ids.collect()} == {1: [4, 5, 4, 3], 2: [], 3: [], 4: [3, 4], 5: [4]}
    wide = spark.range(100).selectExpr("id", "repeat('x', 10) AS t")
    assert dealt(wide, "id", 100).rdd.getNumPartitions() > 4 and dealt(wide, "id").rdd.getNumPartitions() == wide.rdd.getNumPartitions()

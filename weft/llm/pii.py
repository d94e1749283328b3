"""Personal data: fixed patterns, and contexts bootstrapped from what they find, by Spark's own functions.

Seeds are the matches of the base patterns.  A candidate is a run of tokens with a digit or an @, or else a token of it, that
has the shape of a kind of identifier and overlaps no seed.  The words before and after an occurrence (of the run, if the
candidate is inside one) are its contexts.  A context becomes a pattern of a kind once `support` different known values of
that kind have it; known are seeds, and candidates whose score has reached `confidence`, so what is found brings in further
patterns.  Patterns and instances form a graph that is scored in rounds:

  score of a pattern   = sum of the scores of the different values with it / number of different texts with the word
  score of an instance = 1 for seeds, else 1 - product over its patterns of (1 - score), as the same value may be met in several contexts

Texts in which no identifier is beside the word count against it, so common words never become patterns.  Candidates that
end with a score of `confidence` or more are added beside any of their patterns, with the kind of the best one; base spans
always stay.

A null text counts as empty; neither has any spans.  Very long texts are searched whole.  Ties between kinds go to the first
listed; spans that start alike are in the order of their kinds.  Repeated rows are scanned each; copies of a text add their
value to a pattern once and count as one text.  An empty table gives an empty table.  Only the id and text columns are read,
so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import save, text_or_empty
from weft.llm.spans import SPAN, let, located, starts

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns.  Runs before an @ or a dot are taken whole (possessive) and only begin where a run or
#: the last match ends: the leftmost match is the same and a long run costs one try instead of one at each character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What a candidate of each kind looks like, without the marks around it: an @ between two names; three groups or more with dots
# or colons between them; so many digits with nothing but blanks, dots, hyphens (and, for phones, brackets) among them.
SHAPES = [
    r"[^@]+@[^@]+",
    r"(?=[^0-9]*[0-9])[0-9A-Fa-f]*+(?:[.:][0-9A-Fa-f]*+){2,}+",
    r"[0-9](?:[\x20.-]?[0-9]){11,18}",
    r"[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}",
]
_SPACE = r"\x20\x09-\x0D"
_TOKEN = rf"[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
#: Tokens with a digit or an @, a blank between each two.
RUN = rf"(?<![^{_SPACE}]){_TOKEN}(?:\x20{_TOKEN})*+"
LAST = rf"(?<![^{_SPACE}])([^{_SPACE}]++)[{_SPACE}]*+$"
FIRST = rf"^[{_SPACE}]*+([^{_SPACE}]++)"
#: Marks around a candidate that are no part of it.
BEFORE, AFTER = r"^[^A-Za-z0-9+(]++", r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++$"
NEAR = "array<struct<start:int,stop:int,kind:int,left:string,right:string,value:string>>"


def _tidy(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]+", ""))


def _seeds(text: Column, kind: int, pattern: str, keep: Callable[[Column], Column], hint: Column) -> Column:
    """Accepted matches as rows of NEAR, with the words before and after."""

    def row(at: Column, m: Column, before: Column, after: Column) -> Column:
        word = lambda gap, which: _tidy(F.regexp_extract(gap, which, 1))
        return F.struct(at.cast("int").alias("start"), (at + F.length(m)).cast("int").alias("stop"), F.lit(kind).alias("kind"), word(before, LAST).alias("left"), word(after, FIRST).alias("right"), m.alias("value"))

    return F.coalesce(F.filter(located(text, pattern, row, hint), lambda x: keep(x["value"])).cast(NEAR), F.array().cast(NEAR))


def seeds(text: Column) -> Column:
    """Matches of the base patterns, by start and kind, as rows of NEAR."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    n = lambda m: F.length(digits(m))
    part = lambda p: F.ltrim(p, F.lit("0"))
    small = lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    return F.concat(
        _seeds(text, 0, EMAIL, lambda m: F.lit(True), F.contains(text, F.lit("@"))),
        _seeds(text, 1, IP, small, F.rlike(text, F.lit(r"[0-9]\.[0-9]"))),
        _seeds(text, 2, CARD, lambda m: (n(m) <= 19) & F.call_function("luhn_check", digits(m)), F.rlike(text, F.lit("[0-9]"))),
        _seeds(text, 3, PHONE, lambda m: n(m).between(10, 15), F.contains(text, F.lit("+"))),
    )


def candidates(text: Column, base: Column) -> Column:
    """Rows of NEAR without a kind: runs, or else their tokens, that have a shape and overlap nothing in base."""

    def row(at: Column, m: Column, before: Column, after: Column) -> Column:
        word = lambda gap, which: _tidy(F.regexp_extract(gap, which, 1))
        return F.struct(at.cast("int").alias("start"), m.alias("value"), word(before, LAST).alias("left"), word(after, FIRST).alias("right"))

    def bare(run: Column, start: Column, value: Column) -> Column:
        head = F.regexp_replace(value, BEFORE, "")
        tail = F.regexp_replace(head, AFTER, "")
        own = F.regexp_replace(tail, r"^\(([^)]*)$", "$1")  # a bracket that nothing closes
        first = (start + F.length(value) - F.length(head) + F.length(tail) - F.length(own)).cast("int")
        return F.struct(first.alias("start"), (first + F.length(own)).cast("int").alias("stop"), F.lit(None).cast("int").alias("kind"), run["left"].alias("left"), run["right"].alias("right"), own.alias("value"))

    fits = lambda c: (F.size(kinds_of(c["value"])) > 0) & ~F.exists(base, lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"]))

    def parts(run: Column) -> Column:
        tokens = F.split(run["value"], "\x20", -1)
        places = lambda t: let(F.transform(t, lambda x: F.length(x) + 1), lambda n: let(F.transform(n, lambda _: F.lit("")), lambda none: starts(n, none)))
        held = let(tokens, lambda t: F.struct(t.alias("t"), let(t, places).alias("at")))
        single = let(held, lambda h: F.filter(F.transform(h["t"], lambda t, i: bare(run, run["start"] + F.get(h["at"], i), t)), fits))
        return let(bare(run, run["start"], run["value"]), lambda c: F.when(fits(c), F.array(c)).otherwise(single))

    return F.coalesce(F.flatten(F.transform(located(text, RUN, row, F.rlike(text, F.lit("[0-9@]"))), parts)).cast(NEAR), F.array().cast(NEAR))


def kinds_of(value: Column) -> Column:
    """The kinds whose shape a value has."""
    return F.filter(F.array(*(F.when(F.rlike(value, F.lit(f"^(?:{p})$")), F.lit(k)) for k, p in enumerate(SHAPES))), lambda k: k.isNotNull())


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 4, confidence: float = 0.5, rounds: int = 4) -> DataFrame:
    """(id_col, base, spans) for every row: arrays of (start, kind, stop), by start and kind."""
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = text.withColumn("seeds", seeds(F.col("text"))).withColumn("open", candidates(F.col("text"), F.col("seeds")))
    base = F.sort_array(F.transform("seeds", lambda s: F.struct(s["start"], s["kind"], s["stop"]))).cast(SPAN)
    held = save(found.select("row", "id", F.xxhash64("text").alias("copy"), base.alias("base"), F.concat("seeds", "open").alias("near")), "found")
    near = held.select("row", F.explode("near").alias("c")).select("row", "c.*")
    context = F.explode(F.filter(F.array(*(F.when(F.col(w) != "", F.concat(F.lit(m), w)) for m, w in (("<", "left"), (">", "right")))), lambda c: c.isNotNull()))
    near = near.select("row", "start", "stop", "kind", "value", context.alias("context"))
    kinds = F.explode(F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(kinds_of(F.col("value"))))
    values = near.select("context", kinds.alias("of"), "value", F.col("kind").isNotNull().alias("seed")).distinct()  # copies count once
    values = save(values.withColumnRenamed("of", "kind"), "values")
    often = save(values.groupBy("context", "kind").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("context", "kind"), "often")
    # all words are counted: those beside four values become more and more common as the input grows, and so would a join with them
    alike = F.lower(F.regexp_replace(text_or_empty(text_col), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))  # each word as _tidy makes it
    copies = save(held.groupBy("copy").agg(F.count("*").alias("n")).filter("n > 1"), "copies")
    texts = docs.select(F.xxhash64(text_or_empty(text_col)).alias("copy"), F.array_distinct(F.split(alike, rf"[{_SPACE}]+")).alias("words")).join(copies, "copy", "left")
    # n copies count 1 / n each, so tasks add up their own words before the shuffle; explode() would have Spark split the texts once more, to filter
    words = texts.select(F.explode_outer("words").alias("word"), (1 / F.coalesce("n", F.lit(1))).alias("part"))
    corpus = words.groupBy("word").agg(F.round(F.sum("part"), 3).alias("docs_with"))
    cues = often.withColumn("word", F.expr("substring(context, 2)")).join(corpus, "word").drop("word")
    values = save(values.join(save(cues, "cues"), ["context", "kind"]), "graph")
    scores = values.filter("seed").select("kind", "value", F.lit(1.0).alias("score")).distinct()
    patterns = None
    for _ in range(rounds):
        known = values.join(scores, ["kind", "value"])
        summed = known.groupBy("context", "kind", "docs_with").agg(F.count_if(F.col("score") >= confidence).alias("known"), F.sum("score").alias("total"))
        patterns = save(summed.filter(F.col("known") >= support).select("context", "kind", F.least(F.lit(1.0), F.col("total") / F.col("docs_with")).alias("score")), "patterns")
        left = F.product(1 - F.col("score"))
        gained = values.join(patterns, ["context", "kind"]).groupBy("kind", "value").agg(F.when(F.max("seed"), 1.0).otherwise(1 - left).alias("score"))
        seeded = values.filter("seed").select("kind", "value", F.lit(1.0).alias("score")).distinct()
        scores = save(gained.unionByName(seeded).groupBy("kind", "value").agg(F.max("score").alias("score")), "scores")
    best = scores.filter(F.col("score") >= confidence).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    # an instance is a value beside one of its patterns; the value alone, elsewhere, is left alone
    beside = save(values.filter("not seed").join(best, ["kind", "value"]).join(patterns, ["context", "kind"]).select("context", "value", F.col("kind").alias("of")).distinct(), "instances")
    new = near.filter("kind is null").join(beside, ["context", "value"])
    new = new.groupBy("row").agg(F.collect_set(F.struct("start", F.col("of").alias("kind"), "stop")).alias("new"))
    out = held.select("row", "id", "base").join(new, "row", "left")
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", F.col("new").cast(SPAN))))
    return out.select(F.col("id").alias(id_col), "base", spans.alias("spans"))

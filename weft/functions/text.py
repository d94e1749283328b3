"""Text functions on columns: keys, digits, entities and their tags, segmentation and output repair.

All are built-in expressions, so they run in the JVM beside the scan.  Folds over a text's matches use higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the strict key deletes (ASCII punctuation and the danda).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~।"

# First code point of ten digits each; the Telugu digits one to nine, and one more zero.
DIGIT_BLOCKS = [0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0CE6, 0x1C50, 0xABF0]
DIGITS_FROM = "".join(chr(z + d) for z in DIGIT_BLOCKS for d in range(10)) + "".join(chr(0x0C66 + d) for d in range(1, 10)) + chr(0x0660)
DIGITS_TO = "0123456789" * len(DIGIT_BLOCKS) + "123456789" + "0"

# The entity patterns, in the order in which they are applied.  An address needs one label and a dot; what follows
# may hold further ones, so labels are not repeated (a repeated group would recurse once a label).
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
URL = r"\b(?<![\w/.])(?:(?:https?|ftp)://)?[\w-]+\.(?!\.)[\w/\-?#&=%.]+(?!\.\w+)\b"
NUMERAL = r"(~?\d+\.?\d*\s?%?\s?-?\s?~?\d+\.?\d*\s?%|~?\d+%|\d+[-\/.,:']\d+[-\/.,:'+]\d+(?:\.\d+)?|\d+[-\/.:'+]\d+(?:\.\d+)?)"
OTHER = r"[A-Za-z0-9]*[#|@]\w+"
ENTITIES = {"email": EMAIL, "url": URL, "numeral": NUMERAL, "other": OTHER}

# What a text must hold, or a place begin with, for a pattern to match: both are found much faster than the pattern fails.
HELD = {EMAIL: "@", URL: r"\.[^\s.]", OTHER: "[#|@]"}
BEGINS = {NUMERAL: r"(?=[~\d])"}

# White space by Unicode's meaning, as \s is with (?U).
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# How the letters of a placeholder may come back from translation.
PLACEHOLDER_FORMS = ["آی ڈی ", "ꯑꯥꯏꯗꯤ", "आईडी", "आई . डी . ", "ऐटि", "آئی ڈی ", "ᱟᱭᱰᱤ ᱾", "आयडी", "ऐडि", "आइडि"]

SENTENCE = r"[^.!?\n]+[.!?]*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body's lambdas use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    """Without white space, by Unicode's meaning, at both ends."""
    return F.btrim(x, F.lit(SPACES))


def squeeze(x: Column) -> Column:
    """Runs of blanks as one, no line feeds, stripped."""
    return strip(F.replace(F.regexp_replace(x, " +", " "), F.lit("\n"), F.lit("")))


def loose_key(x: Column) -> Column:
    """Letters, marks, digits, connectors and white space in lower case; blanks at the ends may stay after punctuation goes."""
    return F.lower(F.regexp_replace(F.regexp_replace(squeeze(x), r"(?U)[^\w\s]", ""), " +", " "))


def strict_key(x: Column) -> Column:
    """Lower case without blanks, ASCII punctuation and danda."""
    return F.translate(F.lower(F.replace(x, F.lit(" "), F.lit(""))), PUNCTUATION, "")


def ascii_digits(x: Column) -> Column:
    return F.translate(x, DIGITS_FROM, DIGITS_TO)


def matches(x: Column, pattern: str) -> Column:
    """Matches with Unicode's classes."""
    found = F.regexp_extract_all(x, F.lit("(?U)" + BEGINS.get(pattern, "") + pattern), F.lit(0))
    if pattern not in HELD:
        return found
    return F.when(~F.rlike(x, F.lit(HELD[pattern])), F.array().cast("array<string>")).otherwise(found)


def _collapse(x: Column) -> Column:
    """Runs of white space as one blank; single blanks, which most are, are not touched."""
    return F.regexp_replace(x, r"(?U)\s(?:\s+|(?<! ))", " ")


def _wrap(x: Column, found: Column, first: bool) -> Column:
    """x with what is found tagged; after the first step white space is collapsed already."""
    wrapped = F.aggregate(found, x, lambda a, m: F.replace(a, m, F.concat(F.lit(" <dnt> "), m, F.lit(" </dnt> "))))
    return _collapse(wrapped) if first else F.when(F.size(found) == 0, x).otherwise(_collapse(wrapped))


def wrap_common(src: Column, tgt: Column, patterns: list[str] | None = None) -> Column:
    """(src, tgt) with the entities found in both tagged, digits in ASCII; one pattern after the other."""
    state = F.struct(ascii_digits(src).alias("src"), ascii_digits(tgt).alias("tgt"))
    for i, p in enumerate(patterns or ENTITIES.values()):
        state = let(state, _common_step(p, i == 0))
    return state


def _common_step(p: str, first: bool) -> Callable[[Column], Column]:
    def step(s: Column) -> Column:
        both = F.array_intersect(matches(s["src"], p), matches(s["tgt"], p))
        return let(both, lambda found: F.struct(_wrap(s["src"], found, first).alias("src"), _wrap(s["tgt"], found, first).alias("tgt")))

    return step


def wrap(x: Column, patterns: list[str] | None = None) -> Column:
    """Text with its entities tagged, digits in ASCII, stripped."""
    state = ascii_digits(x)
    for i, p in enumerate(patterns or ENTITIES.values()):
        state = let(state, _single_step(p, i == 0))
    return strip(state)


def _single_step(p: str, first: bool) -> Callable[[Column], Column]:
    return lambda s: let(F.array_distinct(matches(s, p)), lambda found: _wrap(s, found, first))


def unwrap(x: Column) -> Column:
    """Text without tags."""
    for tag in ("<dnt>", "</dnt>"):
        x = strip(_collapse(F.replace(x, F.lit(tag), F.lit(" "))))
    return x


def mend_tags(processed: Column, raw: Column) -> Column:
    """Tags that a tokenizer took apart, and the raw text between them."""
    whole = F.replace(F.replace(processed, F.lit("< dnt >"), F.lit("<dnt>")), F.lit("< / dnt >"), F.lit("</dnt>"))
    inner = lambda x: F.regexp_extract_all(x, F.lit("<dnt>(.*?)</dnt>"), F.lit(1))

    def mended(p: Column) -> Column:
        pairs = F.filter(F.arrays_zip(inner(p).alias("now"), inner(raw).alias("was")), lambda x: x["now"].isNotNull() & x["was"].isNotNull())
        return F.aggregate(pairs, p, lambda a, x: F.replace(a, x["now"], x["was"]))

    return let(whole, mended)


def _placeholder_step(name: str, p: str) -> Callable[[Column], Column]:
    def put(a: Column, m: Column) -> Column:
        n = F.size(a["entities"]) + 1
        mark = F.concat(F.lit("<ID"), n.cast("string"), F.lit(">"))
        return F.struct(F.replace(a["text"], m, mark).alias("text"), F.concat(a["entities"], F.array(F.struct(n.alias("n"), m.alias("v")))).alias("entities"))

    def step(s: Column) -> Column:
        found = F.array_distinct(matches(s["text"], p))
        if name == "url":
            found = F.filter(found, lambda m: F.length(F.replace(m, F.lit("."), F.lit(""))) >= 4)
        if name == "numeral":
            found = F.filter(found, lambda m: F.length(F.translate(m, " .:", "")) >= 4)
        return F.aggregate(found, F.struct(s["text"].alias("text"), s["entities"].alias("entities")), put)

    return step


def placeholders(x: Column) -> Column:
    """(text, entities): entities replaced by <ID1>, <ID2>, ... in order of pattern and first occurrence.

    entities holds (n, v) rows.  Short numerals and names with initials that look like addresses stay.
    """
    entry = "array<struct<n:int,v:string>>"
    state = F.struct(ascii_digits(x).alias("text"), F.array().cast(entry).alias("entities"))
    for name, p in ENTITIES.items():
        state = let(state, _placeholder_step(name, p))
    return let(state, lambda s: F.struct(strip(F.replace(_collapse(s["text"]), F.lit(">/"), F.lit(">"))).alias("text"), s["entities"].alias("entities")))


def restore(x: Column, entities: Column) -> Column:
    """Text with each form of its placeholders replaced by the entity."""
    forms = [("<ID", ">"), ("< ID", " >")] + [f for w in PLACEHOLDER_FORMS for f in ((f"<{w}", ">"), (f"< {w}", " >"), (f"< {w} ", " >"))]

    def one(a: Column, e: Column) -> Column:
        for left, right in forms:
            a = F.replace(a, F.concat(F.lit(left), e["n"].cast("string"), F.lit(right)), e["v"])
        return a

    return F.when(F.size(entities) > 0, F.aggregate(entities, x, one)).otherwise(x)


def join_pieces(x: Column) -> Column:
    """Text of blank-separated pieces."""
    return strip(F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit("▁"), F.lit(" ")))


def mend_script(x: Column, code: Column) -> Column:
    """What translation leaves wrong in Perso-Arabic scripts and in Odia."""
    arabic = x
    for a, b in ((" ؟", "؟"), (" ۔", "۔"), (" ،", "،"), ("ٮ۪", "ؠ")):
        arabic = F.replace(arabic, F.lit(a), F.lit(b))
    odia = F.replace(x, F.lit("ଯ଼"), F.lit("ୟ"))
    return F.when(F.substring_index(code, "_", -1).isin("Arab", "Aran"), arabic).when(code.startswith("ory_"), odia).otherwise(x)


def clean_output(x: Column) -> Column:
    """One line of single blanks."""
    return strip(_collapse(x))


def one_line(x: Column) -> Column:
    return strip(F.replace(x, F.lit("\n"), F.lit("")))


def sentences(x: Column) -> Column:
    """Sentences by final punctuation and line ends, soft hyphens removed, blank ones left out."""
    found = F.regexp_extract_all(F.replace(x, F.lit("­"), F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def chunks(words: Column, size: int = 256, trailing: bool = False) -> Column:
    """Runs of `size` words; trailing: one more empty run after an exact multiple, as some line-based tools give."""
    n = F.size(words)
    last = F.floor(n / size) if trailing else F.greatest(F.ceil(n / size) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.slice(words, i * size + 1, F.lit(size)))


def pieces_of(x: Column) -> Column:
    """Pieces between single blanks; an empty line is one piece."""
    return F.split(strip(x), " ", -1)

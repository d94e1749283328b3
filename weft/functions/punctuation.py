"""Punctuation normalisers as tables of steps, each a literal or a pattern, applied in order.

Two conventions exist side by side, one for preparing corpora and one for requests; they differ in single right quotes, runs
of dots and the place of some steps.  N stands for the no-break space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

N = " "

# Fixed values: (what, by what); a leading "re:" marks a pattern.
BRACKETS = [("(", " ("), (")", ") ")]
INNER_BRACKETS = [("( ", "("), (" )", ")")]
BLANKS = [("re: +", " ")]
AFTER_BRACKET = [(r"re:\) ([.!:?;,])", ")$1")]
PERCENT = [(r"re:([0-9]) %", "$1%")]
COLONS = [(" :", ":"), (" ;", ";")]
DOUBLE = [("„", '"'), ("“", '"'), ("”", '"')]
DASHES = [("–", "-"), ("—", " - ")]
GUILLEMETS = [(f"{N}«{N}", ' "'), (f"«{N}", '"'), ("«", '"'), (f"{N}»{N}", '" '), (f"{N}»", '"'), ("»", '"')]
NO_BREAK = [(f"{N}%", "%"), (f"nº{N}", "nº "), (f"{N}:", ":"), (f"{N}ºC", " ºC"), (f"{N}cm", " cm"), (f"{N}?", "?"), (f"{N}!", "!"), (f"{N};", ";"), (f",{N}", ", ")]
ENGLISH_QUOTE = [(r're:"([,.]+)', '$1"')]
OTHER_QUOTE = [(',"', '",'), (r're:(\.+)"([ \t\n\x0b\f\r]*[^<])', '"$1$2')]

CORPUS_START = [
    ("\r", ""), *BRACKETS, *BLANKS, *AFTER_BRACKET, *INNER_BRACKETS, *PERCENT, *COLONS, ("`", "'"), ("''", ' " '), *DOUBLE, *DASHES, *BLANKS, ("´", "'"),
    (r"re:([A-Za-z])‘([A-Za-z])", "$1'$2"), (r"re:([A-Za-z])’([A-Za-z])", "$1'$2"), ("‘", "'"), ("‚", "'"), ("’", '"'), ("''", '"'), ("…", "..."), *GUILLEMETS, *NO_BREAK, *BLANKS,
]
REQUEST = [
    ("\r", ""), *BRACKETS, *INNER_BRACKETS, *COLONS, ("`", "'"), *DOUBLE, *DASHES, ("´", "'"), ("‘", "'"), ("‚", "'"), ("’", "'"), ("''", '"'), ("…", "..."), *GUILLEMETS, *NO_BREAK,
    ("re: {2,}", " "), (r"re:\.{2,}", "."), *AFTER_BRACKET, (r"re:(?U)(\d) %", "$1%"), *ENGLISH_QUOTE, (f"re:(?U)(\\d){N}(\\d)", "$1.$2"),
]

#: Languages in which a no-break space between digits becomes a comma.
COMMA_LANGUAGES = ["de", "es", "cz", "cs", "fr"]


def apply_steps(x: Column, steps: list[tuple[str, str]]) -> Column:
    for what, by in steps:
        x = F.regexp_replace(x, what[3:], by) if what.startswith("re:") else F.replace(x, F.lit(what), F.lit(by))
    return x


def normalize_corpus(x: Column, lang: str = "en") -> Column:
    """The corpus convention for a punctuation language; a line's end counts as text after it, so a line feed is put there and taken off."""
    x = apply_steps(F.concat(x, F.lit("\n")), CORPUS_START)
    if lang == "en":
        x = apply_steps(x, ENGLISH_QUOTE)
    elif lang not in ("cs", "cz"):
        x = apply_steps(x, OTHER_QUOTE)
    x = F.regexp_replace(x, f"([0-9]){N}([0-9])", "$1,$2" if lang in COMMA_LANGUAGES else "$1.$2")
    return F.regexp_replace(x, "\n$", "")


def normalize_request(x: Column) -> Column:
    """The convention for requests: English rules whatever the language; digits of any script."""
    return F.trim(apply_steps(x, REQUEST))

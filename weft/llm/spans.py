"""Matches of a pattern with their places, by Spark's own functions.

Spark tells what matched but not where.  The text between matches comes from split() with the same pattern, so a match
starts where the lengths of all gaps and matches before it end.  Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body's lambdas use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def starts(sizes: Column, gaps: Column) -> Column:
    """Where each match starts. sizes: of gap and match together; sums are taken by blocks, so long lists stay cheap."""
    n = F.size(sizes)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda sums: F.transform(sums, lambda _, i: F.when(i == 0, 0).otherwise(_sum(F.slice(sums, F.lit(1), i))))
    place = lambda done: F.transform(
        sizes,
        lambda _, i: F.get(done, F.floor(i / BLOCK).cast("int")) + F.when(i % BLOCK == 0, 0).otherwise(_sum(F.slice(sizes, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))) + F.length(F.get(gaps, i)),
    )
    return let(let(blocks, before), place)


def located(text: Column, pattern: str, row: Callable[[Column, Column, Column, Column], Column], hint: Column | None = None) -> Column:
    """row(start, match, gap before, gap after) for each leftmost non-overlapping match; hint: a cheap necessary condition."""
    own = F.lit(pattern)
    both = F.struct(F.regexp_extract_all(text, own, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def rows(x: Column) -> Column:
        m, g = x["m"], x["g"]
        sizes = F.transform(m, lambda v, i: F.length(v) + F.length(F.get(g, i)))
        at = let(sizes, lambda s: F.when(F.size(s) > 0, starts(s, g)))
        return let(at, lambda a: F.transform(m, lambda v, i: row(F.get(a, i), v, F.get(g, i), F.get(g, i + 1))))

    test = F.rlike(text, own)
    return F.when(test if hint is None else hint & test, let(both, rows))


def spans_of(text: Column, kind: int, pattern: str, keep: Callable[[Column], Column] | None = None, hint: Column | None = None) -> Column:
    """Spans (start, kind, stop) of matches that keep() accepts: an empty list if there are none."""
    found = located(text, pattern, lambda at, m, *_: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).cast("int").alias("stop"), m.alias("m")), hint)
    if keep is not None:
        found = F.filter(found, lambda x: keep(x["m"]))
    return F.coalesce(F.transform(found, lambda x: F.struct(x["start"], x["kind"], x["stop"])), F.array().cast(SPAN))


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def as_text(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span in order, joined by commas."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))))

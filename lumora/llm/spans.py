"""Spans of pattern matches inside texts, as DataFrame expressions.

A span is a struct (start, kind_no, kind, end, value); start and end are code points, end exclusive. Matches and the pieces
between them come from one pattern (``regexp_extract_all`` and ``split``), and running lengths turn them into places.

Time is near linear in the text and in its matches: patterns use possessive repeats and look behind them, so that a long run
is read once; running values are taken in blocks of ``BLOCK`` (an array that grows by one would be copied for each match);
and what a lambda needs from outside is bound once by ``let`` (Spark evaluates an outer expression again for each element).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,value:string>>"
PLACED = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Code points of text kept on either side of a match, for its context.
SIDE = 64
#: Elements whose running values are taken together.
BLOCK = 256
_LAST = 2**31 - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each element of an array the sum, by ``add``, of those before it; ``kind`` is the type of an element."""
    none = F.array().cast(f"array<{kind}>")

    def sums(xs: Column, first: Column) -> Column:
        begin = F.struct(first.alias("sum"), none.alias("out"))
        return F.aggregate(xs, begin, lambda acc, x: F.struct(add(acc["sum"], x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])

    def blocked(xs: Column) -> Column:
        n = F.ceil(F.size(xs) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(xs, k * BLOCK + 1, BLOCK))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, sums(F.transform(bs, lambda b: F.aggregate(b, zero, lambda x, y: add(x, y))), zero), lambda b, first: sums(b, first))))

    return let(values, lambda xs: F.when(F.size(xs) == 0, none).when(F.size(xs) <= BLOCK, sums(xs, zero)).otherwise(blocked(xs)))


def placed(text: Column, pattern: str, sides: bool = False) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value, before, after).

    With ``sides``, before and after hold the SIDE code points of text around a match (before reaches over earlier matches,
    after ends at the next one); else they are the last and first code point around it.
    """
    side = SIDE if sides else 1

    def at(found: Column, pieces: Column) -> Column:
        own = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
        starts = lambda xs: running(F.transform(xs, lambda x: F.length(x["b"]) + F.length(x["m"])), F.lit(0), lambda a, b: a + b, "int")
        tails = lambda xs: running(F.transform(xs, lambda x: F.right(F.concat(x["b"], x["m"]), F.lit(side))), F.lit(""), lambda a, b: F.right(F.concat(a, b), F.lit(side)), "string")

        def one(x: Column, i: Column, start: Column, tail: Column) -> Column:
            begin = F.element_at(start, i + 1) + F.length(x["b"])
            before = F.right(F.concat(F.element_at(tail, i + 1), x["b"]), F.lit(side))
            return F.struct(begin.alias("start"), (begin + F.length(x["m"])).alias("end"), x["m"].alias("value"), before.alias("before"), F.left(F.element_at(pieces, i + 2), F.lit(side)).alias("after"))

        return let(own, lambda xs: let(starts(xs), lambda s: let(tails(xs), lambda t: F.transform(xs, lambda x, i: one(x, i, s, t)))))

    whole = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: let(F.split(text, pattern, -1), lambda pieces: at(found, pieces)))
    return F.when(F.rlike(text, F.lit(pattern)), whole).otherwise(F.array().cast(PLACED))


def passing(matches: Column, good: Callable[[Column], Column]) -> Column:
    return F.filter(matches, lambda m: good(m["value"]))


def as_kind(matches: Column, kind: str, kind_no: int, good: Callable[[Column], Column] | None = None) -> Column:
    if good is not None:
        matches = passing(matches, good)
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind number, then end; comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart_from(matches: Column, spans: Column) -> Column:
    """Of ``matches`` (by start, not overlapping each other) those that share no place with any of the spans.

    One sweep over both, sorted by start: the greatest end of the spans before a match, and the start of the next span.
    """

    def sweep(ms: Column, ss: Column) -> Column:
        entry = lambda own: lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"))
        every = F.array_sort(F.concat(F.transform(ss, entry(0)), F.transform(ms, entry(1))))

        def judged(es: Column) -> Column:
            ends = running(F.transform(es, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(-1)), F.lit(-1), F.greatest, "int")
            nexts = F.reverse(running(F.reverse(F.transform(es, lambda e: F.when(e["own"] == 0, e["start"]).otherwise(_LAST))), F.lit(_LAST), F.least, "int"))
            fits = lambda e, i, a, b: F.struct(e["own"].alias("own"), ((F.element_at(a, i + 1) <= e["start"]) & (F.element_at(b, i + 1) >= e["end"])).alias("fits"))
            flags = let(ends, lambda a: let(nexts, lambda b: F.transform(es, lambda e, i: fits(e, i, a, b))))
            return F.filter(flags, lambda f: f["own"] == 1)

        return let(let(every, judged), lambda flags: F.filter(ms, lambda m, i: F.element_at(flags, i + 1)["fits"]))

    return let(matches, lambda ms: let(spans, lambda ss: F.when((F.size(ms) == 0) | (F.size(ss) == 0), ms).otherwise(sweep(ms, ss))))


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

"""Secret scans: fixed patterns, and windows of high entropy in candidate strings. DataFrame functions only.

A candidate is a run of key characters. Its class (hex digits; letters with digits; letters of mixed case) sets the limit.
A window of ``WINDOW`` characters slides over it: the sum of n * log2(n) over the window's character counts changes only by
the character that leaves and the one that enters, and entropy = log2(WINDOW) - sum / WINDOW. The highest window decides.
Candidates of ``MIN_SHORT`` characters up to a window are judged if digits and letters alternate, by their share of the entropy
they could have. An allow-list of shapes that are no secrets (UUIDs, numbers, paths of words) suppresses candidates, but of a path
the longest segment is still judged by itself; plain sequences are cut out, and what lies between them is judged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .spans import PLACED, SPAN, apart_from, as_kind, let, n_of, placed, written

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
#: What stands before group 2 of ASSIGN.
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*+[:=]\x20*+["']?"""
MIN_ASSIGNED = 8
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
WINDOW, MIN_SHORT = 20, 16
#: Lowest entropy in bits of a secret's window, by class; 20 characters can have 4.32 bits.
LIMITS = {"hex": 3.0, "mixed": 3.7, "letters": 3.9}
ALLOWED = [
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[0-9/_=+-]+$",
]
#: Segments of letters only; the last may end in a short number.
PATH = r"^/?(?:[A-Za-z]++[/_-]++)++[A-Za-z]*+[0-9]{0,8}$"
SEPARATORS = "[/_=+-]+"
SEQUENCE = "(?i)abcdefghij" + "".join(f"(?:{c}" for c in "klmnopqrstuvwxyz") + ")?" * 16 + "|0123456789|1234567890"
#: The characters of a candidate; counts of _PER_LONG of them share a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_PER_LONG = 12
_LONGS = -(-len(ALPHABET) // _PER_LONG)
_N_LOG_N = [n * math.log2(n) if n else 0.0 for n in range(WINDOW + 2)]


def highest_entropy(s: Column) -> Column:
    """The highest entropy of a window of WINDOW characters; of a shorter string, its entropy as if it had that many.

    The counts of all characters of the alphabet are packed into longs, five bits each. A step adds one at the character that
    enters and takes one off at the character that leaves, so the time is linear in the string.
    """
    n_log_n = lambda n: F.element_at(F.lit(_N_LOG_N), n.cast("int") + 1)
    place = lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1
    bits = lambda code: F.pmod(code, F.lit(_PER_LONG)) * 5
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), bits(code))
    held = lambda counts, code: F.call_function("shiftright", F.element_at(counts, F.floor(code / _PER_LONG).cast("int") + 1), bits(code)).bitwiseAND(F.lit(31))

    def changed(counts: Column, code: Column, sign: int) -> Column:
        at = F.floor(code / _PER_LONG)
        return F.transform(counts, lambda c, k: F.when(k == at, c + sign * one(code)).otherwise(c))

    def step(acc: Column, x: Column) -> Column:
        out, into = x["out"], x["into"]
        left = F.when(out >= 0, let(held(acc["counts"], out), lambda n: n_log_n(n - 1) - n_log_n(n))).otherwise(0.0)
        after = F.when(out >= 0, changed(acc["counts"], out, -1)).otherwise(acc["counts"])
        return let(F.struct(after.alias("counts"), (acc["total"] + left).alias("total")), lambda m: let(held(m["counts"], into), lambda n: entered(acc, m, into, n)))

    def entered(acc: Column, m: Column, into: Column, n: Column) -> Column:
        return let(m["total"] + n_log_n(n + 1) - n_log_n(n), lambda total: F.struct(
            changed(m["counts"], into, 1).alias("counts"), total.alias("total"), (acc["n"] + 1).alias("n"),
            F.when(acc["n"] >= WINDOW - 1, F.greatest(acc["best"], math.log2(WINDOW) - total / WINDOW)).otherwise(acc["best"]).alias("best")))

    def whole(codes: Column) -> Column:
        pairs = F.transform(codes, lambda c, i: F.struct(c.alias("into"), F.when(i >= WINDOW, F.element_at(codes, F.greatest(i - WINDOW + 1, F.lit(1)))).otherwise(-1).alias("out")))
        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), _LONGS).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(-1.0).alias("best"))
        short = lambda acc: (1 - acc["total"] / (acc["n"] * F.log2(acc["n"].cast("double")))) * math.log2(WINDOW)
        return F.aggregate(pairs, zero, step, lambda acc: F.when(acc["best"] >= 0, acc["best"]).otherwise(short(acc)))

    return let(F.transform(F.split(s, ""), place), whole)


def limit_for(s: Column) -> Column:
    has = lambda p: F.rlike(s, F.lit(p))
    return (F.when(has("^[0-9a-fA-F]+$") & has("[0-9]") & has("[a-fA-F]"), F.lit(LIMITS["hex"]))
            .when(has("[0-9]") & has("[A-Za-z]"), F.lit(LIMITS["mixed"]))
            .when((has("(?:[A-Z][^A-Z]*+){3}") & has("(?:[a-z][^a-z]*+){3}")) | has("^[A-Za-z]+$"), F.lit(LIMITS["letters"])))


def has_entropy(s: Column) -> Column:
    short = (F.length(s) >= MIN_SHORT) & F.rlike(s, F.lit("^[A-Za-z0-9]+$")) & F.rlike(s, F.lit("[0-9][A-Za-z]+[0-9]"))
    return F.when(((F.length(s) >= WINDOW) | short) & limit_for(s).isNotNull(), highest_entropy(s) >= limit_for(s)).otherwise(F.lit(False))


def is_secret(s: Column) -> Column:
    def judged(piece: Column) -> Column:
        """What of a piece is judged: itself and its longest segment, or only that."""
        allowed = F.lit(False)
        for p in ALLOWED:
            allowed = allowed | F.rlike(piece, F.lit(p))
        longest = F.array_max(F.transform(F.split(piece, SEPARATORS), lambda x: F.struct(F.length(x).alias("n"), x.alias("value"))))["value"]
        return F.when(allowed, F.array().cast("array<string>")).when(F.rlike(piece, F.lit(PATH)), F.array(longest)).otherwise(F.array(piece, longest))

    return F.exists(F.flatten(F.transform(F.split(s, SEQUENCE), judged)), has_entropy)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_found, n_spans for each row of ``docs(doc_id, text)``.

    A null or empty text has no spans. A span is the whole match. ``spans`` holds the base spans and the n_found spans of
    kind ``entropy``, which never overlap a base span; n_spans counts both. Repeated rows are judged each. Time is linear in
    a text, also of one long run.
    """
    none = F.array().cast(PLACED)
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.withColumn("assign", F.filter(placed(F.col("text"), ASSIGN), lambda m: F.length(F.regexp_replace(m["value"], ASSIGN_HEAD, "")) >= MIN_ASSIGNED))
    rows = rows.withColumn("access", F.when(F.contains("text", F.lit("AKIA")), placed(F.col("text"), ACCESS)).otherwise(none))
    rows = rows.withColumn("hex", placed(F.col("text"), HEX))
    rows = rows.withColumn("base", F.concat(*[as_kind(F.col(k), k, i) for i, k in enumerate(KINDS)]).cast(SPAN))
    rows = rows.withColumn("runs", placed(F.col("text"), CANDIDATE))
    rows = rows.withColumn("more", as_kind(apart_from(F.col("runs"), F.col("base")), "entropy", len(KINDS), is_secret).cast(SPAN))
    base = F.col("base")
    return rows.select("doc_id", *[n_of(base, k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"),
                       written(F.concat(base, F.col("more"))).alias("spans"), F.size("more").cast("long").alias("n_found"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"))

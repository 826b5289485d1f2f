"""Personal data: fixed patterns, and identifiers that their contexts give away. DataFrame functions only.

The matches of four patterns (email, ip, card, phone) are seeds. Their contexts become lexical patterns: the last word before a
value, the last two, and the words on both sides. Candidates are other tokens with digits, grouped numbers (spaces, brackets,
dashes), addresses with @ or [at], and names (words with inner marks, or after a colon or the like). Patterns and instances
(values) form a graph that is bootstrapped in rounds: a pattern's score is the mean score of the values in it, a value's score
the noisy-or of its patterns from half on, and seeds stay at 1. Found values count like seeds in the next round, so contexts
that no seed has become patterns too. In the end patterns with enough known values and a high score extract the candidates in
them, with the kind of their values.

Of a very long text all matches are taken; contexts reach SIDE code points to either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, text_of
from .spans import PLACED, SPAN, apart_from, as_kind, let, n_of, passing, placed, written

KINDS = ("email", "ip", "card", "phone")
#: A run of local-part characters or of digits is tried from its start only, or from the end of the match before (\\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like token: letters, digits and inner marks, with a digit.
TOKEN = r"(?<![A-Za-z0-9._@+-])[A-Za-z._@+-]*+[0-9](?:[A-Za-z0-9._@+-]*[A-Za-z0-9])?"
MIN_TOKEN, MIN_DIGITS = 6, 4
_GAP = r"[\x20()./-]{1,3}"
#: Groups of digits, each too short for a token of its own unless the first is a prefix; a long table of numbers is none.
GROUPED = (rf"(?<![A-Za-z0-9._@+-])(?:(?:[+(]{{1,2}}+[0-9]{{1,5}}+|0[0-9]{{1,4}}+)(?:{_GAP}[0-9]{{1,12}}+){{1,8}}+|[0-9]{{1,5}}+(?:{_GAP}[0-9]{{1,5}}+){{1,8}}+)"
           rf"(?!{_GAP}[0-9]|[A-Za-z0-9@_])")
MIN_GROUPED, MAX_GROUPED = 7, 19
_AT, _DOT = (rf"\x20?[\[({{](?:{x})[\])}}]\x20?" for x in ("at|AT", "dot|DOT"))
ADDRESS = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|{_AT})[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)*+"
NAME = r"(?:(?<=[:=#]\x20)|(?<=[:=#]))[A-Za-z][A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*+|(?<![A-Za-z0-9._@+-])[A-Za-z][A-Za-z0-9]*+(?:[._][A-Za-z0-9]++)++"
ROUNDS = 6
#: Distinct known values that a pattern needs, the score from which it extracts, and the score a value must reach.
MIN_SEEDS, MIN_PATTERN, MIN_VALUE = 3, 0.8, 0.8
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def is_ip(v: Column) -> Column:
    return F.rlike(v, F.lit(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))


def is_card(v: Column) -> Column:
    back = F.reverse(digits(v))

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(F.length(back).between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def is_phone(v: Column) -> Column:
    return F.length(digits(v)).between(10, 15)


def base_spans(text: Column) -> dict[str, Column]:
    """Matches by kind, with their sides; those that fail their check are out."""
    return {
        "email": F.when(F.contains(text, F.lit("@")), placed(text, EMAIL, True)),
        "ip": placed(text, IP, True), "card": placed(text, CARD, True),
        "phone": F.when(F.contains(text, F.lit("+")), placed(text, PHONE, True)),
    }


def contexts(before: Column, after: Column) -> Column:
    """The pattern keys of a place: its last word, its last two words, and the words on both sides."""
    words = lambda c: F.filter(F.split(ascii_lower(F.regexp_replace(c, r"[^\p{L}\p{N}#:=]+", " ")), " "), lambda w: w != "")

    def keys(left: Column, right: Column) -> Column:
        one = F.when(F.size(left) >= 1, F.concat(F.lit("1:"), F.element_at(left, -1)))
        two = F.when(F.size(left) >= 2, F.concat_ws(" ", F.concat(F.lit("2:"), F.element_at(left, -2)), F.element_at(left, -1)))
        both = F.when((F.size(left) >= 1) & (F.size(right) >= 1), F.concat_ws(" ", F.concat(F.lit("3:"), F.element_at(left, -1)), F.lit("_"), F.element_at(right, 1)))
        return F.array_compact(F.array(one, two, both))

    return let(words(before), lambda left: let(words(after), lambda right: keys(left, right)))


def found_in(docs: DataFrame) -> DataFrame:
    """row, doc_id, spans (base), seeds and others (kind, or what kinds a candidate may be of, start, end, value, pattern keys) for each row."""
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("row", F.monotonically_increasing_id())
    some = rows.withColumn("digit", F.rlike("text", F.lit("[0-9]")))
    good = {"email": None, "ip": is_ip, "card": is_card, "phone": is_phone}
    for kind, c in base_spans(F.col("text")).items():
        # a domain may be all letters; the other kinds need a digit
        c = c if kind == "email" else F.when(F.col("digit"), c)
        some = some.withColumn(kind, F.coalesce(c, F.array().cast(PLACED)))
        if good[kind]:
            some = some.withColumn(kind, passing(F.col(kind), good[kind]))
    some = some.withColumn("spans", F.concat(*[as_kind(F.col(k), k, i) for i, k in enumerate(KINDS)]).cast(SPAN))

    def keyed(kind: str | None, c: Column) -> Column:
        return F.transform(c, lambda m: F.struct(F.lit(kind).cast("string").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), contexts(m["before"], m["after"]).alias("keys")))

    def candidates(pattern: str, when: Column, good) -> Column:
        return F.filter(F.when(when, placed(F.col("text"), pattern, True)).otherwise(F.array().cast(PLACED)), good)

    some = some.withColumn("grouped", candidates(GROUPED, F.col("digit"), lambda m: F.length(digits(m["value"])).between(MIN_GROUPED, MAX_GROUPED)))
    some = some.withColumn("address", candidates(ADDRESS, F.rlike("text", F.lit(r"@|[\[({](?:at|AT)[\])}]")), lambda m: F.length(m["value"]) >= MIN_TOKEN))
    some = some.withColumn("tokens", candidates(TOKEN, F.col("digit"), lambda m: (F.length(m["value"]) >= MIN_TOKEN) & (F.length(digits(m["value"])) >= MIN_DIGITS)))
    some = some.withColumn("names", candidates(NAME, F.lit(True), lambda m: F.length(m["value"]) >= 3))
    # none overlaps a base span, or a candidate of a list before its own
    others, taken = [], F.col("spans")
    for c, like in (("grouped", "number"), ("address", None), ("tokens", None), ("names", "email")):
        some = some.withColumn(c, apart_from(F.col(c), taken))
        others.append(keyed(like, F.col(c)))
        taken = F.concat(taken, as_kind(F.col(c), c, len(KINDS)).cast(SPAN))
    return some.select("row", "doc_id", "spans", F.concat(*[keyed(k, F.col(k)) for k in KINDS]).alias("seeds"), F.concat(*others).alias("others"))


def may_be() -> Column:
    """Whether a candidate (like) can be of a kind."""
    return F.col("like").isNull() | (F.col("like") == F.col("kind")) | ((F.col("like") == "number") & (F.col("kind") != "email"))


def learn_patterns(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored patterns (key, kind, score) and found values (value_id, kind, score) of the bootstrapped graph."""

    def edges_of(c: str, kind: str) -> DataFrame:
        each = found.select(F.explode(c).alias("x")).select(F.col("x.kind").alias(kind), F.xxhash64("x.value").alias("value_id"), F.explode("x.keys").alias("key"))
        return stored(each.distinct(), "pii-edges")

    seeds, others = edges_of("seeds", "kind"), edges_of("others", "like")
    of_seeds = seeds.groupBy("key", "kind").agg(F.count("*").alias("n"), F.count("*").cast("double").alias("mass"))
    n_others = stored(others.groupBy("key", "like").agg(F.count("*").alias("n_others")), "pii-others")
    patterns = values = None
    for _ in range(ROUNDS):
        known = of_seeds.withColumn("n_seeds", F.col("n"))
        if values is not None:
            heard = others.join(values, "value_id").where(may_be()).groupBy("key", "kind").agg(F.count_if(F.col("score") >= MIN_VALUE).alias("n"), F.sum("score").alias("mass"))
            known = known.unionByName(heard.withColumn("n_seeds", F.lit(0).cast("long"))).groupBy("key", "kind").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.sum("n_seeds").alias("n_seeds"))
        known = known.where(F.col("n") >= MIN_SEEDS)
        # the other values in a pattern that could be of its kind
        rest = known.select("key", "kind").join(n_others, "key").where(may_be()).groupBy("key", "kind").agg(F.sum("n_others").alias("n_others"))
        score = F.round(F.col("mass") / (F.col("n_seeds") + F.coalesce("n_others", F.lit(0))), 9)
        patterns = stored(known.join(rest, ["key", "kind"], "left").select("key", "kind", score.alias("score")), "pii-patterns")
        heard = others.join(patterns.where("score >= 0.5"), "key").where(may_be())
        values = stored(heard.groupBy("value_id", "kind").agg(F.round(1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))), 9).alias("score")), "pii-values")
    return patterns, values


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans for each row of ``docs(doc_id, text)``.

    A null or empty text has no spans (empty strings; the digest is that of the empty string). ``spans`` holds the base
    spans and the n_found spans that contexts added; those never overlap a base span. n_spans counts both. Equal values in
    several rows are one value of the graph, with a span in each row; of equal scores the kind that is listed first counts.
    """
    found = stored(found_in(docs), "pii-found")
    patterns, values = learn_patterns(found)
    strong = patterns.where(F.col("score") >= MIN_PATTERN).select("key", "kind")
    others = found.select("row", F.explode("others").alias("x")).select("row", F.col("x.kind").alias("like"), "x.start", "x.end", "x.value", F.explode("x.keys").alias("key"))
    hits = others.join(strong, "key").where(may_be()).withColumn("value_id", F.xxhash64("value")).join(values.where(F.col("score") >= MIN_VALUE).select("value_id", "kind"), ["value_id", "kind"])
    number = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int") - 1
    one = hits.groupBy("row", "start", "end").agg(F.min(F.struct(number.alias("kind_no"), "kind", "value")).alias("k"))
    more = one.groupBy("row").agg(F.collect_list(F.struct("start", "k.kind_no", "k.kind", "end", "k.value")).cast(SPAN).alias("more"))
    base = F.col("spans")
    out = found.select("row", "doc_id", "spans").join(more, "row", "left")
    n_found = F.coalesce(F.size(F.coalesce("more", F.array().cast(SPAN))), F.lit(0)).cast("long")
    return out.select(
        "doc_id", *[n_of(base, k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"),
        written(F.concat(base, F.coalesce("more", F.array().cast(SPAN)))).alias("spans"), n_found.alias("n_found"), (F.size(base) + n_found).cast("long").alias("n_spans"))

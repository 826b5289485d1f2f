"""Segmentation: a text into numbered questions and lettered parts, as rows.

Markers are found by one regular expression that puts sentinels around them, and the text is split at those; nothing leaves
the JVM. The rules that look sequential (the guard against numbered bullets, the current parent, the target of bullets) are
running windows over a document's pieces, so any number of documents is one job partitioned by ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.text import base_number, let, natural_key, strip

PAGE_BREAK = "---PAGE_BREAK---"
# The patterns of question markers, part markers, page headers and noise lines.
QUESTION = r"(?i)(?:^|\n)\s*(?:Q(?:uestion|\.)?\s*|Ans(?:wer)?\s*\.?\s*)?[\(\[]?0?(\d{1,2}[a-z]?)[\)\]\.\/\:\-\_\ \\]"
PART = r"(?i)(?:^|\n)\s*([a-h]|[ivx]+)\s*[\)\.\-]\s*"
PAGE_HEADERS = [
    r"\b(?:Main|Additional)\s+(?:Sh[ea][ea]t|Answer)",
    r"\bAddit[io][ao]n[ae]l\s+Sh[ea][ea]t",
    r"Space\s+for\s+Writing",
    r"MARKS\s+T[oO]\s+BE\s+FILLED",
    r"(?:Main|Additional)\s*Sh[a-z]*t\b",
]
NOISE_LINE = r"(?i)^\s*(Sub\s+Total|Maximum\s+Marks|Marks\s+Secured|CO\s*\d|Onos|Q\.?No\.?|\d+)\s*$"
HIGHEST = 50
_OPEN, _CLOSE = "\u0001", "\u0002"


def _marked(text: Column, pattern: str) -> Column:
    """[before, marker + CLOSE + content, ...]; sentinels that the text itself holds are dropped first."""
    safe = F.translate(text, _OPEN + _CLOSE, "")
    return F.split(F.regexp_replace(safe, F.lit(pattern), F.lit(f"{_OPEN}$1{_CLOSE}")), _OPEN, -1)


def _content(piece: Column) -> Column:
    return strip(F.substring_index(piece, _CLOSE, -1))


def _marker(piece: Column) -> Column:
    return F.lower(F.substring_index(piece, _CLOSE, 1))


def pieces(texts: DataFrame) -> DataFrame:
    """doc_id, pos, key_raw, num, suffix, content, guarded, parent for the markers in range of ``texts(doc_id, text)``.

    A guarded piece is a numbered bullet: a number up to 3 below the highest so far, once 4 is reached. ``parent`` is the last
    plain number that is not guarded. Numbers outside 1..50 are dropped with their content.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), PAGE_BREAK, "\n")
    p = texts.select("doc_id", F.posexplode(_marked(body, QUESTION)).alias("pos", "piece")).where("pos > 0")
    p = p.select("doc_id", "pos", _marker(F.col("piece")).alias("key_raw"), _content(F.col("piece")).alias("content"))
    p = p.withColumn("num", base_number(F.col("key_raw")).try_cast("int")).where(F.col("num").between(1, HIGHEST))
    p = p.withColumn("suffix", F.regexp_replace("key_raw", r"\d", ""))
    order = Window.partitionBy("doc_id").orderBy("pos")
    p = p.withColumn("highest", F.max("num").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    p = p.withColumn("guarded", F.coalesce((F.col("highest") >= 4) & (F.col("num") <= 3) & (F.col("num") < F.col("highest")), F.lit(False)))
    plain = F.when(~F.col("guarded") & (F.col("suffix") == ""), F.col("num"))
    return p.withColumn("parent", F.last(plain, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("highest")


def parts_of(content: Column) -> tuple[Column, Column]:
    """The text before the first part marker, and the kept parts as an array of (letter, text).

    Only letters a to h with three characters or more are kept; of a repeated letter the last text, at its first place.
    Text of roman parts is lost. Without any marker both are null.
    """
    split = _marked(content, PART)
    each = F.transform(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0))), lambda x: F.struct(_marker(x).alias("letter"), _content(x).alias("text")))
    good = F.filter(each, lambda x: F.rlike(x["letter"], F.lit("^[a-h]$")) & (F.length(x["text"]) >= 3))
    letters = F.array_distinct(F.transform(good, lambda x: x["letter"]))
    kept = F.transform(letters, lambda k: F.struct(k.alias("letter"), F.try_element_at(F.filter(good, lambda x: x["letter"] == k), F.lit(-1))["text"].alias("text")))
    found = F.size(split) > 1
    return F.when(found, strip(F.try_element_at(split, F.lit(1)))), F.when(found, kept)


def _with_expected(parts: Column, intro: Column, parent: Column, expected: Column) -> tuple[Column, Column]:
    """Parts that are not expected join the part or introduction before them; if none is expected there is no split."""
    is_expected = lambda x: F.array_contains(expected, F.concat(parent, x["letter"]))
    start = F.struct(F.coalesce(intro, F.lit("")).alias("intro"), F.filter(parts, lambda x: F.lit(False)).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        none = F.size(acc["done"]) == 0
        last = F.try_element_at(acc["done"], F.lit(-1))
        glued = F.concat(F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(F.struct(last["letter"].alias("letter"), F.concat_ws(" ", last["text"], x["text"]).alias("text"))))
        done = F.when(is_expected(x), F.concat(acc["done"], F.array(x))).when(none, acc["done"]).otherwise(glued)
        new = F.when(~is_expected(x) & none, F.when(acc["intro"] == "", x["text"]).otherwise(F.concat_ws(" ", acc["intro"], x["text"]))).otherwise(acc["intro"])
        return F.struct(new.alias("intro"), done.alias("done"))

    folded = F.aggregate(parts, start, step)
    some = F.exists(parts, is_expected)
    return F.when(some, folded["intro"]), F.when(some, folded["done"])


def written_pieces(texts: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """doc_id, ord, q_key, text: what each piece adds to which key, in document order, before keys are merged.

    ``expected(doc_id, q_keys array<string>)`` restricts parts to expected keys; meta keys (``_...``) do not count.
    """
    p = pieces(texts)
    intro, parts = parts_of(F.col("content"))
    p = p.withColumn("intro", intro).withColumn("parts", parts)
    p = p.withColumn("parent_key", F.coalesce("parent", "num").cast("string"))
    if expected is not None:
        e = expected.select("doc_id", F.filter("q_keys", lambda k: ~F.startswith(k, F.lit("_"))).alias("expected"))
        p = p.join(e, "doc_id", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<string>")))
        new_intro, new_parts = _with_expected(F.col("parts"), F.col("intro"), F.col("parent_key"), F.col("expected"))
        checked = F.size("expected") > 0
        p = p.withColumn("new_intro", F.when(checked, new_intro).otherwise(F.col("intro"))).withColumn("parts", F.when(checked, new_parts).otherwise(F.col("parts"))).withColumn("intro", F.col("new_intro"))
    split = F.col("parts").isNotNull() & ((F.col("intro") != "") | (F.size("parts") > 0))
    p = p.withColumn("split", F.coalesce(split, F.lit(False))).withColumn("key", F.concat(F.col("num").cast("string"), "suffix"))
    # bullets go to the last part written, or to the parent when the last block had none
    last_part = F.concat("parent_key", F.try_element_at("parts", F.lit(-1))["letter"])
    own = F.when(F.col("suffix") != "", F.col("key"))
    told = F.when(~F.col("guarded") & F.col("split") & (F.size("parts") > 0), F.struct(last_part.alias("k"))).when(~F.col("guarded") & ~F.col("split"), F.struct(own.alias("k")))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("target", F.coalesce(F.last(told, ignorenulls=True).over(order)["k"], F.last("parent", ignorenulls=True).over(before).cast("string")))
    row = lambda key, text: F.struct(key.alias("q_key"), text.alias("text"))
    as_parts = F.transform("parts", lambda x: row(F.concat("parent_key", x["letter"]), x["text"]))
    out = (F.when(F.col("guarded"), F.when(F.col("target").isNotNull(), F.array(row(F.col("target"), F.concat_ws(" ", "key_raw", "content")))))
           .when(F.col("split"), F.concat(F.when(F.col("intro") != "", F.array(row(F.col("key"), F.col("intro")))).otherwise(F.expr("array()").cast("array<struct<q_key:string,text:string>>")), as_parts))
           .otherwise(F.array(row(F.col("key"), F.col("content")))))
    return p.select("doc_id", "pos", F.posexplode(out).alias("no", "x")).select("doc_id", (F.col("pos") * 100 + F.col("no")).alias("ord"), "x.q_key", "x.text")


def merged(written: DataFrame) -> DataFrame:
    """doc_id, q_key, ord, text: repeated keys joined by a space in document order."""
    g = written.groupBy("doc_id", "q_key").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("all"))
    return g.select("doc_id", "q_key", "ord", F.array_join(F.col("all.text"), " ").alias("text"))


def rescued(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds what stands before the first marker, if over ten characters, as question 1 or in front of a shorter one.

    Texts without any marker are question 1 as a whole; blank texts have no rows.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), PAGE_BREAK, "\n")
    split = _marked(body, QUESTION)
    heads = texts.select("doc_id", F.when(F.size(split) > 1, strip(F.try_element_at(split, F.lit(1)))).alias("head"), strip(body).alias("whole"), (F.size(split) > 1).alias("split"))
    ones = found.where("q_key = '1'").select("doc_id", F.col("text").alias("one"), "ord")
    some = found.select("doc_id").distinct().withColumn("some", F.lit(True))
    h = heads.join(ones, "doc_id", "left").join(some, "doc_id", "left")
    long = F.length("head") > 10
    text = (F.when(~F.col("split"), F.col("whole"))
            .when(long & F.col("one").isNull(), F.col("head"))
            .when(long & (F.length("one") < F.length("head")), F.concat_ws(" ", "head", "one"))
            .when(F.col("one").isNull() & F.col("some").isNull() & (F.col("whole") != ""), F.col("whole"))
            .otherwise(F.col("one")))
    first = h.select("doc_id", F.lit("1").alias("q_key"), F.coalesce("ord", F.lit(2_000_000_000)).alias("ord"), text.alias("text"))
    return found.where("q_key <> '1'").select("doc_id", "q_key", "ord", "text").union(first.where("text is not null and (ord < 2000000000 or text <> '')"))


def segment(texts: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """doc_id, q_key, num, part, ord, text for ``texts(doc_id, text)``: all rules together, without the page fallback."""
    out = rescued(merged(written_pieces(texts, expected)), texts)
    key = natural_key(F.col("q_key"))
    return out.select("doc_id", "q_key", key["num"].alias("num"), key["part"].alias("part"), "ord", "text")


def any_of(headers: list[str]) -> str:
    """One pattern of several; an institution adds the lines that stand on its own sheets to PAGE_HEADERS."""
    return "(?i)" + "|".join(headers)


def lines_without_headers(text: Column, headers: list[str] = PAGE_HEADERS) -> Column:
    """Drops header lines with the two lines after each, and noise lines. A header among the two dropped starts nothing."""
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        header, noise = F.rlike(line, F.lit(any_of(headers))), F.rlike(line, F.lit(NOISE_LINE))
        skip = F.when(acc["skip"] > 0, acc["skip"] - 1).when(header, 2).otherwise(0)
        kept = F.when((acc["skip"] > 0) | header | noise, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line)))
        return F.struct(skip.alias("skip"), kept.alias("kept"))

    return F.array_join(F.aggregate(F.split(text, "\n", -1), start, step, lambda acc: acc["kept"]), "\n")


def _long(parts: Column, least: int) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) > least)


def pages(text: Column, headers: list[str] = PAGE_HEADERS) -> Column:
    """Pages by the sentinel (over 20 characters, more than one), else at header lines over 100 characters apart, else the whole."""

    def starts(t: Column) -> Column:
        """Places of the lines with a header, those within 100 characters of the last kept one left out."""
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("kept"))

        def step(acc: Column, line: Column) -> Column:
            far = (F.size(acc["kept"]) == 0) | (acc["at"] - F.try_element_at(acc["kept"], F.lit(-1)) > 100)
            kept = F.when(F.rlike(line, F.lit(any_of(headers))) & far, F.concat(acc["kept"], F.array(acc["at"]))).otherwise(acc["kept"])
            return F.struct((acc["at"] + F.length(line) + 1).alias("at"), kept.alias("kept"))

        return F.aggregate(F.split(t, "\n", -1), zero, step, lambda acc: acc["kept"])

    def by_header(t: Column, kept: Column) -> Column:
        ends = F.concat(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(F.length(t)))
        found = _long(F.zip_with(kept, ends, lambda a, b: F.substring(t, a + 1, b - a)), 20)
        return let(found, lambda p: F.when((F.size(kept) > 1) & (F.size(p) > 1), p).otherwise(F.array(t)))

    def cut(t: Column) -> Column:
        marked = F.when(F.contains(t, F.lit(PAGE_BREAK)), _long(F.split(t, PAGE_BREAK, -1), 20)).otherwise(F.array().cast("array<string>"))
        return let(marked, lambda p: F.when(F.size(p) > 1, p).otherwise(let(starts(t), lambda kept: by_header(t, kept))))

    return let(text, cut)


def chunks(text: Column, n: Column, keep_rest: bool = True, headers: list[str] = PAGE_HEADERS) -> Column:
    """About n pieces: pages (two more at most), else paragraphs at three or more, then two newlines, else the whole.

    Pages beyond n + 2 join the last piece; without ``keep_rest`` they are left out.
    """

    def few(p: Column) -> Column:
        if not keep_rest:
            return F.slice(p, F.lit(1), n + 2)
        rest = F.array(F.array_join(F.slice(p, n + 2, F.greatest(F.size(p) - n - 1, F.lit(0))), "\n\n"))
        return F.when(F.size(p) <= n + 2, p).otherwise(F.concat(F.slice(p, F.lit(1), n + 1), rest))

    def grouped(parts: Column) -> Column:
        per = F.greatest(F.lit(1), F.floor(F.size(parts) / n).cast("int"))
        return let(per, lambda k: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(parts) - 1) / k).cast("int"), F.lit(0))), lambda i: F.array_join(F.slice(parts, i * k + 1, k), "\n\n")))

    def whole(t: Column) -> Column:
        return F.when(strip(t) != "", F.array(strip(t))).otherwise(F.array().cast("array<string>"))

    def paragraphs(t: Column, pattern: str, other) -> Column:
        return let(_long(F.split(t, pattern, -1), 15), lambda parts: F.when(F.size(parts) >= n, grouped(parts)).otherwise(other(t)))

    wide = lambda t: paragraphs(t, r"\n\s*\n\s*\n", lambda u: paragraphs(u, r"\n\s*\n", whole))
    return let(text, lambda t: let(pages(t, headers), lambda p: F.when(F.size(p) >= n, few(p)).otherwise(wide(t))))


def segment_with_fallback(texts: DataFrame, expected: DataFrame, headers: list[str] = PAGE_HEADERS) -> DataFrame:
    """doc_id, q_key, num, part, ord, text; where less than two fifths of the expected keys are found, the rest of the text
    is cut into chunks for the missing keys, in natural order; surplus chunks go to the last of them.

    The rest begins behind the last question found; if that used up nearly all, it is the whole text; if nothing was found
    in place, the last seven tenths. Places are taken in the text with page marks as newlines.
    """
    found = segment(texts, expected)
    e = expected.select("doc_id", F.array_distinct(F.filter("q_keys", lambda k: ~F.startswith(k, F.lit("_")))).alias("want"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), PAGE_BREAK, "\n")
    t = texts.select("doc_id", body.alias("body"))
    have = found.groupBy("doc_id").agg(F.collect_list(F.struct("q_key", "text")).alias("have"))
    d = t.join(e, "doc_id").join(have, "doc_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<struct<q_key:string,text:string>>")))
    keys = F.transform("have", lambda h: h["q_key"])
    bases = F.array_union(keys, F.transform(keys, base_number))
    missing = F.filter("want", lambda k: ~F.array_contains(bases, k) & ~F.array_contains(bases, base_number(k)))
    d = d.where((F.size("have") < 0.4 * F.size("want")) & (F.size("want") > 0)).withColumn("missing", F.transform(F.array_sort(F.transform(missing, lambda k: F.struct(natural_key(k).alias("o"), k.alias("k")))), lambda x: x["k"]))
    snippet = lambda h: strip(F.left(h["text"], F.lit(30)))
    place = lambda h: F.position(snippet(h), F.col("body"))
    ends = F.transform("have", lambda h: F.when((F.length(snippet(h)) >= 10) & (place(h) > 0), place(h) - 1 + F.length(h["text"])).otherwise(0))
    d = d.withColumn("used", F.coalesce(F.array_max(ends), F.lit(0))).withColumn("n", F.length("body"))
    tail = (F.when((F.col("used") > 0) & (F.col("used") < F.col("n") - 50), F.expr("substring(body, used + 1)"))
            .when(F.col("used") >= F.col("n") * 0.9, F.col("body")).otherwise(F.expr("substring(body, cast(n * 0.3 as int) + 1)")))
    d = d.withColumn("tail", tail).where((F.length(strip(F.col("tail"))) >= 30) & (F.size("missing") > 0))
    d = d.withColumn("cuts", chunks(lines_without_headers(F.col("tail"), headers), F.size("missing"), headers=headers)).where(F.size("cuts") > 0)
    n = F.least(F.size("missing"), F.size("cuts"))
    d = d.withColumn("given", F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.try_element_at("missing", i).alias("q_key"), F.when(i == n, F.array_join(F.slice("cuts", i, F.size("cuts")), " ")).otherwise(F.try_element_at("cuts", i)).alias("text"))))
    more = d.select("doc_id", F.posexplode("given").alias("no", "g")).select("doc_id", "g.q_key", natural_key(F.col("g.q_key"))["num"].alias("num"), natural_key(F.col("g.q_key"))["part"].alias("part"), (F.lit(2_000_000_001) + F.col("no")).cast("int").alias("ord"), "g.text")
    return found.withColumn("ord", F.col("ord").cast("int")).union(more)


def marker_context(texts: DataFrame, before: int = 10, after: int = 30) -> DataFrame:
    """doc_id, no, marker, context: each question marker with the characters around it, newlines shown as spaces."""
    body = F.translate(F.coalesce("text", F.lit("")), _OPEN + _CLOSE, "")
    split = F.split(F.regexp_replace(body, F.lit(QUESTION), F.lit(_OPEN)), _OPEN, -1)
    found, name = F.regexp_extract_all(body, F.lit(QUESTION), 0), F.regexp_extract_all(body, F.lit(QUESTION), 1)
    x = texts.select("doc_id", body.alias("body"), F.posexplode(F.arrays_zip(F.slice(split, 1, F.size(found)).alias("gap"), found.alias("found"), name.alias("name"))).alias("no", "m"))
    upto = F.sum(F.length("m.gap") + F.length("m.found")).over(Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("stop", upto.cast("int")).withColumn("start", F.col("stop") - F.length("m.found"))
    first = F.greatest(F.col("start") - before, F.lit(0))
    return x.select("doc_id", "no", F.lower("m.name").alias("marker"), F.translate(F.substring(F.col("body"), first + 1, F.col("stop") + after - first), "\n", " ").alias("context"))

"""Text functions of grading, as column expressions: cleaning, tokens, keywords, noise, windows, fuzzy matches, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of keyword extraction.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "is", "are", "was", "were",
    "in", "on", "at", "to", "for", "with", "by", "of", "it", "that",
    "this", "these", "those", "he", "she", "they", "we", "i", "you",
    "process", "method", "system", "which", "from", "as", "be", "have",
    "has", "had", "do", "does", "did", "can", "could", "will", "would",
    "should", "may", "might", "must", "done", "used", "using", "uses",
]
# The terms that every exam's vocabulary holds.
COMMON_TERMS = [
    "decision", "tree", "pruning", "prepruning", "postpruning",
    "overfitting", "outliers", "simplify", "reduce",
    "training", "data", "model", "classification",
    "early", "stopping", "nodes", "branches", "algorithm",
    "learning", "supervised", "unsupervised", "regression",
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once; inside a lambda Spark would evaluate an outer expression for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _clean(c: Column, dropped: str, by: str) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), dropped, by)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Lower case; only a-z, digits, white space and ``-,.`` stay; white space collapses. Null gives an empty string."""
    return _clean(c, r"[^a-z0-9\s\-,.]", "")


def clean_strict(c: Column) -> Column:
    """As clean_text, without ``-,.``."""
    return _clean(c, r"[^a-z0-9\s]", "")


def clean_alpha(c: Column) -> Column:
    """All but a-z becomes white space, so digits vanish and words split."""
    return _clean(c, r"[^a-z\s]", " ")


def tokens(c: Column) -> Column:
    """White-space tokens; none for null or blank."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def keywords(c: Column, stop: list[str] | None = None) -> Column:
    """Lower-cased words of more than three characters that are no stop words; duplicates stay, in order."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return F.filter(tokens(bare), lambda w: (F.length(w) > 3) & ~w.isin(stop or STOP_WORDS))


def noise_ratio(c: Column) -> Column:
    """Share of tokens without letters (two characters or more), or with as many digits as letters and both; 0.0 if none."""

    def noisy(w: Column) -> Column:
        letters, numbers = F.regexp_count(w, F.lit(r"\p{L}")), F.regexp_count(w, F.lit(r"\p{Nd}"))
        return ((F.length(w) >= 2) & (letters == 0)) | ((numbers > 0) & (letters > 0) & (numbers >= letters))

    return let(tokens(c), lambda words: F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(F.filter(words, noisy)) / F.size(words)))


def readable_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[a-zA-Z]{3,}"))


def choose_engine(a: Column, b: Column) -> Column:
    """Of two recognised texts the one with over 1.3 times the readable words of the other; else both, joined by a newline."""
    na, nb = readable_words(a), readable_words(b)
    both = F.concat_ws("\n", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    return F.when((na == 0) & (nb == 0), both).when(nb > na * 1.3, b).when(na > nb * 1.3, a).otherwise(both)


def word_windows(c: Column, size: int = 6, step: int = 3, whole_up_to: int = 30) -> Column:
    """Runs of six words, three apart, and the last six if the count is no multiple of three; short texts stay whole."""
    run = lambda w, i: F.array_join(F.slice(w, i, size), " ")

    def cut(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(n - size + 1, F.lit(1))
        runs = F.transform(F.sequence(F.lit(1), last, F.lit(step)), lambda i: run(w, i))
        tail = F.when(n % step != 0, F.array(run(w, last))).otherwise(F.array().cast("array<string>"))
        return F.when(n <= max(size, whole_up_to), F.array(F.coalesce(c, F.lit("")))).otherwise(F.concat(runs, tail))

    return let(tokens(c), cut)


def mismatches(a: Column, b: Column) -> Column:
    """Places at which two words differ, position by position; the longer one's surplus counts."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda s, v: s + v)


def fuzzy_equal(target: Column, word: Column) -> Column:
    """Same first character, lengths within two, and at most one mismatch (two from six characters on); targets from four."""
    close = (F.abs(F.length(word) - F.length(target)) <= 2) & (F.left(word, F.lit(1)) == F.left(target, F.lit(1)))
    limit = F.when(F.length(target) <= 5, 1).otherwise(2)
    # the cheap tests decide before the characters are compared
    return F.when((F.length(target) >= 4) & close, mismatches(word, target) <= limit).otherwise(F.lit(False))


def fuzzy_overlap(targets: Column, text: Column) -> Column:
    """Whether any target has a fuzzy match among the text's keywords."""
    return let(keywords(text), lambda found: any_fuzzy(targets, found))


def any_fuzzy(targets: Column, found: Column) -> Column:
    return F.exists(targets, lambda t: F.exists(found, lambda w: fuzzy_equal(t, w)))


def rescue_hits(model_words: Column, text: Column, distinct: bool = False) -> Column:
    """How many model keywords of over five characters the text holds, as substring or fuzzily; duplicates count."""
    meaty = F.filter(model_words, lambda k: (F.length(k) > 5) & ~k.isin(STOP_WORDS))
    meaty = F.array_distinct(meaty) if distinct else meaty
    hit = lambda low, found: lambda k: F.contains(low, k) | F.exists(found, lambda w: fuzzy_equal(k, w))
    return let(F.lower(text), lambda low: let(keywords(text), lambda found: F.size(F.filter(meaty, hit(low, found)))))


def base_number(key: Column) -> Column:
    """A question key without its letters."""
    return F.regexp_replace(key, "[a-z]", "")


def natural_key(key: Column) -> Column:
    """Sorts keys by number, then by letters."""
    return F.struct(F.coalesce(F.regexp_extract(key, r"^(\d+)", 1).try_cast("int"), F.lit(0)).alias("num"), F.regexp_replace(key, r"^\d+", "").alias("part"))


def semantic_base(sim: Column, noisy: Column) -> Column:
    """The piecewise linear base score of a similarity; noisy answers get 15 % more similarity."""
    s = sim * F.when(noisy, 1.15).otherwise(1.0)
    return F.when(s >= 0.55, 1.0).when(s >= 0.40, 0.70 + 0.30 * ((s - 0.40) / 0.15)).when(s >= 0.20, 0.25 + 0.45 * ((s - 0.20) / 0.20)).otherwise(0.0)


def final_score(sim: Column, noisy: Column, coverage: Column, hits: Column, n_words: Column) -> Column:
    """Base and coverage at 85 : 15, lifted to the floors of keyword hits and of long enough answers, within 0 and 1."""
    s = sim * F.when(noisy, 1.15).otherwise(1.0)
    blend = semantic_base(sim, noisy) * 0.85 + coverage * 0.15
    floor = F.when((hits >= 2) & (n_words > 5), 0.35).when((hits >= 1) & (n_words > 5), 0.15).otherwise(0.0)
    other = F.when((n_words >= 8) & (s > 0.25), 0.20).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(blend, floor, other)))


# The sentences of the four tiers and of the missing concepts.
def feedback(score: Column, missing: Column) -> Column:
    """The sentence of the score's tier, and the first two missing concepts below 0.85."""
    tier = (F.when(score >= 0.85, "Excellent understanding of the concept.")
            .when(score >= 0.60, "Good conceptual grasp, but slightly brief or missing some details.")
            .when(score >= 0.35, "Partial understanding shown.").otherwise("Incorrect or insufficient concept."))
    quoted = F.array_join(F.transform(F.slice(missing, 1, 2), lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", ")
    more = F.when((score < 0.85) & (F.size(missing) > 0), F.concat(F.lit(" Consider adding details like: "), quoted, F.lit(".")))
    return F.concat(tier, F.coalesce(more, F.lit("")))

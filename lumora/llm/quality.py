"""Quality rules: how much of a text lies inside n-grams and lines that the text repeats.

Words are hashed with one running sum over the bytes; n-grams of several lengths are rolled over the word hashes in numpy;
equal hashes of one text are found by sorting, and lines of equal hashes are compared by their bytes. The measures of a text:

* base: word_chars, n_symbols, n_dup_lines, n_repeat_words (3-word windows), base_failed;
* dup_gram_chars_N: share of word_chars in N-word windows that the text holds twice or more (first included);
* dup_line_chars: share of word_chars in lines that equal an earlier line;
* symbols per word.

The verdict rejects a text when a share is above its limit. The share in duplicated n-grams counts all but nothing of a
normal text at 5 words and more, so the limits follow the published repetition rules for web text, with more room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import Texts, chunks, covered, mix, repeated

SYMBOLS = b"#*$%&|<>"
GRAMS = (5, 7, 10)
#: Highest accepted shares.
GRAM_LIMITS = {5: 0.40, 7: 0.35, 10: 0.30}
LINE_LIMIT = 0.30
SYMBOLS_PER_WORD = 0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + ", ".join(f"dup_gram_chars_{n} double" for n in GRAMS) + ", dup_line_chars double, reason string"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def measures(t: Texts) -> dict[str, np.ndarray]:
    starts, ends = t.words
    by_doc = t.word_offsets
    points = t.points_before[ends] - t.points_before[starts]
    out = {"n_words": np.diff(by_doc).astype(np.int64), "word_chars": t.per_doc(points, by_doc), "n_symbols": t.per_doc(_SYMBOL[t.data], t.offsets)}
    salt = mix(np.arange(1, t.n + 1, dtype=np.uint64))

    def in_repeats(n: int) -> np.ndarray:
        first, h = t.grams(n)
        twice = repeated(h + salt[t.word_doc[first]])
        return covered(first[twice], n, len(starts))

    out["n_repeat_words"] = t.per_doc(in_repeats(3), by_doc)
    chars = np.maximum(out["word_chars"], 1)
    for n in GRAMS:
        out[f"dup_gram_chars_{n}"] = t.per_doc(np.where(in_repeats(n), points, 0), by_doc) / chars
    # lines with a word
    cut = np.union1d(np.flatnonzero(t.data == 10) + 1, t.offsets)
    line_start, line_end = cut[:-1], cut[1:].copy()
    line_end -= (t.data[line_end - 1] == 10) if len(line_end) else 0
    w0, w1 = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    has = w1 > w0
    line_start, line_end, w0, w1 = line_start[has], line_end[has], w0[has], w1[has]
    doc = t.word_doc[w0]
    later = t.equals_earlier(line_start, line_end, doc)
    sums = np.zeros(len(points) + 1, np.int64)
    np.cumsum(points, out=sums[1:])
    line_chars = sums[w1] - sums[w0]
    out["n_dup_lines"] = np.bincount(doc[later], minlength=t.n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(doc[later], weights=line_chars[later], minlength=t.n) / chars
    return out


def verdicts(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The measures, which texts fail the base rule, and the first rule that failed (or None)."""
    m = measures(t)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    reason = np.full(t.n, None, object)
    found = [("lines", m["dup_line_chars"] > LINE_LIMIT), ("symbols", m["n_symbols"] > SYMBOLS_PER_WORD * m["n_words"])]
    found += [(f"grams_{n}", m[f"dup_gram_chars_{n}"] > GRAM_LIMITS[n]) for n in GRAMS]
    for name, bad in [*found[::-1], ("base", failed)]:
        reason[bad] = name
    return m, failed, reason


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, t in chunks(batches):
        m, failed, reason = verdicts(t)
        columns = {"doc_id": batch.column(0), **m, "base_failed": failed, "kept": np.equal(reason, None).astype(bool), "reason": pa.array(reason, pa.string())}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c]) for c in names], names)


def quality(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: base measures, shares in repeats, base_failed, kept, reason.

    A null or empty text has no words, fails the base rule and is not kept. ``reason`` is the first rule that failed.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, SCHEMA)


def good_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in chunks(batches):
            yield part.filter(pa.array(np.equal(verdicts(t)[2], None).astype(bool)))

    return docs.mapInArrow(keep, docs.schema)

"""Ranked lexical search: postings in buckets of terms, joined with the items' terms, scored in whole numbers and summed.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. The weights are
those of a saturating term frequency with length normalisation (k1 = 0.8, b = 0.9), in integers:

    w = floor(1000 * ln((2N + 2) / (2df + 1)))    m = 10 + (90 * n * N) div L    score = sum of w * (10**9 * tf div (1000 * tf + 8 * m))

How it runs: one pass over the texts counts each text's terms in Arrow batches (a text stays in its task, so counting needs
no shuffle). Postings of terms that no item asks for leave at once. The rest is stored by bucket of term; a bucket is split
over slices of the documents, so that a term which every document holds is spread. Document frequencies are a partial
aggregation of that table. For the sums the postings are dealt out by document, so all of a document's matches are summed
where they arise, and only the best k rows of an item and task go on to the ranking.

Odd rows: a null text has no terms and counts for nothing; a null document id stays null and comes after others of equal
score; rows with equal ids are documents (or items) of their own; an item without terms, or without a match, has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, drop, stored, text_of
from .textnum import Texts, chunks, task_part

#: What the terms are made of, as a pattern.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 16
#: Input partitions whose documents make one slice of a bucket.
SLICE_PARTS = 8
#: Bytes of the items' terms (as counted, not as stored) up to which they are sent to every task; beyond, both sides are dealt by term.
BROADCAST_BYTES = 32 << 20
#: Pairs of an item and a document that one task sums, about.
PAIRS_A_TASK = 2_000_000
POSTING = "row_id long, doc_id long, n long, term string, tf long"
#: Each byte's lower case, or a space where it is no part of a term.
_SHOWN = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _SHOWN[_low : _high + 1] = np.arange(_low, _high + 1)
_SHOWN[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms_of(text: Column) -> Column:
    """A text's distinct terms."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0)))


def counted(texts: Texts) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; then for each text and term of it: the text's place, the term's place, the count; and the terms of each text."""
    shown = pa.Array.from_buffers(pa.large_utf8(), len(texts), [None, pa.py_buffer(texts.offsets.astype(np.int64)), pa.py_buffer(_SHOWN[texts.data])])
    split = pc.ascii_split_whitespace(shown)
    ends = split.offsets.to_numpy()
    flat = split.values.slice(ends[0], ends[-1] - ends[0])
    coded = flat.dictionary_encode()
    solid = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), np.diff(ends))[solid]
    code = coded.indices.to_numpy()[solid].astype(np.int64)
    width = max(len(coded.dictionary), 1)
    pairs, tf = np.unique(text * width + code, return_counts=True)
    return coded.dictionary, pairs // width, pairs % width, tf, np.bincount(text, minlength=len(texts))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of POSTING; for each slice of a batch one row without a term, which has its documents with terms (tf) and terms (n)."""
    names = [x.split()[0] for x in POSTING.split(", ")]
    first = task_part() << 33
    for part, texts in chunks(batches):
        terms, text, code, tf, n = counted(texts)
        ids = part.column(part.schema.get_field_index("doc_id"))
        nulls = [pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.string())]
        yield pa.RecordBatch.from_arrays([nulls[0], nulls[1], pa.array([int(n.sum())]), nulls[2], pa.array([int((n > 0).sum())])], names)
        for a in range(0, len(tf), 200_000):
            own = slice(a, a + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(first + text[own]), ids.take(pa.array(text[own])), pa.array(n[text[own]]), terms.take(pa.array(code[own])).cast(pa.string()), pa.array(tf[own])], names)
        first += len(texts)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _sent(terms: DataFrame) -> DataFrame:
    """The items' terms, marked to be broadcast where their size is known to be small."""
    size = terms.agg(F.sum(F.octet_length("term") + 64).alias("bytes")).first().bytes or 0
    return F.broadcast(terms) if size <= BROADCAST_BYTES else terms


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Stored rows (POSTING, bucket) of ``docs(doc_id, text)``, of the given ``terms(term)`` or of all; sorted by term in a bucket.

    Rows of bucket -1 have no term: n is a number of terms and tf a number of documents with terms, whose sums are those of
    the whole table, whatever terms were asked for.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_postings, POSTING)
    if terms is not None:
        rows = rows.join(_sent(terms.select("term").distinct().withColumn("asked", F.lit(True))), "term", "left").where("asked or term is null").drop("asked")
    rows = rows.select("row_id", "doc_id", "n", "term", "tf", F.coalesce(_bucket(F.col("term")), F.lit(-1)).alias("bucket"))
    rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(F.col("bucket")))
    dealt = rows.repartition("bucket", F.floor(F.shiftright("row_id", 33) / SLICE_PARTS)).sortWithinPartitions("bucket", "term", "row_id")
    return stored(dealt, "postings", partition_by="bucket")


def search(docs: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: for each of ``items(item_id, text)`` its ``most`` best rows of ``docs(doc_id, text)``."""
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.monotonically_increasing_id().alias("item"), terms_of(text_of()).alias("terms"))
    # numbered and stored before the terms are spread: a number made beside an explode would be one for each term
    each = stored(each, "asked-items")
    asked = each.select("item_id", "item", F.explode("terms").alias("term"))
    held = postings(docs, asked)
    seen = held.where("bucket = -1").agg(F.sum("tf").alias("docs"), F.sum("n").alias("terms")).first()
    # a table without a single term matches nothing, whatever the weights
    n_docs, n_terms = seen.docs or 1, seen.terms or 1
    own = held.where("bucket >= 0")
    df = own.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.max("n").alias("longest"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = stored(asked.join(df, "term").select("item", "item_id", "term", "bucket", "longest", weight.cast("long").alias("w")), "weighed-terms")
    total = weighed.agg(F.max("longest").alias("longest"), F.count_distinct("item").alias("items")).first()
    # whole numbers of 64 bits, but where a text is so long that they would not hold
    wide = 90 * (total.longest or 0) * n_docs >= 2**63
    m = F.expr(f"cast(10 + floor((90 * cast(n as decimal(19, 0)) * {n_docs}BD) / {n_terms}BD) as bigint)" if wide else f"10 + (90 * n * {n_docs}L) div {n_terms}L")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_docs * total.items // PAIRS_A_TASK))
    dealt = own.select("row_id", "doc_id", "term", "tf", m.alias("m")).repartition(tasks, "row_id")
    match = dealt.join(_sent(weighed.select("item", "item_id", "term", "w")), "term")
    gain = F.expr("w * ((1000000000L * tf) div (1000 * tf + 8 * m))")
    scores = match.groupBy("row_id", "item").agg(F.sum(gain).alias("score"), F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row_id"))
    best = scores.withColumn("rank", rank).where(F.col("rank") <= most).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    out = stored(best, "ranked")
    drop(each, held, weighed)
    return out

"""Suffix-array dedup: bytes covered by a 400-byte string that starts at another place too, here or in another text.

Suffixes are ordered by a radix sort from the most significant digit, only through the threshold; a bucket with one suffix
is dropped after each pass, and the buckets left at the threshold's depth are exactly the repeated strings. Digits are runs
of bytes, compared by hashes: of 64 bits within a bucket of pass one, however large it is, and of 128 bits near the ends. So
that not every suffix has to be dealt out:

1. The first pass takes suffixes at anchors only: places whose 32 bytes have the least hash of 64 neighbouring places. Equal
   strings have equal anchors, except for those within 64 places of their ends. Pass two orders the anchors left by the rest of the 400 bytes.
   That settles the inside of repeated regions: the 400 bytes from each repeated anchor on are covered.
2. A string that is not all covered yet can only repeat if all its inner anchors survived pass one. These places, near the
   ends of repeated regions, are ordered in the same way at every byte. The equal string elsewhere may lie in the inside of
   a longer repeat; so where one text has an end, two of the texts that agree around that anchor deal out their inner
   places too (all strings that have the anchor as their first inner one lie in the surroundings that agree). Up to BLOCK
   strings are dealt out as one row: the hash of the bytes that all of them hold, the few bytes on both sides of those, and
   a bit for each string. They are told apart behind the shuffle, and what repeats goes back as bits again.

Passages are found with words for digits, so that other white space between them does not matter. Of a run of PASSAGE words
its GRAM_WORDS words of least hash are the anchor; where another text has the anchor too, runs are compared whole, of
NEIGHBOURS in succession the one of least hash. So each run of PASSAGE + NEIGHBOURS - 1 = 50 words or more that two texts
share is found, and nothing below PASSAGE words.

The texts are never shuffled. Places are (input partition, byte or word); results go back to a table by partition, and three
passes over the same partitions read it. Each pass compares a checksum of the texts it sees with that of the first, and the
result is written out by the same scan, so it does not depend on what is done with it later.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, hold_splits, release, stored
from .files import by_part, read_part
from .textnum import RunningHash, Texts, chunks, covered, mix, rows_of, task_part, trim

LENGTH = 400
#: Bytes of the first digit, and neighbouring places of which one is an anchor.
DIGIT, WINDOW = 32, 64
#: The first inner anchor of a string is no more than this behind its start.
BEFORE = 2 * WINDOW - 2
#: Neighbouring strings that are dealt out together, by the distance of their first inner anchor (WINDOW is a multiple of it).
BLOCK = 16
CHUNK = 1 << 20
#: Words that are compared, words of their anchor, and neighbouring runs of which one is compared.
PASSAGE, GRAM_WORDS, NEIGHBOURS = 44, 8, 7
GRAM_PLACES = PASSAGE - GRAM_WORDS + 1
#: Rows of words have this added to their partition, rows of checksums have the place -1.
WORDS = 1 << 30
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, span_starts array<long>, span_ends array<long>"
ANCHORS = "digit long, whole long, around long, part int, at long"
KNOWN = "digit long, whole long, full boolean, first boolean, of_words boolean, part int, at long"
EDGES = "digit long, part int, at long, bits int, sides binary"
_NONE = np.uint64(2**64 - 1)
PASSAGE_BASE = int(np.random.default_rng(50).integers(0, 2**63, dtype=np.uint64)) | 1


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """The least or greatest of x[i : i + w] for each i."""
    f, filler = (np.minimum, _NONE) if least else (np.maximum, np.uint64(0))
    rows = np.append(x, np.full(-len(x) % w + w, filler, np.uint64)).reshape(-1, w)
    ahead = f.accumulate(rows, axis=1).ravel()
    back = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: len(x)], ahead[w - 1 : w - 1 + len(x)])


class Places:
    """Anchors of some texts: ``at`` (bytes), ``digit`` (hash of their first bytes); ``end`` of the text of every byte."""

    def __init__(self, t: Texts):
        self.t, n = t, len(t.data)
        self.end = np.repeat(t.offsets[1:], np.diff(t.offsets))
        self.place = np.arange(n)
        # texts below the threshold take no part
        long = np.repeat(np.diff(t.offsets) >= LENGTH, np.diff(t.offsets))
        some = np.flatnonzero(long & (self.place + DIGIT <= self.end))
        h = np.full(n, _NONE, np.uint64)
        h[some] = np.minimum(t.hash.of(some, some + DIGIT), _NONE - np.uint64(1))
        self.at = np.flatnonzero(chosen(h, WINDOW) & (h != _NONE))
        self.digit = h[self.at]

    def whole(self) -> np.ndarray:
        """The hash of the LENGTH bytes from each anchor on, never 0; 0 where the text ends before."""
        out = np.zeros(len(self.at), np.uint64)
        on = self.at + LENGTH <= self.end[self.at]
        out[on] = np.maximum(self.t.hash.of(self.at[on], self.at[on] + LENGTH), np.uint64(1))
        return out.view(np.int64)

    def around(self, base: int, part: int) -> np.ndarray:
        """The hash of all strings that have the anchor as first inner one; of the place where the text is shorter."""
        a, b = self.at - BEFORE, self.at + LENGTH - WINDOW + 1
        out = mix((self.at + base).astype(np.uint64) + (np.uint64(part) << np.uint64(40)))
        on = (a >= self.t.offsets[np.searchsorted(self.t.offsets, self.at, "right") - 1]) & (b <= self.end[self.at])
        out[on] = self.t.hash.of(a[on], b[on])
        return out.view(np.int64)


def chosen(h: np.ndarray, w: int) -> np.ndarray:
    """Which places have the least value of w neighbouring ones."""
    return sliding(np.append(np.zeros(w - 1, np.uint64), sliding(h, w, True)), w, False)[: len(h)] == h


class Passages:
    """Runs of words in some texts: ``lowest``, the least gram of the run at each word; ``valid`` where the text holds it whole."""

    def __init__(self, t: Texts):
        self.t, words = t, t.word_hash
        self.hash = RunningHash(words, None, PASSAGE_BASE)
        begin, end = (x[t.word_doc] for x in (t.word_offsets[:-1], t.word_offsets[1:]))
        place = np.arange(len(words))
        some = np.flatnonzero((end - begin >= PASSAGE) & (place + GRAM_WORDS <= end))
        h = np.full(len(words), _NONE, np.uint64)
        h[some] = np.minimum(self.hash.of(some, some + GRAM_WORDS), _NONE - np.uint64(1))
        self.lowest = sliding(h, GRAM_PLACES, True)
        self.valid = place + PASSAGE <= end

    def grams(self) -> np.ndarray:
        """The anchors, each once for a text; so those that occur twice are in two texts."""
        doc, gram = self.t.word_doc[self.valid], self.lowest[self.valid]
        new = np.append(True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])) if len(gram) else np.empty(0, bool)
        return np.unique(np.stack([doc[new].astype(np.uint64), gram[new]]), axis=1)[1] if new.any() else np.empty(0, np.uint64)

    def compared(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the runs that are compared, each once for a text, given the anchors (sorted) that two texts have."""
        if not len(self.lowest):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.minimum(np.searchsorted(alive, self.lowest), len(alive) - 1)
        h, runs = np.full(len(self.lowest), _NONE, np.uint64), np.flatnonzero(self.valid)
        h[runs] = np.minimum(self.hash.of(runs, runs + PASSAGE), _NONE - np.uint64(1))
        some = np.flatnonzero(chosen(h, NEIGHBOURS) & self.valid & (alive[at] == self.lowest))
        order = some[np.lexsort((some, h[some], self.t.word_doc[some]))]
        doc, own = self.t.word_doc[order], h[order]
        new = np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]))[: len(order)]
        return order[new], own[new]


class Walk:
    """Chunks of a partition with the byte and word at which each begins; ``checksum`` of what has been seen."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.checksum, self.rows = batches, 0, 0

    def __iter__(self) -> Iterator[tuple[pa.RecordBatch, Texts, int, int]]:
        byte = word = 0
        for part, t in chunks(self.batches, "text", CHUNK):
            yield part, t, byte, word
            byte += len(t.data)
            word += int(t.word_offsets[-1])
            self.rows += t.n
            self.checksum = zlib.crc32(t.data, zlib.crc32(t.offsets.tobytes(), self.checksum))

    def must_be(self, checksum: int | None) -> None:
        if self.rows and self.checksum != checksum:
            raise RuntimeError("the input's partitions changed between the passes")


def trimmed(step):
    """The step, giving memory back once its last arrays are gone too: an idle worker shares the executor with the sorts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            trim()

    return run


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    no, walk = task_part(), Walk(batches)
    for _, t, byte, _ in walk:
        p = Places(t)
        yield rows_of(ANCHORS, p.digit, p.whole(), p.around(byte, no), no, p.at + byte)
        del p
        yield rows_of(ANCHORS, Passages(t).grams(), 0, 0, no + WORDS, 0)
    if walk.rows:
        yield rows_of(ANCHORS, np.array([no]), walk.checksum, 0, no, -1)


class Known:
    """What a stored table has for this partition: of bytes, of words (in order of the places), and its checksum."""

    def __init__(self, folder: str, columns: list[str]):
        found = read_part(folder, task_part(), ["of_words", "at", *columns])
        table = {c: found[c].to_numpy() if found is not None else np.empty(0, np.int64) for c in ["of_words", "at", *columns]}
        order = np.argsort(table["at"], kind="stable")
        table = {c: v[order] for c, v in table.items()}
        of = lambda own: {c: v[own] for c, v in table.items()}
        words = table.pop("of_words").astype(bool)
        self.bytes, self.words = of(~words & (table["at"] >= 0)), of(words)
        self.checksum = int(table["whole"][table["at"] < 0][0]) if "whole" in table and (table["at"] < 0).any() else None


def between(x: dict[str, np.ndarray], a: int, b: int) -> dict[str, np.ndarray]:
    """The places from a up to b, counted from a."""
    i, j = np.searchsorted(x["at"], [a, b])
    return {c: v[i:j] - a if c == "at" else v[i:j] for c, v in x.items()}


def running(flags: np.ndarray, n: int) -> np.ndarray:
    """How many of the places `flags` lie before each of 0..n."""
    out = np.zeros(n + 1, np.int32)
    out[flags + 1] = 1
    return np.cumsum(out, dtype=np.int32)


def blocks(t: Texts, starts: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings at `starts` (ascending), given the first inner anchor of each, by block.

    For each block the hash of the bytes that all its strings hold, its last start, the bit 1 << j for a string that starts j
    before that, and the BLOCK - 1 bytes on either side. Equal strings have equal anchors, so they have the same bit in blocks of the same hash.
    """
    last = starts + (anchors - starts - WINDOW + 1) % BLOCK
    first = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
    bits = np.add.reduceat(np.int64(1) << (last - starts), first)
    last = last[first]
    beside = last[:, None] + np.append(np.arange(1 - BLOCK, 0), np.arange(LENGTH - BLOCK + 1, LENGTH))
    # bytes beyond the ends of a text are in no string that it has
    return t.hash.of(last, last + LENGTH - BLOCK + 1), last, bits, t.data[np.clip(beside, 0, len(t.data) - 1)]


def edge_rows(digit: np.ndarray, part: int, at: np.ndarray, bits: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
    n, width = sides.shape
    binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(sides))])
    numbers = rows_of(EDGES.rpartition(", ")[0], digit, part, at, bits)
    return pa.RecordBatch.from_arrays([*numbers.columns, binary], [*numbers.schema.names, "sides"])


def repeated_strings(edges: DataFrame) -> DataFrame:
    """digit, part, at, bits of ``edges``, with the bits of strings that occur more than once."""
    each = edges.repartition("digit").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).where(F.expr("shiftright(bits, j) & 1 = 1"))
    each = each.select("digit", "part", "at", "j", F.expr(f"xxhash64(j, substring(sides, {BLOCK} - j, {BLOCK - 1}))").alias("whole"))
    twice = each.withColumn("n", F.count("*").over(Window.partitionBy("digit", "whole"))).where("n > 1")
    return twice.groupBy("digit", "part", "at").agg(F.bit_or(F.expr("shiftleft(1, j)")).alias("bits"))


def starts_of(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The places of the strings or runs that the bits stand for, in order."""
    row, j = np.nonzero((x["bits"].astype(np.int64)[:, None] >> np.arange(BLOCK)) & 1)
    return {"at": np.sort(x["at"][row] - j).astype(np.int64)}


def find_edges(anchors: str, helpers: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, walk = task_part(), Walk(batches)
        known, helping = Known(anchors, ["full", "digit", "whole"]), Known(helpers, []).bytes
        grams = np.unique(known.words["digit"].astype(np.int64).view(np.uint64))
        for _, t, byte, word in walk:
            n = len(t.data)
            own = between(known.bytes, byte, byte + n)
            if len(own["at"]):
                p = Places(t)
                lives = np.isin(p.at, own["at"], assume_unique=True)
                if lives.sum() != len(own["at"]):
                    raise RuntimeError("the input's partitions changed between the passes")
                dead, live = running(p.at[~lives], n), running(own["at"], n)
                done = np.append(0, np.cumsum(covered(own["at"][own["full"].astype(bool)], LENGTH, n), dtype=np.int32))
                starts = p.place[p.place + LENGTH <= p.end]
                inner = dead[starts + LENGTH - DIGIT - WINDOW + 2] == dead[starts + WINDOW - 1]
                some = live[starts + LENGTH - DIGIT + 1] > live[starts]
                helps = np.append(np.isin(p.at, between(helping, byte, byte + n)["at"], assume_unique=True), False)
                first = np.searchsorted(p.at, starts + WINDOW - 1)
                open_ = inner & some & ((done[starts + LENGTH] - done[starts] < LENGTH) | helps[first])
                starts, first = starts[open_], p.at[first[open_]]
                del p, dead, live, done, inner, some, helps, open_
                if len(starts):
                    digit, last, bits, sides = blocks(t, starts, first)
                    yield edge_rows(digit, no, last + byte, bits, sides)
            if len(grams):
                at, h = Passages(t).compared(grams)
                yield edge_rows(h, no + WORDS, at + word, np.ones(len(at), np.int64), np.empty((len(at), 0), np.uint8))
        walk.must_be(known.checksum)

    return find


def remove(anchors: str, edges: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, known, more = Walk(batches), Known(anchors, ["full", "whole"]), Known(edges, ["bits"])
        strings, passages = starts_of(more.bytes), starts_of(more.words)
        full = {"at": known.bytes["at"][known.bytes["full"].astype(bool)]}
        for part, t, byte, word in walk:
            n = len(t.data)
            starts = np.union1d(between(full, byte, byte + n)["at"], between(strings, byte, byte + n)["at"]).astype(np.int64)
            gone = covered(starts, LENGTH, n)
            first, last = gone.copy(), gone.copy()
            inner = t.offsets[(t.offsets > 0) & (t.offsets < n)]
            first[1:] &= ~gone[:-1]
            first[inner] = gone[inner]
            last[:-1] &= ~gone[1:]
            last[inner - 1] = gone[inner - 1]
            run0, run1 = np.flatnonzero(first), np.flatnonzero(last) + 1
            cuts = np.searchsorted(run0, t.offsets)
            removed = t.per_doc(gone, t.offsets)
            digests, raw = [], t.data
            for i in range(t.n):
                own = raw[t.offsets[i] : t.offsets[i + 1]]
                digests.append(hashlib.sha256(own[~gone[t.offsets[i] : t.offsets[i + 1]]] if removed[i] else own).hexdigest())
            begin = np.repeat(t.offsets[:-1], np.diff(cuts))
            words = int(t.word_offsets[-1])
            runs = between(passages, word, word + words)["at"]
            shared = t.per_doc(covered(runs, PASSAGE, words), t.word_offsets) if len(runs) else np.zeros(t.n, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x - begin)) for x in (run0, run1)]
            arrays = [part.column(0), pa.array(np.diff(t.offsets)), pa.array(removed), pa.array(np.diff(cuts)), pa.array(digests, pa.string()), pa.array(shared), *lists]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])
        walk.must_be(known.checksum)

    return cut


def repeated_suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, span_starts, span_ends (bytes of the text) for each row of ``docs(doc_id, text)``.

    A null or empty text has no bytes. A text below 400 bytes keeps all. Repeated rows lose all their bytes from 400 on, as
    every copy is judged on the input. n_passage_words counts the words in runs of 44 words or more that another row holds as
    well (all runs of 50 are found; a run that a row holds twice counts once). The result is a stored table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    hold_splits(spark)
    bucket = Window.partitionBy("digit")
    suffixes = rows.mapInArrow(trimmed(find_anchors), ANCHORS)
    left = suffixes.withColumn("n", F.count("*").over(bucket)).where("n > 1 or at < 0")
    left = left.withColumn("full", (F.col("whole") != 0) & (F.count("*").over(Window.partitionBy("digit", "whole")) > 1))
    left = left.withColumn("no", F.row_number().over(Window.partitionBy("digit", "around").orderBy("part", "at")))
    real = lambda: [(F.col("part") >= WORDS).alias("of_words"), (F.col("part") % WORDS).alias("part"), "at"]
    # the checksum is all that is read of this column
    whole = F.when(F.col("at") < 0, F.col("whole")).otherwise(0).alias("whole")
    anchors = by_part(left.select("digit", whole, "full", (F.col("no") <= 2).alias("first"), *real()), "anchors")
    release(spark)
    known = spark.read.schema(KNOWN).parquet(anchors).where("not of_words and at >= 0")
    # anchors whose strings may not all lie in repeats: not repeated themselves, or no repeated one shortly before
    back = F.max(F.when(F.col("full"), F.col("at"))).over(Window.partitionBy("part").orderBy("at").rangeBetween(-LENGTH, -BEFORE))
    ends = known.select("part", "at", "full", "digit").withColumn("back", back).where("not full or back is null").select("digit").distinct()
    helpers = by_part(known.where("first").select("of_words", "part", "at", "digit").join(ends, "digit", "left_semi").select("of_words", "part", "at"), "helpers")
    release(spark)
    strings = rows.mapInArrow(trimmed(find_edges(anchors, helpers)), EDGES)
    edges = by_part(repeated_strings(strings).select(*real(), "bits"), "edges")
    release(spark)
    out = stored(rows.mapInArrow(trimmed(remove(anchors, edges)), SCHEMA), "suffixes")
    for folder in (anchors, helpers, edges):
        delete(spark, folder)
    return out

"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

* A shingle is five words; a text of one to four words is one shingle. Its weight is its count in the text times the mean
  inverse document frequency of its words, over all rows. Frequencies are exact at any size: each input partition gets those
  of its own words back from Spark, in steps of 1 / IDF_STEPS, and they stay with the text, a byte for each word.
* Improved consistent weighted sampling draws SLOTS samples (shingle, quantised weight) of each text; two texts agree in a
  slot with the probability of their weighted Jaccard similarity. The random draws of a shingle and slot are looked up by
  hash in a table of POOL triples (gamma, gamma, uniform).
* BANDS bands of ROWS slots make the buckets. A pair of similarity 0.8 misses all of them with probability 2e-4.
* Exact copies are one node from the start. In a bucket, each text is compared with the one that shares most buckets with
  others and with the one before it among the rest, so a group of n costs 2n comparisons (all pairs of up to three texts).
  Texts of a larger bucket that are still in different components after that are compared block by block: by their samples,
  and those that agree in MIN_AGREE slots by their shingles. A block gives only links that join two components, so its
  result is no longer than its input. Blocks of a large bucket are stored once and read by the tasks that compare two of
  them; only their numbers are dealt out. No group is capped.
* Every link is verified on the whole texts. Classes are the connected components.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, drop, hold_splits, stored, text_of
from .components import components
from .files import by_part, read_part
from .textnum import CHUNK_BYTES, GRAM, Tally, Texts, chunks, mix, rows_of, task_part, trim

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SLOTS = BANDS * ROWS
#: A pair of similarity 0.8 agrees in fewer of 64 slots with probability 1e-6.
MIN_AGREE = 34
IDF_STEPS = 8
POOL = 1 << 16
#: Texts and words of a block, about; a longer text is a block of its own.
BLOCK, BLOCK_WORDS = 256, 400_000
#: Texts from which a bucket's neighbours are looked for in 256 cells of it.
LARGE = 4096
_RNG = np.random.default_rng(8101)
_ODD = _RNG.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _RNG.gamma(2.0, 1.0, POOL)
_LOG_C = np.log(_RNG.gamma(2.0, 1.0, POOL)).astype(np.float32)
_BETA = _RNG.random(POOL).astype(np.float32)
_ONE = np.float32(1)
_INV_R, _R = (1 / _R).astype(np.float32), _R.astype(np.float32)
#: The key under which rows are counted, as a word would be.
ROWS_KEY = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "key long, part int, n long"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, n): in how many rows of this partition each of its words is."""
    no, words = task_part(), Tally()
    for _, t in chunks(batches):
        keys, at = np.unique(t.word_hash, return_inverse=True)
        rows = np.unique(at * np.int64(t.n) + t.word_doc) // t.n
        words.add(np.append(keys, ROWS_KEY), np.append(np.bincount(rows, minlength=len(keys)), t.n))
    for keys, n in words.in_slices():
        yield rows_of(COUNTS, keys, no, n)


def frequencies(rows: DataFrame) -> tuple[str, int]:
    """A table by input partition of its words (key) and in how many rows of all they are (df); the number of rows."""
    counts = stored(rows.select("text").mapInArrow(count_words, COUNTS), "word-parts")
    n = counts.where(F.col("key") == int(ROWS_KEY.view(np.int64))).agg(F.sum("n")).first()[0] or 0
    # summed first, so that a word of every partition is a row for each task; then sent to the partitions that hold it
    sums = counts.groupBy("key").agg(F.sum("n").alias("df"))
    folder = by_part(counts.select("key", "part").join(sums, "key"), "word-frequencies")
    drop(counts)
    return folder, n


class Frequencies:
    """Steps of inverse document frequency of the words of this partition."""

    def __init__(self, folder: str, n: int):
        found = read_part(folder, task_part(), ["key", "df"])
        keys = found["key"].to_numpy().view(np.uint64) if found is not None else np.empty(0, np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        df = found["df"].to_numpy()[order] if found is not None else np.empty(0)
        self.steps = np.minimum(np.rint((np.log((n + 1) / (df + 1)) + 1) * IDF_STEPS), 255).astype(np.uint8)

    def of(self, t: Texts) -> np.ndarray:
        if not len(t.word_hash):
            return np.empty(0, np.uint8)
        at = np.minimum(np.searchsorted(self.keys, t.word_hash), max(len(self.keys) - 1, 0))
        if not len(self.keys) or not (self.keys[at] == t.word_hash).all():
            raise RuntimeError("the input's partitions changed between the passes")
        return self.steps[at]


def shingles(t: Texts, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, hash, weight of the distinct shingles, ordered by doc and hash, for the steps of frequency of the words."""
    each = steps / IDF_STEPS
    sums = np.zeros(len(each) + 1)
    np.cumsum(each, out=sums[1:])
    first, h = t.grams(SHINGLE)
    doc, w = t.word_doc[first], (sums[first + SHINGLE] - sums[first]) / SHINGLE
    counts = np.diff(t.word_offsets)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        a, b = t.word_offsets[few], t.word_offsets[few + 1]
        own = np.zeros(len(few), np.uint64)
        for j in range(SHINGLE - 1):
            on = a + j < b
            own[on] = own[on] * GRAM + t.word_hash[a[on] + j]
        doc, h, w = np.append(doc, few), np.append(h, mix(own)), np.append(w, (sums[b] - sums[a]) / (b - a))
    if not len(h):
        return doc, h, w
    order = np.lexsort((h, doc))
    doc, h, w = doc[order], h[order], w[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
    return doc[new], h[new], np.add.reduceat(w, new)


def samples(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their SLOTS samples as 32-bit values."""
    own, starts, sizes = np.unique(doc, return_index=True, return_counts=True)
    out = np.zeros((len(own), SLOTS), np.uint64)
    log_w = np.log(w).astype(np.float32)
    # whole texts together up to some thousands of shingles: the arrays stay in the cache of the CPU
    at = 0
    while at < len(own):
        to = at + 1
        while to < len(own) and starts[to] + sizes[to] - starts[at] <= 16_384:
            to += 1
        a, b = starts[at], starts[to - 1] + sizes[to - 1]
        hh, lw, cut, size = h[a:b], log_w[a:b], starts[at:to] - a, sizes[at:to]
        n = b - a
        at_pool, same = np.empty(n, np.uint64), np.empty(n, bool)
        r, q, beta, score = (np.empty(n, np.float32) for _ in range(4))
        for k in range(SLOTS):
            np.multiply(hh, _ODD[k], out=at_pool)
            np.right_shift(at_pool, np.uint64(48), out=at_pool)
            j = at_pool.view(np.int64)
            # q = floor(ln w / r + beta); ln a = ln c - r * (q - beta + 1)
            np.take(_BETA, j, out=beta, mode="clip")
            np.take(_INV_R, j, out=q, mode="clip")
            q *= lw
            q += beta
            np.floor(q, out=q)
            beta -= q
            beta -= _ONE
            np.take(_R, j, out=r, mode="clip")
            r *= beta
            np.take(_LOG_C, j, out=score, mode="clip")
            score += r
            np.equal(score, np.repeat(np.minimum.reduceat(score, cut), size), out=same)
            hit = np.flatnonzero(same)
            if len(hit) > to - at:
                hit = hit[np.searchsorted(hit, cut)]
            out[at:to, k] = mix(hh[hit] + q[hit].astype(np.int64).astype(np.uint64) * GRAM)
        at = to
    return own, out


def sketch_with(folder: str, n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for part, t in chunks(batches):
            known = known or Frequencies(folder, n)
            steps = known.of(t)
            doc, h, w = shingles(t, steps)
            own, s = samples(doc, h, w, t.n) if len(h) else (np.empty(0, np.int64), np.empty((0, SLOTS), np.uint64))
            band = s[:, 0::ROWS].copy()
            for j in range(1, ROWS):
                band = band * GRAM + s[:, j::ROWS]
            weight = np.bincount(doc, weights=w, minlength=t.n) if len(doc) else np.zeros(t.n)
            has = np.zeros(t.n, np.int32)
            has[own] = 1
            offsets = np.append(0, np.cumsum(has)).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets * BANDS), pa.array(mix(band).view(np.int64).ravel()))
            raw, at = (s & np.uint64(0xFFFFFFFF)).astype("<u4"), np.cumsum(has) - 1
            slots = pa.array([raw[at[i]].tobytes() if has[i] else b"" for i in range(t.n)], pa.binary())
            idf = pa.array([steps[a:b].tobytes() for a, b in zip(t.word_offsets[:-1], t.word_offsets[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(weight), bands, slots, idf], ["doc_id", "tid", "row", "weight", "bands", "slots", "idf"])

    return sketch


SKETCHES = "doc_id long, tid binary, row long, weight double, bands array<long>, slots binary, idf binary"


def steps_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def similarities(a: Texts, b: Texts, steps_a: np.ndarray, steps_b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the texts, pair by pair."""
    out = np.zeros(a.n)
    (da, ha, wa), (db, hb, wb) = shingles(a, steps_a), shingles(b, steps_b)
    ca, cb = np.searchsorted(da, np.arange(a.n + 1)), np.searchsorted(db, np.arange(b.n + 1))
    for i in range(a.n):
        p, q = slice(ca[i], ca[i + 1]), slice(cb[i], cb[i + 1])
        out[i] = similarity(ha[p], wa[p], hb[q], wb[q])
    return out


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ``texts(tid, text, idf)`` are similar. The first join is on the column that may be hot, with slim rows."""
    side = lambda x: texts.select(F.col("tid").alias(x), F.col("text").alias(f"text_{x}"), F.col("idf").alias(f"idf_{x}"))
    two = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b", "idf_a", "idf_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text that is compared with many comes in runs; half of the usual bytes, as there are two texts
        for part, a in chunks(batches, "text_a", CHUNK_BYTES // 2):
            s = similarities(a, Texts(part.column(3)), steps_of(part.column(4)), steps_of(part.column(5)))
            keep = pa.array(s >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(s).filter(keep)], ["a", "b", "similarity"])

    return two.mapInArrow(check, "a binary, b binary, similarity double")


def similarity(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets."""
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    low = np.minimum(wx[same], wy[at[same]]).sum()
    return float(low / (wx.sum() + wy.sum() - low))


class Members:
    """Texts of a block: id, label, weight, samples, shingles and their weights, row by row."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        self.tid, self.label = table.column("tid").to_pylist(), table.column("label").to_pylist()
        self.weight = table.column("weight").to_numpy()
        self.slots = np.frombuffer(b"".join(table.column("slots").to_pylist()), "<u4").reshape(-1, SLOTS)
        self.hashes, self.weights = (table.column(c).to_pylist() for c in ("hashes", "weights"))

    def set(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.hashes[i], "<u8"), np.frombuffer(self.weights[i], "<f4")


def links_between(x: Members, y: Members) -> list[tuple[bytes, bytes, float]]:
    """Links between the components that meet in two blocks of a bucket (or one), as few as join them."""
    root: dict[bytes, bytes] = {}

    def find(k: bytes) -> bytes:
        while k in root:
            k = root[k]
        return k

    out = []
    for n in range(len(x.tid)):
        w = x.weight[n]
        agree = (y.slots[n + 1 :] if x is y else y.slots) == x.slots[n]
        agree, skip = agree.sum(1), n + 1 if x is y else 0
        wy = y.weight[skip:]
        near = np.flatnonzero((agree >= MIN_AGREE) & (np.minimum(wy, w) >= SIMILARITY * 0.999 * np.maximum(wy, w)))
        for m in (near[np.argsort(-agree[near], kind="stable")] + skip).tolist():
            a, b = find(x.label[n]), find(y.label[m])
            if a != b and (s := similarity(*x.set(n), *y.set(m))) >= SIMILARITY:
                root[a] = b
                out.append((x.tid[n], y.tid[m], s))
    return out


LINKS = "a binary, b binary, similarity double"


def as_links(found: list[tuple[bytes, bytes, float]]) -> pa.RecordBatch:
    a, b, s = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], ["a", "b", "similarity"])


def compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets of one block; rows come sorted by ``group``. Only one group is held besides a batch."""
    try:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column(0).to_numpy()
            cuts = np.append(np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)) if len(group) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != group[a]:
                    yield from _own_links(held)
                    held = []
                held.append(batch.slice(a, b - a))
        yield from _own_links(held)
    finally:
        trim()


def _own_links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if held:
        x = Members(pa.Table.from_batches(held).combine_chunks())
        if found := links_between(x, x):
            yield as_links(found)


def compare_stored(folder: str):
    """Links between two stored blocks of a bucket."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, Members] | None = None
        columns = ["tid", "label", "weight", "slots", "hashes", "weights"]
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is None or last[0] != i:
                    last = i, Members(read_part(folder, i, columns))
                x = last[1]
                if found := links_between(x, x if i == j else Members(read_part(folder, j, columns))):
                    yield as_links(found)
        trim()

    return compare


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingles and weights of texts, as bytes."""
    for part, t in chunks(batches):
        doc, h, w = shingles(t, steps_of(part.column(2)))
        cut = np.searchsorted(doc, np.arange(t.n + 1))
        h, w = h.astype("<u8"), w.astype("<f4")
        lists = [pa.array([v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for v in (h, w)]
        yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(np.diff(t.word_offsets)), part.column(3), part.column(4)], ["tid", "hashes", "weights", "n_words", "slots", "weight"])


def links_in_open(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """More links, from the buckets of over three texts that still hold several components after ``labels``."""
    spark = members.sparkSession
    labelled = members.where("n > 3").select("band", "key", "tid", "n").join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    labelled = stored(labelled, "labelled")
    several = labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band", "key")
    left = stored(labelled.join(several, ["band", "key"], "left_semi"), "open")
    wanted = left.select("tid").distinct()
    some = texts.join(wanted, "tid", "left_semi").select("tid", "text", "idf", "slots", "weight")
    full = stored(some.mapInArrow(sets, "tid binary, hashes binary, weights binary, n_words long, slots binary, weight double"), "open-sets")
    rows = left.join(full.select("tid", "n_words"), "tid")
    size = rows.groupBy("band", "key").agg(F.sum("n_words").alias("all_words"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all_words") / BLOCK_WORDS)).cast("long")
    group = F.xxhash64("band", "key")
    rows = stored(rows.join(size, ["band", "key"]).select("tid", "label", group.alias("group"), blocks.alias("blocks")), "open-rows")
    small = rows.where("blocks = 1").select("group", "tid", "label").join(full, "tid").select("group", "tid", "label", "weight", "slots", "hashes", "weights")
    found = small.repartition("group").sortWithinPartitions("group").mapInArrow(compare_groups, LINKS)
    large = rows.where("blocks > 1")
    more, folder = stored(found, "more-links"), None
    if not large.isEmpty():
        # block numbers run through the large buckets, of which there are at most as many as rows over BLOCK
        number = large.groupBy("group").agg(F.first("blocks").alias("blocks"))
        number = stored(number.withColumn("first", F.sum("blocks").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks")), "open-blocks")
        block = (F.col("first") + F.pmod(F.xxhash64("tid"), F.col("blocks"))).cast("int")
        folder = by_part(large.select("group", "tid", "label").join(number, "group").withColumn("part", block).join(full, "tid").select("part", "tid", "label", "weight", "slots", "hashes", "weights"), "open-texts")
        have = spark.read.parquet(folder).select("part").distinct()
        i = number.select("first", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
        ij = i.select((F.col("first") + F.col("i")).alias("i"), F.explode(F.sequence(F.col("first") + F.col("i"), F.col("first") + F.col("blocks") - 1)).alias("j"))
        ij = ij.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
        ij = ij.join(have.withColumnRenamed("part", "i"), "i", "left_semi").join(have.withColumnRenamed("part", "j"), "j", "left_semi").select("i", "j")
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        more = more.unionByName(stored(ij.repartition(tasks, "i").sortWithinPartitions("i").mapInArrow(compare_stored(folder), LINKS), "more-links"))
        delete(spark, folder)
    drop(labelled, left, full, rows)
    return more


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid, row) of every row, and (tid, label, class_id, class_size, keeper) of every different text.

    ``keeper`` is the row of the class that stays where one has to: that of the smallest doc_id (nulls last).
    """
    spark = docs.sparkSession
    hold_splits(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("tid"), F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    folder, n = frequencies(rows)
    sketches = stored(rows.mapInArrow(sketch_with(folder, n), SKETCHES), "sketches")
    delete(spark, folder)
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    nodes = stored(sketches.groupBy("tid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), keeper.alias("keeper"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("tid", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(banded.join(buckets, ["band", "key"]), "members")
    # the leader of a bucket shares most buckets with others: of copies of one text, that text
    shared = members.groupBy("tid").agg(F.sum("n").alias("shared"))
    leaders = stored(members.join(shared, "tid").groupBy("band", "key").agg(F.max(F.struct("shared", "tid")).alias("top")).select("band", "key", F.col("top.tid").alias("leader")), "leaders")
    # with the leader, and with the one before among the rest; in cells of the text's hash, so that a large bucket is several windows
    cell = F.when(F.col("n") >= LARGE, F.substring("tid", 1, 1))
    rest = members.join(leaders, ["band", "key"]).where("tid != leader")
    chained = rest.withColumn("before", F.lag("tid").over(Window.partitionBy("band", "key", cell).orderBy("tid"))).select(F.explode(F.array("leader", "before")).alias("a"), F.col("tid").alias("b"))
    pairs = stored(chained.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    # a text is fetched from one row of its copies: joins on the row, so that a large group of copies is no hot key
    chosen = nodes.join(members.select("tid").distinct(), "tid", "left_semi").select("tid", F.col("keeper.row").alias("row"))
    one = sketches.select("row", "idf", "slots", "weight").join(chosen, "row")
    found = rows.select("row", "text").join(one, "row")
    same = F.assert_true(text_id() == F.col("tid"), "the input's partitions changed between the passes").isNull()
    texts = stored(found.where(same).select("tid", "text", "idf", "slots", "weight"), "texts")
    links = stored(verify(pairs, texts), "links")
    labels = components(links)
    more = links_in_open(members, labels, texts)
    drop(members, leaders, pairs, texts)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    found = nodes.select("tid", "first_id", "n", "keeper").join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    whole = found.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"), F.min("keeper").alias("keeper"))
    by_text = stored(found.select("tid", "label").join(whole, "label").select("tid", "label", "class_id", "class_size", F.col("keeper.row").alias("keeper")), "classes")
    ids = stored(sketches.select("doc_id", "tid", "row"), "rows")
    drop(sketches, nodes, links, labels)
    return ids, by_text


def text_id():
    return F.unhex(F.md5(text_of()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size for each row of ``docs(doc_id, text)``.

    Null and empty texts are copies of each other; texts without words link to no other text. Repeated rows are rows of one
    class. A class whose doc_ids are all null has a null class_id. Weighted similarity of 0.8 or more is a link.
    """
    rows, by_text = classes(docs)
    return rows.join(by_text, "tid").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row, all columns, of each class of ``docs``: that of the smallest doc_id. ``docs`` must be a table scan.

    Rows are known by their place in the scan; an error is raised if a later scan has another text there.
    """
    ids, by_text = classes(docs)
    row, tid = f"row_{(name := uuid.uuid4().hex)}", f"tid_{name}"
    chosen = by_text.where("keeper is not null").select(F.col("keeper").alias("row")).distinct()
    keepers = ids.join(chosen, "row").select(F.col("row").alias(row), F.col("tid").alias(tid))
    found = docs.withColumn(row, F.monotonically_increasing_id()).join(keepers, row)
    same = F.assert_true(F.col(tid) == text_id(), "the input's partitions changed between the passes").isNull()
    return found.where(same).select(*[F.col(f"`{c}`") for c in docs.columns])

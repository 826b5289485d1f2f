"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences and answer checks.

Words are runs of letters and digits, lower-cased (ASCII and Latin-1). A text is laid out in blocks of BLOCK words; the window
of an item of n words at a block is the run of blocks from there that covers any stretch of STRETCH * n words begun in the
block. An item leaks into a text if, in one of its windows, SURE of its words are in order (longest common subsequence), or
PARAPHRASE of them and ANSWER of the words of its answer, its last quarter, are there. Every window of every text is looked at:

1. Terms are the items' words; their document frequencies are counted over all texts.
2. A randomised SVD of the TF-IDF matrix of the items' passages of PASSAGE words (random test matrix, power rounds, partial
   products summed by Spark) gives the latent space of items and windows.
3. The vector of a window is the sum of its terms' rows of the space (sums over blocks, as differences of running sums). Every
   window of every text is searched against every item by products of matrices; a candidate has a cosine of COSINE or more.
   On prose this drops nine of ten pairs; the leaks of the tests, paraphrased ones too, are at twice COSINE or above.
4. Candidates are checked exactly: first by the words that window and item both hold, which bound a common subsequence, then
   by the subsequence itself (bit-parallel) and the answer, on the whole window.
5. ``complete`` (on unless said otherwise) adds windows below COSINE that hold SURE of an item's words: copies among so many
   repeats of another term that it outweighs them. Without it the search is by cosine alone (recall in the tests: all leaks).

The latent space is that of the items' own passages: texts that share no word with an item can't pass the checks, so words of
the texts alone would not bring up more. Items are dealt with in blocks of at most BLOCK_ITEMS and BLOCK_WORDS (queries
against all rows, in blocks), so what goes to the executors is bounded: one byte for each item and term (BLOCK_ITEMS *
BLOCK_WORDS = 30 MB at most) and RANK numbers for each term (20 MB).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stored
from .textnum import Texts, chunks

PASSAGE, BLOCK, STRETCH = 32, 16, 1.5
RANK, OVERSAMPLE, POWER_ROUNDS = 128, 32, 2
COSINE = 0.3
#: Cosines from running sums are taken for candidates from this much below COSINE; the exact one of the window decides.
SLACK = 5e-3
#: Terms in more than this share of the texts are counted as common ones.
COMMON = 0.2
SURE, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
MIN_WORDS = 5
BLOCK_ITEMS, BLOCK_WORDS = 750, 40_000
#: Cells of (word, item) or (window, item) that are held at once.
CELLS = 4 << 20
#: Blocks whose windows are looked up at once: few, so that running sums in single precision are exact to well below SLACK.
SLICE = 4_096
SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long"

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[[b for b in range(128) if not chr(b).isalnum()]] = 32


def normalised(t: Texts) -> Texts:
    """Letters and digits stay, lower-cased; general punctuation becomes space."""
    data = t.data
    out = _NORMAL[data]
    if (data >= 0xC2).any():
        lead = np.append(np.uint8(0), data[:-1])
        up = (lead == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        out[up] += 32
        for a, b in ((0xE2, 0x80), (0xC2, None), (0xE3, 0x80)):
            at = np.flatnonzero(data[:-1] == a)
            if b is not None:
                at = at[data[at + 1] == b]
            else:  # marks and signs of Latin-1, but not its ordinals and micro
                at = at[~np.isin(data[at + 1], [0xAA, 0xB5, 0xBA])]
            for j in range(3 if b is not None else 2):
                out[np.minimum(at + j, len(out) - 1)] = 32
    t.data = out
    return t


class Items:
    """A block of the benchmark: words, terms, passages."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        t = normalised(Texts(pa.array(texts, pa.string())))
        self.ids, hashes, cuts = ids, t.word_hash, t.word_offsets
        self.terms = np.unique(hashes)
        self.words = [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        self.passage_item, self.passages = [], []
        for i, w in enumerate(self.words):
            if len(w) < MIN_WORDS:
                continue
            last = max(0, len(w) - PASSAGE)
            for a in sorted({*range(0, last, PASSAGE // 2), last}):
                self.passage_item.append(i)
                self.passages.append(np.searchsorted(self.terms, w[a : a + PASSAGE]))

    def term_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their terms."""
        at = np.flatnonzero(self.coarse[(words >> np.uint64(48)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        good = self.terms[found] == words[at]
        return at[good], found[good]


def document_frequency(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    n_terms = len(items.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(n_terms, np.int64), 0
        for _, t in chunks(batches):
            t = normalised(t)
            at, term = items.term_of(t.word_hash)
            df += np.bincount(np.unique(t.word_doc[at] * n_terms + term) % n_terms, minlength=n_terms)
            rows += t.n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], ["term", "df"])

    sums = docs.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, df = sums["term"].to_numpy(), sums["df"].to_numpy()
    out = np.zeros(n_terms, np.int64)
    out[term[term >= 0]] = df[term >= 0]
    return out, int(df[term < 0].sum())


def product(rows: DataFrame, right: np.ndarray, gram: bool) -> np.ndarray:
    """A'A x right (or, with gram, right'A'A x right) for the sparse rows A(terms, weights), summed over partitions in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((right.shape[1] if gram else right.shape[0], right.shape[1]))
        for batch in batches:
            terms, weights = batch.column(0), batch.column(1)
            flat, w = terms.values.to_numpy(), weights.values.to_numpy()
            cut = terms.offsets.to_numpy()
            row = np.repeat(np.arange(len(terms)), np.diff(cut))
            y = np.zeros((len(terms), right.shape[1]))
            np.add.at(y, row, right[flat] * w[:, None])
            if gram:
                total += y.T @ y
            else:
                np.add.at(total, flat, y[row] * w[:, None])
        for a in range(0, len(total), 1024):
            yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([total[a : a + 1024].tobytes()], pa.binary())], ["at", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "data": [reduce(np.add, (np.frombuffer(x) for x in pdf["data"])).tobytes()]})

    sums = rows.mapInArrow(partial, "at long, data binary").groupBy("at").applyInPandas(add, "at long, data binary").toArrow()
    parts = sorted(zip(sums["at"].to_pylist(), sums["data"].to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(d).reshape(-1, right.shape[1]) for _, d in parts])


def randomised_svd(rows: DataFrame, n_terms: int, rank: int) -> np.ndarray:
    """The right singular vectors (n_terms x rank) of the sparse rows ``(terms array<int>, weights array<double>)``."""
    width = min(n_terms, rank + OVERSAMPLE)
    q = np.random.default_rng(7).standard_normal((n_terms, width))
    for _ in range(1 + POWER_ROUNDS):
        q, _ = np.linalg.qr(product(rows, q, gram=False))
    values, vectors = np.linalg.eigh(product(rows, q, gram=True))
    return q @ vectors[:, np.argsort(-values)[:rank]]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Searcher:
    """What a block of items is looked up with. ``least``: words of an item that a leak holds; ``blocks``: of its windows."""

    def __init__(self, spark: SparkSession, items: Items, df: np.ndarray, n: int, complete: bool = True, rank: int = RANK):
        self.items, self.complete = items, complete
        idf = np.log((n + 1) / (df + 1)) + 0.1
        tf = [np.unique(p, return_counts=True) for p in items.passages]
        weights = [c * idf[t] for t, c in tf]
        matrix = pa.table({"terms": pa.array([t.astype(np.int32) for t, _ in tf], pa.list_(pa.int32())), "weights": pa.array([w / np.sqrt((w**2).sum()) for w in weights], pa.list_(pa.float64()))})
        rows = spark.createDataFrame(matrix).repartition(max(1, min(64, len(tf) // 64)))
        rank = min(rank, len(items.terms), len(tf))
        self.basis = (randomised_svd(rows, len(items.terms), rank) * idf[:, None]).astype(np.float32)
        # by length, so that the items with windows of one size are neighbours
        self.known = sorted((i for i, w in enumerate(items.words) if len(w) >= MIN_WORDS), key=lambda i: len(items.words[i]))
        own = [np.searchsorted(items.terms, items.words[i]) for i in self.known]
        self.query = np.array([self.basis[t].sum(0) for t in own])
        self.unit = self.query / np.maximum(np.linalg.norm(self.query, axis=1, keepdims=True), 1e-6)
        size = np.array([len(t) for t in own])
        self.least, self.sure = (np.ceil(x * size - 1e-9).astype(np.int64) for x in (PARAPHRASE, SURE))
        self.blocks = np.ceil(STRETCH * size / BLOCK).astype(np.int64) + 1
        # common terms have columns of their own, by number; rarer ones a row of flags by item
        common = df > COMMON * n
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.counts = np.zeros((len(own), max(1, int(common.sum()))), np.int32)
        self.holds = np.zeros((len(items.terms), len(own)), np.uint8)
        for i, t in enumerate(own):
            self.holds[t, i] = 1
            np.add.at(self.counts[i], self.column[t[common[t]]], 1)
        self.holds[common] = 0
        self.rare_least, self.rare_sure = (np.maximum(x - self.counts.sum(1), 0).astype(np.uint16) for x in (self.least, self.sure))
        self.words = [dict(zip(*(x.tolist() for x in np.unique(t, return_counts=True)), strict=True)) for t in own]

    def block_sums(self, block: np.ndarray, term: np.ndarray, n: int, rows: np.ndarray, small: type, sums: type) -> np.ndarray:
        """Sums of the terms' rows in the blocks before each of 0..n; ``small`` holds the sum of one block."""
        out = np.zeros((n + 1, rows.shape[1]), sums)
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(block)))
        # the first words of all blocks at once, then the second ones of those that have any, ...
        first = first[np.argsort(-size, kind="stable")]
        held = np.zeros((len(first), out.shape[1]), small)
        for j in range(int(size.max(initial=0))):
            m = int((size > j).sum())
            held[:m] += rows.take(term[first[:m] + j], axis=0)
        out[block[first] + 1] = held
        return np.cumsum(out, axis=0, dtype=sums, out=out)

    def search(self, t: Texts) -> list[tuple[int, int, float, float, float, int]]:
        """text, item, cosine, lcs, answer share, first word of the leaks in some texts."""
        words, cuts = t.word_hash, t.word_offsets
        at, term = self.items.term_of(words)
        if not len(at):
            return []
        n_blocks = -(-np.diff(cuts) // BLOCK)
        start = np.append(0, np.cumsum(n_blocks))
        n, doc = int(start[-1]), t.word_doc[at]
        block = start[doc] + (at - cuts[doc]) // BLOCK
        last = np.repeat(start[1:], n_blocks)
        best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for a in range(0, n, SLICE):
            self.search_slice(t, at, term, start, block, last, a, min(n, a + SLICE), best)
        return [(d, i, c, share, answer, first) for (d, i), (share, c, answer, first) in sorted(best.items())]

    def search_slice(self, t: Texts, at: np.ndarray, term: np.ndarray, start: np.ndarray, block: np.ndarray, last: np.ndarray, a: int, b: int, best: dict) -> None:
        """The windows that begin in the blocks from a up to b."""
        top = min(len(last), b + int(self.blocks.max()))
        i, j = np.searchsorted(block, [a, top])
        block, own_term = block[i:j] - a, term[i:j]
        rare, n, width = self.column[own_term] < 0, top - a, self.counts.shape[1]
        # modulo 2**16: differences are far below that
        sums = self.block_sums(block[rare], own_term[rare], n, self.holds, np.uint8, np.uint16)
        latent = self.block_sums(block, own_term, n, self.basis, np.float32, np.float32)
        usual = np.zeros((n + 1, width), np.int32)
        usual[1:] = np.bincount(block[~rare] * width + self.column[own_term[~rare]], minlength=n * width).reshape(n, width)
        np.cumsum(usual, axis=0, out=usual)
        for k in np.unique(self.blocks):
            lo, hi = np.searchsorted(self.blocks, [k, k + 1])
            step = max(64, CELLS // (hi - lo))
            for s in range(0, b - a, step):
                e = min(s + step, b - a)
                at1 = np.minimum(np.arange(s, e) + k, last[a + s : a + e] - a)
                window = latent[at1] - latent[s:e]
                length = np.sqrt(np.einsum("ij,ij->i", window, window))
                near = window @ self.unit[lo:hi].T >= (COSINE - SLACK) * np.maximum(length, 1e-6)[:, None]
                held = sums[at1, lo:hi] - sums[s:e, lo:hi]
                look = near & (held >= self.rare_least[lo:hi])
                if self.complete:
                    look |= held >= self.rare_sure[lo:hi]
                w, c = np.nonzero(look)
                pairs = max(1, CELLS // width)
                for p in range(0, len(w), pairs):
                    x, y = w[p : p + pairs], c[p : p + pairs]
                    bound = held[x, y] + np.minimum(usual[at1[x]] - usual[s + x], self.counts[lo + y]).sum(1)
                    good = np.flatnonzero(bound >= np.where(near[x, y], self.least[lo + y], self.sure[lo + y]))
                    for g0, g1, item in zip((a + s + x[good]).tolist(), (a + at1[x[good]]).tolist(), (lo + y[good]).tolist(), strict=True):
                        self.check(t, at, term, start, g0, g1, item, best)

    def check(self, t: Texts, at: np.ndarray, term: np.ndarray, start: np.ndarray, b0: int, b1: int, k: int, best: dict) -> None:
        """The exact checks of item ``k`` and the window of the blocks from b0 up to b1."""
        cuts, i = t.word_offsets, self.known[k]
        d = int(np.searchsorted(start, b0, "right") - 1)
        w0 = int(cuts[d] + (b0 - start[d]) * BLOCK)
        w1 = int(min(cuts[d] + (b1 - start[d]) * BLOCK, cuts[d + 1]))
        lo, hi = np.searchsorted(at, [w0, w1])
        left, held = dict(self.words[k]), 0
        for x in term[lo:hi].tolist():
            if left.get(x):
                left[x] -= 1
                held += 1
        if held < self.least[k]:
            return
        x, q = self.basis[term[lo:hi]].sum(0), self.query[k]
        cosine = float(x @ q / np.sqrt(max(float((x @ x) * (q @ q)), 1e-12)))
        if cosine < COSINE and not (self.complete and held >= self.sure[k]):
            return
        item, near = self.items.words[i], t.word_hash[w0:w1]
        common = lcs(item, near)
        if common < self.least[k]:
            return
        answer = float(np.isin(item[-max(3, len(item) // 4) :], near).mean())
        if common >= self.sure[k] or answer >= ANSWER:
            now = (common / len(item), cosine, answer, w0 - int(cuts[d]))
            if now > best.get((d, i), (-1.0, 0.0, 0.0, 0)):
                best[d, i] = now


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks, streamed to the driver row by row."""
    ids, texts, words = [], [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        words += len((r.text or "").split())
        if len(ids) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, words = [], [], 0
    if ids:
        yield Items(ids, texts)


def searchers(docs: DataFrame, benchmark: DataFrame, complete: bool = True) -> Iterator[Searcher]:
    for items in item_blocks(benchmark):
        if items.passages:
            yield Searcher(docs.sparkSession, items, *document_frequency(docs, items), complete)


def leaks(docs: DataFrame, benchmark: DataFrame, complete: bool = True) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, first_word for each pair of a row of ``docs(doc_id, text)`` and an item that leaks into it.

    Texts without leaks have no rows; null and empty texts have none; a repeated row has rows of its own, and so has each of
    several items with the same text. Of the windows of a pair the one with the longest common subsequence counts, then the
    highest cosine, answer and place. Items below MIN_WORDS words, and null ones, are not looked for. Null doc_ids stay null.
    A very long text is one row of numpy arrays, looked through in slices.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for s in searchers(docs, benchmark, complete):
        # the hits of a block of items are a written table, so that its searcher can go before the next one is sent out
        sent = docs.sparkSession.sparkContext.broadcast(s)
        found.append(stored(rows.mapInArrow(_find(sent), SCHEMA), "leaks"))
        sent.destroy()
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def _find(searcher):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = searcher.value
        for part, t in chunks(batches):
            hits = s.search(normalised(t))
            if hits:
                d, i, cosine, share, answer, first = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array([s.items.ids[x] for x in i], pa.int64()), *(pa.array(x, pa.float64()) for x in (cosine, share, answer)), pa.array(first, pa.int64())], [x.split()[0] for x in SCHEMA.split(", ")])

    return find


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, into whose text no item leaks. Rows are judged one by one, whatever their ids."""

    def keep_with(searcher):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, t in chunks(batches):
                mask = np.ones(t.n, bool)
                mask[[h[0] for h in searcher.value.search(normalised(t))]] = False
                yield part.filter(pa.array(mask))

        return keep

    out, sent, kept = docs, None, None
    for s in searchers(docs, benchmark):
        if sent is not None:  # of several blocks of items: what the ones before keep is a written table, and their searcher goes
            out, old = stored(out, "clean"), kept
            sent.destroy()
            kept = out
            if old is not None:
                drop(old)
        sent = docs.sparkSession.sparkContext.broadcast(s)
        out = out.mapInArrow(keep_with(sent), docs.schema)
    return out

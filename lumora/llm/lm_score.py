"""LM scoring by context-tree weighting over binary-decomposed bytes, and a unigram base score.

Texts have A-Z lower-cased. A byte is eight binary decisions; each decision has its own tree over the bytes before it, up to
DEPTH of them (zeros before a text). A node holds the Krichevsky-Trofimov estimate of its decisions; context-tree weighting
mixes, at every node, this estimate (one half) with the product of the nodes one byte deeper (one half). Every context of the
training texts is a node. The code length of a text is the sum of -log2 of the weighted predictions; ``score`` is the log10
probability.

Contexts are packed with the byte before the decision highest, so the context one byte shorter is a shift away and sorted
contexts of all lengths lie together. Contexts of up to TOP bytes (at most 65,536, by 256 decisions) go to all executors; the
longer ones, whose number grows with the corpus, stay in Spark. There the tree is folded from its deepest level up: a context
meets the sums of its children (256 at most), and its weights are kept for the decisions it has seen. Each partition is sent
the counts and weights of the contexts that it holds.

Passes: one over the texts counts words and runs of DEPTH + 1 bytes for each input partition; shuffles add the counts up, fold
the tree and send each partition's words and contexts back, to tables by partition; a second pass over the same partitions
reads them and scores. Words and their counts are thus never held in one place. Words are known by a 64-bit hash: of V
distinct words, V / 2**64 are expected to share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, drop, hold_splits, stored
from .files import by_part, read_part
from .textnum import Tally, Texts, chunks, task_part, trim

FOLDS, HELD_OUT = 7, 2
#: Bytes of the longest contexts (6 at most, as a run is packed in 64 bits), and of the longest that all executors hold.
DEPTH, TOP = 4, 2
WORDS, RUNS, WANTED = 0, 1, 2
HALF = float(np.log(0.5))
#: The key of the token that ends a text.
END = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(t: Texts) -> Texts:
    t.data = _LOWER[t.data]
    return t


def runs_of(t: Texts, depth: int = DEPTH) -> np.ndarray:
    """The bytes before each byte, the last one highest, and then the byte itself; zeros before a text."""
    n = len(t.data)
    out = t.data.astype(np.int64)
    place = np.arange(n) - np.repeat(t.offsets[:-1], np.diff(t.offsets))
    for back in range(1, depth + 1):
        out[back:] |= np.where(place[back:] >= back, t.data[: n - back], 0).astype(np.int64) << (8 * (depth + 1 - back))
    return out


def at_depth(runs: np.ndarray, depth: int, of: int = DEPTH) -> np.ndarray:
    """Runs with contexts of ``of`` bytes cut to ``depth`` bytes."""
    return (runs >> (8 * (of - depth + 1))) << 8 | (runs & 0xFF)


def count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, part, n): words with their training counts; training runs; contexts."""
    part_no, words, runs, wanted = task_part(), Tally(), Tally(), Tally()
    for part, t in chunks(batches):
        t = lowered(t)
        train = ~part.column(1).to_numpy(zero_copy_only=False)
        keys, at = np.unique(t.word_hash, return_inverse=True)
        words.add(np.append(keys, END), np.append(np.bincount(at, weights=train[t.word_doc], minlength=len(keys)), train.sum()).astype(np.int64))
        of_train = np.repeat(train, np.diff(t.offsets))
        all_runs = runs_of(t)
        grams, n = np.unique(all_runs[of_train], return_counts=True)
        runs.add(grams.astype(np.uint64), n)
        own = np.unique(np.append(grams, all_runs[~of_train]) >> 8).astype(np.uint64)
        wanted.add(own, np.zeros(len(own), np.int64))
    for kind, tally in ((WORDS, words), (RUNS, runs), (WANTED, wanted)):
        tally.fold()
        for a in range(0, len(tally.keys), 200_000):
            k = tally.keys[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(np.full(len(k), part_no, np.int32)), pa.array(tally.sums[a : a + 200_000])], ["kind", "key", "part", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series from x + 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 decisions (node 1 the first, 2 n and 2 n + 1 below n) of counts by byte; column 0 is idle."""
    tree = np.zeros((len(counts), 512))
    tree[:, 256:] = counts
    for level in range(7, -1, -1):
        a, b = 1 << level, 2 << level
        tree[:, a:b] = tree[:, b : 2 * b : 2] + tree[:, b + 1 : 2 * b : 2]
    return tree[:, 0:512:2][:, :256], tree[:, 1:512:2][:, :256]


def blocks(counts: np.ndarray) -> np.ndarray:
    """For counts by byte: ln of the KT block probability of each decision; 0 for those that were never met."""
    zeros, ones = decisions(counts)
    out, some = np.zeros(zeros.shape), zeros + ones > 0
    z, o = zeros[some], ones[some]
    out[some] = log_gamma(z + 0.5) + log_gamma(o + 0.5) - log_gamma(z + o + 1) - np.log(np.pi)
    return out


class Runs:
    """Counts of (context, byte), as sorted keys context * 256 + byte and running sums."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.sums = np.append(0, np.cumsum(counts[order]))

    def predict(self, keys: np.ndarray) -> list[np.ndarray]:
        """The KT prediction of each of the eight bits of the keys' bytes, after the bits before."""
        out, above = [], None
        for level in range(9):
            width = np.int64(1 << (8 - level))
            low = keys & -width
            n = self.sums[np.searchsorted(self.keys, low + width)] - self.sums[np.searchsorted(self.keys, low)]
            if above is not None:
                out.append((n + 0.5) / (above + 1.0))
            above = n
        return out


class Weights:
    """The weight of a context's own estimate by (context, decision), as sorted keys; one half where there is none."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.weights = np.append(keys[order], np.iinfo(np.int64).max), np.append(weights[order], np.float32(0.5))

    def of(self, runs: np.ndarray) -> list[np.ndarray]:
        """The weights of the eight decisions of the runs' bytes."""
        out = []
        for bit in range(8):
            key = (runs >> 8) << 8 | (256 | runs & 0xFF) >> (8 - bit)
            at = np.searchsorted(self.keys, key)
            out.append(np.where(self.keys[at] == key, self.weights[at], np.float32(0.5)))
        return out


class Tree:
    """Levels of contexts from none to the deepest: counts, and above the deepest the weights."""

    def __init__(self, levels: list[tuple[Runs, Weights | None]]):
        self.levels = levels

    def log10(self, runs: np.ndarray) -> np.ndarray:
        """log10 of the weighted prediction of the byte of each run; runs with contexts of the deepest level."""
        p, deepest = None, len(self.levels) - 1
        for depth in range(deepest, -1, -1):
            # each context and byte of a level once
            own, at = np.unique(at_depth(runs, depth, deepest), return_inverse=True)
            counts, weights = self.levels[depth]
            q = counts.predict(own)
            if p is None:
                p = [x[at] for x in q]
            else:
                p = [(w * x)[at] + (1 - w)[at] * deep for x, w, deep in zip(q, weights.of(own), p, strict=True)]
        return np.log10(p).sum(0)


def dense(parts: pa.ListArray, nodes: str, values: str, n: int) -> np.ndarray:
    """Sums by decision, a row for each list, of a list of (nodes binary, values binary) structs."""
    out, flat = np.zeros((n, 256)), parts.flatten()
    row = np.repeat(np.arange(n), parts.value_lengths().fill_null(0).to_numpy())
    size = pa.compute.binary_length(flat.field(nodes)).to_numpy()
    at = np.frombuffer(b"".join(flat.field(nodes).to_pylist()), np.uint8)
    np.add.at(out, (np.repeat(row, size), at), np.frombuffer(b"".join(flat.field(values).to_pylist()), np.float64))
    return out


def counts_of(after: pa.ListArray) -> np.ndarray:
    out, flat = np.zeros((len(after), 256)), after.flatten()
    out[np.repeat(np.arange(len(after)), after.value_lengths().to_numpy()), flat.field("byte").to_numpy()] = flat.field("c").to_numpy()
    return out


LEVEL = "nodes binary, weights binary, whole binary"


def fold_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, after, children) with the decisions met (nodes), the weights of the estimates, and ln of the weighted probabilities."""
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            after, children = part.column(1), part.column(2)
            block = blocks(counts_of(after))
            whole, weight = block, np.ones(block.shape)
            if children.null_count < len(children):
                whole = np.logaddexp(HALF + block, HALF + dense(children, "nodes", "whole", part.num_rows))
                weight = np.exp(HALF + block - whole)
            row, node = np.nonzero(block)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            columns = [node.astype(np.uint8), weight[row, node].astype(np.float32), whole[row, node]]
            yield pa.RecordBatch.from_arrays([part.column(0), after, *(pa.array([v[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for v in columns)], ["context", "after", "nodes", "weights", "whole"])


def sums_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, below): the sums of a context's children by decision."""
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            sums = dense(part.column(1), "nodes", "whole", part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sums], pa.binary())], ["context", "below"])


def top_levels(keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, below: np.ndarray) -> list[tuple[Runs, Weights]]:
    """Levels 0 to TOP from runs with TOP bytes of context, and the sums below its contexts."""
    out, own = [], np.unique(keys >> 8)
    deep = np.zeros((len(own), 256))
    np.add.at(deep, np.searchsorted(own, contexts), below)
    for depth in range(TOP, -1, -1):
        cut = at_depth(keys, depth, TOP)
        table = np.zeros((len(own), 256))
        np.add.at(table, (np.searchsorted(own, cut >> 8), cut & 0xFF), counts)
        block = blocks(table)
        whole = np.logaddexp(HALF + block, HALF + deep)
        row, node = np.nonzero(block)
        out.insert(0, (Runs(*_summed(cut, counts)), Weights(own[row] << 8 | node, np.exp(HALF + block - whole)[row, node].astype(np.float32))))
        own, at = np.unique(own >> 8, return_inverse=True)
        deep = np.zeros((len(own), 256))
        np.add.at(deep, at, whole)
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)


def deep_levels(runs: DataFrame) -> tuple[dict[int, DataFrame], DataFrame]:
    """For each depth above TOP its contexts with what follows them and their weights; the sums below the contexts of TOP bytes."""
    levels, children = {}, None
    for depth in range(DEPTH, TOP, -1):
        # at most 256 bytes follow a context, and it has at most 256 children
        cut = runs.groupBy((F.expr(f"key >> {8 * (DEPTH - depth + 1)}")).alias("context"), F.expr("cast(key & 255 as int)").alias("byte")).agg(F.sum("c").alias("c"))
        after = cut.groupBy("context").agg(F.collect_list(F.struct("byte", "c")).alias("after"))
        rows = after.withColumn("children", F.lit(None).cast("array<struct<nodes:binary,whole:binary>>")) if children is None else after.join(children, "context", "left")
        levels[depth] = stored(rows.select("context", "after", "children").mapInArrow(fold_level, f"context long, after array<struct<byte:int,c:long>>, {LEVEL}"), "lm-level")
        children = levels[depth].groupBy(F.expr("context >> 8").alias("context")).agg(F.collect_list(F.struct("nodes", "whole")).alias("children"))
    return levels, children.mapInArrow(sums_below, "context long, below binary")


def own_levels(folder: str) -> list[tuple[Runs, Weights | None]]:
    """The levels above TOP for the contexts of this partition, read one after the other."""
    out = []
    for depth in range(TOP + 1, DEPTH + 1):
        found = read_part(folder, task_part(), ["context", "after", "nodes", "weights"], depth=depth)
        own = found.combine_chunks() if found is not None else None
        if own is None or not own.num_rows:
            out.append((Runs(np.empty(0, np.int64), np.empty(0, np.int64)), Weights(np.empty(0, np.int64), np.empty(0, np.float32))))
            continue
        context, after = own["context"].to_numpy(), own["after"].combine_chunks()
        flat = after.flatten()
        keys = np.repeat(context, after.value_lengths().to_numpy()) << 8 | flat.field("byte").to_numpy()
        sizes = pa.compute.binary_length(own["nodes"]).to_numpy()
        nodes = np.frombuffer(b"".join(own["nodes"].to_pylist()), np.uint8)
        weights = np.frombuffer(b"".join(own["weights"].to_pylist()), np.float32)
        out.append((Runs(keys, flat.field("c").to_numpy()), Weights(np.repeat(context, sizes) << 8 | nodes, weights)))
        del found, own, after, flat, keys
        trim()
    return out


def score_with(of_words: str, of_runs: str, top, n_train: int, n_distinct: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = task_part()
        keys = counts = None
        for part, t in chunks(batches):
            if keys is None:
                known = read_part(of_words, no, ["key", "c"])
                if known is None:
                    raise RuntimeError("the input's partitions changed between the passes")
                keys, counts = known["key"].to_numpy().view(np.uint64), known["c"].to_numpy()
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order]
                end = counts[np.searchsorted(keys, END)]
                tree = Tree(top.value + own_levels(of_runs))
                seen, values = np.empty(0, np.int64), np.empty(0)
            t = lowered(t)
            at = np.minimum(np.searchsorted(keys, t.word_hash), len(keys) - 1)
            if not (keys[at] == t.word_hash).all():
                raise RuntimeError("the input's partitions changed between the passes")
            c = counts[at]
            over = np.log10(n_train + n_distinct + 1.0)
            by_word = np.append(0.0, np.cumsum(np.log10(c + 1.0) - over))
            base = by_word[t.word_offsets[1:]] - by_word[t.word_offsets[:-1]] + np.log10(end + 1.0) - over
            runs, at = np.unique(runs_of(t), return_inverse=True)
            new = np.setdiff1d(runs, seen, assume_unique=True)
            if len(new):
                seen, values = np.append(seen, new), np.append(values, tree.log10(new))
                order = np.argsort(seen)
                seen, values = seen[order], values[order]
            by_byte = np.append(0.0, np.cumsum(values[np.searchsorted(seen, runs)][at]))
            value = by_byte[t.offsets[1:]] - by_byte[t.offsets[:-1]]
            n_bytes = np.diff(t.offsets)
            bits = np.where(n_bytes > 0, -value / np.log10(2) / np.maximum(n_bytes, 1), np.nan)
            arrays = [part.column(0), part.column(1), pa.array(np.diff(t.word_offsets) + 1), pa.array(t.per_doc(c > 0, t.word_offsets) + int(end > 0)), pa.array(np.full(t.n, n_train)), pa.array(base), pa.array(value), pa.array(n_bytes), pa.array(bits, mask=np.isnan(bits))]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])

    return score


def lm_scores(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for each row of ``docs(doc_id, text)``.

    A row is held out when crc32 of its doc_id as text, modulo ``folds``, is ``held_out`` (a null id is the empty text). A
    null or empty text has one token (the end), score 0 and null bits_per_byte. If all rows are held out, counts are 0 and
    every byte has probability 1 / 256. The input must be a table scan: both passes have to see the same partitions, else an
    error is raised. The result is a stored table. Repeated rows are scored alike; a very long text is one row of numpy arrays.
    """
    spark = docs.sparkSession
    hold_splits(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held_out).alias("held_out"), "text")
    counts = stored(rows.select("doc_id", "held_out", "text").mapInArrow(count_parts, "kind byte, key long, part int, n long"), "lm-parts")
    same = Window.partitionBy("key")
    words = counts.where(F.col("kind") == WORDS).select("key", "part", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("part")) == 1).alias("first"))
    of_words = by_part(words, "lm-words")
    known = spark.read.schema("key long, c long, first boolean, part int").parquet(of_words)
    totals = known.where("first").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    runs = stored(counts.where(F.col("kind") == RUNS).groupBy("key").agg(F.sum("n").alias("c")), "lm-runs")
    levels, below = deep_levels(runs)
    short = runs.groupBy(F.expr(f"(key >> {8 * (DEPTH - TOP + 1)}) << 8 | key & 255").alias("key")).agg(F.sum("c").alias("c")).toArrow()
    below = below.toArrow()
    sums = np.frombuffer(b"".join(below["below"].to_pylist())).reshape(-1, 256)
    top = spark.sparkContext.broadcast(top_levels(short["key"].to_numpy(), short["c"].to_numpy(), below["context"].to_numpy(), sums))
    wanted = counts.where(F.col("kind") == WANTED).select("key", "part")
    sent = None
    for depth, level in levels.items():
        own = wanted.select(F.expr(f"key >> {8 * (DEPTH - depth)}").alias("context"), "part").distinct().join(level, "context")
        # the deepest level has no weights
        none = F.lit(b"")
        own = own.select("part", F.lit(depth).alias("depth"), "context", "after", *(("nodes", "weights") if depth < DEPTH else (none.alias("nodes"), none.alias("weights"))))
        sent = own if sent is None else sent.unionByName(own)
    of_runs = by_part(sent, "lm-contexts")
    out = stored(rows.select("doc_id", "held_out", "text").mapInArrow(score_with(of_words, of_runs, top, int(totals.n or 0), int(totals.v or 0)), SCHEMA), "lm-scores")
    top.unpersist()
    drop(counts, runs, *levels.values())
    for folder in (of_words, of_runs):
        delete(spark, folder)
    return out

"""Mixing sources to target weights: a golden-ratio lattice schedule over equal-token blocks. DataFrame functions only.

1. Targets. Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share all words; a target stops at
   three times its source, the excess goes to the others by weight. With caps that is: target = min(3 * size, level *
   weight) for the one level at which the targets add up, found from running sums over the sources ordered by cap / weight.
2. Blocks. Each source's documents are shuffled by a hash of their id and laid end to end; that stream is cut into blocks
   of ``block_words`` words (the last is shorter).
3. Slots. The mix is Q slots of one block each. Slot t has the point ((t * F) mod Q) / Q with F the integer next to
   Q / golden ratio that is coprime to Q: golden-ratio points made exact, so each point is met once. Points run through
   the cumulative quotas to a source; a slot's rank in its source names the block (rank mod blocks) and the pass.
4. Blocks meet their slots in an equi-join on (source, block); a document's taken words are its overlaps with them.

Running sums never put a source into one task: rows are dealt to (source, cell), cells are summed, only the cell sums
(one row for ``CELL_ROWS`` rows) run through a window per source, and the rest is local to a cell.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hold_splits, stored, text_of

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 256
CELL_ROWS = 2_000
GOLDEN = (math.sqrt(5) - 1) / 2


def word_count():
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_no, source_size, target for ``sizes(source, size)``; one row a source, so its windows are small."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    per = per.withColumn("source_no", F.row_number().over(every) - 1)
    w = F.element_at(F.lit(list(weights)).cast("array<double>"), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_passes)
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "source_no")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # the level if this source and those after it are not capped
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    # the first source that is not above its cap fixes the level; all before it are capped
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "source_no", "level"))).over(everything)
    per = per.withColumn("final", first["level"])
    return per.select("source", "source_no", "source_size", "docs", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def quotas(per: DataFrame, block_words: int) -> DataFrame:
    """Adds to the sources: words to take (long), blocks, slots, the words of the last slot, and the slots of sources before."""
    per = per.withColumn("want", F.least(F.round("target").cast("long"), F.col("source_size") * MAX_PASSES))
    n = F.greatest(F.col("source_size"), F.lit(1))
    rest = F.col("want") % n
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    per = per.withColumn("slots", F.floor(F.col("want") / n).cast("long") * F.col("blocks") + F.ceil(rest / F.lit(block_words)).cast("long"))
    per = per.withColumn("last_words", F.when(rest % block_words > 0, rest % block_words).otherwise(F.lit(block_words)).cast("long"))
    return per.withColumn("slots_before", F.coalesce(F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def step_for(q: int) -> int:
    """The integer nearest to q / golden ratio that is coprime to q."""
    near = max(1, round(q * GOLDEN))
    return next(f for d in range(q + 1) for f in (near - d, near + d) if f > 0 and math.gcd(f, q) == 1) if q > 1 else 1


def schedule(per: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source_no, rank, block, pass_no, words: what each slot of the mix takes, for the sources of ``quotas``."""
    spark = per.sparkSession
    q = int(per.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    step = step_for(q)
    t = spark.range(q).withColumnRenamed("id", "slot")
    product = F.col("slot") * F.lit(step) if q < 3_000_000_000 else F.col("slot").cast("decimal(19,0)") * F.lit(step).cast("decimal(19,0)")
    t = t.withColumn("point", (product % F.lit(max(q, 1))).cast("long"))
    # sources as one sorted array of upper bounds: a bounded row for each source, searched for the point
    cell = 65_536
    edges = per.where("slots > 0").select("source_no", "slots_before", "blocks", "slots", "last_words", (F.col("slots_before") + F.col("slots")).alias("slots_to"))
    # points are cut at multiples of `cell`; each source covers few of them, so the range join is an equi-join on the cut
    cuts = edges.withColumn("cut", F.explode(F.sequence(F.floor(F.col("slots_before") / cell), F.floor((F.col("slots_to") - 1) / cell))))
    placed = t.withColumn("cut", F.floor(F.col("point") / cell)).join(cuts, "cut").where((F.col("point") >= F.col("slots_before")) & (F.col("point") < F.col("slots_to")))
    # rank in the source: local rank in a cell of slots plus the counts of the cells before
    placed = placed.withColumn("at", F.floor(F.col("slot") / CELL_ROWS).cast("long"))
    counts = placed.groupBy("source_no", "at").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = placed.withColumn("local", F.row_number().over(Window.partitionBy("source_no", "at").orderBy("slot")) - 1)
    ranked = local.join(counts.select("source_no", "at", "before"), ["source_no", "at"]).withColumn("rank", F.col("local") + F.col("before"))
    words = F.when(F.col("rank") == F.col("slots") - 1, F.col("last_words")).otherwise(F.lit(block_words)).cast("long")
    return ranked.select("slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).cast("long").alias("pass_no"), words.alias("words"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, slots (blocks that hold words of it, repeats counted), row for every row.

    Null texts have size 0 and are taken 0 times; null sources are one source, the last; repeated rows are rows of their own.
    The result depends on doc_id, source and size only, so reruns agree.
    """
    hold_splits(docs.sparkSession)
    sizes = stored(docs.select("doc_id", "source", word_count().alias("size"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    per = stored(quotas(targets(sizes, weights), block_words), "mix-sources")
    # positions in the shuffled stream of a source, in cells of the hash
    n = per.select("source", "source_no", "source_size", "target", "docs")
    rows = sizes.join(F.broadcast(n) if _few(per) else n, sizes["source"].eqNullSafe(n["source"])).drop(n["source"])
    rows = rows.withColumn("h", F.xxhash64(F.lit("mix"), F.col("doc_id")))
    cells = F.greatest(F.lit(1), F.ceil(F.col("docs") / CELL_ROWS)).cast("long")
    rows = rows.withColumn("cell", F.floor((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * cells).cast("long"))
    sums = rows.groupBy("source_no", "cell").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("source_no", "cell").orderBy("h", "doc_id", "size", "row")
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn("inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(sums.select("source_no", "cell", "before"), ["source_no", "cell"]).withColumn("start", F.col("inside") + F.col("before"))
    # slots of each block: full ones, and at most one that takes only the first words of its block
    slots = schedule(per, block_words).groupBy("source_no", "block").agg(F.count_if(F.col("words") == block_words).alias("full"), F.max(F.when(F.col("words") < block_words, F.col("words"))).alias("part"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    first = F.floor(F.col("start") / block_words).cast("long")
    pieces = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    joined = pieces.join(slots, ["source_no", "block"], "left")
    taken = F.coalesce("full", F.lit(0)) * (hi - lo) + F.greatest(F.lit(0), F.least(hi, F.col("block") * block_words + F.coalesce("part", F.lit(0))) - lo)
    held = F.when(F.col("size") > 0, taken).otherwise(0)
    return joined.groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(
        F.sum(held).cast("long").alias("taken"), F.sum(F.when(F.col("size") > 0, F.coalesce("full", F.lit(0)) + F.when(F.col("part").isNotNull(), 1).otherwise(0)).otherwise(0)).cast("long").alias("slots"),
    ).select("doc_id", "source", "size", "source_size", "target", "taken", "slots", "row")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it: its taken words over its size, rounded.

    ``docs`` must be a table scan. Rows without words are not taken. Rows are known by their place in the scan; an error is
    raised if a later scan has another row there.
    """
    row, times, doc = (f"{x}_{uuid.uuid4().hex}" for x in ("row", "times", "doc"))
    often = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    taken = mix(docs).where("size > 0").select(F.col("row").alias(row), often.alias(times), F.col("doc_id").alias(doc)).where(F.col(times) > 0)
    rows = docs.withColumn(row, F.monotonically_increasing_id()).join(taken, row)
    same = F.col("doc_id").eqNullSafe(F.col(doc))
    rows = rows.where(F.assert_true(same, "the input's partitions changed between the passes").isNull())
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _few(per: DataFrame, most: int = 50_000) -> bool:
    """Whether the sources (about 100 bytes each) are few enough to be broadcast."""
    return per.count() <= most

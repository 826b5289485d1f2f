"""Repair of conversations: the cheapest edits that give a well-formed sequence of roles, by Dijkstra on an edit lattice.

A node of the lattice is (rows read, state of the grammar ``(s?(ua)+)?``); an edge keeps the next row (0), gives it another
role (3), deletes it (4) or inserts an empty turn (3); a truncated row that stays costs 3 more, and a blank or repeated row can
only be deleted. The queue is ordered by (cost, audit), where the audit is the string of edit letters K, R, D, I, and the search
stops at the first end node taken from it. Two paths to one node of equal cost never have audits of which one begins the
other, so the order of paths stays when both are carried on, and the first path to a node is the best.

How it runs: rows are numbered by range partitions over (conversation, turn), cut into blocks of at most ``BLOCK_ROWS`` rows of one
conversation. The search needs a letter for each row, not its text. A conversation of one block is solved at once; a longer one
has each block solved from every state (in parallel), and a second search over (block, state) joins the blocks, so a
conversation that holds a third of all rows is no task of its own but for that joining and for its digest, which by its nature
is one pass over its repaired text; it streams through, a block at a time. Texts join again for the repaired result: a row
that stays is the first of its conversation, role and text, so that digest finds it.

Odd rows: null role or text count as one space, null turns come first; rows of one turn stand in the order of the input; roles
that begin with none of s, u, a (an empty one, too) can only be changed or deleted; a null conv_id is a conversation of its
own; one whose rows are all dropped has zeros, an empty audit and the digest of an empty string.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, stored
from .textnum import task_part

#: Most rows of a block, and bytes of text from which on it takes no more.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
KEEP, RELABEL, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system's, a user's, an assistant's turn. What a kept initial leads to, and a made turn.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
MADE = (2, 2, 3, 2)
ENDS = (0, 3)
_BLANKS = " \t\n\x0b\f\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place, copy, kept: ``rows(conv_id, turn, role, text)`` with a fault for five in twenty of them.

    The remainder of crc32(``conv_id:turn``) by 20 decides: 0 drops a row (kept is false), 1 empties its text, 2 takes its
    sentence ends, 3 repeats it, 4 makes it a user's.
    """
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text_or("role").alias("role"), text_or("text").alias("text"), F.monotonically_increasing_id().alias("place"), (F.crc32(F.concat(text_or("conv_id"), F.lit(":"), text_or("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    r = r.select("conv_id", "turn", role.alias("role"), text.alias("text"), "place", "fault")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return r.withColumn("copies", copies).select("conv_id", "turn", "role", "text", "place", F.explode("copies").alias("copy"), (F.col("fault") != 0).alias("kept"))


def sound(rows: DataFrame) -> DataFrame:
    """The same columns for rows as they are."""
    return damaged(rows.limit(0)).unionByName(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.monotonically_increasing_id().alias("place"), F.lit(0).alias("copy"), F.lit(True).alias("kept")))


def _key() -> Column:
    """A digest of conversation, role and text."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    return F.unhex(F.sha2(F.concat_ws(":", F.octet_length(conv).cast("string"), conv, F.octet_length("role").cast("string"), "role", "text"), 256))


def _bare() -> Column:
    return F.rtrim(F.col("text"), F.lit(_BLANKS))


def _numbered(rows: DataFrame) -> DataFrame:
    """Stored conv_id, turn, kept, init, state (blank, cut, fine), key, id (in order) and block."""
    state = F.when(_bare() == "", "blank").when(~F.right(_bare(), F.lit(1)).isin(".", "!", "?"), "cut").otherwise("fine")
    first = F.left("role", F.lit(1))
    r = rows.select("conv_id", "turn", "place", "copy", "kept", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("init"), state.alias("state"), _key().alias("key"), F.octet_length("text").cast("long").alias("size"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("place"), F.col("copy")]
    kind = dict(r.dtypes)["conv_id"]
    r = r.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "kept", "init", "state", "key", "size")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = task_part() << 33
        block, held, size, last, begun = row - 1, 0, 0, None, False
        for batch in batches:
            blocks = []
            for conv, own in zip(batch.column(0).to_pylist(), batch.column(6).to_pylist(), strict=True):
                if not begun or conv != last or held == BLOCK_ROWS or size > BLOCK_BYTES:
                    block, held, size, last, begun = block + 1, 0, 0, conv, True
                blocks.append(block)
                held, size = held + 1, size + own
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(range(row, row + n), pa.int64()), pa.array(blocks, pa.int64())], [*batch.schema.names[:6], "id", "block"])
            row += n

    return stored(r.mapInArrow(number, f"conv_id {kind}, turn long, kept boolean, init string, state string, key binary, id long, block long"), "turns")


def search(codes: str, begin: int = 0, every: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the first end node taken from the queue, under its state; with ``every`` the best of all end states.

    A letter of ``codes`` is a row: its initial (s, u, a, o), in upper case if it is truncated, or x if it must go.
    """
    queue, settled, ends, n = [(0, "", 0, begin)], set(), {}, len(codes)
    while queue and len(ends) < 4:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n:
            if every:
                ends[state] = (cost, audit)
            elif state in ENDS:
                return {state: (cost, audit)}
        else:
            heapq.heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
            code = codes[i]
            if code != "x":
                more = TRUNCATED if code.isupper() else 0
                to = KEPT.get((state, code.lower()))
                if to is not None:
                    heapq.heappush(queue, (cost + KEEP + more, audit + "K", i + 1, to))
                heapq.heappush(queue, (cost + RELABEL + more, audit + "R", i + 1, MADE[state]))
        heapq.heappush(queue, (cost + INSERT, audit + "I", i, MADE[state]))
    return ends


@lru_cache(maxsize=100_000)
def cheapest(codes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation; equal strings of letters, of which most tables have few, are searched once."""
    return next(iter(search(codes).values()))


@F.pandas_udf(T.StructType().add("cost", "long").add("ops", "string"))
def _solved(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cheapest(c) for c in codes], columns=["cost", "ops"])


@F.pandas_udf(T.ArrayType(T.StructType().add("begin", "integer").add("end", "integer").add("cost", "long").add("ops", "string")))
def _ways(codes: pd.Series) -> pd.Series:
    """The best ways through a block of a longer conversation, from every state to every state."""
    return pd.Series([[{"begin": b, "end": e, "cost": c, "ops": o} for b in range(4) for e, (c, o) in sorted(search(code, b, True).items())] for code in codes])


def follow(codes: str, ops: str, state: int) -> tuple[list[str], list[str], str, int]:
    """For each row what is written before it and its edit (K, D, or the initial of its new role); what is written at the end; the state then."""
    before, edits, made, i = [], [], "", 0
    for op in ops:
        if op == "I" or op == "R":
            state = MADE[state]
        if op == "I":
            made += ("user" if state == 2 else "assistant") + ":\n"
            continue
        if op == "K":
            state = KEPT[(state, codes[i].lower())]
        edits.append("ua"[state - 2] if op == "R" else op)
        before.append("" if op == "D" else made)
        made = made if op == "D" else ""
        i += 1
    return before, edits, made[:-1], state


@F.pandas_udf(T.StructType().add("before", T.ArrayType(T.StringType())).add("edits", T.ArrayType(T.StringType())).add("tail", "string"))
def _written(codes: pd.Series, ops: pd.Series, state: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([follow(c, o, s)[:3] for c, o, s in zip(codes, ops, state, strict=True)], columns=["before", "edits", "tail"])


def _joined(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """block, ops, state, cost, illegal, repeats for the blocks of long conversations, which come in order.

    The search over (block, state) goes block by block, since no way leads back. What the audits of all states have in common
    at their beginning is set aside, so that they stay short. The cost stands on the last block.
    """

    def end(own: list[tuple], common: list[str], now: dict[int, tuple[int, str]]) -> pd.DataFrame:
        cost, rest = min(now[s] for s in ENDS if s in now)
        audit, at, state, out, turn, init = "".join(common) + rest, 0, 0, [], None, ""
        for k, (block, codes, inits, first_turn, last_turn) in enumerate(own):
            stop, left = at, len(codes)
            while left or (k == len(own) - 1 and stop < len(audit)):
                left -= audit[stop] != "I"
                stop += 1
            ops = audit[at:stop]
            wrong = bool(init and inits) and init + inits[0] not in ("su", "ua", "au")
            out.append((block, ops, state, cost if k == len(own) - 1 else 0, int(wrong), int(turn is not None and first_turn == turn)))
            state, at, init = follow(codes, ops, state)[3], stop, inits[-1:] or init
            turn = turn if last_turn is None else last_turn
        return pd.DataFrame(out, columns=["block", "ops", "state", "cost", "illegal", "repeats"])

    conv, own, common, now = None, [], [], {0: (0, "")}
    for batch in blocks:
        for row in batch.itertuples(index=False):
            if own and row.conv != conv:
                yield end(own, common, now)
                own, common, now = [], [], {0: (0, "")}
            conv = row.conv
            own.append((row.block, row.codes, row.inits, None if pd.isna(row.first_turn) else int(row.first_turn), None if pd.isna(row.last_turn) else int(row.last_turn)))
            best: dict[int, tuple[int, str]] = {}
            for way in row.ways:
                if way["begin"] in now:
                    cost, audit = now[way["begin"]]
                    path = (cost + way["cost"], audit + way["ops"])
                    if way["end"] not in best or path < best[way["end"]]:
                        best[way["end"]] = path
            shared = len(os.path.commonprefix([audit for _, audit in best.values()]))
            common.append(next(iter(best.values()))[1][:shared])
            now = {s: (cost, audit[shared:]) for s, (cost, audit) in best.items()}
    if own:
        yield end(own, common, now)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """conv, repaired_sha256 of long conversations, whose blocks come in order; one block's text at a time."""
    conv, sum_, any_, begun = None, hashlib.sha256(), False, False
    for batch in batches:
        for row in batch.itertuples(index=False):
            if begun and row.conv != conv:
                yield pd.DataFrame({"conv": [conv], "repaired_sha256": [sum_.hexdigest()]})
                sum_, any_ = hashlib.sha256(), False
            conv, begun = row.conv, True
            if row.body:
                sum_.update((("\n" if any_ else "") + row.body).encode())
                any_ = True
    if begun:
        yield pd.DataFrame({"conv": [conv], "repaired_sha256": [sum_.hexdigest()]})


def _blocks(numbered: DataFrame) -> DataFrame:
    """Stored: a row for each block, with its letters, counts and keys."""
    live = numbered.where(F.col("kept") & (F.col("state") != "blank"))
    # the key holds the conversation; partial sums first, so that one text which fills a conversation does no harm
    firsts = live.groupBy("key").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    r = numbered.join(firsts, "id", "left")
    fault = F.when(F.col("state") == "blank", "b").when(F.col("first").isNull(), "d").when(F.col("state") == "cut", "t").otherwise("")
    code = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper("init")).otherwise(F.col("init"))
    r = r.withColumn("fault", fault).withColumn("row", F.when(F.col("kept"), F.struct("id", code.alias("code"), "init", "fault", "turn", "key")))
    # a block has a bounded number of rows
    b = r.groupBy("block").agg(F.first("conv_id").alias("conv_id"), F.min("id").alias("first"), F.array_sort(F.collect_list("row")).alias("rows"))
    count = lambda f: F.size(F.filter("rows", lambda x: x["fault"] == f)).cast("long")
    inits = F.array_join(F.col("rows.init"), "")
    pairs = F.zip_with(F.slice("rows.init", 1, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice("rows.init", 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda x, y: F.concat(x, y))
    turns = F.filter("rows.turn", lambda t: t.isNotNull())
    b = b.select(
        "block", "conv_id", "first", F.array_join(F.col("rows.code"), "").alias("codes"), inits.alias("inits"), F.col("rows.key").alias("keys"),
        count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"),
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.array_min(turns).alias("first_turn"), F.array_max(turns).alias("last_turn"), F.size(F.array_distinct(turns)).cast("long").alias("n_turns"))
    return stored(b, "turn-blocks")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for ``rows`` as ``damaged`` or ``sound`` give them."""
    numbered = _numbered(rows)
    blocks = _blocks(numbered)
    drop(numbered)
    long = stored(blocks.groupBy(F.col("conv_id").alias("long_id")).agg(F.count("*").alias("n_blocks")).where("n_blocks > 1"), "long-conversations")
    some_long = not long.isEmpty()
    names = ["block", "conv_id", "first", "codes", "keys", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "n_turns"]
    whole = blocks.join(long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_anti") if some_long else blocks
    solved = whole.withColumn("s", _solved("codes")).select(*names, "s.ops", F.lit(0).alias("state"), "s.cost", F.lit(False).alias("long"))
    if some_long:
        # the conversation as text: it only has to be told from others
        conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
        parts = blocks.join(long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi").withColumn("conv", conv).withColumn("ways", _ways("codes"))
        ordered = parts.select("conv", "first", "block", "codes", "inits", "first_turn", "last_turn", "ways").repartition("conv").sortWithinPartitions("conv", "first")
        path = ordered.mapInPandas(_joined, "block long, ops string, state int, cost long, more long, repeats long".replace("more", "illegal")).withColumnRenamed("illegal", "more")
        own = blocks.join(path, "block").withColumn("illegal", F.col("illegal") + F.col("more")).withColumn("n_turns", F.col("n_turns") - F.col("repeats"))
        solved = solved.unionByName(own.select(*names, "ops", "state", "cost", F.lit(True).alias("long")))
    solved = stored(solved, "turn-edits")
    edits = solved.withColumn("w", _written("codes", "ops", "state"))
    stays = edits.select("block", F.posexplode(F.arrays_zip("keys", F.col("w.before").alias("before"), F.col("w.edits").alias("edit"))).alias("n", "x")).where("x.edit != 'D'").select("block", "n", "x.before", "x.edit", F.col("x.keys").alias("key"))
    texts = rows.where(F.col("kept") & (_bare() != "")).select(_key().alias("key"), "role", "text").groupBy("key").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") == "u", "user").otherwise("assistant")
    pieces = stays.join(texts, "key").select("block", "n", F.concat("before", role, F.lit(":"), "text").alias("piece"))
    bodies = pieces.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "\n").alias("body"))
    tails = edits.select("block", "conv_id", "first", "long", F.nullif("w.tail", F.lit("")).alias("tail"))
    texts = tails.join(bodies, "block", "left").select("block", "conv_id", "first", "long", F.concat_ws("\n", "body", "tail").alias("body"))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    out = ["conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.col("ops").alias("audit"), "repaired_sha256"]
    if not some_long:
        return solved.join(texts.select("block", F.sha2(F.col("body").cast("binary"), 256).alias("repaired_sha256")), "block").select(*out)
    texts = stored(texts, "turn-texts")
    one = solved.where("not long").join(texts.where("not long").select("block", F.sha2(F.col("body").cast("binary"), 256).alias("repaired_sha256")), "block").select(*out)
    ordered = texts.where("long").select(conv.alias("conv"), "first", "body").repartition("conv").sortWithinPartitions("conv", "first")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "ops"))), lambda x: x["ops"]), "").alias("ops")
    per = solved.where("long").withColumn("conv", conv).groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), audit, *sums)
    return one.unionByName(per.join(ordered.mapInPandas(_digests, "conv string, repaired_sha256 string"), "conv").select(*out))

"""Conversation repair, ranked search and chunked encoding against plain Python, and on odd, tied, very long and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from lumora.llm import chunk_bpe, ranked_search, turn_repair

D = "/root/testdata/sf0.001"
KINDS = {"user": "u", "assistant": "a", "system": "s"}


def turns_after(rows):
    """The rows of one conversation after damage, by turn."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        if fault:
            out += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def brute_repair(rows):
    """All counts and the cheapest audit by dynamic programming over rows and states."""
    rows, seen, faults = turns_after(rows), set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {(0, 0): (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts, more than two in a row never pay
            for s in range(4):
                if (i, s) in best:
                    cost, audit, made = best[i, s]
                    to = {0: 2, 1: 2, 2: 3, 3: 2}[s]
                    new = (cost + 3, audit + "I", (*made, ("user:", "assistant:")[to - 2]))
                    if (i, to) not in best or new[:2] < best[i, to][:2]:
                        best[i, to] = new
        if i == len(rows):
            break
        for s in range(4):
            if (i, s) not in best:
                continue
            cost, audit, made = best[i, s]
            _, role, text = rows[i]
            to = {0: 2, 1: 2, 2: 3, 3: 2}[s]
            steps = [(s, 4, "D", made)]
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((s, role[:1]))
                if kept is not None:
                    steps.append((kept, more, "K", (*made, f"{role}:{text}")))
                steps.append((to, 3 + more, "R", (*made, f"{('user', 'assistant')[to - 2]}:{text}")))
            for t, c, letter, m in steps:
                new = (cost + c, audit + letter, m)
                if (i + 1, t) not in best or new[:2] < best[i + 1, t][:2]:
                    best[i + 1, t] = new
    cost, audit, made = min((best[len(rows), s] for s in (0, 3) if (len(rows), s) in best), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def repaired(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {k: brute_repair(v) for k, v in groups.items()}


@pytest.mark.parametrize("block_rows", [256, 3, 1])
def test_repair_against_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", block_rows)
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repaired(e.queries()["op11_turn_repair"](spark, D))
    assert got == expected(rows)


@pytest.mark.parametrize("block_rows", [256, 4])
def test_repair_of_odd_and_long_conversations(spark, monkeypatch, block_rows):
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(4)
    rows = [(1, i, str(rng.choice(["user", "assistant", "system", "tool", "", "user"])), str(rng.choice(["Yes.", "no", "", "  \n", "Ok!", f"word {i}."]))) for i in range(700)]
    rows += [(None, None, None, None), (None, 3, "user", "a."), (2, None, "user", "x."), (2, None, "assistant", "y."), (2, 5, "assistant", None), (2, 5, "assistant", "z.")]
    rows += [(3, i, "user", "same.") for i in range(9)] + [(4, 7, "assistant", "q" * 3_000_000 + "."), (5, 1, "sé", "é? "), (6, 2**40, "user", "far.")]
    rows += [(7, i, "user", "drop") for i in range(4000) if zlib.crc32(f"7:{i}".encode()) % 20 == 0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    df = df.withColumn("place", F.lit("x")).withColumn("kept", F.lit(False)).withColumn("key", F.lit(0))
    got = repaired(turn_repair.repair(turn_repair.damaged(df)))
    assert turn_repair._numbered(turn_repair.damaged(df)).select("block").distinct().count() >= 700 // block_rows
    assert got == expected(rows)
    assert got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_sound_and_no_rows(spark):
    df = spark.createDataFrame([("c", 0, "user", "Hi."), ("c", 1, "assistant", "Yes."), ("d", 0, "assistant", "Alone.")], "conv_id string, turn int, role string, text string")
    got = repaired(turn_repair.repair(turn_repair.sound(df)))
    assert got["c"][5:7] == (0, "KK") and got["d"][5:7] == (3, "IK")
    assert turn_repair.repair(turn_repair.damaged(df.limit(0))).collect() == []


def brute_search(docs, items, most=10):
    from math import floor, log

    cut = lambda t: re.findall(ranked_search.TERM, "" if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    words = [(d, cut(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        asked, rows = set(cut(text)), []
        for d, w in words:
            m = 10 + (90 * len(w) * n_docs) // total if total else 0
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in asked & set(w))
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows, key=lambda r: r[:3])[:most])]
    return sorted(out, key=str)


def test_search_of_odd_rows(spark):
    docs = [(1, "Alpha beta beta"), (2, None), (3, ""), (None, "alpha BETA gamma"), (4, "alpha"), (4, "alpha"), (5, "Été été-alpha beta αβ 123abc"), (6, "x" * 1_000_000 + " beta " + "gamma " * 100_000), (7, "!!! ..."), (8, "delta")]
    docs += [(100 + i, f"filler{i} word{i % 7}") for i in range(40)]
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "???"), (None, "gamma gamma"), (4, "été 123ABC αβ"), (5, "unknown"), (6, "delta word3 " + "z" * 100_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("alpha")).withColumn("tf", F.lit(3)).withColumn("bucket", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(9))
    assert sorted(map(tuple, ranked_search.search(d, i).collect()), key=str) == brute_search(docs, items)
    assert ranked_search.search(d.limit(0), i).collect() == [] and ranked_search.search(d, i.limit(0)).collect() == []
    assert ranked_search.search(d.where("doc_id in (2, 3, 7)"), i).collect() == []


def library(tokenizer, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    ids = [t.encode("" if x is None else x, add_special_tokens=False).ids for x in texts]
    return [(len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in ids]


def test_encoding_of_whole_tables(spark):
    rows = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in e.queries()["op13_chunk_bpe"](spark, D).collect()}
    assert got == dict(zip([r.doc_id for r in rows], library(chunk_bpe.default_tokenizer(), [r.text for r in rows]), strict=True))


def odd_texts():
    rng = np.random.default_rng(11)
    atoms = [" ", "  ", "\n", "\n\n\n", "\t ", "a", "the", "'ll", "'", "s", "<|endoftext|>", "<|endof", "|>", "é", " ", " ", "中文", "\U0001f600", "1", "234", "!", "?!.", "\x85", " ", "A", "Zebra", "\x00", "́", " word", " x1"]
    texts = ["".join(rng.choice(atoms, int(n))) for n in rng.integers(1, 6000, 120)]
    texts += ["a" * 50_000, " " * 30_000, "中" * 20_000, "<|endoftext|>" * 3_000, "x " * 30_000, "\n" * 9_000 + "end", "'" * 10_000, None, "", " ", "é" * 9_001]
    passage = "".join(rng.choice(atoms, 4000))
    return [*texts, passage, passage, "begin " + passage, passage + " end", texts[0], texts[0]]


def test_encoding_of_odd_texts(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("part", F.lit(1)).repartition(5)
    got = sorted(tuple(r)[1:] for r in chunk_bpe.round_trip(df, chunk_bpe.default_tokenizer()).collect())
    assert got == sorted(library(chunk_bpe.default_tokenizer(), texts))
    assert chunk_bpe.round_trip(df.limit(0), chunk_bpe.default_tokenizer()).collect() == []


def test_encoding_gives_back_the_text_and_repairs_joins(spark, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "BITS", 4)
    monkeypatch.setattr(chunk_bpe, "LEAST", 32)
    coder = chunk_bpe.Coder(chunk_bpe.default_tokenizer())
    import pyarrow as pa

    from lumora.llm.textnum import Texts

    for text in odd_texts():
        raw = (text or "").encode()
        t = Texts(pa.array([raw], pa.large_binary()))
        made = chunk_bpe._ids_of(t, coder, {})[0]
        assert made.tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert coder.decode(made) == raw
        assert len(raw) < 1000 or len(chunk_bpe.cut_places(t)[0]) > 2 or len(set(raw)) < 5


def test_other_tokenizers_take_whole_texts(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "The Cat sat. " * 400), (2, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in chunk_bpe.round_trip(df, path).collect()) == sorted(n for n, _, _ in library(path, ["The Cat sat. " * 400, ""]))

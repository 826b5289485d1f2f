"""Byte-pair encoding and decoding of whole texts, with chunks that texts share encoded once and the joins repaired.

Texts are cut into chunks where a rolling hash over the last bytes has its top bits unset, so that equal passages are cut
alike wherever they stand. Three passes over the same scan:

1. cut: a digest for each chunk; a digest that occurs more than once has an owner, the first place in order of the input;
2. encode the owned chunks, once for all texts that hold them, and store their ids; each input partition is then sent the
   ids of the shared chunks that occur in it (a chunk once for a partition, so one that half of all texts hold does no harm);
3. put each text together: shared chunks from the table, all others encoded where they stand, and the joins repaired.

Repair: a chunk's ids are right but near its ends, as a merge, a run of spaces or a special token may reach over a cut. So the
words around a cut (white space after a visible character always begins a new piece) are encoded again in one go, with a word
more on both sides; where the ids of those outer words are not exactly those of the chunks, the window grows by twice as many
words, up to the whole text. Only what the window holds between the outer words is taken from it.

Ids are those of the tokenizers library for the whole text with add_special_tokens=False (special tokens in a text are found);
a tokenizer file with other rules than byte-level pieces is used on whole texts. If a later pass sees other rows than the
first, an owned chunk has another digest, which is an error, and an unknown chunk is simply encoded.

Odd rows: a null or empty text has no ids and decodes to an empty text; null, equal and clashing columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, drop, hold_splits, stored
from .files import by_part, read_part
from .textnum import Texts, chunks, rows_of, task_part

#: Bytes that the rolling hash sees, a power of two; bits that must be unset at a cut; least and most bytes of a chunk.
WINDOW, BITS, LEAST, MOST = 32, 11, 512, 16384
_VALUES = np.random.default_rng(977).integers(0, 2**32, 256, dtype=np.uint32)
_FACTOR = 0x9E3779B1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once.
_BLOCK = 1 << 20
CUT = "part int, row long, start long, stop long, h1 long, h2 long"
ENCODED = "doc_id long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _hash_cuts(data: np.ndarray) -> np.ndarray:
    """Places before which the rolling hash of the last WINDOW bytes allows a cut, at the first byte of a character."""
    found = []
    for at in range(0, len(data), _BLOCK):
        back = min(at, WINDOW - 1)
        h = _VALUES[data[at - back : at + _BLOCK]]
        span, factor = 1, _FACTOR
        while span < WINDOW:  # from the hash of `span` bytes that of twice as many
            wider = h.copy()
            wider[span:] += h[:-span] * np.uint32(factor)
            h, span, factor = wider, span * 2, factor * factor % 2**32
        found.append(np.flatnonzero(h[back:] < np.uint32(1 << (32 - BITS))) + at + 1)
    cuts = np.concatenate(found) if found else np.empty(0, np.int64)
    cuts = cuts[cuts < len(data)]
    return cuts[(data[cuts] & 0xC0) != 0x80]


def cut_places(texts: Texts) -> list[np.ndarray]:
    """For each text the places of its cuts, with 0 and its length; they depend on its own bytes alone."""
    free, out = _hash_cuts(texts.data), []
    for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
        places, last = [0], a
        if b - a > LEAST:
            i, stop = int(np.searchsorted(free, a + LEAST)), int(np.searchsorted(free, b))
            own = free[i:stop].tolist()
            i = 0
            while b - last > LEAST:
                while i < len(own) and own[i] < last + LEAST:
                    i += 1
                at = own[i] if i < len(own) else b
                if at > last + MOST:  # back to the first byte of a character
                    at = last + MOST
                    while at > last + 1 and texts.data[at] & 0xC0 == 0x80:
                        at -= 1
                if at >= b:
                    break
                places.append(at - a)
                last = at
        if b > a:
            places.append(b - a)
        out.append(np.array(places, np.int64))
    return out


def piece_starts(texts: Texts) -> np.ndarray:
    """Places of white space after a visible character, which always begins a piece."""
    d = texts.data
    if len(d) < 2:
        return np.empty(0, np.int64)
    visible = (d >= 0x21) & (d <= 0x7E)
    # two-byte characters but those of the first block, which has white space
    visible[1:] |= (d[1:] >= 0x80) & (d[1:] <= 0xBF) & (d[:-1] >= 0xC3) & (d[:-1] <= 0xDF)
    return np.flatnonzero(_SPACE[d[1:]] & visible[:-1]) + 1


def digest(raw: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Coder:
    """A tokenizer file: ids of byte strings, and the bytes of each id. One for each worker and file."""

    _made: dict[str, Coder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        model = spec.get("model", {})
        added = spec.get("added_tokens", [])
        plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not any(c.isspace() for c in t["content"]) for t in added)
        #: Whether the rules are those that cutting and repairing rest on.
        self.by_chunk = bool(pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and spec.get("post_processor") is None and model.get("type") == "BPE" and not model.get("dropout") and plain)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {chr(b): b for b in shown}
        letter.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
        of = {i: bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        of.update({t["id"]: t["content"].encode() for t in added})
        size = max(of, default=-1) + 1
        self.bytes = pa.array([of.get(i, b"") for i in range(size)], pa.large_binary())
        self.sizes = np.array([len(of.get(i, b"")) for i in range(size)], np.int64)
        self.type = np.dtype("<u2" if size <= 0x10000 else "<u4")

    @classmethod
    def of(cls, path: str) -> Coder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """The library's ids of each; bytes that are no characters are replaced, as for any text."""
        out: list[np.ndarray] = []
        for i in range(0, len(raws), 2000):
            texts = [r.decode("utf-8", "replace") for r in raws[i : i + 2000]]
            out += [np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        taken = self.bytes.take(pa.array(ids.astype(np.int64)))
        return taken.buffers()[2].to_pybytes()[: int(self.sizes[ids].sum())] if len(ids) else b""


def _groups(k: np.ndarray, words: int, last: int) -> list[tuple[int, int]]:
    """Runs of joins whose windows (with so many outer words) touch, as the words they lie in: first and last piece start."""
    out: list[list[int]] = []
    for x in k.tolist():
        if out and x - 1 - words <= out[-1][1] + words:
            out[-1][1] = min(x, last)
        else:
            out.append([x - 1, min(x, last)])
    return [(a, b) for a, b in out]


def repaired(raw: bytes, ids: np.ndarray, cuts: np.ndarray, starts: np.ndarray, coder: Coder, ask: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """A text's ids from those of its chunks, one after the other; ``starts`` are its piece starts, with 0 and its length."""
    k = np.searchsorted(starts, cuts[1:-1])
    k = k[starts[k] != cuts[1:-1]]
    if not len(k):
        return ids
    ends = np.concatenate([[0], np.cumsum(coder.sizes[ids])])
    last, words = len(starts) - 1, 1

    def place(at: int, all_ends: np.ndarray) -> int:
        i = int(np.searchsorted(all_ends, at))
        return i if i < len(all_ends) and all_ends[i] == at else -1

    while True:
        out, done, fits = [], 0, True
        for a, b in _groups(k, words, last):
            outer_a, outer_b = int(starts[max(a - words, 0)]), int(starts[min(b + words, last)])
            inner_a, inner_b = int(starts[a]), int(starts[b])
            own = ask(raw[outer_a:outer_b])
            own_ends = np.concatenate([[0], np.cumsum(coder.sizes[own])]) + outer_a
            w1, w2, c0, c1, c2, c3 = place(inner_a, own_ends), place(inner_b, own_ends), place(outer_a, ends), place(inner_a, ends), place(inner_b, ends), place(outer_b, ends)
            # without outer words a window reaches to the end of the text
            left = inner_a == 0 or (min(w1, c0, c1) >= 0 and np.array_equal(own[:w1], ids[c0:c1]))
            right = inner_b == len(raw) or (min(w2, c2, c3) >= 0 and np.array_equal(own[w2:], ids[c2:c3]))
            if not (left and right):
                fits = False
                break
            first, stop = (0 if inner_a == 0 else w1), (len(own) if inner_b == len(raw) else w2)
            out += [ids[done : 0 if inner_a == 0 else c1], own[first:stop]]
            done = len(ids) if inner_b == len(raw) else c2
        if fits:
            return np.concatenate([*out, ids[done:]])
        if words > last:
            return ask(raw)
        words *= 2


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = task_part(), 0
    for _, texts in chunks(batches):
        raw, out = texts.data.tobytes(), []
        for i, places in enumerate(cut_places(texts)):
            base = int(texts.offsets[i])
            p = places.tolist()
            out += [(row + i, a, b, *digest(raw[base + a : base + b])) for a, b in zip(p[:-1], p[1:], strict=True)]
        row += len(texts)
        for a in range(0, len(out), 50_000):
            columns = np.array(out[a : a + 50_000], np.int64).T
            yield rows_of(CUT, np.full(columns.shape[1], part), *columns)


def _owned(folder: str, tokenizer: str) -> Callable:
    """h1, h2, ids of the chunks that a partition owns."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, found, row = Coder.of(tokenizer), read_part(folder, task_part(), ["row", "start", "stop", "h1", "h2"]), 0
        own = np.array([found.column(c).to_numpy() for c in ("row", "start", "stop", "h1", "h2")]) if found is not None else np.empty((5, 0), np.int64)
        own = own[:, np.argsort(own[0], kind="stable")]
        for _, texts in chunks(batches):
            a, b = np.searchsorted(own[0], [row, row + len(texts)])
            raws = []
            for r, start, stop, h1, h2 in own[:, a:b].T.tolist():
                base = int(texts.offsets[r - row])
                raws.append(texts.data[base + start : base + stop].tobytes())
                if digest(raws[-1]) != (h1, h2):
                    raise RuntimeError("a second scan of the documents has other rows than the first")
            row += len(texts)
            if raws:
                yield pa.RecordBatch.from_arrays([pa.array(own[3, a:b]), pa.array(own[4, a:b]), pa.array([x.tobytes() for x in coder.encode(raws)], pa.binary())], ["h1", "h2", "ids"])

    return encode


def _whole(folder: str | None, tokenizer: str) -> Callable:
    """ENCODED rows, with ids as little-endian unsigned 32-bit integers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(tokenizer)
        found = read_part(folder, task_part(), ["h1", "h2", "ids"]) if folder else None
        shared = {}
        if found is not None:
            h1, h2 = found.column("h1").to_pylist(), found.column("h2").to_pylist()
            shared = dict(zip(zip(h1, h2, strict=True), found.column("ids").to_pylist(), strict=True))
            del found, h1, h2
        for part, texts in chunks(batches):
            made = _ids_of(texts, coder, shared)
            ids = part.column(part.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.astype("<u4").tobytes() for x in made], pa.binary())], ["doc_id", "ids"])

    return encode


def _ids_of(texts: Texts, coder: Coder, shared: dict[tuple[int, int], bytes]) -> list[np.ndarray]:
    raw, at = texts.data.tobytes(), texts.offsets.tolist()
    own = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    if not coder.by_chunk:
        return coder.encode(own)
    valid = True
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:  # some text holds bytes that are no characters: those texts whole
        valid = False
    cuts, starts = cut_places(texts), piece_starts(texts)
    new: dict[bytes, int] = {}
    wanted: list[list] = []
    for text, places in zip(own, cuts, strict=True):
        p, chain = places.tolist(), []
        for a, b in zip(p[:-1], p[1:], strict=True):
            piece = text[a:b]
            ids = shared.get(digest(piece)) if shared else None
            chain.append(new.setdefault(piece, len(new)) if ids is None else np.frombuffer(ids, coder.type))
        wanted.append(chain)
    encoded = coder.encode(list(new))
    empty = np.empty(0, coder.type)
    bounds = np.searchsorted(starts, texts.offsets)
    held: dict[bytes, np.ndarray] = {}
    # the windows of the first try, all at once
    frames = []
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if len(cuts[i]) > 2:
            inner = starts[bounds[i] : bounds[i + 1]] - a
            s = np.concatenate([[0], inner[inner > 0], [b - a]])
            k = np.searchsorted(s, cuts[i][1:-1])
            k = k[s[k] != cuts[i][1:-1]]
            for x, y in _groups(k, 1, len(s) - 1):
                held[own[i][int(s[max(x - 1, 0)]) : int(s[min(y + 1, len(s) - 1)])]] = empty
            frames.append(s)
        else:
            frames.append(None)
    held.update(zip(held, coder.encode(list(held)), strict=True))

    def ask(window: bytes) -> np.ndarray:
        known = held.get(window)
        return coder.encode([window])[0] if known is None else known

    out = []
    for text, chain, places, s in zip(own, wanted, cuts, frames, strict=True):
        if not valid:
            try:
                text.decode("utf-8")
            except UnicodeDecodeError:
                out.append(coder.encode([text])[0])
                continue
        parts = [encoded[x] if isinstance(x, int) else x for x in chain]
        if s is None:
            out.append(parts[0] if parts else empty)
        else:
            out.append(repaired(text, np.concatenate(parts), places, s, coder, ask))
    return out


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """ENCODED: the ids of each of ``docs(doc_id, text)``, a row for a row, as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    hold_splits(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if not Coder.of(tokenizer).by_chunk:
        return rows.mapInArrow(_whole(None, tokenizer), ENCODED)
    texts = rows.select("text")
    cuts = stored(texts.mapInArrow(_cuts, CUT), "chunk-cuts")
    first = F.min(F.struct("part", "row", "start", "stop"))
    shared = cuts.groupBy("h1", "h2").agg(F.count("*").alias("n"), first.alias("o")).where("n > 1").select("o.*", "h1", "h2")
    owners = by_part(shared, "chunk-owners")
    ids = stored(texts.mapInArrow(_owned(owners, tokenizer), "h1 long, h2 long, ids binary"), "chunk-ids")
    sent = by_part(cuts.select("part", "h1", "h2").distinct().join(ids, ["h1", "h2"]), "chunk-ids-sent")
    drop(cuts, ids)
    delete(spark, owners)
    return rows.mapInArrow(_whole(sent, tokenizer), ENCODED)


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with ``text``: what the ids stand for, special tokens as their text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(tokenizer)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [coder.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(decode, ENCODED + ", text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text encoded and decoded again."""
    both = decode_ids(encode_texts(docs, tokenizer), tokenizer)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))

"""Token ids in length-delimited binary records with masked checksums, and a separate offset index.

Layout of a shard (all integers little-endian):

    record := length uint64 | masked crc of the 8 length bytes uint32 | payload | masked crc of the payload uint32
    payload := doc_id int64 | flags uint8 (1: doc_id is null, 2: ids are uint32, else uint16) | ids

A checksum is CRC-32, masked as ((crc >> 15) | (crc << 17)) + 0xa282ead8 modulo 2**32, so that checksums of data that holds
checksums stay apart. Shards hold documents in ascending doc_id order (nulls first), and shards are numbered in that order.
The index is a Parquet table: shard, path, row, doc_id, offset, length, n_tokens, start; with it any record can be read alone.

Writing: rows are range-partitioned by doc_id; each task encodes its rows and writes one file under a name of its own, so a
repeated attempt can't touch the file of another, and only files that the index names count. Encoding runs through a cache
of white-space separated pieces where the vocabulary's rules don't join text across white space (see ``Encoder``).
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored
from .files import open_fs
from .textnum import chunks
from .word_bpe import WordBpe

END_ID = 2
#: Text that goes into one shard, about.
SHARD_BYTES = 24 << 20
#: Pieces of text whose ids a worker remembers, and the longest remembered (about 100 MB in all).
CACHE_PIECES, CACHE_BYTES = 600_000, 48
READ_BYTES = 4 << 20
INDEX = "shard int, path string, row long, doc_id long, offset long, length long, n_tokens long"
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<qB")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = _META.pack(0 if doc_id is None else doc_id, (doc_id is None) | wide << 1) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(zlib.crc32(length))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def parse(record: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids (uint32) of a whole framed record; raises ValueError where a checksum or a length is wrong."""
    length, crc = _HEAD.unpack_from(record)
    if masked(zlib.crc32(record[:8])) != crc or len(record) != length + 16:
        raise ValueError("damaged record length")
    payload = record[12 : 12 + length]
    if masked(zlib.crc32(payload)) != struct.unpack_from("<I", record, 12 + length)[0]:
        raise ValueError("damaged record payload")
    doc_id, flags = _META.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_META.size).astype("<u4")


class Encoder:
    """Ids of texts by a tokenizer file, through a cache of pieces. One for each worker and file.

    A piece is what stands between white space. New pieces of ASCII and Latin-1 letters, digits and marks are cut into units
    as the general rules do (a run of letters, a digit, a run of marks), and the units are merged in numpy, many at once; all
    other pieces go through the library. Both are checked against the library when an encoder is made, and pieces against
    whole texts on the first texts it gets: where they differ, the library encodes the pieces, or the texts, itself.
    """

    _made: dict[str, Encoder] = {}
    PROBE = ["the", "Straße", "ÉTÉ,", "don", "zwölf,", "a1b22", "word.%%%", "x=[1,2]", "#!?", "A", "9", "it,s", "<a|b>", "ÿÿÿ***ÿ", "internationalization", "q" * 40]
    SIMPLE = re.compile("[!-&(-~ß-öø-ÿ]+")
    UNIT = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    #: Texts of the first chunk that are encoded whole, too.
    WHOLE = 32

    def __init__(self, path: str):
        # a task has one core; threads of the library would only add memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 0x10000 else "<u4"
        self.cache: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.by_piece: bool | None = None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bpe = WordBpe(path, self._alphabet(level))
        if self.bpe.usable:
            probe = [p.encode() for p in self.PROBE]
            self.bpe.usable = self.type == "<u2" and self._pieces(probe) == self._whole(probe)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @staticmethod
    def _alphabet(level) -> dict[int, str]:
        """The character that stands for each byte, as far as characters of two bytes and ASCII show it."""
        out = {}
        for c in map(chr, [*range(0x80), *range(0x80, 0x800)]):
            raw, shown = c.encode(), level.pre_tokenize_str(c)[0][0]
            if len(raw) == len(shown):
                out.update(zip(raw, shown, strict=True))
        known = set(out.values())
        # bytes that are in no such character, in the order of the rest of the alphabet
        rest = sorted(set(level.alphabet()) - known)
        out.update(zip((b for b in range(256) if b not in out), rest, strict=False))
        return out

    def _ids(self, ids) -> bytes:
        return np.array(ids, self.type).tobytes()

    def _whole(self, pieces: list[bytes]) -> list[bytes]:
        out, step = [], 2000
        for i in range(0, len(pieces), step):
            out += [self._ids(e.ids) for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces[i : i + step]], add_special_tokens=False)]
        return out

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        if not self.bpe.usable:
            return self._whole(pieces)
        # no piece holds a line end
        low = b"\n".join(pieces).decode("utf-8", "replace").lower().split("\n") if pieces else []
        match, findall = self.SIMPLE.fullmatch, self.UNIT.findall
        cut = [[] if not s else None if not match(s) or "<|" in s or len(s) > CACHE_BYTES else s if s.isalpha() else findall(s) for s in low]
        wanted = {u for u in cut if type(u) is str}
        wanted.update(*[u for u in cut if type(u) is list])
        new = list(wanted - self.units.keys())
        if len(self.units) + len(new) > CACHE_PIECES // 2:
            self.units, new = {}, list(wanted)
        known = self.units
        known.update(zip(new, self.bpe.encode([u.encode() for u in new]), strict=True))
        out = [None if u is None else known[u] if type(u) is str else b"".join([known[x] for x in u]) for u in cut]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._whole([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian integers of ``self.type``."""
        # millions of small lists and bytes without cycles: the collector would walk through them again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            if self.by_piece is None:
                some = [t[:20_000].decode("utf-8", "ignore").encode() for t in texts[: self.WHOLE]]
                self.by_piece = self._by_piece(some) == self._whole(some)
            return self._by_piece(texts) if self.by_piece else self._whole(texts)
        finally:
            if collects:
                gc.enable()

    def _by_piece(self, texts: list[bytes]) -> list[bytes]:
        column = pa.array(texts, pa.large_binary())
        # the same bytes as strings, whether or not they are valid UTF-8
        column = pa.Array.from_buffers(pa.large_utf8(), len(column), column.buffers())
        split = pc.ascii_split_whitespace(column)
        pieces = split.values.dictionary_encode()
        distinct = pa.Array.from_buffers(pa.large_binary(), len(pieces.dictionary), pieces.dictionary.buffers()).to_pylist()
        known = self.cache
        new = [p for p in distinct if p not in known]
        if len(known) + len(new) > CACHE_PIECES:
            self.cache, new = {}, distinct
            known = self.cache
        known.update(zip(new, self._pieces(new), strict=True))
        ids = pa.array([known[p] for p in distinct], pa.large_binary()).take(pieces.indices)
        for p in new:
            if len(p) > CACHE_BYTES:
                del known[p]
        at = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()] if len(ids) else np.zeros(len(texts) + 1, np.int64)
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shards in a folder; the stored index, with ``start`` (ids of all documents before)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if shards is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-total // SHARD_BYTES))
    # equal ids could meet in one range only together; the salt lets a hot id go over several, in order
    ranged = rows.withColumn("salt", F.rand(7)).repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "salt").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "salt").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, top = open_fs(folder)
        path = f"{top}/shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        encoder, sink, at, row = Encoder.of(tokenizer), None, 0, 0
        wide, end = encoder.type == "<u4", np.array([end_id], encoder.type).tobytes()
        for part, _ in chunks(batches):
            if sink is None:
                fs.create_dir(top, recursive=True)
                sink = fs.open_output_stream(path)
            doc_ids = part.column(0).to_pylist()
            made = encoder.encode(part.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist())
            out = {"offset": [], "length": [], "n_tokens": []}
            for doc_id, ids in zip(doc_ids, made, strict=True):
                record = frame(doc_id, ids + end, wide)
                sink.write(record)
                out["offset"].append(at)
                out["length"].append(len(record))
                out["n_tokens"].append(len(ids) // (4 if wide else 2) + 1)
                at += len(record)
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([path] * n, pa.string()), pa.array(range(row, row + n), pa.int64()), part.column(0), *(pa.array(v, pa.int64()) for v in out.values())], [x.split()[0] for x in INDEX.split(", ")])
            row += n
        if sink is not None:
            sink.close()

    index = stored(ranged.mapInArrow(write, INDEX), "token-index-parts")
    # starts: whole shards first (a row for each), then within a shard
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    totals = totals.withColumn("before", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    out = index.withColumn("inside", inside).join(totals.select("shard", "before"), "shard")
    return stored(out.select(*[x.split()[0] for x in INDEX.split(", ")], (F.col("inside") + F.col("before")).cast("long").alias("start")), "token-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, offset of every record that the index names, read back from the files.

    Rows of the index may come in any order or number: each is read at its offset. Runs of neighbours are read at once.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = open_fs(folder)
        for batch in batches:
            batch = batch.sort_values(["path", "offset"], kind="stable")
            for path, own in batch.groupby("path", sort=False):
                out = []
                with fs.open_input_file(path) as file:
                    held, held_at = b"", 0
                    for offset, length, start, shard in zip(own["offset"], own["length"], own["start"], own["shard"], strict=True):
                        if not held_at <= offset or offset + length > held_at + len(held):
                            held, held_at = file.read_at(max(length, READ_BYTES), offset), offset
                        doc_id, ids = parse(held[offset - held_at : offset - held_at + length])
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), shard, offset))
                frame_ = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
                frame_["doc_id"] = frame_["doc_id"].astype("Int64")
                yield frame_

    return index.select("path", "offset", "length", "start", "shard").mapInPandas(read, schema)


def token_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode, write and read back ``docs(doc_id, text)``: doc_id, start, n_tokens (with the end id), ids_crc32, shard, offset.

    A null or empty text is the end id alone. Null ids come first; repeated ids are records of their own. An empty table
    makes no file and gives no rows.
    """
    folder = folder or fresh_path(docs.sparkSession, "token-shards")
    return read_records(write_shards(docs, tokenizer, folder, end_id), folder)

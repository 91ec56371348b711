"""Token-id files of directly addressable codes.

An id is split into chunks of 8 bits, least first.  Level 0 holds the first chunk of
every id, level 1 the second chunk of those ids that have one, and so on; a bitmap
beside each level says which chunks go on, and a rank directory holds the number of
set bits before every block of 512, so the place of an id's next chunk is one
directory entry plus the bits of one block.  Any id, or any run of ids, is read
without decoding what stands before it.

One segment is such a structure with the index of its documents; layout, little-endian:

    "DAC2"  u32 n_ids  u32 n_docs  u32 n_levels  u64 first_in_shard
    per level: u32 n, u32 place of the level in the segment
    n_docs x i64 doc_id      ceil(n_docs / 8) bytes: which doc_ids are not null
    (n_docs + 1) x u32 offset of its first id
    per level: n x u8 chunks, ceil(n / 8) bitmap bytes (bit i of byte i // 8),
               ceil(n / 512) + 1 x u32 rank directory

A shard's segments follow one another in one plain, uncompressed file, so a reader that
knows a segment's place seeks to the few bytes of a token: the segment's head, and per
level one chunk, one bitmap byte, one directory entry and at most one block of bits.
`token` does that; `Segment` reads a whole segment at once.

Shards are ranges of doc_id, in order.  Tasks write files under names of their own and
give their segments' places as rows, which Spark writes as the index (Parquet) when all
tasks have ended: a file of a lost or repeated attempt is in no index.  Files are opened
through pyarrow's file systems, so any store they reach serves.

Defined results: null and empty texts are their end id alone; a null doc_id stands first
and stays null; every long value is a usable doc_id; rows with equal ids follow one
another in the order of their texts' hashes, dealt over tasks by it; very long texts lie
in one segment, however large; repeated rows are kept; an empty table gives an index
without rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .tokens import coder
from .util import bounded_batches

MAGIC = b"DAC2"
HEAD = struct.Struct("<4sIIIQ")
BLOCK = 512
SEGMENT_IDS = 1 << 19
INDEX = "shard int, segment int, first_in_shard long, n_ids long, file string, place long, size long"
DOCUMENTS = "doc_id long, start long, ids binary"


def encode_levels(ids: np.ndarray) -> list[tuple[int, bytes]]:
    """(places, bytes) of each level of `ids` (unsigned 32-bit)."""
    out, v = [], ids.astype(np.uint32)
    while True:
        more = v > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), np.arange(0, len(bits), BLOCK // 8)) if len(bits) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        out.append((len(v), (v & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes()))
        v = v[more] >> 8
        if not len(v):
            return out


def encode_segment(doc_ids: list, lengths: list[int], ids: bytes, first_in_shard: int) -> bytes:
    a = np.frombuffer(ids, "<u4")
    levels = encode_levels(a)
    known = np.array([d is not None for d in doc_ids], dtype=bool)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + np.packbits(known, bitorder="little").tobytes()
    offsets = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))]).astype("<u4").tobytes()
    at = HEAD.size + 8 * len(levels) + len(names) + len(offsets)
    heads = b""
    for n, body in levels:
        heads += struct.pack("<II", n, at)
        at += len(body)
    return HEAD.pack(MAGIC, len(a), len(doc_ids), len(levels), first_in_shard) + heads + names + offsets + b"".join(body for _, body in levels)


def token(read, i: int) -> int:
    """Id i of a segment of which `read(place, n)` gives n bytes; a few bytes a level are read, whatever the segment's size."""
    magic, n_ids, _, n_levels, _ = HEAD.unpack(read(0, HEAD.size))
    if magic != MAGIC:
        raise ValueError("not a segment of directly addressable codes")
    if not 0 <= i < n_ids:
        raise IndexError(i)
    heads = struct.unpack(f"<{2 * n_levels}I", read(HEAD.size, 8 * n_levels))
    value = 0
    for level in range(n_levels):
        n, at = heads[2 * level : 2 * level + 2]
        value |= read(at + i, 1)[0] << (8 * level)
        bits, block = at + n, i // BLOCK
        own = read(bits + block * (BLOCK // 8), min(BLOCK // 8, -(-n // 8) - block * (BLOCK // 8)))  # the block's bits
        k = i % BLOCK
        if not own[k // 8] >> (k % 8) & 1:
            break
        (before,) = struct.unpack("<I", read(bits + -(-n // 8) + 4 * block, 4))
        i = before + (int.from_bytes(own, "little") & ((1 << k) - 1)).bit_count()
    return value


class Segment:
    """Random access to one segment's bytes."""

    def __init__(self, payload: bytes):
        magic, self.n_ids, n_docs, n_levels, self.first_in_shard = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        heads = struct.unpack_from(f"<{2 * n_levels}I", payload, HEAD.size)
        at = HEAD.size + 8 * n_levels
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        n_known = -(-n_docs // 8)
        self.known = np.unpackbits(np.frombuffer(payload, np.uint8, n_known, at + 8 * n_docs), bitorder="little")[:n_docs].astype(bool)
        self.offsets = np.frombuffer(payload, "<u4", n_docs + 1, at + 8 * n_docs + n_known)
        self.levels = []
        for n, at in zip(heads[::2], heads[1::2], strict=True):
            n_bits, n_ranks = -(-n // 8), -(-n // BLOCK) + 1
            self.levels.append((np.frombuffer(payload, np.uint8, n, at), np.frombuffer(payload, np.uint8, n_bits, at + n), np.frombuffer(payload, "<u4", n_ranks, at + n + n_bits)))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i of a level: one directory entry and at most one block."""
        _, bits, ranks = self.levels[level]
        block = i // BLOCK
        byte = i // 8
        got = int(ranks[block]) + int(np.bitwise_count(bits[block * (BLOCK // 8) : byte]).sum(dtype=np.int64))
        return got + (int(bits[byte]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else got

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi, read from their own chunks only."""
        out = np.zeros(hi - lo, dtype=np.uint32)
        place = np.arange(hi - lo)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if hi <= lo:
                break
            out[place] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            place = place[more]
            lo, hi = self._rank(level, lo), self._rank(level, hi) if hi < len(chunks) else int(self.levels[level][2][-1])
        return out


def _store(uri: str):
    """(file system, path in it) of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_dac(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Encode every whole text of `docs` (doc_id, text) into files below `path`, a folder that all executors share, in ascending doc_id order.

    Null text is empty; every document ends with `end_id`; a null doc_id stands first;
    rows with equal ids follow one another, ordered by their texts' hashes.  A document lies in one
    segment.  The shuffle by ranges of doc_id and hash is the only one.
    """
    kind = _parse_datatype_string(INDEX)
    arrow = to_arrow_schema(kind)
    end = end_id.to_bytes(4, "little")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, shard = coder(tokenizer_path).encode, TaskContext.get().partitionId()
        names, lengths, held, first, n, place, rows = [], [], [], 0, 0, 0, []
        store, folder = _store(path)
        file, sink = f"shard-{shard:06d}-{uuid.uuid4().hex}.dac", None

        def out() -> None:
            nonlocal sink, place
            if sink is None:
                store.create_dir(folder + "/data", recursive=True)
                sink = store.open_output_stream(f"{folder}/data/{file}", compression=None)
            payload = encode_segment(names, lengths, b"".join(held), first)
            sink.write(payload)
            rows.append((shard, len(rows), first, n, file, place, len(payload)))
            place += len(payload)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = code(text) + end
                names.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                n += lengths[-1]
                if n >= SEGMENT_IDS:
                    out()
                    first, n = first + n, 0
                    names, lengths, held = [], [], []
        if names:
            out()
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    # rows equal in id and text are interchangeable: their place in the input deals them over ranges as well
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    dealt = keyed.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").select("doc_id", "text")
    dealt.mapInArrow(run, kind).write.parquet(path + "/index")


def read_dac(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) of every document.

    Only one number per shard goes to the driver; shards are as many as the tasks that wrote.
    """
    kind = _parse_datatype_string(DOCUMENTS)
    arrow = to_arrow_schema(kind)
    index = spark.read.schema(INDEX).parquet(path + "/index")
    starts, total = {}, 0
    for r in sorted(index.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        starts[r["shard"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        for batch in batches:
            for shard, file, place, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{folder}/data/{file}") as source:
                    s = Segment(source.read_at(size, place))
                base = starts[shard] + s.first_in_shard
                at = s.offsets.astype(np.int64)
                ids = [s.ids(int(a), int(b)).astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, type=pa.int64(), mask=~s.known), pa.array(base + at[:-1]), pa.array(ids, type=pa.binary())], schema=arrow)

    # the index is small; its segments are dealt over the tasks
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return index.select("shard", "file", "place", "size").repartition(slots, "shard", "place").mapInArrow(run, kind)


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a position over all documents, read from the few bytes that hold it; the shards' sizes come from the index."""
    index = spark.read.schema(INDEX).parquet(path + "/index")
    left = position
    for r in sorted(index.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        if left < r["n"]:
            found = index.where((F.col("shard") == r["shard"]) & (F.col("first_in_shard") <= left) & (F.col("first_in_shard") + F.col("n_ids") > left)).first()
            store, folder = _store(path)
            with store.open_input_file(f"{folder}/data/{found['file']}") as source:
                return token(lambda at, n: source.read_at(n, found["place"] + at), left - found["first_in_shard"])
        left -= r["n"]
    raise IndexError(position)


def dac_digest(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids."""
    return documents.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

r"""Repeated passages: a count-min prefilter, then exact grouping of the windows it lets through.

A window is `window` consecutive words of one document.  First pass: every task counts the
windows of its blocks in sketches of `ROWS` rows of cells, sends them as sorted cell lists a
range of cells, and each range is merged in one task into a bit a cell: counted twice or
more.  Merged counts are never too low, so a window that occurs twice has its bit in every row.
Second pass: windows with all bits go on, others are dropped for good.  Inside a block the
smallest doc_id of each window decides at once; only its windows are shuffled, in compressed columns by parts of the
keys, to meet the other blocks' ones.  So a window that a third of all documents hold is sent once
a block, not once a document.  What is to be removed returns to its document as positions.

Windows are known by 96 bits: sums of 13 word hashes times odd powers, in two
independent 64-bit arithmetics, of which 64 and 32 bits are kept; words of more than 32 bytes enter by
XXH3.  Two different windows out of 10**12 share them with a chance of about 10**-5.

Sketch size: four cells a window and row, `MOST_CELLS` a row at most, so the bits that are
broadcast stay below ROWS * MOST_CELLS / 8 = 128 MB.  A table beyond some 130 million
windows fills the cells more, and more unrepeated windows go through to the exact pass; results
do not change.

Defined results: words are `[^\x20\x09-\x0D]+`, unchanged; null text has none; documents below `window`
words lose nothing; a null doc_id comes after all others, and among null ids nothing is removed;
rows that share a doc_id do not remove from one another, so repeated rows stay alike and a window
repeated inside one document stays; very long texts are read whole; an empty table gives no
rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import bounded_batches, hot_keys, map_rows, spread_join

WINDOW = 13
ROWS = 2
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 29  # cells of a sketch row
RANGE = 1 << 22  # cells of a row that one task merges
BLOCK = 1 << 22  # windows whose cells are held at a time
LONG_WORD = 32  # bytes; longer words are hashed one by one
STRETCH = 1 << 20  # bytes hashed at a time
OUT = 64  # blobs of a batch that a task sends on
LEAST_PARTS, PART_WORDS = 64, 1 << 21  # parts of the keys: one a so many words
BYTES_A_WORD = 6
SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Arithmetic(NamedTuple):
    """One of the independent hashes: a value a byte, powers for bytes, the factor for words, the seed of long words."""

    values: np.ndarray
    powers: np.ndarray
    factor: np.uint64
    seed: int


def _arithmetic(seed: int) -> Arithmetic:
    drawn = np.random.default_rng(seed).integers(0, 1 << 63, 258, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    powers = np.full(LONG_WORD, drawn[256], dtype=np.uint64)
    powers[0] = 1
    return Arithmetic(drawn[:256], np.multiply.accumulate(powers), drawn[257], seed)


HASHES = (_arithmetic(1), _arithmetic(2))


class Words(NamedTuple):
    """Words of a batch of texts: hashes (one array an arithmetic), and of each text the first word's place and one past the last."""

    hashes: list[np.ndarray]
    first: np.ndarray
    last: np.ndarray


def batch_words(texts: pa.Array) -> Words:
    """Hashes of all words of a string column, straight from its UTF-8 bytes."""
    import xxhash

    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = (np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    solid = ~SPACES[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    fresh = edge[:-1].copy()
    fresh[1:] |= ~solid[:-1]
    starts = np.nonzero(solid & fresh)[0]
    done = edge[1:].copy()
    done[:-1] |= ~solid[1:]
    ends = np.nonzero(solid & done)[0] + 1
    hashes = [np.empty(len(starts), dtype=np.uint64) for _ in HASHES]
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH, "right")))
        lengths = np.minimum(ends[at:upto] - starts[at:upto], LONG_WORD)
        heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        inside = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        letters = data[np.repeat(starts[at:upto], lengths) + inside]
        for a, h in zip(HASHES, hashes, strict=True):
            h[at:upto] = _mixed(np.add.reduceat(a.values[letters] * a.powers[inside], heads) + lengths.astype(np.uint64))
        at = upto
    for k in np.nonzero(ends - starts > LONG_WORD)[0].tolist():
        word = data[starts[k] : ends[k]].tobytes()
        for a, h in zip(HASHES, hashes, strict=True):
            h[k] = xxhash.xxh3_64_intdigest(word, seed=a.seed)
    return Words(hashes, np.searchsorted(starts, bounds[:-1]), np.searchsorted(starts, bounds[1:]))


def window_keys(words: Words, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of every window of the batch: a key an arithmetic, the text it is in, its first word's place in that text."""
    counts = np.maximum(0, words.last - words.first - size + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    start = words.first[text] + place
    keys = []
    for a, h in zip(HASHES, words.hashes, strict=True):
        n = max(0, len(h) - size + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            rolled = rolled * a.factor + h[k : n + k]
        keys.append(_mixed(rolled[start]))
    return keys, text, place


def cell(keys: list[np.ndarray], row: int, cells: int) -> np.ndarray:
    """The cell of every window in a row of the sketch; cells: a power of two."""
    return (_mixed(keys[0] + np.uint64(row + 1) * keys[1]) & np.uint64(cells - 1)).astype(np.int64)


def coded(cells: np.ndarray) -> bytes:
    """Sorted cells as compressed differences of 16 bits; 65535 stands for a step without a cell."""
    gaps = np.diff(cells, prepend=0)
    steps = gaps // 65535
    out = np.full(len(cells) + int(steps.sum()), 65535, dtype="<u2")
    out[np.cumsum(steps + 1) - 1] = gaps % 65535
    return zstandard.ZstdCompressor(level=1).compress(out.view(np.uint8).reshape(-1, 2).T.tobytes())  # low bytes, then high ones


def decoded(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def count_words(docs: DataFrame) -> int:
    """About as many words as all texts have, by their bytes."""
    return (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_WORD


def sketch_cells(words: int) -> int:
    """Cells of a sketch row: four a window, a power of two."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * words).bit_length()))


def repeated_cells(docs: DataFrame, window: int, cells: int) -> list[np.ndarray]:
    """A bit a cell, packed, for every row of the merged sketch: counted twice or more."""
    bounded_batches(docs.sparkSession)
    span = min(RANGE, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def sketch() -> pa.RecordBatch:
            out: dict = {"row": [], "part": [], "blob": []}
            for row in range(ROWS):
                found = np.sort(np.concatenate([h[row] for h in held]))
                third = np.zeros(len(found), dtype=bool)
                third[2:] = found[2:] == found[:-2]
                found = found[~third]  # a count beyond two says no more than two
                edges = np.searchsorted(found, np.arange(0, cells + span, span))
                for part in np.nonzero(np.diff(edges))[0].tolist():
                    out["row"].append(row)
                    out["part"].append(part)
                    out["blob"].append(coded(found[edges[part] : edges[part + 1]] - part * span))
            held.clear()
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("row", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())]))

        n = 0
        for batch in batches:
            keys, _, _ = window_keys(batch_words(batch.column(0)), window)
            if len(keys[0]):
                held.append([cell(keys, row, cells) for row in range(ROWS)])
                n += len(keys[0])
            if n >= BLOCK:
                yield sketch()
                n = 0
        if held:
            yield sketch()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(span, dtype=np.uint8)
        for blob in pdf["blob"]:
            found = decoded(blob)
            again = np.zeros(len(found), dtype=bool)
            again[1:] = found[1:] == found[:-1]
            seen[found[~again]] = np.minimum(seen[found[~again]] + 1, 2)
            seen[found[again]] = 2
        return pd.DataFrame({"row": [int(pdf["row"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "bits": [np.packbits(seen > 1, bitorder="little").tobytes()]})

    sketches = docs.select("text").mapInArrow(count, "row int, part int, blob binary")
    bits = [np.zeros(cells // 8, dtype=np.uint8) for _ in range(ROWS)]
    # bits of a bounded number of cells, whatever the table's size
    for r in sketches.groupBy("row", "part").applyInPandas(merge, "row int, part int, bits binary").toLocalIterator():
        bits[r["row"]][r["part"] * span // 8 : (r["part"] + 1) * span // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def written(**columns) -> bytes:
    """Equally long columns as compressed bytes."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_back(blob: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(blob).read_all()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _named(names: np.ndarray, at: np.ndarray, **columns) -> tuple[bytes, bytes]:
    """Columns of rows that belong to texts, and those texts once each; ids and keys as differences, which are small."""
    used, spot = np.unique(at, return_inverse=True)
    docs = written(none=names[used, 0].astype(np.int8), step=np.diff(names[used, 1], prepend=0), t=names[used, 2])
    return written(spot=spot.astype(np.uint32), **columns), docs


def _unnamed(body: bytes, docs: bytes) -> dict[str, np.ndarray]:
    """The columns of `_named` with none, doc and t of each row."""
    found, texts = read_back(body), read_back(docs)
    spot = found.pop("spot")
    return found | {"none": texts["none"][spot], "doc": np.cumsum(texts["step"])[spot], "t": texts["t"][spot]}


def _joined(frames: list[dict[str, np.ndarray]], *columns: str) -> list[np.ndarray]:
    return [np.concatenate([f[c] for f in frames]) for c in columns]


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    new = np.ones(len(sorted_columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def _holders(key: np.ndarray, tag: np.ndarray, none: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a row has the smallest id of its window; rows are sorted by all four."""
    head = np.maximum.accumulate(np.where(_heads(key, tag), np.arange(len(key)), 0))
    return (doc == doc[head]) & (none == none[head])


def _block(keys: list[np.ndarray], rows: np.ndarray, at: np.ndarray, place: np.ndarray, parts: int) -> Iterator[tuple]:
    """(part, known, body, docs) of a block's candidate windows.

    rows: none, doc_id, t of the block's texts; at: the text of each window.  Known windows go already, as a smaller id of the
    block has them; of the others the smallest id's are sent, in the part of their key.
    """
    names, same = np.unique(rows, axis=0, return_inverse=True)  # equal rows are one
    at = same.ravel()[at]
    _, once = np.unique(at << 32 | place, return_index=True)
    key, tag, at, place = keys[0][once], (keys[1][once] >> np.uint64(32)).astype(np.uint32), at[once], place[once]
    order = np.lexsort((at, tag, key))  # names are sorted by id
    key, tag, at, place = key[order], tag[order], at[order], place[order]
    holds = _holders(key, tag, names[at, 0], names[at, 1])
    if not holds.all():
        gone = np.nonzero(~holds)[0]
        gone = gone[np.lexsort((place[gone], at[gone]))]
        yield int(names[at[gone[0]], 2]) % parts, True, *_named(names, at[gone], p=place[gone].astype(np.uint32))
    key, tag, at, place = (c[holds] for c in (key, tag, at, place))
    part = (key >> np.uint64(32)).astype(np.int64) * parts >> 32
    edges = np.searchsorted(part, np.arange(parts + 1))
    for k in np.nonzero(np.diff(edges))[0].tolist():
        s = slice(edges[k], edges[k + 1])
        yield k, False, *_named(names, at[s], key=np.diff(key[s], prepend=np.uint64(0)), tag=tag[s], p=place[s].astype(np.uint32))


def removable(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, t, spans: the words to be removed from `rows` (doc_id, t, text), as first places and ones past the last.

    Candidate windows travel as compressed columns, one blob a block and part of the keys; a part
    is decided in one task, and what goes returns by parts of the documents.  Both numbers of parts
    follow the table's size.
    """
    bounded_batches(rows.sparkSession)
    words = count_words(rows)
    cells, parts = sketch_cells(words), max(LEAST_PARTS, words // PART_WORDS)
    # ROWS * MOST_CELLS / 8 bytes at most; few bits are set, so what is sent and kept on disk is less
    sent_bits = rows.sparkSession.sparkContext.broadcast([zstandard.ZstdCompressor(level=1).compress(b.tobytes()) for b in repeated_cells(rows, window, cells)])
    sent = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("body", pa.binary()), ("docs", pa.binary())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> Iterator[pa.RecordBatch]:
            keys = [np.concatenate([h[0][k] for h in held]) for k in range(len(HASHES))]
            first = np.cumsum([0, *[len(h[1]) for h in held[:-1]]])
            at = np.concatenate([h[2] + f for h, f in zip(held, first, strict=True)])
            found = list(_block(keys, np.concatenate([h[1] for h in held]), at, np.concatenate([h[3] for h in held]), parts))
            held.clear()
            for k in range(0, len(found), OUT):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found[k : k + OUT], strict=True), sent, strict=True)], schema=sent)

        bits = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8) for b in sent_bits.value]
        n = 0
        for batch in batches:
            keys, text, place = window_keys(batch_words(batch.column(2)), window)
            near = np.ones(len(text), dtype=bool)
            for row, found in enumerate(bits):
                spot = cell(keys, row, cells)
                near &= (found[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0
            if near.any():
                ids = batch.column(0)
                named = np.stack([ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
                used, at = np.unique(text[near], return_inverse=True)
                held.append(([k[near] for k in keys], named[used], at, place[near]))
                n += len(at)
            if n >= BLOCK // 2:
                yield from block()
                n = 0
        if held:
            yield from block()

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = [(known, _unnamed(body, docs)) for known, body, docs in zip(pdf["known"], pdf["body"], pdf["docs"], strict=True)]
        gone, open_ = [f for known, f in frames if known], [f for known, f in frames if not known]
        if open_:
            key = np.concatenate([np.cumsum(f["key"], dtype=np.uint64) for f in open_])
            tag, none, doc, t, p = _joined(open_, "tag", "none", "doc", "t", "p")
            order = np.lexsort((doc, none, tag, key))
            lost = order[~_holders(key[order], tag[order], none[order], doc[order])]
            gone.append({"none": none[lost], "doc": doc[lost], "t": t[lost], "p": p[lost]})
        none, doc, t, p = _joined(gone, "none", "doc", "t", "p")
        names, at = np.unique(np.stack([none.astype(np.int64), doc, t], axis=1), axis=0, return_inverse=True)
        at = at.ravel()
        home = (names[:, 2].astype(np.uint64) % np.uint64(parts)).astype(np.int64)[at]
        order = np.lexsort((p, at, home))
        edges = np.searchsorted(home[order], np.arange(parts + 1))
        out = [(k, *_named(names, at[order[edges[k] : edges[k + 1]]], p=p[order[edges[k] : edges[k + 1]]])) for k in np.nonzero(np.diff(edges))[0].tolist()]
        return pd.DataFrame(out, columns=["home", "body", "docs"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        none, doc, t, p = _joined([_unnamed(body, docs) for body, docs in zip(pdf["body"], pdf["docs"], strict=True)], "none", "doc", "t", "p")
        order = np.lexsort((p, doc, none, t))
        none, doc, t, p = none[order], doc[order], t[order], p[order]
        new = np.nonzero(_heads(none, doc, t))[0]
        spans = [covered(x.astype(np.int64), window).astype("<i8").tobytes() for x in np.split(p, new[1:])]
        ids = pd.array(doc[new], dtype="Int64")
        ids[none[new] > 0] = pd.NA
        return pd.DataFrame({"doc_id": ids, "t": t[new], "spans": spans})

    found = rows.select("doc_id", "t", "text").mapInArrow(candidates, "part int, known boolean, body binary, docs binary")
    decided = found.groupBy("part").applyInPandas(decide, "home int, body binary, docs binary")
    return decided.groupBy("home").applyInPandas(gather, "doc_id long, t long, spans binary")


def covered(places: np.ndarray, window: int) -> np.ndarray:
    """Rows (first, one past the last) of the stretches that windows at sorted places cover."""
    new = np.ones(len(places), dtype=bool)
    new[1:] = places[1:] > places[:-1] + window
    first = np.nonzero(new)[0]
    return np.stack([places[first], places[np.append(first[1:] - 1, len(places) - 1)] + window], axis=1)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept per row of `docs` (doc_id, text).

    A word goes if a window that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input.  kept: the other words, joined by one space.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("doc_id", "text"))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("t").cast("string")).alias("row")
    marked = removable(rows, window).select(name, "spans")
    sizes = rows.groupBy(name).agg(F.count("*").alias("n"))
    joined = spread_join(rows.select("doc_id", "text", name), marked, "row", hot_keys(sizes, "row", rows.count()), "left", "merge")
    return _cut_out(joined)


def _cut_out(joined: DataFrame) -> DataFrame:
    def start():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                for first, last in np.frombuffer(spans or b"", dtype="<i8").reshape(-1, 2)[::-1].tolist():
                    del words[first:last]
                kept = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode())
            return out

        return step

    return map_rows(joined.select("doc_id", "text", "spans"), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", start)

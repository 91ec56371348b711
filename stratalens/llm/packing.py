"""Packing: vector bin packing by the dot-product heuristic.

A sequence is a bin with three limits at once: tokens, segments and loss-bearing
tokens.  Stretches of `capacity` tokens of long documents are sequences of their own;
what is left of each document waits in a buffer of the task.  A sequence is filled by
taking, again and again, the waiting piece whose demand has the largest dot product
with what is left of the limits, among those that fit.  When none fits whole, the one
with the largest product of which a part fits is cut to what is left, so a sequence ends
short only where the segment limit is reached, or nothing that waits bears no loss, or
the task's input has ended.  A document longer than a sequence is laid out as sequences
that hold as much of its loss-bearing ids as the limit allows, filled with those of its
prompt.

Loss-bearing tokens are those behind a document's prompt: a prompt column, or the first
`prompt_share` of its ids where instruction and answer stand in one text.

Each task packs its own input: nothing is shuffled, the buffer holds a bounded number of pieces with their own ids, and a lost
task repeats the same sequences.  A task leaves one short sequence at its end; with
the usual 128 MB of input to a task that is far below 0.1 % of padding.

Defined results: null text is empty; every document ends with `end_id`, so an empty
one is a single token; very long texts are cut into many sequences; of equal products the
piece that has waited longest is taken; a null id is kept; repeated rows are packed apart;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .tokens import coder
from .util import bounded_batches

SCHEMA = "doc_id long, start long, length long, doc_tokens long, n_loss long, sequence_id long, offset long, ids binary"
#: limits for text that is its own instruction: the first quarter of a document stands for the prompt
INSTRUCTION_LIMITS = {"max_segments": 64, "max_loss": 1792, "prompt_share": 0.25}
BUFFER = 512
FLUSH = 2000


class Packer:
    """Fills sequences from pieces; `add` and `finish` give placed pieces.

    A piece is [doc_id, start, length, prompt, ids, total]: its own ids only, so that what waits does
    not keep whole documents; the document's first `prompt` ids bear no loss.
    """

    def __init__(self, capacity: int, max_segments: int, max_loss: int, first_id: int, buffer: int = BUFFER):
        self.limits = np.array([capacity, max_segments, max_loss], dtype=float)
        self.capacity, self.max_segments, self.max_loss = capacity, max_segments, max_loss
        self.next_id, self.buffer = first_id, buffer
        self.wait: list[list] = []
        self.size = np.zeros(0, dtype=np.int64)
        self.loss = np.zeros(0, dtype=np.int64)

    def _place(self, piece: list, length: int, offset: int) -> tuple:
        doc_id, start, _, prompt, ids, total = piece
        return doc_id, start, length, total, max(0, start + length - max(start, prompt)), self.next_id, offset, ids[: 4 * length]

    def add(self, doc_id, ids: bytes, prompt: int) -> Iterator[tuple]:
        total = len(ids) // 4
        most_loss, spare = min(self.max_loss, self.capacity), max(0, self.capacity - self.max_loss)
        lead, tail = 0, min(prompt, total)  # next ids of the prompt and behind it

        def piece(start: int, length: int) -> list:
            return [doc_id, start, length, prompt, ids[4 * start : 4 * (start + length)], total]

        if total <= self.capacity:
            self.wait.append(piece(0, total))
        else:
            prompt = tail
            while total - tail >= most_loss and prompt - lead >= spare and (self.max_segments > 1 or not spare):
                if spare:
                    yield self._place(piece(lead, spare), spare, 0)
                yield self._place(piece(tail, most_loss), most_loss, spare)
                self.next_id, lead, tail = self.next_id + 1, lead + spare, tail + most_loss
            while prompt - lead >= self.capacity:
                yield self._place(piece(lead, self.capacity), self.capacity, 0)
                self.next_id, lead = self.next_id + 1, lead + self.capacity
            if lead < prompt:
                self.wait.append(piece(lead, prompt - lead))
            for at in range(tail, total, most_loss):
                self.wait.append(piece(at, min(most_loss, total - at)))
        if len(self.wait) >= 2 * self.buffer:
            yield from self._fill(self.buffer)

    def finish(self) -> Iterator[tuple]:
        yield from self._fill(0)

    def _fill(self, keep: int) -> Iterator[tuple]:
        wait = self.wait
        size = np.array([p[2] for p in wait], dtype=np.int64)
        loss = np.array([p[2] - min(p[2], max(0, p[3] - p[1])) for p in wait], dtype=np.int64)
        left = len(wait)
        live = np.ones(left, dtype=bool)
        while left > keep:
            room, segments, loss_room, offset = self.capacity, self.max_segments, self.max_loss, 0
            while room and segments and left:
                # dot product of demand and what is left, each over its limit
                score = size * (room / self.capacity**2) + segments / self.max_segments**2 + loss * (loss_room / self.max_loss**2)
                fits = live & (size <= room) & (loss <= loss_room)
                whole = fits.any()
                # size - loss: a piece's ids before the first that bears loss
                able = fits if whole else live & (size - loss + loss_room > 0)
                if not able.any():
                    break
                at = int(np.argmax(np.where(able, score, -1.0)))
                piece = wait[at]
                n = piece[2] if whole else min(room, piece[2], int(size[at] - loss[at]) + loss_room)
                yield self._place(piece, n, offset)
                used = max(0, n - int(size[at] - loss[at]))
                room, segments, loss_room, offset = room - n, segments - 1, loss_room - used, offset + n
                if n == piece[2]:
                    live[at] = False
                    left -= 1
                else:
                    piece[1] += n
                    piece[2] -= n
                    piece[4] = piece[4][4 * n :]
                    size[at] -= n
                    loss[at] -= used
            self.next_id += 1
        self.wait = [p for p, x in zip(wait, live, strict=True) if x]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, max_segments: int = 128, max_loss: int | None = None, end_id: int = 1, prompt_col: str | None = None, prompt_share: float = 0.0) -> DataFrame:
    """Pieces of `docs` (doc_id, text and, for instruction data, a prompt column); see SCHEMA.

    Ids of the prompt stand before those of the text and bear no loss; without a prompt
    column the first `prompt_share` of a text's ids bear none.  `sequence_id`
    counts within a task above the task's number times 2**32.
    """
    kind = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(kind)
    max_loss = capacity if max_loss is None else max_loss
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("limits must be at least 1")
    end = end_id.to_bytes(4, "little")
    bounded_batches(docs.sparkSession)

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = coder(tokenizer_path).encode
        packer = Packer(capacity, max_segments, max_loss, TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text, prompt in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lead, ids = code(prompt) if prompt else b"", code(text) + end
                rows += packer.add(doc_id, lead + ids, len(lead) // 4 if prompt_col else int(prompt_share * (len(ids) // 4)))
                if len(rows) >= FLUSH:
                    yield frame(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield frame(rows)

    prompt = F.col(prompt_col) if prompt_col else F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", prompt.cast("string").alias("prompt")).mapInArrow(run, kind)


def pack_digest(docs: DataFrame, tokenizer_path: str, **limits) -> DataFrame:
    """Pieces with the checksum of their ids (little-endian unsigned 32-bit) in place of the ids."""
    return pack(docs, tokenizer_path, **limits).withColumn("ids_crc32", F.crc32("ids")).drop("ids")

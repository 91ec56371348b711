r"""Quality rules: base word counts, then zstandard compression bands.

Base counts use words `[^\x20\x09-\x0D]+` of the whole text.  The verdict looks at
the ratio of compressed to raw bytes, of the whole text and of each chunk of
`CHUNK` bytes: text that repeats compresses too well, noise (random characters,
encoded data) hardly at all.  Short texts compress less well than long ones, so the
limits depend on the length.  A last chunk shorter than half a chunk is joined to the
one before, since a few bytes never compress: chunks have 2,048 to 6,143 bytes.  A text is
rejected if its whole ratio is outside the band of its length, or if chunks outside the
band of theirs hold more than `bad_share` of its bytes.

Defined results: null and empty texts have no words and fail the base rules; lines
end at \n only; repeated rows are judged alike; a null doc_id is kept; a very long text is
judged whole and chunk by chunk, whatever its length; a ratio equal to a limit, or a share
equal to `bad_share`, is inside; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import filter_texts, map_rows

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CHUNK = 4096
LEVEL = 3
#: (bytes below which the band holds, least ratio, greatest ratio); bands are narrow where the ratio falls fast.
#: The greatest lies between clean text (documents of sf0.1 and, as unseen text, technical Markdown) and random base64 words.
#: Below 256 bytes the two overlap.  Random lower-case and hexadecimal words compress like short clean text: they are
#: told apart from 4 KB and 8 KB on.
BANDS = (
    (192, 0.42, 1.30), (256, 0.42, 0.95), (320, 0.36, 0.87), (384, 0.36, 0.85), (448, 0.36, 0.83), (512, 0.36, 0.81),
    (640, 0.32, 0.79), (768, 0.32, 0.775), (1024, 0.32, 0.75), (1536, 0.28, 0.725), (2048, 0.28, 0.69), (4096, 0.26, 0.65),
    (8192, 0.22, 0.57), (16384, 0.22, 0.51), (float("inf"), 0.16, 0.48),
)
BAD_SHARE = 0.3
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_low long, n_chunks_high long, reason string"


def repeat_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more in `words`."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    m = len(seen)
    if m == n:
        return 0
    pairs = ids[:-1] * m + ids[1:]
    if m > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(n, dtype=bool)
    for k in range(3):
        marked[k : n - 2 + k] |= twice
    return int(marked.sum())


def band(n_bytes: int) -> tuple[float, float]:
    return next((lo, hi) for most, lo, hi in BANDS if n_bytes < most)


def chunks(raw: bytes):
    """Stretches of CHUNK bytes, none if all is one; a tail below half of it belongs to the stretch before."""
    n = (len(raw) + CHUNK // 2) // CHUNK
    for k in range(n if n > 1 else 0):
        yield raw[k * CHUNK : (k + 1) * CHUNK if k < n - 1 else len(raw)]


def compression(raw: bytes, compress, bad_share: float = BAD_SHARE) -> tuple[float, int, int, int, str]:
    """Whole ratio, chunks, chunks that repeat, chunks that are noise, reason or ''."""
    if not raw:
        return 0.0, 0, 0, 0, ""
    ratio = len(compress(raw)) / len(raw)
    lo, hi = band(len(raw))
    reason = "repetitive" if ratio < lo else "incompressible" if ratio > hi else ""
    n = low = high = low_bytes = high_bytes = 0
    for part in chunks(raw):
        a, b = band(len(part))
        r = len(compress(part)) / len(part)
        n, low, high = n + 1, low + (r < a), high + (r > b)
        low_bytes, high_bytes = low_bytes + (r < a) * len(part), high_bytes + (r > b) * len(part)
    if not reason and low_bytes + high_bytes > bad_share * len(raw):
        reason = "repetitive chunks" if low_bytes >= high_bytes else "incompressible chunks"
    return ratio, n, low, high, reason


class Judge:
    """The whole verdict on one text: the columns of SCHEMA after doc_id."""

    def __init__(self, min_words: int, max_repeat_percent: int, bad_share: float):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.symbols = re.compile("[" + re.escape(SYMBOLS) + "]")
        self.min_words, self.max_repeat_percent, self.bad_share = min_words, max_repeat_percent, bad_share

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        raw = text.encode()
        words = raw.split()  # splits at exactly the six ASCII white space bytes
        n = len(words)
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        again = repeat_words(words)
        failed = n < self.min_words or 100 * again > self.max_repeat_percent * n
        ratio, chunks, low, high, reason = compression(raw, self.compress, self.bad_share)
        return (n, len(text) - sum(map(text.count, SPACES)), len(self.symbols.findall(text)), len(lines) - len(set(lines)), again, failed, not failed and not reason, ratio, chunks, low, high, "base" if failed else reason)


def quality(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, bad_share: float = BAD_SHARE) -> DataFrame:
    """One row per row of `docs` (doc_id, text); see SCHEMA."""

    def start():
        judge = Judge(min_words, max_repeat_percent, bad_share)

        def step(batch: pa.RecordBatch) -> dict:
            columns = zip(*map(judge, batch.column(1).to_pylist()), strict=True)
            return {"doc_id": batch.column(0)} | dict(zip(names[1:], columns, strict=True))

        return step

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SCHEMA, start)


def kept(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, bad_share: float = BAD_SHARE) -> DataFrame:
    """Rows of `docs`, all columns, that `quality` keeps."""

    def start():
        judge = Judge(min_words, max_repeat_percent, bad_share)
        return lambda texts: [judge(t)[6] for t in texts]

    return filter_texts(docs, start)

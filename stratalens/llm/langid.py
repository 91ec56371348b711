r"""Language identification: a linear-chain conditional random field over words.

Every word (a run of letters) has features: hashed prefixes, suffixes and character
n-grams, its own hash, and membership in the learned list of frequent words of each
language.  Emission weights and transitions are fitted together by stochastic gradient
on the chain likelihood.  Training chains are spliced from windows of documents in
different languages, so transitions are learned where languages really change; that is
what lets the field label code-switched text word by word.

Marginals of whole texts come from forward-backward.  A chain is cut into blocks whose
transfer matrices are multiplied first, so a very long text takes no more numpy steps
than a short one and its marginals are still those of the whole chain.

Bounds, all parameters: `per_lang` documents a language (by hash of doc_id) of at most
`max_chars` characters are learned from, as wholes; every language that has one can be
predicted.  What reaches the driver is bounded in rows and characters: beyond some 100 languages each gets an
equal share, and with very many only shorter documents are learned from.
Prediction reads whole texts of all documents.

Defined results: a text that is null or has no letter (str.isalpha; digits, fractions and
ordinals are none) is `und` with score 0; without any usable training row all texts are
`und`; ties go to the first language by name; very long texts are labelled whole, in
blocks; a null doc_id is kept and learned from never; of different texts that share a
doc_id and language one, by hash, can be learned from; repeated rows are predicted alike; an empty table gives
no rows; columns other than doc_id, lang and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .util import cut, map_rows

LETTERS = re.compile(r"[^\W\d_]+")
SIZE = 1 << 15
BLOCK = 256
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, lang_words array<long>"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # the pattern also lets numeric signs through
    return [p for w in found for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def feature_groups(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of lower-cased words, a group at a time: (features one word after another, how many each word has).

    Groups: bias, whole word, lexicon, prefixes of 1-3 and suffixes of 1-4 characters,
    2- and 3-grams with word borders.
    """
    n = len(words)
    one = np.ones(n, dtype=np.int64)
    crc = zlib.crc32
    yield np.zeros(n, dtype=np.int64), one
    yield np.fromiter((1 + crc(w.encode()) % (SIZE - 1) for w in words), dtype=np.int64, count=n), one
    listed = [lexicon.get(w, ()) for w in words]
    yield np.fromiter((SIZE + k for x in listed for k in x), dtype=np.int64), np.fromiter(map(len, listed), dtype=np.int64, count=n)
    chars = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    length = np.fromiter(map(len, words), dtype=np.int64, count=n)
    open_ = np.concatenate([[0], np.cumsum(length + 2)[:-1]])
    close = open_ + length + 1
    for k in (1, 2, 3):
        has = length >= k
        yield _hash([chars[open_[has] + j] for j in range(1, k + 1)], 10 + k), has.astype(np.int64)
    for k in (1, 2, 3, 4):
        has = length >= k
        yield _hash([chars[close[has] - j] for j in range(1, k + 1)], 20 + k), has.astype(np.int64)
    inside = np.ones(len(chars), dtype=bool)
    inside[close] = False
    at = np.nonzero(inside)[0]
    yield _hash([chars[at], chars[at + 1]], 32), length + 1
    inside[close - 1] = False
    at = np.nonzero(inside)[0]
    yield _hash([chars[at], chars[at + 1], chars[at + 2]], 33), length


def _hash(columns: list[np.ndarray], kind: int) -> np.ndarray:
    """1 to SIZE - 1 from characters and the kind of feature."""
    h = np.full(len(columns[0]), kind, dtype=np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return 1 + (h % np.uint64(SIZE - 1)).astype(np.int64)


def emissions(words: list[str], weights: np.ndarray, lexicon: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Sum of the feature weights of each word."""
    out = np.zeros((len(words), weights.shape[1]))
    if words:
        for flat, count in feature_groups(words, lexicon):
            if len(flat):
                has = count > 0
                starts = np.concatenate([[0], np.cumsum(count[has])[:-1]])
                out[has] += np.add.reduceat(weights[flat], starts, axis=0)
    return out


def padded_features(words: list[str], lexicon: dict[str, tuple[int, ...]], fill: int) -> np.ndarray:
    """One row of features a word, filled up with `fill`."""
    groups = list(feature_groups(words, lexicon))
    owner = np.concatenate([np.repeat(np.arange(len(words)), count) for _, count in groups])
    flat = np.concatenate([f for f, _ in groups])
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(words))
    out = np.full((len(words), int(count.max())), fill, dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < count[:, None]] = flat[order]
    return out


def marginals(em: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior of each label at each place; `em` holds the emissions of chains one after another."""
    return forward_backward(em, lengths, trans, start, block)[0]


def forward_backward(em: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, scaled forward messages, scaled backward messages with the place's own potential."""
    n, k = em.shape
    if not n:
        return (np.zeros((0, k)),) * 3
    potential = np.exp(em - em.max(axis=1, keepdims=True))
    step = np.exp(trans - trans.max())
    lengths = lengths[lengths > 0]
    chain_start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n_blocks = -(-lengths // block)
    first = np.repeat(chain_start, n_blocks) + block * (np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
    size = np.minimum(block, np.repeat(chain_start + lengths, n_blocks) - first)
    head = np.concatenate([[0], np.cumsum(n_blocks)[:-1]])  # number of each chain's first block
    entry = np.zeros((len(first), k))  # scaled forward message into the block, transition applied
    leave = np.ones((len(first), k))  # scaled backward message at the block's last place
    entry[head] = np.exp(start - start.max())
    many = np.repeat(n_blocks > 1, n_blocks)
    if many.any():
        rows = np.nonzero(many)[0]
        rows = rows[np.argsort(-size[rows], kind="stable")]
        moved = np.broadcast_to(np.eye(k), (len(rows), k, k)).copy()
        whole = np.empty((len(first), k, k))  # from the message into a block to the message at its last place
        for t in range(int(size[rows[0]])):
            live = int(np.searchsorted(-size[rows], -t, "left"))
            m = moved[:live] * potential[first[rows[:live]] + t][:, None, :]
            m /= m.sum(axis=(1, 2), keepdims=True)
            ends = int(np.searchsorted(-size[rows], -(t + 1), "left"))  # the blocks after these end here
            whole[rows[ends:live]] = m[ends:]
            moved[:ends] = m[:ends] @ step
        for b, c in zip(head[n_blocks > 1], n_blocks[n_blocks > 1], strict=True):
            for j in range(b, b + c - 1):
                e = entry[j] @ whole[j] @ step
                entry[j + 1] = e / e.sum()
            for j in range(b + c - 2, b - 1, -1):
                u = step @ (whole[j + 1] @ leave[j + 1])
                leave[j] = u / u.sum()
    order = np.argsort(-size, kind="stable")
    alpha, post, beta = np.empty((n, k)), np.empty((n, k)), np.empty((n, k))
    now = entry[order].copy()
    for t in range(int(size[order[0]])):
        live = int(np.searchsorted(-size[order], -t, "left"))
        at = first[order[:live]] + t
        a = now[:live] * potential[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
        now[:live] = a @ step
    now = leave[order].copy()
    for t in range(int(size[order[0]]) - 1, -1, -1):
        live = int(np.searchsorted(-size[order], -t, "left"))
        at = first[order[:live]] + t
        g = alpha[at] * now[:live]
        post[at] = g / g.sum(axis=1, keepdims=True)
        beta[at] = now[:live] * potential[at]
        b = beta[at] @ step.T
        now[:live] = b / b.sum(axis=1, keepdims=True)
    return post, alpha, beta


def fit(windows: list[tuple[str, list[str]]], lexicon_size: int = 60, epochs: int = 2, most_steps: int = 160, seed: int = 7) -> dict:
    """Model from (language, words) texts, in at most `most_steps` steps of 6,000 words."""
    langs = sorted({lang for lang, words in windows if words})
    if not langs:
        return {"langs": [], "weights": np.zeros((SIZE, 0)), "trans": np.zeros((0, 0)), "start": np.zeros(0), "lexicon": {}}
    k, code = len(langs), {x: i for i, x in enumerate(langs)}
    tally = {x: Counter() for x in langs}
    for lang, words in windows:
        tally[lang].update(words)
    lexicon: dict[str, tuple[int, ...]] = {}
    for i, x in enumerate(langs):
        for w, _ in sorted(tally[x].items(), key=lambda c: (-c[1], c[0]))[:lexicon_size]:
            lexicon[w] = (*lexicon.get(w, ()), i)
    vocabulary = sorted({w for _, words in windows for w in words})
    place = {w: i for i, w in enumerate(vocabulary)}
    padded = padded_features(vocabulary, lexicon, SIZE + k)  # the last row of weights is padding
    widest = padded.shape[1]
    rng = np.random.default_rng(seed)
    weights, trans, start = np.zeros((SIZE + k + 1, k)), np.eye(k) * 2.0, np.zeros(k)
    gw, gt, gs = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6), np.full_like(start, 1e-6)
    by_lang = [[np.array([place[w] for w in words]) for lang, words in windows if lang == x and words] for x in langs]
    total = sum(len(w) for ws in by_lang for w in ws)
    for _ in range(min(most_steps, max(8, epochs * total // 6000))):
        words, labels, lengths = [], [], []
        while sum(lengths) < 6000:
            n = 0
            for _ in range(int(rng.integers(1, 5))):
                lang = int(rng.integers(k))
                w = by_lang[lang][int(rng.integers(len(by_lang[lang])))]
                a = int(rng.integers(len(w)))
                part = w[a : a + int(rng.integers(4, 70))]
                words.append(part)
                labels.append(np.full(len(part), lang))
                n += len(part)
            lengths.append(n)
        w, y, ln = np.concatenate(words), np.concatenate(labels), np.array(lengths)
        used, inverse = np.unique(w, return_inverse=True)
        em = weights[padded[used]].sum(axis=1)[inverse]
        post, alpha, beta = forward_backward(em, ln, trans, start)
        delta = post.copy()
        delta[np.arange(len(y)), y] -= 1
        grad_words = np.zeros((len(used), k))
        np.add.at(grad_words, inverse, delta)
        touched = np.unique(padded[used])
        slot = np.searchsorted(touched, padded[used])
        grad = np.zeros((len(touched), k))
        np.add.at(grad, slot.ravel(), np.repeat(grad_words, widest, axis=0))
        grad = grad / len(ln) + 1e-4 * weights[touched]
        gw[touched] += grad**2
        weights[touched] -= 0.3 * grad / np.sqrt(gw[touched])
        weights[-1] = 0.0
        ends = np.cumsum(ln)
        inner = np.ones(len(y), dtype=bool)
        inner[ends - 1] = False
        i = np.nonzero(inner)[0]
        pair = alpha[i][:, :, None] * np.exp(trans)[None] * beta[i + 1][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        observed = np.zeros((k, k))
        np.add.at(observed, (y[i], y[i + 1]), 1.0)
        grad_t = (pair.sum(axis=0) - observed) / len(ln) + 0.02 * trans
        gt += grad_t**2
        trans -= 0.1 * grad_t / np.sqrt(gt)
        grad_s = delta[np.concatenate([[0], ends[:-1]])].sum(axis=0) / len(ln) + 0.02 * start
        gs += grad_s**2
        start -= 0.05 * grad_s / np.sqrt(gs)
    return {"langs": langs, "weights": weights[:-1].astype(np.float32), "trans": trans, "start": start, "lexicon": lexicon}


def training_rows(docs: DataFrame, per_lang: int, max_chars: int, max_total: int = 40_000_000, max_rows: int = 60_000) -> DataFrame:
    """lang, text of at most `per_lang` documents of each language that are not held out.

    One document of each language and hash bucket, chosen by numbers that combine before
    the shuffle, whatever a language's share or a doc_id's repeats.  All of them have at most `max_total`
    characters and are at most `max_rows`: with many languages each gets its equal share of both, in the order of
    hashes, so what reaches the driver and the tasks is bounded.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("lang is not null and doc_id is not null and text is not null")
    usable = usable.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).withColumn("chars", F.length("text")).where(F.col("chars") <= max_chars).withColumn("h", F.xxhash64("doc_id")).withColumn("t", F.xxhash64("text"))
    least = cut(usable.groupBy("lang", F.pmod("h", F.lit(per_lang)).alias("bucket")).agg(F.min(F.struct("h", "doc_id", "t", "chars")).alias("m")).select("lang", "m.*"), "langid-picked")
    n_langs = max(1, least.select("lang").distinct().count())
    order = W.partitionBy("lang").orderBy("h", "doc_id", "t")  # per_lang rows at most
    budget = max_total // n_langs
    share = least.where(F.col("chars") <= budget).withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("chars").over(order.rowsBetween(W.unboundedPreceding, 0)))
    picked = share.where((F.col("place") <= max(1, max_rows // n_langs)) & (F.col("upto") <= budget)).orderBy("place", "lang").limit(max_rows).select("lang", "doc_id", "t")
    # at most max_rows short rows; copies of a row combine before the shuffle
    return usable.join(F.broadcast(picked), ["lang", "doc_id", "t"], "left_semi").dropDuplicates(["lang", "doc_id", "t"]).select("doc_id", "lang", "text")


def language_model(docs: DataFrame, per_lang: int = 300, max_chars: int = 100_000, max_total: int = 40_000_000) -> dict:
    """Fit on the `training_rows` of `docs` (doc_id, lang, text)."""
    rows = training_rows(docs, per_lang, max_chars, max_total).collect()
    return fit([(r["lang"], words_of(r["text"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"]))])


class Tagger:
    """Word marginals of texts; keeps emissions of up to `max_words` distinct words."""

    def __init__(self, model: dict, max_words: int = 300_000):
        self.model, self.max_words = model, max_words
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(model["langs"])))

    def tag(self, texts: list[str | None]) -> tuple[list[int], np.ndarray]:
        """Words of each text, and the marginals of all words one after another."""
        m = self.model
        lists = [words_of(t) if t else [] for t in texts]
        if len(self.place) > self.max_words:
            self.place, self.rows = {}, self.rows[:0]
        place = self.place
        new = list({w for ws in lists for w in ws if w not in place})
        if new:
            place |= zip(new, range(len(place), len(place) + len(new)), strict=True)
            self.rows = np.concatenate([self.rows, emissions(new, m["weights"], m["lexicon"])])
        lengths = np.array([len(ws) for ws in lists])
        at = np.fromiter((place[w] for ws in lists for w in ws), dtype=np.int64, count=int(lengths.sum()))
        return lengths.tolist(), marginals(self.rows[at], lengths, m["trans"], m["start"])


def language(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of `docs` (doc_id, text); lang_words counts words by language, in the order of model["langs"]."""

    def start():
        tagger, langs = Tagger(model), model["langs"]

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column(1).to_pylist()
            out = {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": [], "score": [], "n_words": [], "lang_words": []}
            lengths, post = tagger.tag(texts) if langs else ([0] * len(texts), None)
            at = 0
            for n in lengths:
                lang, score, counts = "und", 0.0, [0] * len(langs)
                if n:
                    mean = post[at : at + n].mean(axis=0)
                    lang, score = langs[int(mean.argmax())], float(min(1.0, mean.max()))
                    counts = np.bincount(post[at : at + n].argmax(axis=1), minlength=len(langs)).tolist()
                at += n
                for k, v in (("lang_pred", lang), ("score", score), ("n_words", n), ("lang_words", counts)):
                    out[k].append(v)
            return out

        return step

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")), SCHEMA, start)

"""Embedding whitening, spelling variants and repeated passages against brute force and edge cases."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens.llm import queries, spelling, substrings, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<float>, n int, x int, component int, piece int"


def exact_covariance(xs):
    """Python integers and fractions only: n, S, n**3 * V."""
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    ys = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in xs]
    return n, sums, [[sum(y[i] * y[j] for y in ys) for j in range(d)] for i in range(d)]


def check_whitening(rows, xs_by_row, k=16):
    fit = sorted(set(xs_by_row.values()))
    n, sums, m = exact_covariance(fit)
    d = len(sums)
    v = np.array([[float(Fraction(c, n**3)) for c in row] for row in m])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = collections.defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert set(got) == set(xs_by_row)
    white = {}
    for key, x in xs_by_row.items():
        y = [n * c - s for c, s in zip(x, sums, strict=True)]
        assert sorted(got[key]) == list(range(1, min(k, d) + 1))
        for c, r in got[key].items():
            assert r.n == n and int(r.deviation) == sum(a * a for a in y)
            assert r.explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9
            white[key, c] = r.whitened
            want = float(np.dot([float(Fraction(a, n)) for a in y], vectors[:, c - 1]) / np.sqrt(values[c - 1]))
            assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-6)
    # one sign a component for all rows
    for c in range(1, min(k, d) + 1):
        want = {key: float(np.dot([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)], vectors[:, c - 1])) for key, x in xs_by_row.items()}
        signs = {np.sign(white[key, c] * want[key]) for key in want if abs(want[key]) > 1e-3}
        assert len(signs) == 1


def test_whitening_query_against_exact_arithmetic(spark, sf):
    table = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    xs = {i: tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for i, v in table}
    check_whitening(queries.op11_embedding_whitening(spark, sf).collect(), xs)


def test_whitening_cases(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(5)], 1, 2, 3, 4) for i in range(40)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0], 1, 2, 3, 4), (100, rows[0][1], 1, 2, 3, 4), (101, None, 1, 1, 1, 1), (102, [], 1, 1, 1, 1), (103, [1.0, None, 1.0, 1.0, 1.0], 1, 1, 1, 1), (104, [1.0, float("nan"), 1.0, 1.0, 1.0], 1, 1, 1, 1), (105, [float("-inf"), 0.0, 1.0, 1.0, 1.0], 1, 1, 1, 1), (106, [1.0], 1, 1, 1, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    xs = {r[0]: tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r[1]) for r in rows[:42]}
    check_whitening(got, xs)
    none = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"} <= set(none.columns)
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, 0, 0)] * 3, VECTORS)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.explained is None and r.identity_error is None for r in same)
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, 0, 0), (2, [3.0, 2.0], 0, 0, 0, 0)], VECTORS)).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and all(r.identity_error < 1e-12 for r in flat)


def test_whitening_of_wide_integers(spark):
    """Entries that no 64-bit product holds run on big integers."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10.0**e for e in (1, 9, 15)]) for i in range(60)]
    got = whitening.whiten(spark.createDataFrame(rows + [(60, [1e300, 0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 183
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, sums, _ = exact_covariance([tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for _, v in rows])
    for r in got:
        x = [int(np.floor(64 * c)) + 1_000_000 for c in rows[r.vec_id][1]]
        exact = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        assert (int(r.deviation) if r.deviation is not None else None) == (exact if exact < 10**38 else None)


@pytest.mark.parametrize("bits", [1, 19, 20, 21, 41, 63, 90])
def test_digit_slices_are_exact(bits):
    rng = random.Random(bits)
    y = np.array([[rng.randrange(-(2**bits), 2**bits) for _ in range(3)] for _ in range(500)], dtype=object if bits > 62 else np.int64)
    gram = whitening.Gram(3, bits)
    gram.held = whitening.HELD - 1  # recombined in between
    gram.add(y[:200])
    gram.add(y[200:])
    assert gram.recombine().tolist() == [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]


def test_moments_merge_as_one():
    x = np.random.default_rng(1).normal(size=(50, 3))

    def part(w):
        off = w - w.mean(axis=0)
        return [len(w), w.mean(axis=0).tolist(), (off.T @ off).ravel().tolist()]

    m, mean, co = whitening.moments_merged(whitening.moments_merged(part(x[:7]), part(x[7:8])), part(x[8:]))
    want = part(x)
    assert m == 50 and np.allclose(mean, want[1]) and np.allclose(co, want[2])


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_variants(rows):
    words = brute_words(rows)
    sketch = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            sketch[w[:k] + w[k + 1 :]].add(w)
    near = {w: set() for w in words}
    for w in words:
        near[w] = {x for k in range(len(w)) for x in sketch[w[:k] + w[k + 1 :]] if one_edit(w, x)} | {x for x in sketch[w] if one_edit(w, x)} | {w[:k] + w[k + 1 :] for k in range(len(w)) if w[:k] + w[k + 1 :] in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def as_variants(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_spelling_query_against_brute_force(spark, size):
    sf = f"/root/testdata/{size}"
    want = brute_variants(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    got = queries.op12_spelling_variants(spark, sf).collect()
    assert len(got) == len(want) and as_variants(got) == want


@pytest.mark.parametrize("seed", range(30))
def test_tries_find_exactly_the_near_pairs(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("ab" if seed % 2 else "abc", k=rng.randrange(0, 7))) for _ in range(60)})
    got = {(min(p), max(p)) for p in spelling.Trie(words).near()}
    assert got == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}


@pytest.mark.parametrize(("group", "letters"), [(4096, 1 << 18), (2, 1 << 18), (4096, 10)])
def test_groups_of_any_size_lose_no_pair(spark, group, letters):
    rng = random.Random(1)
    words = sorted({"commonbeginning" + "".join(rng.choices("abé", k=rng.randrange(1, 5))) for _ in range(60)} | {"".join(rng.choices("ab", k=6)) for _ in range(30)} | {"x" * 40, "x" * 41, "x" * 20 + "y" + "x" * 20})
    found = spelling.near_pairs(spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long"), group, letters).collect()
    assert len(found) == len({(r.word, r.near) for r in found})
    assert {(r.word, r.near) for r in found} == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert all(r.n == 5 + words.index(r.word) and r.near_n == 5 + words.index(r.near) for r in found)


def test_spelling_cases(spark, docs, no_docs):
    assert spelling.variants(no_docs).count() == 0
    assert as_variants(spelling.variants(docs).collect()) == brute_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    rows = [(i, t) for i, t in enumerate(["orange " * 125, "oranges " * 25, "orangess " * 5, "ORANGE Ünïcödé", "orangé " * 30, None, "", "aaaaaa " * 5 + "aaaaaaa " * 5, "x" * 300_000])] * 1
    rows += [(None, "orange " * 3)] * 2 + [(7, "z" * 5000 + " ")] * 6 + [(8, "z" * 4999 + " ")] * 5
    got = as_variants(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_variants(rows)
    assert got["orangess"][:2] == ("oranges", "orange") and got["aaaaaa"][0] is None


def brute_substrings(rows, size=13):
    least = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - size + 1):
            k = tuple(words[i : i + size])
            if d is not None and (k not in least or least[k] is None or d < least[k]):
                least[k] = d
            least.setdefault(k, None)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - size + 1):
            m = least[tuple(words[i : i + size])]
            if m is not None and (d is None or m < d):
                gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def as_counter(df):
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_substring_query_against_brute_force(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert as_counter(queries.op13_substring_dedup(spark, sf)) == brute_substrings(rows)


@pytest.mark.parametrize("block", [substrings.BLOCK, 100])
def test_substring_cases(spark, docs, no_docs, block, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", block)
    assert substrings.dedup_substrings(no_docs).count() == 0
    assert as_counter(substrings.dedup_substrings(docs)) == brute_substrings([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    passage = " ".join(f"w{i}" for i in range(20))
    long_word = "x" * 40
    rows = [
        (5, passage), (3, f"a {passage} b"), (9, f"{passage} {passage} " * 3), (None, passage), (None, "own " + passage), (None, "nowhere else " * 10), (4, passage.replace("w7", "W7")), (3, passage), (3, passage), (6, None), (7, ""),
        (8, " ".join([f"{long_word}{i}" for i in range(13)])), (10, "\n".join([f"{long_word}{i}" for i in range(14)])), (11, "a " * 5000), (12, " a" * 40), (-1, "the end of one text"), (1, " ".join(f"v{i}" for i in range(13))), (2, " ".join(f"v{i}" for i in range(12))),
    ]
    rows += [(100 + i, f"{passage} tail {i}") for i in range(300)] + [(50, passage)] * 200
    assert as_counter(substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute_substrings(rows)


def test_full_sketch_passes_more_windows_but_gives_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = as_counter(substrings.dedup_substrings(docs))
    monkeypatch.setattr(substrings, "MOST_CELLS", 1 << 10)
    monkeypatch.setattr(substrings, "LEAST_CELLS", 1 << 10)
    assert as_counter(substrings.dedup_substrings(docs)) == want


def test_merged_sketch_has_every_repeated_window(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").where("length(text) < 3000").repartition(3)
    cells = 1 << 18
    bits = substrings.repeated_cells(docs, 13, cells)
    texts = pa.array([r.text for r in docs.collect()])
    keys, _, _ = substrings.window_keys(substrings.batch_words(texts), 13)
    for row in range(substrings.ROWS):
        at = substrings.cell(keys, row, cells)
        counted = np.bincount(at, minlength=cells)
        assert np.array_equal(np.unpackbits(bits[row], bitorder="little").astype(bool), counted > 1)


@pytest.mark.parametrize("stretch", [substrings.STRETCH, 50])
def test_word_hashes_follow_the_words(stretch, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    texts = ["one two", "two", None, "", " three one\x1fone one ", "y" * 33 + " " + "y" * 34, "one " * 200, "two"]
    words = substrings.batch_words(pa.array(texts, pa.string()).slice(1))
    seen = {}
    for text, a, b in zip(texts[1:], words.first, words.last, strict=True):
        split = WORD.findall(text or "")
        assert b - a == len(split)
        for k, w in enumerate(split):
            h = tuple(int(x[a + k]) for x in words.hashes)
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("cells", [[], [0], [0, 0, 5], [65534, 65535, 65535, 65536], [3, 3_000_000, 4_194_303]])
def test_cell_lists_round_trip(cells):
    assert substrings.decoded(substrings.coded(np.array(cells, dtype=np.int64))).tolist() == cells


@given(st.lists(st.integers(0, 60), min_size=1, max_size=20), st.integers(1, 8))
def test_covered_stretches(places, window):
    spans = substrings.covered(np.array(sorted(places)), window).tolist()
    assert {w for p in places for w in range(p, p + window)} == {w for a, b in spans for w in range(a, b)}
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_extra_columns_are_ignored(spark, docs):
    wide = docs.withColumns({c: F.lit(1) for c in ("t", "row", "key", "p", "spans", "part", "known", "body", "word", "n", "root", "at", "g", "short")})
    assert as_counter(substrings.dedup_substrings(wide)) == as_counter(substrings.dedup_substrings(docs))
    assert as_variants(spelling.variants(wide).collect()) == as_variants(spelling.variants(docs).collect())

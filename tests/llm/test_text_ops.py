"""Quality rules, mixing, SimHash and components against brute force."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import mixing, quality, simhash
from stratalens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    marked = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


@given(st.text(alphabet=st.sampled_from("ab #\n\t|é \x1f\x85"), max_size=120))
@settings(max_examples=150, deadline=None)
def test_base_counts_match_brute_force(text):
    assert quality.Judge(50, 50, 0.3)(text)[:5] == brute_quality(text)


def test_repeat_words_of_many_distinct_words():
    words = [str(i) for i in range(3000)] + ["1", "2", "3", "x"]
    assert quality.repeat_words(words) == 6


def test_quality_table(docs, no_docs):
    got = {(r.doc_id, r.n_words): r for r in quality.quality(docs).collect()}
    assert len(quality.quality(docs).collect()) == docs.count()
    for r in docs.collect():
        want = brute_quality(r.text)
        g = got[r.doc_id, want[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.base_failed and g.kept)
    assert quality.quality(no_docs).count() == 0
    assert quality.kept(docs).columns == docs.columns
    assert sorted(str(r.doc_id) for r in quality.kept(docs).collect()) == sorted(str(r.doc_id) for r in quality.quality(docs).where("kept").collect())


def test_compression_bands_reject_noise_and_repeats_and_keep_prose():
    rng = random.Random(3)
    compress = zstandard.ZstdCompressor(level=3).compress
    syllables = ["ka", "lo", "mi", "tur", "ban", "es", "or", "thi", "qu", "ren"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(2000)]
    prose = " ".join(rng.choices(words, k=1500))
    assert quality.compression(prose.encode(), compress)[4] == ""
    assert quality.compression(("the same line again. " * 300).encode(), compress)[4] == "repetitive"
    assert quality.compression("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=6000)).encode(), compress)[4] == "incompressible"
    mixed = prose + "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=12000))
    assert quality.compression(mixed.encode(), compress)[4] != ""


@pytest.mark.parametrize("alphabet, least", [("".join(map(chr, range(33, 127))), 256), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 256), ("abcdefghijklmnopqrstuvwxyz", 4096), ("0123456789abcdef", 8192)])
def test_random_words_are_incompressible_in_every_band(alphabet, least):
    rng = random.Random(5)
    compress = zstandard.ZstdCompressor(level=3).compress
    edges = [most for most, _, _ in quality.BANDS[:-1] if most > least] + [60_000]
    for size in sorted({least} | {e - 1 for e in edges} | {(a + b) // 2 for a, b in zip(edges, edges[1:])}):
        text = " ".join("".join(rng.choices(alphabet, k=rng.randint(4, 9))) for _ in range(size // 5 + 1))[:size]
        assert quality.compression(text.encode(), compress)[4] == "incompressible", size


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, clamped = budget * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in clamped]
        total = sum(w[s] for s in rest)
        room = left - sum(clamped.values())
        want = {s: room * w[s] / total for s in rest} if rest else {}
        over = [s for s in rest if want[s] > most * sizes[s]]
        if not over:
            return clamped | want
        for s in over:
            clamped[s] = most * sizes[s]


def check_mix(df, rows):
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = brute_targets(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by_size = collections.defaultdict(set)
    for s, t in want.items():
        by_size[sizes[s]].add(round(t, 6))
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert round(r.target, 6) in by_size[r.source_size]
        taken[r.source_size, round(r.target, 6)] += r.taken
    same = collections.Counter((sizes[s], round(t, 6)) for s, t in want.items())
    for key, n in same.items():
        assert abs(taken[key] - n * key[1]) <= n * 0.500001
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))


def test_mix_against_water_filling_by_rounds(spark, docs, no_docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "z", "é", "B", None, "zz", "a", "a", "a"])) for i in range(400)]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows)
    check_mix(docs, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert mixing.mix(no_docs).count() == 0


def test_mix_plan_has_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repeated_keeps_columns_and_counts(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.repeated(df)
    assert got.columns == df.columns
    assert abs(got.count() * 10 - 600) <= 20


def brute_fingerprint(text, k=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet=st.sampled_from("aBcÉ \n.\x85"), max_size=60))
@settings(max_examples=120, deadline=None)
def test_fingerprint_matches_brute_force(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) == brute_fingerprint(text)


def brute_components(fps, radius):
    ids = list(range(len(fps)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in ids]


@pytest.mark.parametrize("tile", [4, 16, 64])
def test_components_against_all_pairs(spark, tile):
    rng = random.Random(tile)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    texts = ["", None, "one", "one two"]
    for _ in range(15):
        own = rng.choices(words, k=150)
        texts.append(" ".join(own))
        for _ in range(rng.randint(0, 4)):
            own = own[:]
            own[rng.randrange(150)] = rng.choice(words)
            texts.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, rng.choice(texts)) for i in range(10)]
    rng.shuffle(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    least: dict = {}
    roots = brute_components(fps, 3)
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    assert any(0 < (a ^ b).bit_count() <= 3 for a in fps for b in fps)
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True)}


def jaccard_roots(texts):
    """The first text of the group of each, by all pairs of five-word shingle sets at 0.8."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [3, 8, 512])
def test_near_dedup_in_blocks_of_any_size_against_all_pairs(spark, block):
    """One large group of near copies, a chain whose ends are far apart, and texts just below the threshold."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    base = rng.choices(words, k=90)
    texts = [" ".join(base[:k] + [w] + base[k + 1 :]) for k, w in zip(range(2, 88, 2), words, strict=False)]
    chain = rng.choices(words, k=70)
    for _ in range(25):
        chain = chain[3:] + rng.choices(words, k=3)
        texts.append(" ".join(chain))
    for c in range(4, 16):
        own = rng.choices(words, k=64)
        texts += [" ".join(own), " ".join(own[: 64 - c] + rng.choices(words, k=c))]
    got = simhash.one_per_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(jaccard_roots(texts)))


def test_simhash_table(docs, no_docs):
    got = simhash.simhash_components(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(r.text) for r in rows]
    assert sorted(g.fingerprint for g in got) == sorted(f"{f:016x}" for f in fps)
    root = brute_components(fps, 3)
    least = {}
    for r, k in zip(rows, root):
        least.setdefault(k, []).append(r.doc_id)
    want = collections.Counter((str(r.doc_id), f"{f:016x}", min(x for x in least[k] if x is not None) if any(x is not None for x in least[k]) else None) for r, f, k in zip(rows, fps, root))
    assert collections.Counter((str(g.doc_id), g.fingerprint, g.component_id) for g in got) == want
    assert simhash.simhash_components(no_docs).count() == 0


def test_one_per_group_keeps_one_copy_and_all_clean(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    clean = [" ".join(rng.choices(words, k=200)) for _ in range(30)]
    near = clean[0].split()
    near[100] = "changed"
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, clean[1]) for i in range(5)] + [(200, " ".join(near))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in simhash.one_per_group(df).collect()) == list(range(30))
    again = df.unionAll(df)
    assert sorted(r.doc_id for r in simhash.one_per_group(again).collect()) == list(range(30))


def test_one_per_group_keeps_different_texts_without_or_with_equal_ids(spark):
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    clean = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    rows = [(None, t) for t in clean[:6]] * 2 + [(7, t) for t in clean[6:9]] * 2 + [(8, clean[9]), (None, clean[9]), (9, clean[10]), (3, clean[10])]
    got = simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, t) for t in clean[:6]] + [(7, t) for t in clean[6:9]] + [(8, clean[9]), (3, clean[10])]
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in want)


def test_one_per_group_against_exact_jaccard(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    texts = []
    for k in range(60):
        base = rng.choices(words, k=64)  # 60 shingles; k % 20 words at the end differ: Jaccard (60 - c) / (60 + c)
        texts += [" ".join(base), " ".join(base[: 64 - k % 20] + rng.choices(words, k=k % 20))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(60)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[i] = min(root[i], root[j])
    got = simhash.one_per_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[1000 + i] for i in range(80)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tail_chunks_never_reject_clean_prose(sf):
    import duckdb
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    raw = next(t for (t,) in duckdb.sql(f"select text from '{sf}/documents.parquet' order by length(text) desc").fetchall()).encode()
    assert len(raw) > 8500 and not quality.compression(raw, compress)[4]
    for size in (*range(4096, 4401), *range(8190, 8451)):
        assert quality.compression(raw[:size], compress)[4] == "", size


@pytest.mark.parametrize("size", [1, 4096, 4097, 6143, 6144, 8192, 8193, 10_239, 10_240, 50_001])
def test_chunks_cover_the_text_and_none_is_short(size):
    raw = bytes(i % 251 for i in range(size))
    parts = list(quality.chunks(raw))
    assert b"".join(parts) == (raw if size >= 6144 else b"")
    assert all(2048 <= len(p) < 6144 for p in parts)


def test_whole_verdict_of_the_quality_query(spark, sf):
    """kept, row by row, against the rule spelled out: base counts, the whole ratio, bytes in bad chunks."""
    import duckdb
    import zstandard

    from stratalens.llm import queries

    def fits(raw):
        lo, hi = quality.band(len(raw))
        return lo <= len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw) <= hi

    want = {}
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        n, *_, repeated = brute_quality(text)
        raw = (text or "").encode()
        cuts = list(range(0, len(raw) - 2047, 4096))[: max(1, (len(raw) + 2048) // 4096)] if len(raw) >= 6144 else []
        parts = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)] if cuts else []
        want[doc_id] = not (n < 50 or 100 * repeated > 50 * n) and fits(raw) and sum(len(p) for p in parts if not fits(p)) <= 0.3 * len(raw)
    assert {r.doc_id: r.kept for r in queries.op6_quality_rules(spark, sf).collect()} == want


def sourced_targets(rows):
    """Targets by source of (source, size) rows, filled round by round."""
    sizes = collections.Counter()
    for source, size in rows:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_repeats_meet_targets_with_null_and_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 50)
    rng = random.Random(2)
    rows = [(None, " ".join(["w"] * rng.randrange(1, 40)), "en", "nulls", 1) for _ in range(3000)] + [(7, " ".join(["x"] * rng.randrange(1, 60)) + f" {i}", "en", "equal", 2) for i in range(1000)]
    rows += [(i, " ".join(["y"] * rng.randrange(1, 30)), None, None, 3) for i in range(500)] + [(None, "the same row again", "en", "same", 4)] * 700 + [(None, None, None, "nulls", None)] * 20 + [(9, "", "en", "equal", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, b long")
    want = sourced_targets([(r[3], len((r[1] or "").split())) for r in rows])
    got = mixing.repeated(df).collect()
    words, most = collections.Counter(), collections.Counter()
    for r in got:
        words[r.source] += len((r.text or "").split())
    for r in rows:
        most[r[3]] = max(most[r[3]], len((r[1] or "").split()))
    assert all(abs(words[s] - want[s]) <= most[s] for s in want), (words, want)
    before, after = collections.Counter(rows), collections.Counter(tuple(r) for r in got)
    assert set(after) <= set(before) and all(after[r] == n for r, n in before.items() if not (r[1] or "").split())
    assert all(after[r] <= 2 * n for r, n in before.items())
    assert collections.Counter(tuple(r) for r in mixing.repeated(df.repartition(7)).collect()) == after
    # the same rows through the query's operator
    taken = collections.Counter()
    mixed = mixing.mix(df).collect()
    assert len(mixed) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in mixed)
    for r in mixed:
        taken[r.source_size] += r.taken
    assert all(abs(taken[r.source_size] - r.target) <= 1 for r in mixed)
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert mixing.repeated(df.limit(0)).count() == 0

"""Learned operators: exact parts against brute force, the rest by held-out figures."""

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import ann, html_blocks, langid, licenses, toxicity
from stratalens.llm.util import table


def distance(a, b):
    """Edit distance with swaps of neighbours (restricted)."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


TERMS = [("abcde", False, 1), ("abcab", False, 2), ("bead", False, 0), ("dda", True, 0), ("acid", False, 1)]


@given(st.text(alphabet="abcde", max_size=7))
@settings(max_examples=400, deadline=None)
def test_automaton_matches_edit_distance(word):
    want = []
    for k, (text, stem, edits) in enumerate(TERMS):
        if stem:
            if word.startswith(text):
                want.append((0, k))
        elif (n := distance(word, text)) <= edits:
            want.append((n, k))
    got = AUTOMATON.match(word)
    assert (got is None) == (not want)
    if want:
        assert (got[1], got[0]) == min(want) or got[1] == min(want)[0]


AUTOMATON = toxicity.Automaton(TERMS)


def test_quotation_weighs_less_than_abuse():
    scan = toxicity.Scanner([("idiot", False, 1, 5.0)])
    abuse, quoted = (scan.features(t)[0] for t in ("you are an idiot and you know it", 'the report quoted him: "an idiot" he said'))
    assert np.dot(abuse, toxicity.PRIOR) > np.dot(quoted, toxicity.PRIOR)
    assert scan.features("you are an idoit")[2] == 1 and scan.features("you are an 1diot")[2] == 1
    assert scan.features(None)[0] == scan.features("")[0] == scan.features("a nice day")[0]


def test_toxicity_tables(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (toxicity.toxicity_model(docs, labels), toxicity.toxicity_model(no_docs, labels), toxicity.toxicity_model(docs, labels.limit(0))):
        got = toxicity.toxicity(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert toxicity.toxicity(no_docs, model).count() == 0
        assert toxicity.clean(docs, model).columns == docs.columns


def test_toxicity_held_out(spark):
    """Held-out accuracy on the larger test table, where enough toxic rows are labelled."""
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = toxicity.toxicity(docs, toxicity.toxicity_model(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95 and (got.predicted[got.toxic == 0] == 0).mean() > 0.98


@pytest.mark.parametrize("block", [1, 2, 3, 50])
def test_marginals_against_enumeration(block):
    rng = np.random.default_rng(block)
    lengths, k = [5, 1, 4], 3
    em, trans, start = rng.normal(size=(10, k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
    want, at = [], 0
    for n in lengths:
        p = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            s = np.exp(start[y[0]] + sum(em[at + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                p[i, y[i]] += s
        want.append(p / p.sum(axis=1, keepdims=True))
        at += n
    got = langid.marginals(em, np.array(lengths), trans, start, block)
    assert np.allclose(got, np.concatenate(want))


def test_language_labels_switched_text_word_by_word():
    rng = np.random.default_rng(2)
    vocab = {"xx": [f"ka{i}lo".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(60)], "yy": [f"ti{i}mu".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(60)]}
    windows = [(lang, list(rng.choice(words, 80))) for lang, words in vocab.items() for _ in range(20)]
    model = langid.fit(windows)
    text = " ".join([*rng.choice(vocab["xx"], 12), *rng.choice(vocab["yy"], 15)])
    _, post = langid.Tagger(model).tag([text])
    assert (post.argmax(axis=1) == [0] * 12 + [1] * 15).mean() > 0.95


def test_language_tables(spark, docs, no_docs, sf):
    model = langid.language_model(docs)
    got = {r.doc_id: r for r in langid.language(docs, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0
    assert langid.language(no_docs, model).count() == 0
    none = langid.language_model(no_docs)
    assert {r.lang_pred for r in langid.language(docs, none).collect()} == {"und"}
    real = table(spark, sf, "documents")
    out = langid.language(real, langid.language_model(real)).where("held_out").join(real.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.95


def test_blocks_of_loose_markup():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><script>var a='</p>';</script><article><h1>Head &amp; more</h1><p><b>One<br>two<p>Three <i>four</i>\n five<!-- no --></article><p>&lt;tag&gt;"
    assert [t for _, t, _ in html_blocks.blocks(page)] == ["menu", "Head & more", "One two", "Three four five", "<tag>"]
    assert html_blocks.blocks(None) == html_blocks.blocks("") == html_blocks.blocks("<div><p></p></div>") == []
    assert html_blocks.blocks("a < b and <3 hearts")[0][1] == "a < b and <3 hearts"


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = html_blocks.Network()
    x, mask = html_blocks._pad([rng.normal(size=(4, html_blocks.DIM)), rng.normal(size=(2, html_blocks.DIM))])
    x, mask = x.astype(float), mask.astype(float)
    y = (rng.random(mask.shape) > 0.5) * mask

    def loss():
        p = net._score(np.concatenate([net._run(x, mask, "f"), net._run(x, mask, "b")], axis=2))
        return float(-((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())

    grads = net.gradients(x, mask, y)
    for name, g in grads.items():
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(4)]:
            old = net.p[name][at]
            net.p[name][at] = old + 1e-5
            up = loss()
            net.p[name][at] = old - 1e-5
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_extraction_gives_the_articles(spark, sf):
    import html

    pages = table(spark, sf, "pages")
    extra = spark.createDataFrame([(None, None, None), (1, "u", ""), (2, "u", "<p>")], "page_id long, url string, html string")
    got = html_blocks.extract(pages.unionByName(extra), html_blocks.block_model(pages)).collect()
    assert len(got) == pages.count() + 3 and all(r.n_chars == len(r.text) for r in got)
    texts = {(r.page_id, r.url): r.text for r in got}
    for r in pages.collect():
        art = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", art)]
        assert texts[r.page_id, r.url] == "\n\n".join(x for x in parts if x)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), [float(v) for v in centres[i % 12] + 0.3 * rng.normal(size=16)]) for i in range(1500)]
    rows += [(3000 + i, rows[40][1]) for i in range(60)]  # equal vectors: ties by id
    bad = [(9000, None), (9020, []), (9040, [0.0] * 16), (9060, [float("nan")] * 16), (9080, [None] * 16), (9100, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    found = ann.search(df, chunk=400, query_block=30).cache()
    got = found.toPandas()
    assert set(got.query_id) == {i for i, _ in rows if i % 20 == 0} and not set(got.vec_id) & {9000, 9020, 9040, 9060, 9080, 9100}
    assert (got.groupby("query_id").size() == 20).all() and (got.query_id != got.vec_id).all()
    vec = dict(rows)
    for r in got.sample(50, random_state=1).itertuples():
        assert abs(r.score - float(np.dot(vec[r.query_id], vec[r.vec_id]))) < 1e-12
    for _, g in got.sort_values("rank").groupby("query_id"):
        pairs = list(zip(-g.score, g.vec_id))
        assert pairs == sorted(pairs) and list(g["rank"]) == list(range(1, 21))
    assert ann.recall(found, df.where("vec_id < 9000")) >= 0.9
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(0, 60, 20)], "vec_id long, embedding array<double>")
    assert ann.search(few).count() == 6
    assert ann.search(df.limit(0)).count() == 0


def test_licences(spark, docs, no_docs):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.ts", "code"), (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (4, "a/c/y.ts", "more\nThis work is licensed under the GNU General Public License, version 3.\nend"),
        (5, "z.ts", None), (6, None, "Released under the MIT License."), (7, None, "x"), (8, "a/d/e/f.ts", "deep"), (9, "b/long.ts", "word " * 5000 + "the license of the word is a word"), (10, "a/z.ts", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.basis, r.from_dir) for r in licenses.licences(df).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", None), 4: ("GPL-3.0", "own", None), 5: (None, "none", None), 6: ("MIT", "own", None), 7: (None, "none", None), 8: ("MIT", "inherited", "a"), 9: (None, "none", None), 10: ("MIT", "inherited", "a")}
    assert licenses.licences(licenses.document_files(docs)).count() == docs.count()
    assert licenses.licences(licenses.document_files(no_docs)).count() == 0


def test_licence_cosine_against_dense_vectors():
    df = {"license": 5, "the": 90, "mit": 2}
    m = licenses.Matcher(licenses.TEMPLATES, df, 100, 0.0)
    for line in ("Released under the MIT License", "under the license", "the GNU General Public License version 2 or 3"):
        words = sorted({w for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.words_of(t)} | set(licenses.words_of(line)))

        def dense(text):
            ws = licenses.words_of(text)
            v = np.array([ws.count(w) * m.idf.get(w, m.unknown) for w in words])
            return v / np.linalg.norm(v)

        want = max(float(dense(line) @ dense(t)) for ts in licenses.TEMPLATES.values() for t in ts)
        assert abs(m.line(line)[0] - want) < 1e-9

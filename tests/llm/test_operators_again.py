"""Licence units, token files by bytes read, packing by plain loops, letters, toxicity recall, hot keys, and every registered query."""

import math
import textwrap

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_learned_ops import distance

from stratalens.llm import ann, dac, langid, licenses, packing, queries, toxicity
from stratalens.llm.components import components
from stratalens.llm.util import hot_keys, shared_dir, spread_join, table

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def matcher():
    df = dict.fromkeys(licenses.vocabulary(licenses.TEMPLATES), 3) | dict.fromkeys(("the", "of", "this", "and", "is", "or", "by", "in", "to"), 900)
    return licenses.Matcher(licenses.TEMPLATES, df, 1000, 0.8)


BSD = "Copyright (c) 2020, Acme Corp. All rights reserved.\n\n" + textwrap.fill(licenses.TWO_CLAUSES + licenses.THIRD_CLAUSE.replace("the copyright holder", "Acme"), 72)


@pytest.mark.parametrize(
    "text,want",
    [
        (BSD, "BSD-3-Clause"), (textwrap.fill(licenses.TWO_CLAUSES, 72), "BSD-2-Clause"), (textwrap.fill(licenses._gnu("Lesser ", "library", "2.1")[0], 72), "LGPL-2.1"), (textwrap.fill("MIT License Copyright (c) 2021 Someone " + licenses.TEMPLATES["MIT"][-1], 72), "MIT"),
        ("# " + textwrap.fill(licenses._gnu("", "program", "3")[1], 60).replace("\n", "\n# "), "GPL-3.0"), ("// SPDX-License-Identifier: MIT\nx", "MIT"), ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", "MIT OR Apache-2.0"),
        ("This software is licensed under the MIT License.", "MIT"), ("Source code released under the MIT License.", "MIT"), ("Copyright 2021 Acme Corp. Licensed under the MIT License.", "MIT"), ("(c) x. All rights reserved. Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Files licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("word " * 400 + "licensed\nunder the GNU General\nPublic License, version 2" + " word" * 400, "GPL-2.0"), ("All rights reserved.", "Proprietary"), ("prose about a license of the mit lab and its general public", None), ("", None), (None, None),
    ],
)
def test_licence_of_a_unit(text, want):
    got = matcher().text(text)
    assert got[0] == want
    assert got[3] <= got[4]


def test_a_hot_folder_and_clashing_columns(spark):
    rows = [(i, f"a/f{i}.ts", "code") for i in range(900)] + [(1000, "a/LICENSE", "Released under the MIT License."), (1001, "b/x.ts", "code"), (1002, None, "code")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").select("*", F.lit(1).alias("folder"), F.lit(2).alias("dir"), F.lit(3).alias("own"))
    got = licenses.licences(df)
    assert got.count() == len(rows)
    assert got.where("licence = 'MIT' and basis = 'inherited'").count() == 900 and got.where("licence is null").count() == 2


def test_one_token_reads_few_bytes(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(0, 200))))) for i in range(-50, 400)] + [(-(1 << 63), "least"), (None, "none"), (7, "seven again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "codes")
    dac.write_dac(df, path, WORD_FILE)
    whole = dac.read_dac(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in whole[:2]] == [None, -(1 << 63)] and len(whole) == len(rows)
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in whole), "<u4")
    for at in (0, 1, 77, len(ids) // 2, len(ids) - 1):
        assert dac.token_at(spark, path, at) == ids[at]
    with pytest.raises(IndexError):
        dac.token_at(spark, path, len(ids))
    read = []
    payload = dac.encode_segment([1], [len(ids)], ids.tobytes(), 0)
    big = dac.encode_segment([1], [40 * len(ids)], np.tile(ids, 40).tobytes(), 0)
    for data, n in ((payload, len(ids)), (big, 40 * len(ids))):
        for at in rng.integers(0, n, 50):
            read.append(0)

            def take(place, size, data=data):
                read[-1] += size
                return data[place : place + size]

            assert dac.token(take, int(at)) == ids[at % len(ids)]
    assert max(read) <= 400 and max(read[50:]) <= max(read[:50]) + 80  # the same few bytes, however large the segment


def plain_packer(pieces, capacity, most_segments, most_loss):
    """The heuristic by loops: [(size, prompt)] that all wait -> [[(piece, length)]] of each sequence."""
    left = [[i, n, min(p, n)] for i, (n, p) in enumerate(pieces)]
    out = []
    while left:
        room, segments, loss_room, seq = capacity, most_segments, most_loss, []
        while room and segments and left:
            def score(x):
                return x[1] * (room / capacity**2) + segments / most_segments**2 + (x[1] - x[2]) * (loss_room / most_loss**2)

            fits = [x for x in left if x[1] <= room and x[1] - x[2] <= loss_room]
            able = fits or [x for x in left if x[2] + loss_room > 0]
            if not able:
                break
            best = max(able, key=score)  # the first of equal ones
            n = best[1] if fits else min(room, best[1], best[2] + loss_room)
            used = max(0, n - best[2])
            seq.append((best[0], n))
            room, segments, loss_room = room - n, segments - 1, loss_room - used
            best[1], best[2] = best[1] - n, max(0, best[2] - n)
            if not best[1]:
                left.remove(best)
        out.append(seq)
    return out


@pytest.mark.parametrize("limits", [(64, 8, 56), (64, 3, 30), (100, 50, 100), (40, 40, 7)])
def test_every_choice_of_the_packer(limits):
    rng = np.random.default_rng(sum(limits))
    pieces = [(int(n), int(n * s)) for n, s in zip(rng.integers(1, limits[0] + 1, 60), rng.random(60))]
    packer = packing.Packer(*limits, 0, buffer=1000)
    got = []
    for i, (n, prompt) in enumerate(pieces):
        got += packer.add(i, bytes(4 * n), prompt)
    got += packer.finish()
    by_seq = {}
    for doc, _, length, _, _, seq, offset, _ in got:
        by_seq.setdefault(seq, []).append((offset, doc, length))
    assert [[(d, n) for _, d, n in sorted(s)] for _, s in sorted(by_seq.items())] == plain_packer(pieces, *limits)


def test_loss_limit_binds_with_little_padding():
    rng = np.random.default_rng(8)
    packer, total, got = packing.Packer(2048, 64, 1792, 0), 0, []
    for d in range(3000):
        n = int(rng.lognormal(5.5, 1.3)) + 1
        total += n
        got += packer.add(d, bytes(4 * n), int(packing.INSTRUCTION_LIMITS["prompt_share"] * n))
    got += packer.finish()
    used, loss, parts = {}, {}, {}
    for _, _, length, _, n_loss, seq, _, _ in got:
        used[seq], loss[seq], parts[seq] = used.get(seq, 0) + length, loss.get(seq, 0) + n_loss, parts.get(seq, 0) + 1
    assert sum(used.values()) == total and max(used.values()) <= 2048 and max(loss.values()) == 1792 and max(parts.values()) <= 64
    assert total / (2048 * len(used)) > 0.99


def test_letters_only():
    assert langid.words_of("½ ② ab½cd ３ É_x") == ["ab", "cd", "é", "x"]


def test_language_training_rows_are_bounded(spark):
    many = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3).alias("text"), F.lit("xx").alias("lang"))
    more = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("other words").alias("text"), F.concat(F.lit("l"), F.col("id") % 90).alias("lang"))
    rows = langid.training_rows(many.unionByName(more), 5, 1000)
    assert rows.where("lang = 'xx'").count() == 1 and rows.count() <= 5 * 91 and rows.select("lang").distinct().count() == 91
    empty = spark.createDataFrame([(1, "½ ②", "xx"), (2, None, "xx")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.language(empty, langid.language_model(more)).collect()} == {"und"}


@pytest.mark.parametrize("stem,word", [("bomente", "bomnetex"), ("bomente", "bommentelo"), ("reeux", "reexux"), ("reeux", "rexeux")])
def test_stems_are_matched_with_edits(stem, word):
    edits = toxicity.allowed_edits(stem)
    want = min((distance(word[:k], stem) for k in range(len(word) + 1)), default=9)
    assert toxicity.Automaton([(stem, True, edits)]).match(word) == ((0, want) if want <= edits else None)


def test_automaton_restarts_with_the_same_answers():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcde"), int(rng.integers(1, 8)))) for _ in range(400)]
    terms = [("abcde", False, 1), ("dda", True, 0), ("bead", True, 1)]
    small, large = toxicity.Automaton(terms, max_states=5), toxicity.Automaton(terms)
    assert [small.match(w) for w in words] == [large.match(w) for w in words]
    assert len(small.states) < 200


def test_toxicity_recall_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"  # the smaller tables hold six such rows only
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = toxicity.toxicity(docs, toxicity.toxicity_model(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted[got.toxic == 1] == 1).mean() > 0.9


def test_spread_join_and_components_with_hot_keys(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("v"))
    one = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), "k", 5000)
    assert hot == [(1, math.ceil(2500 / 64))]
    for how in ("inner", "left", "left_semi"):
        a, b = spread_join(many, one, "k", hot, how), many.join(one, "k", how)
        assert sorted(map(tuple, a.select(*sorted(a.columns)).collect()), key=str) == sorted(map(tuple, b.select(*sorted(b.columns)).collect()), key=str)
    edges = [(0, i) for i in range(1, 1500)] + [(9000 - i, 9000) for i in range(1, 700)] + [(20_000 + i, 20_001 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1500)} == {0} and {got[9000 - i] for i in range(700)} == {8301} and {got[20_000 + i] for i in range(41)} == {20_000}


def test_neighbours_with_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:40], "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("part", "order", "shelf", "score", "rank", "v")])
    got = ann.search(df).toPandas()
    assert set(got.query_id) == set(range(0, 200, 20)) and (got.query_id != got.vec_id).all() and (got.groupby("query_id").size() == 20).all()


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_recall_of_the_registered_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    assert ann.recall(queries.op5_nearest_neighbours(spark, sf_dir), vectors) >= 0.9
    assert 0 < ann.scored_share(vectors) <= 1


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_registered_query_runs_whole(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    n, docs, pages = got.count(), table(spark, sf, "documents").count(), table(spark, sf, "pages").count()
    if name.startswith("op1_"):
        assert n == pages
    elif name.startswith(("op5_", "op12_")):
        assert n > 0
    elif name.startswith("op11_"):
        assert n == 16 * table(spark, sf, "embeddings").count()
    elif name.startswith("op7_"):
        assert got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n = m").count() == docs
    else:
        assert n == docs
    assert shared_dir(spark)


def test_language_training_is_bounded_in_total(spark):
    rows = [(i, f"l{i % 40}", "word " * (20 + i % 7), "s", 1) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_chars long")
    some = langid.training_rows(docs, 30, 1000, max_total=16_000).collect()
    assert sum(len(r.text) for r in some) <= 16_000 and {r.lang for r in some} == {f"l{i}" for i in range(40)}
    assert langid.training_rows(docs, 30, 1000, max_rows=40).count() == 40
    assert langid.training_rows(docs, 30, 1000, max_rows=7).count() == 7


@pytest.mark.parametrize(
    "text,want",
    [
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option", ["Apache-2.0", "MIT"]), ("Dual licensed under the MIT and GPL licenses", ["MIT", "GPL"]), ("Released under the GPLv3", ["GPL-3.0"]), ("Distributed under the BSD license", ["BSD-3-Clause"]),
        ("license: MIT", ["MIT"]), ('license = "Apache-2.0"', ["Apache-2.0"]), ("License: EPL-2.0", ["EPL-2.0"]), ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("x\nSPDX-License-Identifier: MIT\n// SPDX-License-Identifier: GPL-2.0-only OR ISC", ["MIT", "GPL-2.0-only OR ISC"]),
        ("This is not licensed under the MIT License.", []), ("It isn't licensed under the GPL.", []), ("no longer released under the MIT License", []), ("The driving license and MIT were far.", []), ("He studied at MIT; a license of the ISC.", []), ("", []), (None, []),
        (textwrap.fill(licenses.TWO_CLAUSES + licenses.THIRD_CLAUSE, 72), ["BSD-3-Clause"]), ("prose " * 300_000 + "licensed under the MIT License " + "and on " * 300_000, ["MIT"]),
    ],
)
def test_all_licences_of_a_text(text, want):
    assert matcher().text(text)[5] == want


def test_licence_query_against_brute_force_on_a_tree(spark):
    """Own licences by plain comparison of every stretch with every notice, inherited ones by walking up."""
    files = {"LICENSE": "Released under the MIT License.", "a/x.py": "code", "a/b/COPYING": textwrap.fill(licenses.TWO_CLAUSES, 60), "a/b/y.py": "more code", "a/b/c/z.py": None, "a/b/c/own.py": "SPDX-License-Identifier: ISC\n" + "x = call(y)\n" * 20, "d/e.py": "not licensed under the GPL", "d/NOTICE.txt": "Licensed under the Apache License, Version 2.0.", "d/f/g.py": "prose"}
    rows = [(i, p, t) for i, (p, t) in enumerate(files.items())]
    m = matcher()

    def own(text):
        words = licenses.words_of(text or "")
        tag = licenses.SPDX.search(text or "")
        if tag:
            return tag.group(1)
        best = (0.0, None)
        for t, name in enumerate(m.names):
            size = m.vectors[t][1]
            for a in range(max(1, len(words) - size + 1)):
                if t not in m.short and words and not (size < licenses.SHORT and "not" in words[max(0, a - 3) : a]) and (c := m._cosine(words[a : a + size], t)) >= 0.8:
                    best = max(best, (size * round(c, 9) ** 20, name), key=lambda x: x[0])
        return best[1]

    def inherited(path):
        folder = path.rpartition("/")[0]
        while True:
            for name in ("LICENSE", "COPYING", "NOTICE.txt"):
                found = files.get(f"{folder}/{name}".lstrip("/"))
                if found:
                    return own(found)
            if not folder:
                return None
            folder = folder.rpartition("/")[0]

    want = {p: (own(t), "own") if own(t) else (inherited(p), "inherited") for p, t in files.items()}
    got = {r.path: (r.licence, r.basis) for r in licenses.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == want

"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are whole notices, whole short licences and the sentences by which texts name
a licence.  Where a text holds a telling word of a template, the stretch of as many words
as the template has, laid so that the two words meet, is compared with it, across line
ends and inside lines: a header that is wrapped, quoted or followed by other words is
compared as a unit, and so is a licence file.  A stretch's vector has the weights (term
frequency times inverse document frequency) of its words; document frequencies are
counted over all documents for the templates' vocabulary, a fixed small set; words outside
it have the mean weight of that vocabulary, whatever the number of documents.  An SPDX
tag is evidence of its own.  Of the cosines of at least `threshold` the one with most
evidence decides, a template's words times the cosine's 20th power, so that a whole
licence beats a beginning that it shares with another; then the earlier place.  A mere reservation of all rights
counts only in texts that hold no licence.

A file without a licence takes that of its nearest ancestor directory that has a
licence file: a file named LICENSE, LICENCE, COPYING or NOTICE (with any ending), or one
most of whose words stand in stretches that match.  Ancestors are exploded into rows and
joined by path; sums and choices combine before shuffles, and files of a folder that holds
more than a thousandth of all are dealt over several tasks.

A name alone ("MIT", "GPLv3") is compared like a template, but counts only behind a head word (licensed under, released under,
license: and the like), with nothing but joining words and other names between; so dual
licences and short forms are found, and mentions are not.  A sentence or name that a word before it denies ("is
not licensed under") is none.  `all` lists every licence of a text once, in the order of their places: those of all SPDX
tags, and of the stretches left when each covers its words before weaker ones do.

Defined results: null and empty texts have no own licence but can inherit; very long texts
are read whole, in time proportional to their length and telling words; a null path
neither gives nor inherits; several licence files in a directory: the best cosine, ties
by licence name then by path; repeated rows are treated alike; an empty table gives no
rows; columns other than doc_id, path and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, hot_keys, map_rows, spread_join

WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
TWO_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
THIRD_CLAUSE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(kind: str, what: str, version: str) -> tuple[str, ...]:
    """The notice of a GNU licence, as its own text recommends it, and shorter forms."""
    name, it = f"GNU {kind}General Public License", f"This {what} is free software"
    grant = f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
    return (
        f"{it}; {grant}; either version {version} of the License, or (at your option) any later version.",
        f"{it}: {grant}, either version {version} of the License, or (at your option) any later version.",
        f"{it}; {grant}; version {version} of the License.",
        f"This work is licensed under the {name}, version {version}.",
        f"licensed under the {name} version {version}",
        f"released under the {name} version {version}",
        f"under the terms of the {name} version {version}",
    )


#: texts of well-known public licences; fixed values
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "released under the Apache License Version 2.0", "under the terms of the Apache License Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    "MIT": ("Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT License.", "distributed under the MIT License", "under the terms of the MIT License", GRANT, GRANT + ": The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    "GPL-3.0": (*_gnu("", "program", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright Free Software Foundation"),
    "GPL-2.0": (*_gnu("", "program", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright Free Software Foundation"),
    "LGPL-3.0": (*_gnu("Lesser ", "library", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright Free Software Foundation"),
    "LGPL-2.1": (*_gnu("Lesser ", "library", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright Free Software Foundation"),
    "AGPL-3.0": (*_gnu("Affero ", "program", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright Free Software Foundation"),
    "BSD-3-Clause": (TWO_CLAUSES + THIRD_CLAUSE, "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "BSD-2-Clause": (TWO_CLAUSES, "Licensed under the BSD 2-Clause License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "licensed under the Mozilla Public License Version 2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Creative Commons Legal Code CC0 1.0 Universal"),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",),
}
#: names by which a text puts itself under a licence; they count behind a head word only
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache License v2"),
    "MIT": ("MIT License", "MIT"),
    "GPL-3.0": ("GPLv3", "GPL v3", "GPL-3.0", "GPL 3.0", "GPL version 3", "GNU General Public License version 3"),
    "GPL-2.0": ("GPLv2", "GPL v2", "GPL-2.0", "GPL 2.0", "GPL version 2", "GNU General Public License version 2"),
    "GPL": ("GPL", "GNU General Public License"),
    "LGPL-3.0": ("LGPLv3", "LGPL v3", "LGPL-3.0"),
    "LGPL-2.1": ("LGPLv2.1", "LGPL v2.1", "LGPL-2.1"),
    "AGPL-3.0": ("AGPLv3", "AGPL v3", "AGPL-3.0"),
    "BSD-3-Clause": ("BSD License", "BSD", "BSD 3-Clause", "BSD-3-Clause", "new BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause", "BSD-2-Clause", "simplified BSD License"),
    "MPL-2.0": ("MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("EPL 2.0", "EPL-2.0", "Eclipse Public License 2.0"),
    "BSL-1.0": ("Boost Software License", "BSL-1.0"),
    "CC0-1.0": ("CC0", "CC0-1.0", "CC0 1.0 Universal"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "zlib"),
}
HEADS = frozenset("license licence licensed licenced released distributed dual-licensed relicensed".split())
LINKS = frozenset("under the a an of either both or and terms to you may choose at your option licenses dual as is this".split())
NOT = frozenset("not no never neither without longer isn't".split())
REACH = 12  # words between a head word and a name
SHORT = 14  # a template of fewer words is a sentence, which a word before it can deny
RESERVED = re.compile(r"\ball\s+rights\s+reserved\b", re.I)
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9][A-Za-z0-9.+-]*)*)")
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"
SCHEMA = "doc_id long, path string, own string, score double, line int, licence_words long, n_words long, all array<string>"


def words_of(line: str) -> list[str]:
    return WORD.findall(line.lower())


def vocabulary(templates: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({w for texts in templates.values() for t in texts for w in words_of(t)})


def document_frequencies(docs: DataFrame, vocab: list[str]) -> tuple[dict[str, int], int]:
    """How many documents hold each word of `vocab`, over all documents; one number a word reaches the driver."""

    def start():
        known = set(vocab)

        def step(batch: pa.RecordBatch) -> dict:
            tally: dict[str, int] = {"": batch.num_rows}
            for text in batch.column(0).to_pylist():
                for w in known.intersection(words_of(text)) if text else ():
                    tally[w] = tally.get(w, 0) + 1
            return {"w": list(tally), "n": list(tally.values())}

        return step

    rows = map_rows(docs.select("text"), "w string, n long", start).groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {r["w"]: r["n"] for r in rows}
    return found, found.pop("", 0)


class Matcher:
    """Cosine of stretches of a text to templates.

    A template's telling words are its `n_telling` rarest; where one stands in a text, the
    stretch that lines up with the template is compared, if it holds most of them.
    """

    def __init__(self, templates: dict[str, tuple[str, ...]], df: dict[str, int], n_docs: int, threshold: float, n_telling: int = 3, names: dict[str, tuple[str, ...]] = NAMES):
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) + 1.0 for w in vocabulary(templates)}
        seldom = {w: -df.get(w, 0) for w in vocabulary(names)}
        self.unknown = sum(self.idf.values()) / max(1, len(self.idf))  # bounded, so that a strange word costs the same in any corpus
        self.threshold = threshold
        self.names: list[str] = []
        self.vectors: list[tuple[dict[str, float], int, list[str]]] = []  # unit vector, words, telling words
        self.telling: dict[str, list[tuple[int, int]]] = {}  # word -> (template, place in it)
        self.short: set[int] = set()  # templates that are names
        texts = [(n, x, False) for n in sorted(templates) for x in templates[n]] + [(n, x, True) for n in sorted(names) for x in names[n]]
        self.named = {w for _, x, short in texts if short for w in words_of(x)}
        for name, text, short in texts:
            words = words_of(text)
            if short:
                self.short.add(len(self.names))
            if words:
                v = self._vector(words)
                norm = math.sqrt(sum(x * x for x in v.values()))
                t = len(self.names)
                rare = [max(v, key=lambda w: (seldom[w], len(w), w))] if short else sorted(v, key=lambda w: (-self.idf[w], w))[:n_telling]
                self.names.append(name)
                self.vectors.append(({w: x / norm for w, x in v.items()}, len(words), rare))
                for w in rare:
                    self.telling.setdefault(w, []).append((t, words.index(w)))

    def _vector(self, words: list[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        for w in words:
            out[w] = out.get(w, 0.0) + self.idf.get(w, self.unknown)
        return out

    def _cosine(self, words: list[str], t: int) -> float:
        v, unit = self._vector(words), self.vectors[t][0]
        norm = math.sqrt(sum(x * x for x in v.values()))
        return sum(x * unit[w] for w, x in v.items() if w in unit) / norm if norm else 0.0

    def line(self, line: str) -> tuple[float, str, int]:
        """(cosine, licence, words) of a whole stretch against the best template, or (0, '', words)."""
        words = words_of(line)
        score, t = max(((self._cosine(words, t), -t) for t in range(len(self.names)) if t not in self.short), default=(0.0, 0))
        return (score, self.names[-t], len(words)) if score >= self.threshold and score > 0 else (0.0, "", len(words))

    def _denied(self, words: list[str], a: int, own: dict[str, float] | None = None, size: int = 0) -> bool:
        """Whether a word just before a place, or in the stretch of `size` words there and not in its template `own`, denies it."""
        near = [w for w in words[max(0, a - 3) : a + size] if w not in (own or ())]
        return not NOT.isdisjoint(near) or any(x == "isn" and y == "t" for x, y in zip(near, near[1:], strict=False))

    def _headed(self, words: list[str], a: int) -> bool:
        """Whether a head word stands before a place, with joining words and names only between, that nothing denies."""
        for k in range(a - 1, max(-1, a - 1 - REACH), -1):
            noun = words[k] in ("license", "licence")
            if words[k] in HEADS and (k == a - 1 or not noun):
                return (k == a - 1 or "under" in words[k:a]) and not self._denied(words, k)
            if words[k] not in LINKS and words[k] not in self.named:
                return False
        return False

    def text(self, text: str | None) -> tuple[str | None, float, int | None, int, int, list[str]]:
        """Own licence, cosine, line number, words in stretches that match, words, all licences."""
        text = text or ""
        low = text.lower()
        words = WORD.findall(low)
        n = len(words)
        tags = list(SPDX.finditer(text)) if "SPDX" in text else []
        found: list[tuple] = []  # (evidence, cosine, minus place, licence, end)
        spans: list[int] = []
        if tags or not self.telling.keys().isdisjoint(words):
            spans = [m.start() for m in WORD.finditer(low)]
        for tag in tags:
            k = next((i for i, at in enumerate(spans) if at >= tag.start()), 0)
            found.append((math.inf, 1.0, -k, " ".join(tag.group(1).split()), k + len(words_of(tag.group()))))
        if spans:
            seen = set()
            for i, w in enumerate(words):
                for t, place in self.telling.get(w, ()):
                    _, size, rare = self.vectors[t]
                    a = max(0, i - place)
                    if (t, a) in seen:
                        continue
                    seen.add((t, a))
                    stretch = words[a : a + size]
                    if 2 * len(stretch) < size or 2 * sum(r in stretch for r in rare) <= len(rare):
                        continue
                    if (score := self._cosine(stretch, t)) < (0.999 if t in self.short else self.threshold):
                        continue
                    if not self._headed(words, a) if t in self.short else size < SHORT and self._denied(words, a, self.vectors[t][0], len(stretch)):
                        continue
                    found.append((size * round(score, 9) ** 20, round(score, 9), -a, self.names[t], a + len(stretch)))
        if not found:
            held = RESERVED.search(low)
            return ("Proprietary", self.threshold, low.count("\n", 0, held.start()) + 1, 0, n, ["Proprietary"]) if held else (None, 0.0, None, 0, n, [])
        best = max(found)
        inside, end = 0, 0
        for a, b in sorted((-f[2], f[4]) for f in found):
            inside += max(0, b - max(a, end))
            end = max(end, b)
        return best[3], best[1], low.count("\n", 0, spans[-best[2]]) + 1, inside, n, self._all(found)

    def _all(self, found: list[tuple]) -> list[str]:
        """Licences of the stretches that no stronger one overlaps, each once, by place."""
        taken: list[tuple[int, int, str]] = []
        covered: set[int] = set()
        for _, _, minus, name, end in sorted(found, reverse=True):
            place = range(-minus, end)
            if covered.isdisjoint(place):
                covered.update(place)
                taken.append((-minus, end, name))
        return list(dict.fromkeys(name for _, _, name in sorted(taken)))


def own_licences(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """SCHEMA for each row of `files` (doc_id, path, text)."""
    df, n_docs = document_frequencies(files, vocabulary(templates) + vocabulary(NAMES))

    def start():
        m = Matcher(templates, df, n_docs, threshold)

        def step(batch: pa.RecordBatch) -> dict:
            got = [m.text(t) for t in batch.column(2).to_pylist()]
            return {"doc_id": batch.column(0), "path": batch.column(1), "own": [g[0] for g in got], "score": [g[1] for g in got], "line": [g[2] for g in got], "licence_words": [g[3] for g in got], "n_words": [g[4] for g in got], "all": [g[5] for g in got]}

        return step

    return map_rows(files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "text"), SCHEMA, start)


def licences(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8, file_share: float = 0.5) -> DataFrame:
    """doc_id, path, licence, basis ('own', 'inherited', 'none'), score, line, from_dir, all (licences of the text itself) per row of `files` (doc_id, path, text)."""
    own = cut(own_licences(files, templates, threshold), "licences-own")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    gives = own.where(F.col("own").isNotNull() & F.col("path").isNotNull() & (base.rlike(LICENCE_FILE) | (F.col("licence_words") > file_share * F.col("n_words"))))
    by_dir = gives.groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("neg"), "own", "path")).alias("g")).select("dir", F.col("g.own").alias("dir_licence"))
    # distinct folders, not files, are exploded into their ancestors
    folders = own.where(F.col("own").isNull() & F.col("path").isNotNull()).select(folder.alias("folder")).distinct()
    steps = F.expr("transform(sequence(0, size(split(folder, '/'))), n -> array_join(slice(split(folder, '/'), 1, n), '/'))")
    near = (
        folders.select("folder", F.explode(steps).alias("dir"))
        .join(by_dir, "dir")
        .groupBy("folder")
        .agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "dir_licence")).alias("m"))
        .select("folder", F.col("m.dir").alias("from_dir"), F.col("m.dir_licence").alias("dir_licence"))
    )
    placed = own.withColumn("folder", F.when(F.col("own").isNull(), folder))
    # files without a licence of a folder that holds many are dealt over tasks; a null folder meets nothing
    hot = hot_keys(placed.where("folder is not null").groupBy("folder").agg(F.count("*").alias("n")), "folder", own.count())
    out = spread_join(placed.withColumn("folder", F.coalesce("folder", F.concat(F.lit("\u0000"), F.pmod(F.monotonically_increasing_id(), F.lit(1000)).cast("string")))), near, "folder", hot, "left")
    basis = F.when(F.col("own").isNotNull(), "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", "dir_licence").alias("licence"), basis.alias("basis"), "score", "line", "from_dir", "all")


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/thousands of doc_id/doc_id.txt."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")

r"""Spelling variants: errata tries over groups of words, light subtrees merged small to large.

Words are counted in tasks, with a bounded table of counts a task, and summed.  Two words are near if
one inserted, deleted or replaced code point turns one into the other.  Such an edit lies in
one half of the shorter word, so the other half is equal in both: a word joins the groups of its
halves, once as the shorter and once as the longer of a pair.  A group that is too
large is cut again by the halves of what is not equal yet, until one code point is left; so
no group outgrows a task, however many words share a beginning.

In a group the parts that differ make a trie.  At every node the heaviest child stays; light
subtrees are merged into it and into one another with the first character replaced, and into the
node itself with it skipped.  Terminals that coincide are near words.  A node is merged as a part
of a light subtree only, at most log2(n) times.

A word's form is its near word of largest count, if that is at least `ratio` times its own; following forms
multiplies the count each time, so chains are short, and roots are found by as many joins.

Defined results: null and empty texts have no words; a null doc_id is written `null` where
the id enters the checksum; runs are whole, however long; ties of counts go to the smaller word in
code-point order; repeated rows count each; an empty table gives no rows; columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .util import bounded_batches, cut, hot_keys, spread_join

RUN = re.compile("[a-zÀ-ÿ]+")  # after A-Z are lower-cased
ERROR_ONE_IN = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
HELD = 500_000  # words a task counts before it sends them
GROUP, LETTERS = 4096, 1 << 18  # words, and letters not known to be equal, of a group


def doc_words(doc_id: int | None, text: str | None, least_length: int = LEAST_LENGTH, one_in: int = ERROR_ONE_IN) -> Counter:
    """Counts of the words of one text, of at least `least_length` code points."""
    found: Counter = Counter()
    if not text:
        return found
    lead = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes.lower changes A-Z only
        if len(run) >= least_length:
            h = zlib.crc32(run.encode(), lead)
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least_length:
                    continue
            found[run] += n
    return found


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of `docs` (doc_id, text) that occur often enough."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> Iterator[pa.RecordBatch]:
            words, counts = list(held), list(held.values())
            held.clear()
            for at in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 16)], pa.string()), pa.array(counts[at : at + (1 << 16)], pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update(doc_words(doc_id, text, least_length))
                if len(held) >= HELD:
                    yield from send()
        yield from send()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """A trie of distinct strings; `near` gives the pairs one edit apart."""

    def __init__(self, words: list[str]):
        self.kids: list[dict[str, int]] = [{}]
        self.term = [-1]
        self.length = list(map(len, words))
        for i, word in enumerate(words):
            at = 0
            for c in word:
                nxt = self.kids[at].get(c)
                if nxt is None:
                    nxt = self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.term.append(-1)
                at = nxt
            self.term[at] = i
        self.size = [1] * len(self.kids)
        for at in range(len(self.kids) - 1, -1, -1):  # children have larger numbers
            self.size[at] += sum(self.size[k] for k in self.kids[at].values())

    def _coinciding(self, light: int, other: int) -> Iterator[tuple[int, int]]:
        """Terminals at equal paths below two nodes; walks the first one's subtree."""
        kids, term = self.kids, self.term
        stack = [(light, other)]
        while stack:
            a, b = stack.pop()
            if term[a] >= 0 and term[b] >= 0:
                yield term[a], term[b]
            below = kids[b]
            stack += [(k, below[c]) for c, k in kids[a].items() if c in below]

    def _replaced(self, lights: list[int], heavy: int) -> Iterator[tuple[int, int]]:
        """Light subtrees merged, largest first, into the heavy one and into one another, their first characters being equal now."""
        kids, term = self.kids, self.term
        merged: tuple[dict, list] = ({}, [])
        for light in lights:
            stack: list = [(light, merged, heavy)]
            while stack:
                a, (spots, ends), b = stack.pop()
                if term[a] >= 0:
                    if b is not None and term[b] >= 0:
                        yield term[a], term[b]
                    for other in ends:
                        yield term[a], other
                    ends.append(term[a])
                for c, k in kids[a].items():
                    spot = spots.get(c)
                    if spot is None:
                        spot = spots[c] = ({}, [])
                    stack.append((k, spot, kids[b].get(c) if b is not None else None))

    def near(self) -> Iterator[tuple[int, int]]:
        """Pairs of places of words one edit apart; a pair may come twice."""
        for at, below in enumerate(self.kids):
            if not below:
                continue
            (_, heavy), *lights = sorted(below.items(), key=lambda p: -self.size[p[1]])
            if len(lights) == 1:
                yield from self._coinciding(lights[0][1], heavy)
            elif lights:
                yield from self._replaced([k for _, k in lights], heavy)
            # skipped: a light first character, then the heavy one
            for _, light in lights:
                yield from self._coinciding(light, at)
            if self.term[at] >= 0 and self.term[heavy] >= 0:
                yield self.term[heavy], self.term[at]
            for c, light in lights:
                if c in self.kids[heavy]:
                    yield from self._coinciding(light, self.kids[heavy][c])


def _halves(short: Column, pre: Column, post: Column) -> Column:
    """(pre, post) of the two groups in which a word's next half is equal as well; `short` is the length of the shorter words."""
    word, middle = F.col("word"), short - F.length(pre) - F.length(post)
    half = F.floor(middle / 2).cast("int")
    first = F.struct(F.concat(pre, F.substring(word, F.length(pre) + 1, half)).alias("pre"), post.alias("post"))
    rest = (middle - half).cast("int")
    second = F.struct(pre.alias("pre"), F.concat(F.substring(word, F.length(word) - F.length(post) - rest + 1, rest), post).alias("post"))
    return F.array(first, second)


def _grouped(rows: DataFrame) -> DataFrame:
    """`rows` (word, n, short, pre, post) in the groups of the next halves, with the group's name g."""
    halved = rows.withColumn("half", F.explode(_halves(F.col("short"), F.col("pre"), F.col("post"))))
    got = halved.select("word", "n", "short", F.col("half.pre").alias("pre"), F.col("half.post").alias("post"))
    return got.withColumn("g", F.concat_ws("|", F.col("short").cast("string"), "pre", "post"))  # | is in no word


def groups(words: DataFrame, group: int = GROUP, letters: int = LETTERS) -> DataFrame:
    """g, short, lead, trail, word, n: words in groups that hold every near pair; lead and trail count equal code points."""
    out = None
    rows = words.withColumn("short", F.explode(F.array(F.length("word"), F.length("word") - 1))).withColumn("pre", F.lit("")).withColumn("post", F.lit(""))
    while True:
        rows = cut(_grouped(rows), "spelling-groups")
        loose = F.length("word") - F.length("pre") - F.length("post")
        sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum(loose).alias("letters"), F.min(loose).alias("middle"), F.max((F.length("word") == F.col("short")).cast("int")).alias("shorter"))
        # a group of one word, or without a word of the shorter length, has no pair of its own
        sizes = cut(sizes.where("n > 1 and shorter = 1"), "spelling-sizes")
        large = ((F.col("n") > group) | (F.col("letters") > letters)) & (F.col("middle") > 1)
        joined = spread_join(rows, sizes.select("g", large.alias("large")), "g", hot_keys(sizes, "g", max(1, rows.count())))
        small = joined.where("not large").select("g", "short", F.length("pre").alias("lead"), F.length("post").alias("trail"), "word", "n")
        out = small if out is None else out.unionAll(small)
        if not sizes.where(large).limit(1).count():
            return out
        rows = joined.where("large").select("word", "n", "short", "pre", "post")


def near_pairs(words: DataFrame, group: int = GROUP, letters: int = LETTERS) -> DataFrame:
    """word, n, near, near_n: every near pair of `words` (word, n), both ways, once."""
    bounded_batches(words.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def pairs(members: list[tuple]) -> Iterator[pa.RecordBatch]:
        short, lead, trail = members[0][:3]
        loose = short - lead - trail
        trie = Trie([w[lead : len(w) - trail] for *_, w, _ in members])
        found = {(min(p), max(p)) for p in trie.near() if min(trie.length[p[0]], trie.length[p[1]]) == loose}
        both = [p for i, j in found for p in ((i, j), (j, i))]
        for at in range(0, len(both), 1 << 16):
            part = both[at : at + (1 << 16)]
            names, counts = [m[3] for m in members], [m[4] for m in members]
            yield pa.RecordBatch.from_pydict({"word": [names[i] for i, _ in part], "n": [counts[i] for i, _ in part], "near": [names[j] for _, j in part], "near_n": [counts[j] for _, j in part]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, members = None, []
        for batch in batches:
            for g, *member in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if g != name and members:
                    yield from pairs(members)
                    members = []
                name = g
                members.append(tuple(member))
        if members:
            yield from pairs(members)

    met = groups(words, group, letters).repartition("g").sortWithinPartitions("g")  # groups are bounded
    return met.mapInArrow(run, "word string, n long, near string, near_n long").dropDuplicates(["word", "near"])


def variants(docs: DataFrame, ratio: int = RATIO, group: int = GROUP, letters: int = LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of `docs` (doc_id, text)."""
    words = cut(vocabulary(docs), "spelling-words")
    best = near_pairs(words, group, letters).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    strong = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    forms = cut(
        words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")),
        "spelling-forms",
    )
    up = forms.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("next"))
    roots = rooted(forms.where("form is not null").select("word", F.col("form").alias("at")), up)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def rooted(steps: DataFrame, up: DataFrame) -> DataFrame:
    """word, root: the end of the chain `up` (at, next) from where `steps` (word, at) stand; a round a link."""
    spark = steps.sparkSession
    out = spark.createDataFrame([], StructType([steps.schema["word"]]).add("root", "string"))
    while True:
        total = steps.count()
        if not total:
            return out
        hot = hot_keys(steps.groupBy("at").agg(F.count("*").alias("n")), "at", total)
        moved = cut(spread_join(steps, up, "at", hot, "left"), "spelling-roots")
        out = out.unionAll(moved.where("next is null").select("word", F.col("at").alias("root")))
        steps = moved.where("next is not null").select("word", F.col("next").alias("at"))

"""Toxicity: Levenshtein automata over a learned lexicon, scored in context.

The lexicon is a small seed of English insults plus words and stems whose documents
are toxic far more often than others in a bounded sample of labelled rows.  Its trie is
intersected with Levenshtein automata: a state is a set of (trie node, edits so far),
built only when a text first reaches it, so each word of a text costs one dictionary
step per character and most words leave the automaton after a few.

Every hit is read in a window of words: quotation marks around it, reporting verbs and
negation near it speak for quotation, words of address for abuse.  Sums over the whole
text go into a logistic model fitted on the same sample; its prior already ranks abuse
above quotation, so that few labels are enough.

Whole terms and stems are both matched with edits: a stem accepts every word of which a
beginning is close enough to it.

Bounds, all parameters: `max_train` labelled rows (by a hash of doc_id), `max_terms`
lexicon entries; a worker remembers at most `max_words` verdicts and `max_states` states
and builds further ones anew.  Everything else runs over whole texts of all documents.

Defined results: null and empty texts score as texts without hits; very long texts are
read whole, in time proportional to their length; a null doc_id is
kept and counts as held out by the rule crc32 of a null (not learned from); several
labels for one id count as toxic if any is; of several texts of one id that with the
least hash is learned from; null labels are ignored; equal term weights go by the term;
repeated rows score alike; without usable labels the prior model is used; an empty table
gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut, filter_texts, map_rows

#: common English insults to start from; fixed values
SEED_TERMS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "worthless", "pathetic", "disgusting", "loser", "losers", "imbecile", "retard", "bastard", "asshole", "bitch", "dumbass", "vermin")
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes according cited claims claimed word term dit écrit appelé selon sagte schrieb nannte laut dijo escribió llamó según".split())
NEGATION = frozenset("not no never isn't don't wasn't pas jamais nicht nie kein nunca jamás".split())
ADDRESS = frozenset("you your you're u ya tu toi vous du dich ihr sie usted vos eres are is".split())
OPENERS, CLOSERS = "\"“«„", "\"”»“"
QUOTED = re.compile("[" + OPENERS + "][^" + CLOSERS + "]*+[" + CLOSERS + "]")
TOKEN = re.compile(r"\w(?:[\w@$*'’-]*\w)?")
WINDOW = 6
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_exact int, n_fuzzy int, n_quoted int, terms array<string>"
FEATURES = ("bias", "any", "abuse_exact", "abuse_fuzzy", "quoted", "evidence", "density", "address")
PRIOR = np.array([-3.5, 1.5, 0.8, 0.4, 0.2, 0.5, 0.3, 0.2])
SEED_WEIGHT = 3.0


class Automaton:
    """Trie of terms intersected with Levenshtein automata, made deterministic as texts need it.

    terms: (text, is_stem, edits).  A whole term accepts words within `edits` insertions,
    deletions, substitutions or swaps of neighbours; a stem accepts words with a beginning
    within `edits` of it.  `match` gives (term index, edits used) or None; least edits
    first, then the lower index.  Beyond `max_states` states the machine starts anew.
    """

    def __init__(self, terms: list[tuple[str, bool, int]], max_states: int = 300_000):
        self.terms = terms
        self.max_states = max_states
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.most: list[int] = [0]
        for k, (text, is_stem, edits) in enumerate(terms):
            node, path = 0, [0]
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(-1)
                    self.stem.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                path.append(node)
            target = self.stem if is_stem else self.whole
            if target[node] < 0:
                target[node] = k
            for n in path:
                self.most[n] = max(self.most[n], edits)
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.known: dict[tuple, int] = {}
        self.found: list[tuple[int, int] | None] = []  # (edits, term) of whole terms that end here
        self.begun: list[tuple[int, int] | None] = []  # and of stems that are complete here
        self.start = self._state({(0, 0, ""): None})

    def _state(self, items) -> int:
        """Close over deletions and drop items that another dominates; -1 is the dead state."""
        best: dict[tuple[int, str], int] = {}
        todo = [(n, e, s) for n, e, s in items]
        while todo:
            n, e, swap = todo.pop()
            if best.get((n, swap), 99) <= e:
                continue
            best[n, swap] = e
            if not swap and e < self.most[n]:
                todo += [(c, e + 1, "") for c in self.children[n].values() if e + 1 <= self.most[c]]
        if not best:
            return -1
        key = tuple(sorted((n, e, s) for (n, s), e in best.items()))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            for kind, out in ((self.whole, self.found), (self.stem, self.begun)):
                out.append(min(((e, kind[n]) for n, e, s in key if not s and kind[n] >= 0 and e <= self.terms[kind[n]][2]), default=None))
        return self.known[key]

    def _step(self, state: int, c: str) -> int:
        out = []
        for n, e, swap in self.states[state]:
            if swap:  # the second half of a swap: `swap` must come now
                if c == swap[0]:
                    out.append((int(swap[1:]), e, ""))
                continue
            for d, child in self.children[n].items():
                if d == c:
                    out.append((child, e, ""))
                elif e < self.most[child]:
                    out.append((child, e + 1, ""))
                    after = self.children[child].get(c)
                    if after is not None and e < self.most[after]:
                        out.append((n, e + 1, f"{d}{after}"))
            if e < self.most[n]:
                out.append((n, e + 1, ""))
        got = self.steps[state][c] = self._state(out)
        return got

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.states) > self.max_states:
            self._reset()
        state, best = self.start, None
        for c in word:
            got = self.steps[state].get(c)
            state = self._step(state, c) if got is None else got
            if state < 0:
                break
            begun = self.begun[state]
            if begun is not None and (best is None or begun < best):
                best = begun
        whole = self.found[state] if state >= 0 else None
        if whole is not None and (best is None or whole < best):
            best = whole
        return best[::-1] if best else None


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Scanner:
    """Features of whole texts; remembers the verdict on up to `max_words` distinct words.

    terms: (text, is_stem, edits, weight); the weight is the log odds a hit speaks for.
    """

    def __init__(self, terms: list[tuple[str, bool, int, float]], max_words: int = 400_000):
        self.auto = Automaton([t[:3] for t in terms])
        self.weight = [t[3] for t in terms]
        self.memo: dict[str, object] = {}
        self.max_words = max_words

    def _look(self, word: str):
        got = self.auto.match(word) or False
        if len(self.memo) < self.max_words:
            self.memo[word] = got
        return got

    def hits(self, low: str) -> tuple[list[str], list[tuple[int, int, int]]]:
        """Tokens of the lower-cased text and (token, term, edits) of each hit."""
        tokens = TOKEN.findall(low)
        seen = list(map(self.memo.get, tokens))
        if None in seen:
            look = self._look
            seen = [look(w) if v is None else v for v, w in zip(seen, tokens, strict=True)]
        if not any(seen):
            return tokens, []
        return tokens, [(i, *v) for i, v in enumerate(seen) if v]

    def features(self, text: str | None) -> tuple[list[float], int, int, int, list[str]]:
        low = (text or "").lower()
        tokens, hits = self.hits(low)
        if not hits:
            return [1.0] + [0.0] * 7, 0, 0, 0, []
        inside = quoted_tokens(low)
        exact = fuzzy = reported = near = 0.0
        n_quoted = 0
        terms: dict[int, float] = {}
        for i, k, edits in hits:
            around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            q = 0.8 * (i in inside) + 0.3 * any(w in REPORTING for w in around) + 0.15 * any(w in NEGATION for w in around)
            q = min(1.0, q)
            near += any(w in ADDRESS for w in around[max(0, min(i, WINDOW) - 3) :])
            reported += q
            terms[k] = max(terms.get(k, 0.0), self.weight[k] * (1 - q) * (0.6 if edits else 1.0))
            n_quoted += q >= 0.5
            if edits:
                fuzzy += 1 - q
            else:
                exact += 1 - q
        row = [1.0, 1.0 - min(1.0, reported / len(hits)), math.log1p(exact), math.log1p(fuzzy), math.log1p(reported), min(12.0, sum(terms.values())), math.log1p(100 * len(hits) / len(tokens)), math.log1p(near)]
        return row, sum(not e for *_, e in hits), sum(e > 0 for *_, e in hits), n_quoted, sorted(self.auto.terms[k][0] for k in terms)


def quoted_tokens(low: str) -> set[int]:
    """Numbers of the tokens between quotation marks on one line."""
    if not any(c in low for c in "\"“«„"):
        return set()
    out, n = set(), 0
    for line in low.split("\n"):
        spans = iter([m.span() for m in QUOTED.finditer(line)])  # in order, apart from one another
        a, b = next(spans, (0, 0))
        for m in TOKEN.finditer(line):
            while b and b <= m.start():
                a, b = next(spans, (0, 0))
            if b and a < m.start() and m.end() <= b:
                out.add(n)
            n += 1
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """doc_id, text, y of at most `max_train` labelled ids that are not held out."""
    ids = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    # at most max_train rows of two numbers, so the broadcast is bounded
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")


def learn_terms(train: DataFrame, max_terms: int) -> list[tuple[str, bool, float]]:
    """Words and stems (word, is_stem, log odds) that mark toxic documents in the sample, best first.

    A term must stand in four toxic documents at least and be so one-sided that chance,
    over as many terms as were tried, is an unlikely reason.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}]{4,}"), 0))
    stems = F.expr("array_distinct(flatten(transform(w, x -> transform(sequence(4, least(7, greatest(4, length(x) - 1))), n -> substr(x, 1, n)))))")
    base = train.select("y", words.alias("w")).where("y is not null")
    counts = base.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    n, pos = counts["n"], counts["pos"] or 0
    if not pos or pos == n:
        return []
    keys = base.select("y", F.explode(F.concat(F.transform("w", lambda x: F.concat(x, F.lit(" "))), stems)).alias("k"))
    tally = keys.groupBy("k").agg(F.count("*").alias("df"), F.sum("y").alias("p")).where("p >= 4 and p >= 0.6 * df")
    rate = pos / n
    p, m = F.col("p"), F.col("df") - F.col("p")
    share = (p + 0.5) / (F.col("df") + 1)
    llr = p * F.log(share / rate) + m * F.log((1 - share) / (1 - rate))
    floor = math.log(n) + 4.0
    top = tally.withColumn("llr", llr).where(F.col("llr") > floor).orderBy(F.desc("llr"), F.desc(F.length("k")), "k").limit(20 * max_terms).collect()
    out: list[tuple[str, bool, float]] = []
    support: list[int] = []
    for r in top:  # a stem covers its words and longer stems; it must say more than one of its words
        word, is_stem = r["k"].rstrip(" "), not r["k"].endswith(" ")
        if any(s and word.startswith(t) for t, s, _ in out):
            continue
        if is_stem and any(t.startswith(word) and r["p"] < 1.3 * n_t for (t, _, _), n_t in zip(out, support, strict=True)):
            continue
        odds = math.log((r["p"] + 0.5) / (r["df"] - r["p"] + 0.5)) - math.log(rate / (1 - rate))
        out.append((word, is_stem, min(6.0, odds)))
        support.append(r["p"])
        if len(out) >= max_terms:
            break
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic weights with a Gaussian prior around PRIOR, by Newton steps."""
    w = PRIOR.copy()
    strength = np.array([0.05] + [1.0] * (len(PRIOR) - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(strength), grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity_model(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, max_terms: int = 300) -> dict:
    """{"terms", "weights"} learned from the rows that are not held out."""
    train = cut(training_rows(docs, labels, max_train), "toxicity-train")
    learned = learn_terms(train, max_terms)
    seen_terms = {t for t, s, _ in learned if not s}
    terms = [(t, s, allowed_edits(t), w) for t, s, w in learned + [(t, False, SEED_WEIGHT) for t in SEED_TERMS if t not in seen_terms]]

    def start():
        scan = Scanner(terms)

        def step(batch: pa.RecordBatch) -> dict:
            got = []
            for text in batch.column(0).to_pylist():
                low = (text or "").lower()
                got.append(sorted({10 * k + e for _, k, e in scan.hits(low)[1] if e}))
            return {"y": batch.column(1), "fuzzy": got}

        return step

    # edits that mostly give words of clean texts are switched off, term by term
    seen = map_rows(train.select("text", "y"), "y int, fuzzy array<int>", start)
    tally = seen.select("y", F.explode("fuzzy").alias("k")).groupBy("k").agg(F.count("*").alias("df"), F.sum("y").alias("p")).collect()
    off = {r["k"] for r in tally if r["df"] - r["p"] >= 2 and r["p"] < 0.5 * r["df"]}
    terms = [(t, s, min([e, *(n - 1 for n in range(1, e + 1) if 10 * k + n in off)]), w) for k, (t, s, e, w) in enumerate(terms)]

    def start_features():
        scan = Scanner(terms)

        def step(batch: pa.RecordBatch) -> dict:
            return {"y": batch.column(1), "x": [scan.features(t)[0] for t in batch.column(0).to_pylist()]}

        return step

    rows = map_rows(train.select("text", "y"), "y int, x array<double>", start_features).collect()  # at most max_train short rows
    weights = PRIOR
    if rows and 0 < sum(r["y"] for r in rows) < len(rows):
        x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=float)
        order = np.lexsort([*x.T, y])  # sums do not depend on the order in which tasks end
        weights = fit(x[order], y[order])
    return {"terms": terms, "weights": [float(v) for v in weights]}


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of `docs` (doc_id, text); see SCHEMA."""
    terms, weights = model["terms"], np.array(model["weights"])

    def start():
        scan = Scanner(terms)

        def step(batch: pa.RecordBatch) -> dict:
            found = [scan.features(t) for t in batch.column(1).to_pylist()]
            z = np.clip(np.array([f[0] for f in found]) @ weights, -30, 30)
            score = 1 / (1 + np.exp(-z))
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": score, "predicted": (score >= 0.5).astype(np.int32), "n_exact": [f[1] for f in found], "n_fuzzy": [f[2] for f in found], "n_quoted": [f[3] for f in found], "terms": [f[4] for f in found]}

        return step

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")), SCHEMA, start)


def clean(docs: DataFrame, model: dict) -> DataFrame:
    """Rows of `docs`, all columns, that `toxicity` does not predict toxic."""
    terms, weights = model["terms"], np.array(model["weights"])

    def start():
        scan = Scanner(terms)
        return lambda texts: [float(np.dot(scan.features(t)[0], weights)) < 0 for t in texts]

    return filter_texts(docs, start)

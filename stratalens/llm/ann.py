"""Approximate nearest neighbours: learned partitions of a neighbour graph.

On a bounded sample the nearest-neighbour graph is cut into balanced parts: seeded by
balanced clustering, then refined by moving rows to the part most of their neighbours
are in, as capacity allows.  A small network learns which part a vector's neighbours
lie in.  Every row of the table is indexed in its most probable part; a query goes to
its `probes` most probable ones, where it meets every row, and the survivors are scored
again in double precision on the original vectors.

Small parts share a shelf; shelves are cut into chunks by row and query blocks by size,
so a part that holds a third of all rows becomes many groups; per group a task holds one
chunk and one block, and multiplies a query with the rows of the parts it probes only.
Recall against brute force is measured by `recall`, the share of rows scored by
`scored_share`; tests hold recall above 0.9 on whole tables.

Bounds, all parameters: graph and router are fitted on `fit_rows` rows (by hash); there
are an eighth as many parts, as fine parts prune best, so a larger table
wants a larger sample.  Every row is indexed.

Defined results: vectors that are null, empty, of another length than most, zero, or
hold null or non-finite components take no part, neither as query nor as candidate; very
long vectors are only slower; the rows of a query's own vec_id are left out; ties go to the smaller vec_id; if fewer than `k`
candidates exist, all are returned; null ids take no part; rows that share a vec_id are one
query, whose list holds the best of all of them, and each is a candidate for other queries;
tables of fewer than 16 usable rows are one part; an empty table gives no rows; columns other than vec_id and
embedding are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .util import cut, hash_sample, map_rows

CHUNK = 16_384
QUERY_BLOCK = 16_384
HIDDEN = 64
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(ok)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner product for every row of x, itself left out."""
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """A part for every row, each of at most slack * rows / parts rows, with few neighbours apart."""
    rng = np.random.default_rng(seed)
    n, most = len(x), math.ceil(slack * len(x) / parts)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=np.int64)
    for _ in range(8):
        s = unit @ centres.T
        order = np.argsort(-(np.sort(s, axis=1)[:, -1] - s.mean(axis=1)), kind="stable")
        choice, room = np.argsort(-s, axis=1), np.full(parts, most)
        for i in order:
            for c in choice[i]:
                if room[c]:
                    part[i], room[c] = c, room[c] - 1
                    break
        for c in range(parts):
            if (part == c).any():
                m = unit[part == c].mean(axis=0)
                centres[c] = m / (np.linalg.norm(m) + 1e-12)
    both = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            both[i].append(j)
            both[j].append(i)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts)
            votes[(size >= most) & (np.arange(parts) != part[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, target: np.ndarray, parts: int, steps: int = 400, seed: int = 4) -> dict:
    """One hidden layer; `target` (rows, parts) is the share of each row's neighbours in each part."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    p = {"a": rng.normal(0, 1 / z.shape[1] ** 0.5, (z.shape[1], HIDDEN)), "ab": np.zeros(HIDDEN), "b": rng.normal(0, 1 / HIDDEN**0.5, (HIDDEN, parts)), "bb": np.zeros(parts)}
    m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    for step in range(1, steps + 1):
        rows = rng.choice(len(z), min(512, len(z)), replace=False)
        zb, tb = z[rows], target[rows]
        h = np.maximum(zb @ p["a"] + p["ab"], 0)
        o = h @ p["b"] + p["bb"]
        o = np.exp(o - o.max(axis=1, keepdims=True))
        d = (o / o.sum(axis=1, keepdims=True) - tb) / len(rows)
        dh = (d @ p["b"].T) * (h > 0)
        g = {"a": zb.T @ dh + 1e-5 * p["a"], "ab": dh.sum(axis=0), "b": h.T @ d + 1e-5 * p["b"], "bb": d.sum(axis=0)}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    return p | {"mean": mean, "scale": scale}


def route(model: dict, x: np.ndarray) -> np.ndarray:
    """Score of each part for each row (larger: more probable)."""
    h = np.maximum(((x - model["mean"]) / model["scale"]) @ model["a"] + model["ab"], 0)
    return h @ model["b"] + model["bb"]


def fit(sample: np.ndarray, parts: int, graph_k: int = 20) -> dict:
    graph = neighbour_graph(sample, min(graph_k, len(sample) - 1))
    part = balanced_parts(sample, graph, parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.arange(len(sample))[:, None], part[graph]), 1.0)
    target[np.arange(len(sample)), part] += 0.25 * graph.shape[1]
    return train_router(sample, target / target.sum(axis=1, keepdims=True), parts)


def probes_needed(model: dict, sample: np.ndarray, parts: int, k: int, target: float) -> int:
    """Least probes with which rows kept out of the fit find `target` of their k nearest in the sample."""
    held = np.arange(len(sample))[::5]
    rest = np.setdiff1d(np.arange(len(sample)), held)
    near = neighbour_near(sample[held], sample[rest], min(k, len(rest)))
    order = np.argsort(-route(model, sample[held]), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(held), 0), axis=1)
    home = route(model, sample[rest]).argmax(axis=1)
    found = np.take_along_axis(rank, home[near], axis=1)
    share = np.cumsum(np.bincount(found.ravel(), minlength=parts)) / found.size
    return int(np.searchsorted(share, target) + 1)


def neighbour_near(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest inner products in x for each row of q."""
    return np.concatenate([np.argpartition(-(q[at : at + 1024] @ x.T), k - 1, axis=1)[:, :k] for at in range(0, len(q), 1024)])


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so equal vectors score equally wherever they stand."""
    s = np.zeros(len(x))
    for d in range(x.shape[1]):
        s += x[:, d] * q[d]
    return s


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) for one query; `rough` are matrix products, used with a margin only; rows at minus infinity take no part."""
    rough = np.where(ids == own, -np.inf, rough)
    usable = np.isfinite(rough)
    if len(ids) > k:
        kth = np.partition(rough, len(rough) - k)[len(rough) - k]
        if np.isfinite(kth):
            usable = rough >= kth - 1e-9 * (1 + abs(kth))
    near = np.nonzero(usable)[0]
    score = exact_scores(x[near], q)
    order = np.lexsort((ids[near], -score))[:k]
    return ids[near][order], score[order]


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int, parts: int) -> pd.DataFrame:
    """The k best rows of `left` (vec_id, v, part) for each query of `right` (query_id, v, to), among the parts it probes."""
    if left.empty or right.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    x, ids, part = np.stack(left["v"].to_numpy()).astype(float), left["vec_id"].to_numpy(np.int64), left["part"].to_numpy()
    q, own = np.stack(right["v"].to_numpy()).astype(float), right["query_id"].to_numpy(np.int64)
    out = []
    rows_of = [(p, np.nonzero(part == p)[0]) for p in np.unique(part)]
    for at in range(0, len(q), 256):
        some = q[at : at + 256]
        probed = np.zeros((len(some), parts), dtype=bool)
        for row, to in zip(probed, right["to"].iloc[at : at + 256], strict=True):
            row[to] = True
        rough = np.full((len(some), len(x)), -np.inf)
        for p, rows in rows_of:
            asks = np.nonzero(probed[:, p])[0]
            if len(asks):
                rough[np.ix_(asks, rows)] = some[asks] @ x[rows].T
        for r, one, i in zip(rough, q[at : at + 256], own[at : at + 256], strict=True):
            near, score = nearest(x, ids, one, i, k, r)
            out.append(pd.DataFrame({"query_id": np.full(len(near), i), "vec_id": near, "score": score}))
    return pd.concat(out)


def shelves(sizes: list[int], most: int) -> list[int]:
    """Neighbouring parts put together up to `most` rows; a larger part stands alone.  Gives each part's shelf."""
    out, held, shelf = [], 0, 0
    for n in sizes:
        if held and held + n > most:
            shelf, held = shelf + 1, 0
        out.append(shelf)
        held += n
    return out


def _listed(values: list[int], kind: str):
    """A constant array column, indexed from 0."""
    return F.from_json(F.lit(str(list(values))), f"array<{kind}>")


def search(vectors: DataFrame, query_every: int = 20, k: int = 20, fit_rows: int = 6000, parts: int | None = None, probes: int | None = None, target: float = 0.93, chunk: int = CHUNK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose vec_id is divisible by `query_every`.

    fit_rows: rows (by hash) that graph and router are fitted on.  parts: an
    eighth of the rows fitted on by default, and at most.  probes: by default the least number
    that finds `target` of the neighbours of sample rows kept out of the fit; few where
    vectors form clusters, most parts where they do not.  If the parts probed hold no
    more than k rows, further ones are probed.
    """
    spark = vectors.sparkSession
    base = usable(vectors)
    widths = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = widths[0]["d"]
    base = base.where(F.size("v") == dim)
    sample = [r["v"] for r in hash_sample(base, ["vec_id", "v"], fit_rows).collect()]
    parts = max(1, min(parts or len(sample), len(sample) // 8))
    model = None
    if parts > 1:
        rows = np.array(sample)
        model = fit(rows[np.arange(len(rows)) % 5 > 0], parts)
        probes = probes or probes_needed(model, rows, parts, k, target)
    probes = min(parts, probes or 1)

    def assign():
        def step(batch: pa.RecordBatch) -> dict:
            x = np.array(batch.column(1).to_pylist(), dtype=float)
            order = np.argsort(-route(model, x), axis=1, kind="stable") if model else np.zeros((len(x), 1), dtype=int)
            asks = np.array(batch.column(0).to_pylist()) % query_every == 0
            return {"vec_id": batch.column(0), "v": batch.column(1), "part": order[:, 0], "order": [o.tolist() if a else None for o, a in zip(order, asks, strict=True)]}

        return step

    indexed = cut(map_rows(base, "vec_id long, v array<double>, part int, order array<int>", assign), "ann-index")
    sizes = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number a part
    size_of = _listed([sizes.get(p, 0) for p in range(parts)], "long")
    # the least number of leading parts that is `probes` or more and holds more than k rows
    reached = F.expr("aggregate(order, named_struct('n', 0, 'rows', 0L), (a, p) -> if(a.n < %d or a.rows <= %d, named_struct('n', a.n + 1, 'rows', a.rows + size_of[p]), a), a -> a.n)" % (probes, k + 1))
    # small parts share a shelf, so a query gives k rows a shelf, not a part
    shelf_of = shelves([sizes.get(p, 0) for p in range(parts)], chunk)
    shelf = _listed(shelf_of, "int")
    queries = indexed.where("order is not null").withColumn("size_of", size_of).select(F.col("vec_id").alias("query_id"), "v", F.slice("order", 1, reached).alias("to"))
    routed = cut(queries.select("query_id", "v", "to", F.explode(F.array_distinct(F.transform("to", lambda p: shelf[p]))).alias("shelf")), "ann-queries")
    asked = {r["shelf"]: r["n"] for r in routed.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    held = {s: sum(sizes.get(p, 0) for p in range(parts) if shelf_of[p] == s) for s in set(shelf_of)}
    n_chunks = _listed([max(1, -(-held[s] // chunk)) for s in sorted(held)], "int")  # shelves are numbered from 0
    n_blocks = _listed([-(-asked.get(s, 0) // query_block) for s in sorted(held)], "int")
    left = (
        indexed.select("vec_id", "v", "part", shelf[F.col("part")].alias("shelf"))
        .withColumn("chunk", F.pmod(F.xxhash64("vec_id"), n_chunks[F.col("shelf")]).cast("int"))
        .withColumn("blocks", n_blocks[F.col("shelf")])
        .where("blocks > 0")
        .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    )
    right = (
        routed.withColumn("n", n_chunks[F.col("shelf")])
        .withColumn("block", F.pmod(F.xxhash64("query_id"), n_blocks[F.col("shelf")]).cast("int"))
        .withColumn("chunk", F.explode(F.expr("sequence(0, n - 1)")))
    )
    keys = ["shelf", "chunk", "block"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _search(a, b, k, parts)

    found = left.select("vec_id", "v", "part", *keys).groupBy(*keys).cogroup(right.select("query_id", "v", "to", *keys).groupBy(*keys)).applyInPandas(run, RESULT)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored_share(vectors: DataFrame, query_every: int = 20, k: int = 20, fit_rows: int = 6000, parts: int | None = None, target: float = 0.93) -> float:
    """Share of all rows that `search` scores for a query of the sample; for reports on how well parts prune."""
    rows = np.array([r["v"] for r in hash_sample(usable(vectors), ["vec_id", "v"], fit_rows).collect()])
    parts = max(1, min(parts or len(rows), len(rows) // 8))
    if parts == 1:
        return 1.0
    model = fit(rows[np.arange(len(rows)) % 5 > 0], parts)
    probes = probes_needed(model, rows, parts, k, target)
    order = np.argsort(-route(model, rows), axis=1, kind="stable")
    size = np.bincount(order[:, 0], minlength=parts) / len(rows)
    return float(size[order[:, :probes]].sum(axis=1).mean())


def recall(found: DataFrame, vectors: DataFrame, k: int = 20) -> float:
    """Share of the true k nearest among `found`, over its queries; brute force, for tables of test size."""
    rows = usable(vectors).collect()
    x, ids = np.array([r["v"] for r in rows]), np.array([r["vec_id"] for r in rows])
    got: dict[int, set] = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for i, q in zip(ids, x, strict=True):
        if i in got:
            near, _ = nearest(x, ids, q, i, k, x @ q)
            hit, total = hit + len(got[i] & set(near.tolist())), total + len(near)
    return hit / max(1, total)

"""Embedding whitening: exact covariance by digit-slice products, then eigenvectors.

Entries become integers x = floor(scale * c) + offset.  The distinct integer vectors are
the fit list: n of them with sums S.  A vector is centred before anything is multiplied,
as y = n * x - S, which is exact.  y is split into limbs of `LIMB` bits; a float64 product
of two limb matrices over at most `BLOCK` rows stays below 2**53, so BLAS gives it exactly.
Products are added as 64-bit integers, recombined as big integers by their limbs' weights,
and merged over tasks in two levels, a matrix row at a time.  The driver gets the one
covariance, d by d, divides it by n**3 with correct rounding and takes its eigenvectors.

Where n is so large that y leaves 64 bits, the same steps run on Python integers.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries
go; so do those of another length than most have (of equal counts the larger length), which
no covariance can hold; entries beyond 2**62 / scale count as that; repeated rows and rows
that share a vec_id are whitened each and count once in the fit if their vectors are equal;
a null vec_id is kept; tied eigenvalues have some orthonormal basis, the same for all
rows, each component's sign such that its entry of largest size is positive; components without
variance (below rounding of the trace) have whitened null and do not enter identity_error;
with no variance at all explained and identity_error are null; long vectors are only
slower, by their square; an empty table gives no rows; columns other than vec_id and
embedding are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import bounded_batches, cut, map_rows

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
LIMB, BLOCK = 20, 4096  # 2 * 20 + 12 bits of a sum of products are below 53
HELD = 1024  # blocks whose products are added before 64 bits could overflow
DEALS = 64  # tasks' partial results are merged in this many groups, then in one
MOST = 2.0**62
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def levels(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, x (array<long>) of the rows of `vectors` (vec_id, embedding) that can be whitened."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    whole = v.where("v is not null and size(v) > 0").where("forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    sizes = whole.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    if not sizes:
        return whole.select("vec_id", F.expr("transform(v, c -> 0L)").alias("x"))
    clipped = lambda c: F.least(F.greatest(c * F.lit(float(scale)), F.lit(-MOST)), F.lit(MOST))
    return whole.where(F.size("v") == sizes[0]["d"]).select("vec_id", F.transform("v", lambda c: F.floor(clipped(c)).cast("long") + F.lit(offset).cast("long")).alias("x"))


def centred(x: np.ndarray, n: int, sums: list[int], wide: bool) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers, or Python integers if `wide`."""
    x = x - OFFSET
    if wide:
        return x.astype(object) * n - np.array([s - n * OFFSET for s in sums], dtype=object)
    return x * n - np.array([s - n * OFFSET for s in sums], dtype=np.int64)


def limbs(y: np.ndarray, count: int) -> list[np.ndarray]:
    """y = sum of limb k times 2**(LIMB * k), as float64; all but the last limb are not negative."""
    out = []
    for _ in range(count - 1):
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


class Gram:
    """Exact sum of y^T y over blocks of rows y with entries of at most `bits` bits."""

    def __init__(self, d: int, bits: int):
        self.d, self.count = d, max(1, -(-bits // LIMB))
        self.total = np.zeros((d, d), dtype=object)
        self.held = 0
        self._clear()

    def _clear(self) -> None:
        self.sums = {(a, b): np.zeros((self.d, self.d), dtype=np.int64) for a in range(self.count) for b in range(a, self.count)}

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), BLOCK):
            parts = limbs(y[at : at + BLOCK], self.count)
            for (a, b), held in self.sums.items():
                held += (parts[a].T @ parts[b]).astype(np.int64)
            self.held += 1
            if self.held == HELD:
                self.recombine()

    def recombine(self) -> np.ndarray:
        """The sum so far, as big integers."""
        for (a, b), held in self.sums.items():
            both = held.astype(object) if a == b else held.astype(object) + held.T.astype(object)
            self.total = self.total + both * (1 << (LIMB * (a + b)))
        self.held = 0
        self._clear()
        return self.total


def folded(rows: DataFrame, start: Callable[[], tuple], merge: Callable[[list, list], list]) -> dict[int, list]:
    """Lists of numbers that tasks make of the x of `rows`, merged over all tasks.

    `start()` gives a function for each block of rows and one that ends with (item, list)
    pairs.  Lists travel as JSON, whose integers have any length.  First the tasks' lists are merged in
    DEALS groups an item, then in one, so no task reads the lists of all tasks.
    """
    bounded_batches(rows.sparkSession)
    kind = "item int, deal int, body string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        add, end = start()
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                add(matrix(batch.column(0)))
        if seen:
            deal = TaskContext.get().partitionId() % DEALS
            got = [(item, deal, json.dumps(body)) for item, body in end()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(got, columns=["item", "deal", "body"]), schema=pa.schema([("item", pa.int32()), ("deal", pa.int32()), ("body", pa.string())]), preserve_index=False)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        bodies = map(json.loads, pdf["body"])
        body = next(bodies)
        for other in bodies:
            body = merge(body, other)
        return pd.DataFrame({"item": [int(pdf["item"].iloc[0])], "deal": [0], "body": [json.dumps(body)]})

    parts = rows.select("x").mapInArrow(run, kind)
    merged = parts.groupBy("item", "deal").applyInPandas(one, kind).groupBy("item").applyInPandas(one, kind)
    return {r["item"]: json.loads(r["body"]) for r in merged.collect()}  # a row of numbers an item; as many items as dimensions at most


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a 64-bit integer matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def added(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b, strict=True)]


def column_sums(fit: DataFrame, d: int) -> list[int]:
    """Sums of every dimension, exactly: halves of the entries are added apart."""

    def start():
        total = [0] * d

        def add(x: np.ndarray) -> None:
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total[:] = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, high, low, strict=True)]

        return add, lambda: [(0, total)]

    return folded(fit, start, added)[0]


def covariance(fit: DataFrame, n: int, sums: list[int], bits: int) -> list[list[int]]:
    """Upper triangle of n**3 times the covariance: row i from its diagonal on."""
    d, wide = len(sums), bits > 62

    def start():
        gram = Gram(d, bits)

        def end():
            total = gram.recombine()
            return [(i, total[i, i:].tolist()) for i in range(d)]

        return lambda x: gram.add(centred(x, n, sums, wide)), end

    rows = folded(fit, start, added)
    return [rows[i] for i in range(d)]


def eigen(upper: list[list[int]], n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The `most` largest eigenvalues, their unit vectors as columns, and the trace of the covariance."""
    d, cube = len(upper), n**3
    v = np.zeros((d, d))
    for i, row in enumerate(upper):
        v[i, i:] = v[i:, i] = [value / cube for value in row]  # division of integers rounds correctly
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    vectors = vectors[:, order]
    return values[order], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]), sum(row[0] for row in upper) / cube


def moments_merged(a: list, b: list) -> list:
    """Two of (count, means, summed products of deviations, flat) as one."""
    (m, mean, co), (m2, mean2, co2) = a, b
    x, y = np.array(mean), np.array(mean2)
    gap, all_ = y - x, m + m2
    both = np.array(co) + np.array(co2) + (np.outer(gap, gap) * (m * m2 / all_)).ravel()
    return [all_, (x + gap * (m2 / all_)).tolist(), both.tolist()]


def identity_gap(fit: DataFrame, project: Callable[[np.ndarray], np.ndarray], k: int) -> float:
    """Largest absolute entry of the covariance of the projected fit list minus the identity."""

    def start():
        held: list = []

        def add(x: np.ndarray) -> None:
            w = project(x)
            off = w - w.mean(axis=0)
            part = [len(w), w.mean(axis=0).tolist(), (off.T @ off).ravel().tolist()]
            held[:] = [moments_merged(held[0], part)] if held else [part]

        return add, lambda: [(0, held[0])]

    m, _, co = folded(fit, start, moments_merged)[0]
    return float(np.abs(np.array(co).reshape(k, k) / m - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable row of `vectors` (vec_id, embedding) and component up to `components`; see SCHEMA.

    deviation: sum over dimensions of (n * x - S)**2, exact, null beyond 38 digits.
    """
    rows = levels(vectors)
    fit = cut(rows.select("x").distinct(), "whiten-fit")
    seen = fit.agg(F.count("*").alias("n"), F.max(F.expr(f"array_max(transform(x, c -> abs(c - {OFFSET})))")).alias("far"), F.max(F.size("x")).alias("d")).first()
    n, d = seen["n"], seen["d"]
    if not n:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    sums = column_sums(fit, d)
    bits = (2 * n * max(1, seen["far"])).bit_length()  # of any entry of n * x - S
    wide = bits > 62
    values, axes, trace = eigen(covariance(fit, n, sums, bits), n, min(components, d))
    good = values > trace * d * 2.0**-50
    spread = np.where(good, np.sqrt(np.where(good, values, 1.0)), np.nan)
    count = len(values)

    def project(x: np.ndarray) -> np.ndarray:
        y = centred(x, n, sums, wide)
        return ((y / n).astype(np.float64) @ axes) / spread

    gap = identity_gap(fit, lambda x: project(x)[:, good], int(good.sum())) if good.any() else None
    explained = [float(v) / trace for v in values] if trace else [None] * count
    squares_wide = 2 * bits + d.bit_length() > 62

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            x = matrix(batch.column(1))
            y = centred(x, n, sums, wide)
            squares = (y.astype(object) if squares_wide else y) ** 2
            exact = [Decimal(int(s)) if s < 10**38 else None for s in squares.sum(axis=1)]
            at = np.repeat(np.arange(len(x)), count)
            white = project(x).ravel()
            return {
                "vec_id": batch.column(0).take(pa.array(at)), "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)), "n": np.full(len(at), n, dtype=np.int64),
                "deviation": pa.array(exact, type=pa.decimal128(38, 0)).take(pa.array(at)), "whitened": pa.array(white, mask=np.isnan(white)), "explained": explained * len(x), "identity_error": [gap] * len(at),
            }

        return step

    return map_rows(rows, SCHEMA, start)

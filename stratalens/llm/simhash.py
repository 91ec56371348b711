r"""SimHash near-duplicates by tiled exact comparison.

Each text gives one fingerprint from its word shingles.  Distinct fingerprints are
sorted by the population counts of their four 16-bit quarters, dealt by range, and cut
into tiles of at most `TILE`, full but for the last.  Two fingerprints within r bits differ by at most r in
the sum of their quarters' counts, so a pair of tiles whose count ranges lie further
apart is never formed; the others are compared in full by numpy exclusive-or and bit
counts.  A pair of tiles gives a spanning forest of its links, not the links, so a
group of any size leaves at most one row per fingerprint and tile pair.  Components
come from alternating star contraction over written tables.

No bucket or candidate limit exists: every linked pair of distinct fingerprints is
compared.  The comparison is quadratic in distinct fingerprints, which is what the
method asks for; exact copies share a fingerprint and are collapsed before.

Defined results: words are `[^\x20\x09-\x0D]+` after A-Z are lower-cased; a text with
fewer words than a shingle is one shingle; a text without words (null, empty) has
fingerprint zero and is linked like any other; repeated rows and ties share a
component; rows with a null doc_id take part but never name a component unless all of
its ids are null; very long texts are hashed whole; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .util import cut, hot_keys, map_rows, spread_join

DEALS = 64  # left tiles of one population count are dealt over as many keys
BLOCK = 512  # codes of a group that are held against as many in one task
TILE, LEAST_TILE = 16_384, 2_048  # codes in a tile: a twelfth of all, between these
SEED = 42
_ODD = np.uint64(0x9E3779B97F4A7C15)  # golden-ratio increment of the public splitmix64 generator
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of the whole text, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest, last = xxhash.xxh64_intdigest, min(size, len(words)) - 1
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[last:])), dtype=np.uint64, count=len(words) - last)  # noqa: B905


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if over half the hashes have it; unsigned."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def lanes(hashes: np.ndarray, n: int) -> list[int]:
    """n fingerprints of the same shingles; the first is the plain one."""
    out = []
    for k in range(n):
        out.append(fingerprint(hashes))
        if k < n - 1:
            with np.errstate(over="ignore"):
                z = hashes + _ODD
                z = (z ^ (z >> np.uint64(30))) * _M1
                z = (z ^ (z >> np.uint64(27))) * _M2
                hashes = z ^ (z >> np.uint64(31))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, n_lanes: int = 1, key: str | None = None, repeats: bool = True) -> DataFrame:
    """doc_id, fp (signed long, first lane), code (binary: all lanes, little-endian), and the column `key` as key if given.

    Without `repeats` a shingle counts once a text.
    """

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            hashes = (shingle_hashes(t, shingle) for t in batch.column(1).to_pylist())
            codes = [np.array(lanes(h if repeats else np.unique(h), n_lanes), dtype="<u8") for h in hashes]
            got = {"doc_id": batch.column(0), "fp": np.array([c[0] for c in codes], dtype=np.uint64).view(np.int64), "code": [c.tobytes() for c in codes]}
            return got | ({"key": batch.column(2)} if key else {})

        return step

    carried = [F.col(key).alias("key")] if key else []
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried), "doc_id long, fp long, code binary" + (", key string" if key else ""), start)


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union the pairs (a, b) in `parent`, which stays fully compressed; gives the pairs that joined two trees."""
    used_a, used_b = [a[:0]], [b[:0]]
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return np.concatenate(used_a), np.concatenate(used_b)
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        np.minimum.at(parent, high, low)
        hooked = np.nonzero(parent[high] == low)[0]
        hooked = hooked[np.unique(high[hooked], return_index=True)[1]]
        used_a.append(a[hooked])
        used_b.append(b[hooked])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def tile_pairs(a: np.ndarray, b: np.ndarray | None, first: int, total: int):
    """Links in one tile (b None) or between two, a block of rows at a time, as positions in a followed by b.

    a, b: (rows, lanes) unsigned.  A link has at most `first` differing bits in lane 0
    and at most `total` in all lanes.
    """
    own = b is None
    b = a if own else b
    base = 0 if own else len(a)
    count_b = np.bitwise_count(b[:, 0]).astype(np.int64)
    order = np.argsort(count_b, kind="stable")
    sorted_b, sorted_counts = np.ascontiguousarray(b[order, 0]), count_b[order]
    count_a = np.bitwise_count(a[:, 0]).astype(np.int64)
    order_a = np.argsort(count_a, kind="stable")
    for at in range(0, len(a), 64):
        rows = order_a[at : at + 64]
        lo = np.searchsorted(sorted_counts, count_a[rows[0]] - first, "left")
        hi = np.searchsorted(sorted_counts, count_a[rows[-1]] + first, "right")
        if lo >= hi:
            continue
        i, j = np.nonzero(np.bitwise_count(a[rows, :1] ^ sorted_b[None, lo:hi]) <= first)
        i, j = rows[i], order[j + lo]
        if own:
            up = i < j
            i, j = i[up], j[up]
        if a.shape[1] > 1 and len(i):
            near = np.zeros(len(i), dtype=np.int64)
            for lane in range(a.shape[1]):
                near += np.bitwise_count(a[i, lane] ^ b[j, lane])
            i, j = i[near <= total], j[near <= total]
        yield i, j + base


def tile_forest(a: np.ndarray, b: np.ndarray | None, first: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, made of links, of the links in one tile (b None) or between two; positions in a followed by b."""
    parent = np.arange(len(a) + (0 if b is None else len(b)))
    out_a, out_b = [parent[:0]], [parent[:0]]
    for i, j in tile_pairs(a, b, first, total):
        i, j = _merge(parent, i, j)
        out_a.append(i)
        out_b.append(j)
    return np.concatenate(out_a), np.concatenate(out_b)


def exact_forest(codes: np.ndarray, sets: list[np.ndarray], split: int, first: int, total: int, similarity: float, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest, made of links, of the pairs whose sets have a Jaccard similarity of at least `similarity`.

    Pairs are those of the first `split` rows with the others, or all if split is 0; only
    pairs close enough by `codes` are counted, and of these no pair that is connected already: by
    equal `labels` or by the links found.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    start = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if start[-1] else np.zeros(0, np.int64)
    held = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=bool)
    parent = np.arange(n) if labels is None else np.unique(labels, return_inverse=True)[1].ravel()
    out: list[tuple[int, int]] = []
    for i_all, j_all in tile_pairs(codes[:split] if split else codes, codes[split:] if split else None, first, total):
        if not len(i_all):
            continue
        order = np.argsort(i_all, kind="stable")
        i_all, j_all = i_all[order], j_all[order]
        names, at = np.unique(i_all, return_index=True)
        for i, js in zip(names.tolist(), np.split(j_all, at[1:]), strict=True):
            js = js[(parent[js] != parent[i]) & (size[js] > 0)]  # only the code without words has an empty set
            if not len(js):
                continue
            own = ids[start[i] : start[i + 1]]
            held[own] = True
            for k in range(0, len(js), 512):
                part = js[k : k + 512]
                flat = np.concatenate([ids[start[j] : start[j + 1]] for j in part])
                ends = np.concatenate([[0], np.cumsum(size[part])[:-1]])
                shared = np.add.reduceat(held[flat].astype(np.int64), ends) if len(flat) else np.zeros(len(part), np.int64)
                shared[size[part] == 0] = 0
                for j in part[shared + 1e-9 >= similarity * (size[i] + size[part] - shared)].tolist():
                    if parent[i] != parent[j]:
                        out.append((i, j))
                        low, high = sorted((parent[i], parent[j]))
                        parent[parent == high] = low
            held[own] = False
    return out


def numbered(codes: DataFrame, tile: int | None = None) -> tuple[DataFrame, int]:
    """`codes` (fp, code, any others), one row per distinct code, with place (0, 1, ...) and q0..q3, and the tile size.

    Codes are sorted by range of their quarters' population counts; a row's place is its
    place in its partition plus the rows of the partitions before, of which only the counts
    reach the driver.  So tiles are full whatever the number of partitions.
    """
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int").alias(f"q{k}") for k in range(4)]
    keys = [f"q{k}" for k in range(4)]
    ordered = cut(codes.select("*", *quarters).repartitionByRange(*keys, "fp").sortWithinPartitions(*keys, "fp").withColumn("m", F.monotonically_increasing_id()), "simhash-order")
    split = ordered.withColumn("part", F.shiftright("m", 33)).withColumn("at", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    total, rows = 0, []
    for r in sorted(split.groupBy("part").agg(F.count("*").alias("n")).collect()):
        rows.append((r["part"], total))
        total += r["n"]
    before = codes.sparkSession.createDataFrame(rows, "part long, before long")  # one row a partition
    return split.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("at")).drop("m", "part", "at", "before"), tile or min(TILE, max(LEAST_TILE, total // 12))


def place_links(places: DataFrame, tile: int, radius: int, total: int | None, n_lanes: int) -> DataFrame:
    """Edges (a, b) between places of a spanning forest per tile pair of `places` (place, code, q0..q3)."""
    spark = places.sparkSession
    keys = [f"q{k}" for k in range(4)]

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        row = {"tile_id": int(p["tile_id"].iloc[0]), "blob": b"".join(p.sort_values("place")["code"])}
        for k in range(4):
            row |= {f"lo{k}": int(p[f"q{k}"].min()), f"hi{k}": int(p[f"q{k}"].max())}
        return pd.DataFrame([row])

    schema = "tile_id long, blob binary, " + ", ".join(f"lo{k} int, hi{k} int" for k in range(4))
    dealt = places.withColumn("tile_id", F.floor(F.col("place") / tile).cast("long")).select("tile_id", "place", "code", *keys)
    tiles = cut(dealt.groupBy("tile_id").applyInPandas(pack, schema), "simhash-tiles")
    meta = tiles.drop("blob").withColumn("lo", F.expr("lo0 + lo1 + lo2 + lo3")).withColumn("hi", F.expr("hi0 + hi1 + hi2 + hi3"))
    left = meta.select(*[F.col(c).alias(f"l_{c}") for c in meta.columns]).withColumn("p", F.explode(F.expr("sequence(l_lo, l_hi)"))).withColumn("deal", F.pmod("l_tile_id", F.lit(DEALS)))
    right = meta.select(*[F.col(c).alias(f"r_{c}") for c in meta.columns]).withColumn("p", F.explode(F.expr(f"sequence(r_lo - {radius}, r_hi + {radius})"))).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    gaps = " + ".join(f"greatest(0, l_lo{k} - r_hi{k}, r_lo{k} - l_hi{k})" for k in range(4))
    # a pair meets at several counts; it is kept at the least of them only.  Counts are few, so left tiles are dealt
    pairs = left.join(right, ["p", "deal"]).where(f"l_tile_id <= r_tile_id and p = greatest(l_lo, r_lo - {radius}) and {gaps} <= {radius}").select("l_tile_id", "r_tile_id")
    work = pairs.join(tiles.select(F.col("tile_id").alias("l_tile_id"), F.col("blob").alias("l_blob")), "l_tile_id")
    work = work.join(tiles.select(F.col("tile_id").alias("r_tile_id"), F.col("blob").alias("r_blob")), "r_tile_id")
    limit = radius if total is None else total

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            own = r.l_tile_id == r.r_tile_id
            a = np.frombuffer(r.l_blob, "<u8").reshape(-1, n_lanes)
            i, j = tile_forest(a, None if own else np.frombuffer(r.r_blob, "<u8").reshape(-1, n_lanes), radius, limit)
            at = [x + np.where(x < len(a), r.l_tile_id * tile, r.r_tile_id * tile - len(a)) for x in (i, j)]
            out.append(pd.DataFrame({"a": at[0], "b": at[1]}))
        return pd.concat(out)

    # one tile pair per group, so a worker holds two tiles at a time; a given number of
    # partitions keeps small runs from being merged into one slow task
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return work.repartition(slots, "l_tile_id", "r_tile_id").groupBy("l_tile_id", "r_tile_id").applyInPandas(compare, "a long, b long")


def _rooted(places: DataFrame, edges: DataFrame) -> DataFrame:
    """`places` with the root of each over `edges`, its own place where it has none."""
    return places.join(components(edges).withColumnRenamed("node", "place"), "place", "left").withColumn("root", F.coalesce("root", "place"))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, n_lanes: int = 1, total: int | None = None, tile: int | None = None) -> DataFrame:
    """doc_id, fp (signed long), fingerprint (16 hex digits), component_id per row of `docs` (doc_id, text).

    component_id: the smallest doc_id reachable over links, the row's own included.
    With n_lanes > 1 a link needs at most `radius` bits in the first lane and `total`
    in all; the further lanes sharpen the estimate of similarity.
    """
    marked = cut(fingerprints(docs, shingle, n_lanes), "simhash-docs")
    places, tile = numbered(marked.groupBy("code").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.count("*").alias("n")), tile)
    rooted = cut(_rooted(places, place_links(places, tile, radius, total, n_lanes)).select("code", "least", "n", "root"), "simhash-rooted")
    groups = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-groups")
    named = spread_join(rooted.drop("n"), groups.drop("n"), "root", hot_keys(groups, "root", rooted.count())).select("code", "component_id")
    found = spread_join(marked, named, "code", hot_keys(rooted, "code", marked.count()))
    return found.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def lanes_limit(similarity: float, n_lanes: int, margin: float = 1.0) -> int:
    """Differing bits of n_lanes * 64 up to which a pair counts as at least `similarity` alike (Jaccard of shingle sets).

    Sets of Jaccard s have cosine 2s / (1 + s) at equal sizes; a bit differs with
    probability angle / pi.  `margin` standard deviations are added, so that pairs at
    the threshold are mostly caught.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * n_lanes
    return round(n * p + margin * math.sqrt(n * p * (1 - p)))


def shingle_sets(wanted: DataFrame, texts: DataFrame, hot_rows: list[tuple], shingle: int) -> DataFrame:
    """place, shingles (distinct hashes) of the places of `wanted` (place, __row), from the texts of their rows.

    The one time that whole texts are shuffled to be compared.
    """

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            return {"place": batch.column(0), "shingles": [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch.column(1).to_pylist()]}

        return step

    return map_rows(spread_join(texts, wanted, "__row", hot_rows, hint="merge").select("place", "text"), "place long, shingles array<long>", start).dropDuplicates(["place"])


def _own_block(blocks: Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64("place", F.lit(seed)), blocks).cast("int")


def _verified(met: DataFrame, n_lanes: int, first: int, far: int, similarity: float) -> DataFrame:
    """Edges (a, b) found in the blocks of `met` (root, i, j, own, place, label, code, shingles): within one (i = j) or between two."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "place"])
        split = 0 if pdf["i"].iloc[0] == pdf["j"].iloc[0] else int((pdf["own"] == pdf["i"]).sum())
        place = pdf["place"].to_numpy(np.int64)
        if len(place) < 2 or split == len(place) or (pdf["i"].iloc[0] != pdf["j"].iloc[0] and not split):
            return pd.DataFrame({"a": place[:0], "b": place[:0]})
        codes = np.frombuffer(b"".join(pdf["code"]), "<u8").reshape(-1, n_lanes)
        found = exact_forest(codes, [np.asarray(x, dtype=np.int64) for x in pdf["shingles"]], split, first, far, similarity, pdf["label"].to_numpy(np.int64))
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": place[at[:, 0]], "b": place[at[:, 1]]})

    return cut(met.groupBy("root", "i", "j").applyInPandas(count, "a long, b long"), "simhash-verified")


def _open_places(met: DataFrame, n_lanes: int, first: int, far: int) -> DataFrame:
    """root, i, j, own, place of the members of two blocks of `met` (root, i, j, own, place, label, code) that have a candidate with another label in the other."""
    kind = "root long, i int, j int, own int, place long"

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "place"]).reset_index(drop=True)
        split = int((pdf["own"] == pdf["i"]).sum())
        wanted = np.zeros(len(pdf), dtype=bool)
        if 0 < split < len(pdf):
            codes, label = np.frombuffer(b"".join(pdf["code"]), "<u8").reshape(-1, n_lanes), pdf["label"].to_numpy(np.int64)
            for i, j in tile_pairs(codes[:split], codes[split:], first, far):
                apart = label[i] != label[j]
                wanted[i[apart]] = True
                wanted[j[apart]] = True
        return pdf.loc[wanted, ["root", "i", "j", "own", "place"]]

    return cut(met.groupBy("root", "i", "j").applyInPandas(near, kind), "simhash-open")


def similar(texts: DataFrame, hot_rows: list[tuple], places: DataFrame, tile: int, shingle: int, similarity: float, n_lanes: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of spanning forests of the pairs of `places` (place, code, least, q0..q3) whose shingle sets are at least `similarity` alike.

    texts: __row, text; hot_rows: rows that repeat often.  Pairs within four standard
    deviations of the threshold, in the first lane and in all, are candidates.  Forests of
    candidates give groups that hold every candidate pair.  A group's members are dealt over
    blocks of about `block`.  First every block is counted in itself.  Then one member of each component found
    so far is dealt over blocks again, as long as that joins many: a group of near copies becomes one
    component while each shingle set is sent a few times.  At last each two blocks of a group that still
    has several components meet, codes only; sets are sent for the members that have a candidate of another
    component there.  So every candidate pair is connected or counted, whatever a group's size, and no step
    gives more than an edge a member and block.
    """
    first, far = lanes_limit(similarity, 1, 4.0), lanes_limit(similarity, n_lanes, 4.0)
    groups = cut(components(place_links(places, tile, first, far, n_lanes)), "simhash-groups")
    sizes = cut(groups.groupBy("root").agg(F.count("*").alias("n")), "simhash-sizes")
    many = F.ceil(F.col("n") / block).cast("int").alias("blocks")
    dealt = spread_join(groups, sizes.select("root", many), "root", hot_keys(sizes, "root", groups.count()))
    members = cut(places.join(dealt.withColumnRenamed("node", "place"), "place").select("place", "code", "root", "blocks", F.col("least.row").alias("__row")), "simhash-members")
    sets = cut(shingle_sets(members.select("place", "__row"), texts, hot_rows, shingle), "simhash-sets")
    members = members.drop("__row")

    def inside(rows: DataFrame, seed: int) -> DataFrame:
        own = rows.withColumn("own", _own_block(F.col("blocks"), seed))
        return _verified(own.select("root", F.col("own").alias("i"), F.col("own").alias("j"), "own", "place", F.col("place").alias("label"), "code").join(sets, "place"), n_lanes, first, far, similarity)

    edges = inside(members, 0)
    large = members.where("blocks > 1")
    before, seed = large.count(), 0
    while before:
        found = components(edges)
        labelled = cut(large.join(found.select(F.col("node").alias("place"), F.col("root").alias("label")), "place", "left").withColumn("label", F.coalesce("label", "place")), "simhash-labels")
        heads = labelled.where("place = label")
        left = cut(heads.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "simhash-left")
        total = left.agg(F.sum("n")).first()[0] or 0
        if not total:
            return edges
        hot = hot_keys(left, "root", total)
        if 2 * total > before:
            break
        before, seed = total, seed + 1
        again = spread_join(heads.select("place", "code", "root"), left.select("root", many), "root", hot)
        edges = cut(edges.unionAll(inside(again, seed)), "simhash-edges")
    else:
        return edges
    open_ = spread_join(labelled, left.select("root"), "root", hot, "left_semi").withColumn("own", _own_block(F.col("blocks")))
    met = open_.withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), k -> k <> own)"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    wanted = _open_places(met.select("root", "i", "j", "own", "place", "label", "code"), n_lanes, first, far)
    rows = wanted.join(open_.select("place", "label", "code"), "place").join(sets, "place")
    return edges.unionAll(_verified(rows, n_lanes, first, far, similarity))


def _row_key() -> Column:
    """Row by content: id and text; null and empty texts, which no code tells apart, are one."""
    return F.md5(F.concat_ws("\u0000", F.coalesce(F.col("__id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))


def one_per_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, n_lanes: int = 8, block: int = BLOCK) -> DataFrame:
    """Rows of `docs`, one of each near-duplicate group: the one with the smallest doc_id, of equal ids that of the least hash of id and text.

    A link is a Jaccard similarity of shingle sets of at least `similarity`, found by
    `similar`.  Texts without words are all one group.  A null doc_id comes after all others.  Ids need not be unique: a row is
    known by its id and its text's hash, so different texts that share an id, or have
    none, stay if their groups differ.  Rows equal in id and text are one.  Very long texts
    are hashed whole.  An empty table gives no rows; other columns are kept, whatever
    their names, but for those that begin with two underscores.

    The row that stays is a least value by code, then by group: both combine before the
    shuffle.  Texts meet the ids that stay by the hash of id and text, which copies do not
    share; the repeats of a row that is hot are dealt over several tasks.
    """
    names = docs.columns
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__row", _row_key())
    marked = cut(fingerprints(keyed.select("doc_id", "text", "__row"), shingle, n_lanes, "__row", repeats=False), "simhash-docs")
    found = marked.groupBy("code").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", F.col("key").alias("row"))).alias("least"), F.min("fp").alias("fp"))
    places, tile = numbered(found)
    hot_rows = hot_keys(marked.groupBy(F.col("key").alias("__row")).agg(F.count("*").alias("n")), "__row", marked.count())
    rooted = _rooted(places, similar(keyed.select("__row", "text"), hot_rows, places, tile, shingle, similarity, n_lanes, block))
    stay = cut(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("__row")), "simhash-stay")
    return spread_join(keyed, stay, "__row", hot_rows, "left_semi", hint="merge").dropDuplicates(["__row"]).select(*[F.col(f"`{c}`") for c in names])

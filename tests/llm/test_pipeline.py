"""The pipeline's stages on the small table, each against its operator's verdicts."""

from pyspark.sql import functions as F

import corpus_pipeline
from stratalens.llm import quality, simhash, toxicity
from stratalens.llm.util import cut, table


def exact_groups(docs):
    """Least ids of the groups of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more, by all pairs."""
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in docs.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in sets})


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    names = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], sf), "test-stage"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "simhash near-dedup", "mixing", "packing"]
    assert all(d.columns == names for d in seen[1:5])
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen[:5]]
    assert ids[1] == sorted(r.doc_id for r in quality.quality(docs).where("kept").collect())
    model = toxicity.toxicity_model(seen[1], table(spark, sf, "labels"))
    assert ids[2] == sorted(r.doc_id for r in toxicity.toxicity(seen[1], model).where("predicted = 0").collect())
    assert ids[3] == exact_groups(seen[2])
    assert set(ids[4]) <= set(ids[3]) and len(ids[4]) > len(ids[3])
    assert set(r.doc_id for r in seen[5].select("doc_id").collect()) == set(ids[4])
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == text[r.doc_id] for r in seen[4].collect())


def test_empty_input(spark, sf):
    none = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = cut(stage(spark, none, sf), "test-empty")
        assert none.count() == 0


def test_near_dedup_stage_against_exact_jaccard(spark, sf):
    docs = table(spark, sf, "documents")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == exact_groups(docs)


def test_stages_with_null_and_repeated_ids_and_clashing_columns(spark, sf):
    """Rows without ids, one id for several texts, and equal rows go through all stages; ids never stand for rows."""
    docs = table(spark, sf, "documents").orderBy("doc_id").limit(60)
    some = lambda n, i: docs.limit(n).withColumn("doc_id", F.lit(i).cast("long"))
    none = spark.createDataFrame([(None, None, None, None, None)] * 5 + [(1, "", "en", "x", 0)], docs.schema)
    rows = docs.unionByName(some(20, None)).unionByName(docs.limit(10)).unionByName(some(15, 3)).unionByName(none)
    now = cut(rows.select("*", *[F.lit(1).alias(c) for c in ("size", "copies", "fp", "code", "place", "kept", "score")]), "test-clash")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, sf), "test-clash")
        seen.append(now)
    kept, clean, near, mixed, packed = seen
    assert all(d.columns == docs.columns for d in seen[:4])
    ids = clean.select("doc_id").collect()
    assert any(r.doc_id is None for r in ids) and sum(r.doc_id == 3 for r in ids) > 1
    texts = sorted({r.text for r in clean.collect()})
    assert near.count() == len(set(exact_roots(texts)))
    assert {r.text for r in mixed.collect()} <= {r.text for r in near.collect()}
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def exact_roots(texts):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]

"""Token ids, packing and directly addressable files: exact round trips."""

import collections
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratalens.llm import dac, packing
from stratalens.llm.tokens import WordCoder, coder
from stratalens.llm.util import shared_dir

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["a  b", "x\n\ny", " lead", "tail ", "don't stop's", "A\tB", "naïve café", "x y", "ΑΣ Σας", "İstanbul", "a\n b", "é x", "123 4a5b", "<|endoftext|> hi", "foo.\nBar baz.", "'s", "x 's", '"quote," he', "日本 語。", "a​b", "x\x1cy z", "x \x85y", "K K", "...,,", "WORD!! WORD!!\nWORD"]


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("name", FILES)
def test_word_memo_gives_the_library_ids(name):
    mine, want = WordCoder(public_tokenizers.path(name), max_words=50), plain(name)
    for text in ODD + ODD[::-1] + ["", None]:
        assert mine.encode(text) == want(text), text


@pytest.mark.parametrize("name", FILES)
def test_word_memo_on_random_text(name):
    mine, want = coder(public_tokenizers.path(name)), plain(name)

    @given(st.text(alphabet=st.one_of(st.sampled_from("ab Z.,'\n\t09é# Σ"), st.characters(blacklist_categories=["Cs"])), max_size=40))
    @settings(max_examples=200, deadline=None)
    def check(text):
        assert mine.encode(text) == want(text)

    check()


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70000), max_size=1500), st.data())
@settings(max_examples=60, deadline=None)
def test_dac_random_access(ids, data):
    a = np.array(ids, dtype=np.uint32)
    s = dac.Segment(dac.encode_segment([None, 3], [len(ids) // 2, len(ids) - len(ids) // 2], a.astype("<u4").tobytes(), 11))
    lo = data.draw(st.integers(0, len(ids)))
    hi = data.draw(st.integers(lo, len(ids)))
    assert s.ids(lo, hi).tolist() == ids[lo:hi]
    assert [s[i] for i in range(lo, min(hi, lo + 20))] == ids[lo : min(hi, lo + 20)]
    with pytest.raises(IndexError):
        s[len(ids)]


def test_dac_files_round_trip(spark, docs, no_docs):
    want = plain("word_bpe_49k.json")
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    path = f"{shared_dir(spark)}/dac-test-{uuid.uuid4().hex}"
    dac.write_dac(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(dac.dac_digest(dac.read_dac(spark, path)).collect(), key=lambda r: r.start)
    at = 0
    for g, r in zip(got, rows, strict=True):
        ids = want(r.text) + (1).to_bytes(4, "little")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids) // 4, zlib.crc32(ids))
        at += g.n_tokens
    dac.write_dac(no_docs, path + "-none", public_tokenizers.path("word_bpe_49k.json"))
    assert dac.read_dac(spark, path + "-none").count() == 0


def check_pieces(pieces, texts, want, capacity, segments, loss):
    """texts: (id, prompt ids, text ids); every id in exactly one piece, limits kept, offsets gapless."""
    left = collections.Counter(x[1] + x[2] for x in texts)
    by_doc = collections.defaultdict(list)
    by_seq = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_seq[p.sequence_id].append(p)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and len(seq) <= segments and sum(p.n_loss for p in seq) <= loss
    total = sum(p.length for p in pieces)
    assert total == sum(len(x[1]) + len(x[2]) for x in texts) // 4
    return by_seq, left


@pytest.mark.parametrize("limits", [(2048, 128, 2048), (64, 3, 20), (1, 1, 1), (50, 50, 7)])
def test_pack_keeps_every_id_and_all_limits(docs, limits):
    capacity, segments, loss = limits
    want = plain("byte_bpe_50k.json")
    end = (1).to_bytes(4, "little")
    small = docs.where("doc_id is null or doc_id <> 9") if capacity < 2048 else docs
    from pyspark.sql import functions as F

    with_prompt = small.withColumn("ask", F.when(F.col("doc_id") % 2 == 0, F.lit("Please answer this")))
    pieces = packing.pack(with_prompt, public_tokenizers.path("byte_bpe_50k.json"), capacity, segments, loss, prompt_col="ask").collect()
    texts = [(r.doc_id, want(r.ask), want(r.text) + end) for r in with_prompt.collect()]
    check_pieces(pieces, texts, want, capacity, segments, loss)
    whole = collections.Counter()
    for r in with_prompt.select("doc_id").distinct().collect():
        mine = sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.start)
        copies = [x for x in texts if x[0] == r.doc_id]
        ids = copies[0][1] + copies[0][2]
        covered = collections.Counter(i for p in mine for i in range(p.start, p.start + p.length))
        assert set(covered.values()) == {len(copies)} and len(covered) == len(ids) // 4
        for p in mine:
            assert bytes(p.ids) == ids[4 * p.start : 4 * (p.start + p.length)]
            prompt = len(copies[0][1]) // 4
            assert p.n_loss == max(0, p.start + p.length - max(p.start, prompt))
            whole[p.sequence_id] += p.length


def test_pack_pads_little(spark, sf, no_docs):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack_digest(df, public_tokenizers.path("byte_bpe_50k.json"))
    sizes = [r.n for r in got.groupBy("sequence_id").sum("length").withColumnRenamed("sum(length)", "n").collect()]
    assert sum(2048 - n for n in sizes) <= 2048 * df.rdd.getNumPartitions()
    assert packing.pack(no_docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_what_waits_does_not_keep_whole_documents():
    import tracemalloc

    packer = packing.Packer(2048, 64, 1792, 0)
    tracemalloc.start()
    try:
        for i in range(300):
            for _ in packer.add(i, bytes(4 * 200_001), 50_000):
                pass
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(packer.wait) >= 300 and kept < 3 * sum(4 * p[2] for p in packer.wait) + 1_000_000

from stratalens.llm import queries


def test_contract_columns(spark, sf):
    want = {
        "op1_html_extraction": {"page_id", "url", "text", "n_chars"}, "op2_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op4_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op5_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
        "op6_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op7_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op8_directly_addressable_codes": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op9_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"}, "op10_mix_to_weights": {"doc_id", "size", "source_size", "target", "taken"}, "op3_license_scans": {"doc_id", "licence", "basis"},
        "op11_embedding_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}, "op12_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"}, "op13_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    }
    got = queries.queries()
    assert set(got) == set(want)
    for name in ("op5_nearest_neighbours", "op7_packing", "op8_directly_addressable_codes", "op9_simhash_near_dedup", "op10_mix_to_weights", "op6_quality_rules", "op11_embedding_whitening", "op12_spelling_variants", "op13_substring_dedup"):
        assert want[name] <= set(got[name](spark, sf).columns), name

"""Every corpus query has SQL, or a test of its whole result against a brute-force version or held-out rows."""

import importlib

from rainshed.llm.queries import QUERIES, SQL

# query -> (module, test) that holds its rows against a plain version
PLAIN = {
    "op2_fingerprints": ("test_fingerprint", "test_query"),
    "op4_main_text": ("test_htmltext", "test_query"),
    "op6_personal_data": ("test_pii", "test_query_and_plan"),
    "op8_bpe_roundtrip": ("test_bpe", "test_query"),
    "op9_language_id": ("test_langid", "test_held_out_accuracy"),
    "op10_repeated_passages": ("test_repeats", "test_query"),
    "op12_tokenizer_alignment": ("test_alignment", "test_query"),
    "op13_sentencepiece": ("test_pieces", "test_query"),
}


def test_every_corpus_query_has_sql_or_a_plain_test():
    assert set(SQL) | set(PLAIN) == set(QUERIES) and not set(SQL) & set(PLAIN)
    for module, test in PLAIN.values():
        assert callable(getattr(importlib.import_module(module), test))

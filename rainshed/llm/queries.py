"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .alignment import op12_tokenizer_alignment
from .bpe import op8_bpe_roundtrip
from .decontaminate import op5_decontaminate
from .fingerprint import op2_fingerprints
from .htmltext import op4_main_text
from .langid import op9_language_id
from .neardup import op3_near_duplicates
from .oracle import SQL
from .pieces import op13_sentencepiece
from .pii import op6_personal_data
from .ranked import op11_ranked_search
from .repeats import op10_repeated_passages
from .tokencounts import op7_token_counts
from .warc import op1_warc_roundtrip

__all__ = ["QUERIES", "SQL"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_roundtrip, op2_fingerprints, op3_near_duplicates, op4_main_text, op5_decontaminate, op6_personal_data,
        op7_token_counts, op8_bpe_roundtrip, op9_language_id, op10_repeated_passages,
        op11_ranked_search, op12_tokenizer_alignment, op13_sentencepiece,
    )
}

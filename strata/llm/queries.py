"""Queries of this package: name -> (callable(spark, data folder), DuckDB SQL or None).

Where SQL is None it cannot express the method or is too slow over whole tables
(all pairs, all suffixes); those are tested against brute force, an exact round
trip or held-out labels in tests/llm.
"""

from __future__ import annotations

from strata.llm.ann import op1_hilbert_neighbours
from strata.llm.jaccard_join import op5_ngram_jaccard_join
from strata.llm.language import op9_language_id
from strata.llm.lexical import SEARCH_SQL, op13_lexical_search
from strata.llm.licenses import LICENSE_SQL, op7_license_scan
from strata.llm.mixing import op8_source_mixing
from strata.llm.pieces import op6_sentencepiece
from strata.llm.quality import op2_rule_quality
from strata.llm.secrets import op10_secret_scan
from strata.llm.suffix_dedup import op4_suffix_dedup
from strata.llm.url_models import op12_url_filter
from strata.llm.vectors_dedup import op3_vector_near_duplicates
from strata.llm.word_runs import op11_word_runs

QUERIES = {
    "op1_hilbert_neighbours": (op1_hilbert_neighbours, None),
    "op2_rule_quality": (op2_rule_quality, None),
    "op3_vector_near_duplicates": (op3_vector_near_duplicates, None),
    "op4_suffix_dedup": (op4_suffix_dedup, None),
    "op5_ngram_jaccard_join": (op5_ngram_jaccard_join, None),
    "op6_sentencepiece": (op6_sentencepiece, None),
    "op7_license_scan": (op7_license_scan, LICENSE_SQL),
    "op8_source_mixing": (op8_source_mixing, None),
    "op9_language_id": (op9_language_id, None),
    "op10_secret_scan": (op10_secret_scan, None),
    "op11_word_runs": (op11_word_runs, None),
    "op12_url_filter": (op12_url_filter, None),
    "op13_lexical_search": (op13_lexical_search, SEARCH_SQL),
}

"""Queries of the corpus operators, by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from . import urls
from .chat import op7_chat_windows
from .lm import op9_ngram_trie_scores
from .media import op5_telephony_audio
from .minhash import op1_minhash_components
from .mixing import op10_source_mixing
from .pieces import op8_sentencepiece_codec
from .quality import op3_quality_classifier
from .secrets import op4_secret_ledger
from .urls import op6_url_filter_cascade
from .winnow import op2_winnowing_fingerprints

QUERIES = {f.__name__: f for f in (op1_minhash_components, op2_winnowing_fingerprints, op3_quality_classifier, op4_secret_ledger, op5_telephony_audio, op6_url_filter_cascade, op7_chat_windows, op8_sentencepiece_codec, op9_ngram_trie_scores, op10_source_mixing)}
ORACLES: dict[str, str] = {"op6_url_filter_cascade": urls.ORACLE}

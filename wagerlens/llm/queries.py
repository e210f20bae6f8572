"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wagerlens.llm import backoff, conversations, decontamination, spelling, url_filter
from wagerlens.llm.bpe_count import op6_token_counts
from wagerlens.llm.compression_rules import op8_quality_rules
from wagerlens.llm.embedding_dedup import op2_embedding_dedup
from wagerlens.llm.gam_quality import op4_quality_classifier
from wagerlens.llm.ngram_join import op3_ngram_jaccard_join
from wagerlens.llm.packing import op10_best_fit_packing
from wagerlens.llm.piece_codec import op9_sentencepiece_codec
from wagerlens.llm.token_shards import op7_token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_lm_scoring": backoff.op5_lm_scoring,
    "op6_token_counts": op6_token_counts,
    "op7_token_shards": op7_token_shards,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece_codec": op9_sentencepiece_codec,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_benchmark_decontamination": decontamination.op11_benchmark_decontamination,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.ORACLE_SQL,
    "op5_lm_scoring": backoff.ORACLE_SQL,
    "op11_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
    "op13_conversation_repair": conversations.ORACLE_SQL,
}

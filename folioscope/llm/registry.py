"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_PLACES = {
    "op1_url_filter": "folioscope.llm.url_filter",
    "op2_ngram_join": "folioscope.llm.ngram_join",
    "op3_suffix_tree_lm": "folioscope.llm.suffix_tree_lm",
    "op4_secret_scan": "folioscope.llm.secret_scan",
    "op5_quality_rules": "folioscope.llm.quality_rules",
    "op6_quality_crf": "folioscope.llm.quality_crf",
    "op7_term_fingerprint": "folioscope.llm.term_fingerprint",
    "op8_bwt_dedup": "folioscope.llm.bwt_dedup",
    "op9_source_mix": "folioscope.llm.source_mix",
    "op10_bpe_codec": "folioscope.llm.bpe_codec",
    "op11_importance_resample": "folioscope.llm.importance_resample",
    "op12_conversation_repair": "folioscope.llm.conversation_repair",
    "op13_language_id": "folioscope.llm.language_id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: getattr(import_module(place), name) for name, place in _PLACES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {name: sql for name, place in _PLACES.items() if (sql := getattr(import_module(place), "ORACLE_SQL", None))}

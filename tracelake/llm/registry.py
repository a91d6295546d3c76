"""Queries and oracle SQL of the corpus operators, by name."""

from __future__ import annotations

import importlib

MODULES = ("decontamination", "mixing", "ngram_join", "chat", "sharding", "quality_rules", "suffix_dedup", "quality_classifier", "substring_dedup", "packing", "lexical_search", "run_detection", "vector_graph")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tracelake.llm.{name}"), what)
    return out


def queries() -> dict:
    import corpus_pipeline

    return _gather("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return _gather("ORACLES") | own

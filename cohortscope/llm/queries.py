"""All corpus queries by name."""

from __future__ import annotations

import importlib

MODULES = (
    "simhash",
    "pivot_topk",
    "decontamination",
    "licenses",
    "toxicity",
    "quality",
    "sentence_spans",
    "packing",
    "token_files",
    "token_counts",
    "periodic_runs",
    "suffix_dedup",
    "spelling_variants",
)


def all_llm_queries() -> tuple[dict, dict]:
    """Every corpus query, the pipeline included, and every SQL statement, by name."""
    from cohortscope.llm.base import ORACLES, QUERIES

    for module in MODULES:
        importlib.import_module(f"cohortscope.llm.{module}")
    import corpus_pipeline

    queries, oracles = {**QUERIES, "pipeline": corpus_pipeline.run}, dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return queries, oracles

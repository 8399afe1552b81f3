"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

from recordlink.functions.workers import ship

#: query name -> module with query() and, where SQL can express it, SQL
MODULES = {
    "op1_mixing": "mixing",
    "op2_quality": "quality",
    "op3_secrets": "secrets",
    "op4_bpe": "bpe",
    "op5_licenses": "licenses",
    "op6_passages": "passages",
    "op7_vectors": "vectors",
    "op8_jaccard": "jaccard",
    "op9_urls": "urls",
    "op10_toxicity": "toxicity",
    "op11_conversations": "conversations",
    "op12_neighbours": "neighbours",
    "op13_divergence": "divergence",
}


def _module(name: str):
    return importlib.import_module(f"recordlink.llm.{name}")


def _shipped(run):
    def query(spark, sf_dir: str):
        ship(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict:
    return {k: _shipped(_module(m).query) for k, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: _module(m).SQL for k, m in MODULES.items() if getattr(_module(m), "SQL", None)}

"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": q.op1_simhash,
    "op2_quality_rules": q.op2_quality_rules,
    "op3_quality_classifier": q.op3_quality_classifier,
    "op4_sharding": q.op4_sharding,
    "op5_exact_dedup": q.op5_exact_dedup,
    "op6_bpe": q.op6_bpe,
    "op7_packing": q.op7_packing,
    "op8_lm_scoring": q.op8_lm_scoring,
    "op9_warc": q.op9_warc,
    "op10_url_filters": q.op10_url_filters,
    "op11_best_fit": q.op11_best_fit,
    "op12_periodic_runs": q.op12_periodic_runs,
    "op13_ranked_search": q.op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": q.OP2_SQL,
    "op5_exact_dedup": q.OP5_SQL,
    "op9_warc": q.OP9_SQL,
    "op10_url_filters": q.OP10_SQL,
    "op12_periodic_runs": q.OP12_SQL,
    "op13_ranked_search": q.OP13_SQL,
}

"""Registered queries of this package and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefloom.llm import alignment, decontaminate, divergence, jaccard, licenses, linedup, packing, shard, simhash, suffix, topk, toxicity, warc
from prefloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": lambda s, d: packing.query(table(s, d, "documents")),
    "op2_decontamination": lambda s, d: decontaminate.query(table(s, d, "documents"), table(s, d, "benchmark")),
    "op3_license_scan": lambda s, d: licenses.query(table(s, d, "documents")),
    "op4_toxicity": lambda s, d: toxicity.query(table(s, d, "documents"), table(s, d, "labels")),
    "op5_sharding": lambda s, d: shard.query(table(s, d, "documents")),
    "op6_ngram_jaccard_join": lambda s, d: jaccard.query(table(s, d, "documents")),
    "op7_line_dedup": lambda s, d: linedup.query(table(s, d, "documents")),
    "op8_substring_dedup": lambda s, d: suffix.query(table(s, d, "documents")),
    "op9_warc": lambda s, d: warc.query(table(s, d, "pages")),
    "op10_exact_top_k": lambda s, d: topk.query(table(s, d, "embeddings")),
    "op11_tokenizer_alignment": lambda s, d: alignment.query(table(s, d, "documents")),
    "op12_simhash_near_dedup": lambda s, d: simhash.query(table(s, d, "documents")),
    "op13_source_divergence": lambda s, d: divergence.query(table(s, d, "documents")),
}

ORACLE: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE,
    "op6_ngram_jaccard_join": jaccard.ORACLE,
    "op7_line_dedup": linedup.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_exact_top_k": topk.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}

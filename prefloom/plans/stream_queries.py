"""Queries over the stateful streams (registered on import): pairs per prompt (ST2 + R1) and
first rows per key (D1). Both end with the closing step of a finite source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.plans import fixtures as FX
from prefloom.plans import oracle as O
from prefloom.plans.extra_queries import _state_parts
from prefloom.plans.registry import _pairs_sql, query
from prefloom.streaming import jobs as ST
from prefloom.streaming import stateful as SS

_EPOCH = 1704067200  # delivery times (fixture rule): one minute per conversation, one second per turn


def _read_back(spark, emitted: DataFrame) -> DataFrame:
    """The stream's sink, read in the caller's session."""
    path = emitted.inputFiles()
    return spark.read.schema(emitted.schema).parquet(*path) if path else spark.createDataFrame([], emitted.schema)


@query("stream_pairs", O.with_views("scored_v") + _pairs_sql("scored_v", 2.0))
def q_stream_pairs(spark, d):
    """Judgements, each delivered twice, parsed, de-duplicated and paired in one stream."""
    own = SS.stateful_session(spark, _state_parts(spark))
    conv = ST.read_table_stream(own, d, "conversations").where(F.col("role") == "assistant")
    pid, idx = F.col("conv_id").cast("bigint"), F.col("turn").cast("int")
    judged = conv.select(pid.alias("prompt_id"), idx.alias("cand_idx"), F.col("text").alias("response"),
                         FX.judge_text_rule(pid, idx).alias("judge_text"), F.lit(None).cast("string").alias("error"),
                         F.timestamp_seconds(F.lit(_EPOCH) + pid * 60 + idx).alias("ts"))
    prompts = FX.prompts(own, d).select(F.col("ord").alias("prompt_id"), "prompt")
    judged = judged.unionByName(judged).join(prompts, "prompt_id", "left")
    scored = ST.scored_stream(judged, keep=("prompt", "response", "ts"))
    emitted = ST.run_available_now(SS.pairs_stream(scored, 2.0, watermark=None), "pairs-stream")
    return SS.close_pairs(_read_back(spark, emitted), FX.scored(spark, d), 2.0)


_TURNS = "(SELECT *, conv_id * 1000 + turn AS ord FROM conversations) c"


@query("stream_dedup", f"""
SELECT ord, conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY md5(lower({O.strip('text')})) ORDER BY ord) AS rn FROM {_TURNS}) x WHERE rn = 1""")
def q_stream_dedup(spark, d):
    """D1 over all turns as they arrive: the first of equal texts."""
    turns = lambda c: c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "conv_id", "turn", "role", "text")
    own = SS.stateful_session(spark, _state_parts(spark))
    stream = turns(ST.read_table_stream(own, d, "conversations")).withColumn("ts", F.timestamp_seconds(F.lit(_EPOCH) + F.col("conv_id") * 60 + F.col("turn")))
    keep = ["ord", "conv_id", "turn", "role"]
    first = SS.first_rows_stream(stream, key="text", remember="10000 days", keep=keep)
    emitted = ST.run_available_now(first, "dedup-stream")
    return SS.close_first_rows(_read_back(spark, emitted), turns(FX.table(spark, d, "conversations")), key="text")

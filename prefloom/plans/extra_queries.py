"""Queries that need a Python hook, a sink round trip or a stream (registered here so
that :mod:`prefloom.plans.registry` stays pure DataFrame/SQL).

The hook queries use small deterministic stand-ins for the user's model functions
(a real model is the caller's), so their results can still be checked by SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.operators.candidates import fan_out, generate_candidates, judge_candidates
from prefloom.operators.rewards import compute_reward
from prefloom.plans import fixtures as FX
from prefloom.plans import oracle as O
from prefloom.plans.registry import ORACLE, q_build_pairs, query
from prefloom.sources.sinks import persist, write_pairs_json
from prefloom.session import scratch_path
from prefloom.streaming import jobs as ST


# --- stand-in model functions (what a user passes in) ------------------------------

def demo_generator(prompts: list[str]) -> list[str]:
    """Deterministic 'model': counts the prompt's characters."""
    return [f"Step 1. Count the characters. The answer is: {len(p)}" for p in prompts]


def demo_judge(prompts: list[str], responses: list[str]) -> list[str]:
    """Deterministic 'judge': a JSON verdict from the response length."""
    return [f'{{"score": {len(r) % 11}, "reason": "length rule"}}' for r in responses]


def demo_reward_model(texts: list[str]) -> list[float]:
    """Deterministic 'reward model': words / 100."""
    return [len(t.split()) / 100.0 for t in texts]


# --- hooks ---------------------------------------------------------------------------

@query("generate_candidates", O.with_views("prompts_v") + """
SELECT ord AS prompt_id, CAST(i AS INTEGER) AS cand_idx,
       'Step 1. Count the characters. The answer is: ' || CAST(length(prompt) AS VARCHAR) AS response
FROM prompts_v, range(0, 2) t(i)""")
def q_generate_candidates(spark, d):
    reqs = fan_out(FX.prompts(spark, d), n=2)
    out = generate_candidates(reqs, demo_generator)
    return out.select("prompt_id", F.col("cand_idx").cast("int").alias("cand_idx"), "response")


@query("judge_candidates", O.with_views("candidates_v") + f"""
SELECT prompt_id, cand_idx,
  CASE WHEN {O.blank('response')} THEN 0.0 ELSE CAST(length(response) % 11 AS DOUBLE) END AS score,
  CASE WHEN {O.blank('response')} THEN 'Empty response' ELSE 'length rule' END AS reason
FROM candidates_v""")
def q_judge_candidates(spark, d):
    j = judge_candidates(FX.candidates(spark, d), demo_judge)
    return j.select("prompt_id", "cand_idx", "score", "reason")


@query("compute_reward", O.with_views("reward_input_v") + f"""
SELECT prompt_id, cand_idx, {O.words("coalesce(query, '') || chr(10) || chr(10) || coalesce(response, '')")} / 100.0::DOUBLE AS reward
FROM reward_input_v""")
def q_compute_reward(spark, d):
    r = compute_reward(FX.reward_input(spark, d), demo_reward_model)
    return r.select("prompt_id", "cand_idx", "reward")


# --- sinks -----------------------------------------------------------------------------

@query("json_roundtrip", ORACLE["build_pairs"])
def q_json_roundtrip(spark, d):
    """S8 then read back: the pairs written as JSON lines equal the pairs computed."""
    pairs = q_build_pairs(spark, d)
    path = scratch_path(spark, "pairs-json")
    write_pairs_json(pairs, path)
    return spark.read.schema(pairs.schema).json(path)


@query("persisted_pairs", ORACLE["build_pairs"])
def q_persisted_pairs(spark, d):
    """S7/persist: the scored table is written before pairing (lineage cut), pairs equal."""
    from prefloom.operators.pairs import build_pairs
    from prefloom.operators.prep import default_identity

    sc = persist(FX.scored(spark, d), "scored")
    pairs = build_pairs(sc, min_gap=2.0)
    ids = FX.prompts(spark, d).select(F.col("ord").alias("prompt_id"), "ord", "id", "category")
    return default_identity(pairs.join(ids, "prompt_id", "left")).drop("ord")


# --- streams ---------------------------------------------------------------------------

def _state_parts(spark) -> int:
    """State partitions for the fixture streams: the session's cores (tens of keys per
    window here; a production stream sizes this to its key cardinality)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


_METHOD_SQL = "coalesce(" + O._case("event_type", FX.METHOD_BY_EVENT) + ", event_type)"


@query("stream_reward_monitor", f"""
SELECT CAST(epoch(ws) AS BIGINT) AS window_start, CAST(epoch(ws + INTERVAL 1 HOUR) AS BIGINT) AS window_end,
  method, n, round(mean_value, 9) AS mean_value
FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ws, {_METHOD_SQL} AS method, count(*) AS n, avg(value) AS mean_value
      FROM events GROUP BY 1, 2) g""", digits=9)
def q_stream_reward_monitor(spark, d):
    """The stream's closed windows and, at the end of the input, those still open."""
    logs = lambda ev: ev.select("ts", FX.event_method().alias("method"), "value")
    own = ST.stream_session(spark, _state_parts(spark))
    emitted = ST.run_available_now(ST.reward_monitor(logs(ST.read_table_stream(own, d, "events"))), "reward-monitor")
    path = emitted.inputFiles()
    emitted = spark.read.schema(emitted.schema).parquet(*path) if path else spark.createDataFrame([], emitted.schema)
    return ST.close_windows(emitted, logs(FX.table(spark, d, "events")))


@query("stream_scored", O.with_views("scored_v") + "SELECT prompt_id, cand_idx, score, reason FROM scored_v")
def q_stream_scored(spark, d):
    own = ST.stream_session(spark, _state_parts(spark))
    conv = ST.read_table_stream(own, d, "conversations").where(F.col("role") == "assistant")
    pid, idx = F.col("conv_id").cast("bigint"), F.col("turn").cast("int")
    judged = conv.select(
        pid.alias("prompt_id"), idx.alias("cand_idx"), F.col("text").alias("response"),
        FX.judge_text_rule(pid, idx).alias("judge_text"), F.lit(None).cast("string").alias("error"),
        # delivery time of the judgement (fixture rule): one minute per conversation
        F.timestamp_seconds(F.lit(1704067200) + pid * 60 + idx).alias("ts"),
    )
    # every judgement is delivered twice; the second is dropped
    return ST.run_available_now(ST.scored_stream(judged.unionByName(judged)), "scored-stream")

"""Reward computation (hook or rule), per-batch reward stats, pairs from rewards."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.functions import reward as RW
from prefloom.functions.templates import scoring_text
from prefloom.operators.pairs import build_pairs

# --- fixed values -----------------------------------------------------------
LOGGING_STEPS = 5   # the reference logs batches whose index is a multiple of this
# ---------------------------------------------------------------------------


def reward_terms(df: DataFrame, response: str = "response") -> DataFrame:
    """W2-W6 as separate columns."""
    return df.withColumns({
        "length_term": RW.length_term(response),
        "step_term": RW.step_term(response),
        "answer_term": RW.answer_term(response),
        "notation_term": RW.notation_term(response),
        "repetition_term": RW.repetition_term(response),
    })


def compute_reward(df: DataFrame, fn: Callable[[list[str]], list[float]] | None = None,
                   query: str = "query", response: str = "response") -> DataFrame:
    """The user's reward model over ``query + "\\n\\n" + response`` (Arrow batches),
    else the rule-based reward W1 as a native expression."""
    if fn is None:
        return df.withColumn("reward", RW.heuristic_reward(response))
    src = df.withColumn("_text", scoring_text(query, response))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = pdf["_text"].fillna("").tolist()
            vals = [float(v) for v in fn(texts)]
            if len(vals) != len(texts):
                raise ValueError("reward model returned a different number of outputs")
            yield pdf.drop(columns=["_text"]).assign(reward=vals)

    schema = T.StructType(df.schema.fields + [T.StructField("reward", T.DoubleType())])
    return src.mapInPandas(run, schema)


def batch_reward_stats(rewards: DataFrame, logging_steps: int = LOGGING_STEPS) -> DataFrame:
    """Mean reward per (epoch, batch) for every batch, with a flag for the batches the
    reference would have logged (``batch % logging_steps == 0``); extra logged
    columns (e.g. ``kl``, ``entropy``) are averaged when present."""
    extra = [c for c in ("kl", "entropy") if c in rewards.columns]
    return rewards.groupBy("epoch", "batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("reward").alias("mean_reward"),
        *[F.avg(c).alias(f"mean_{c}") for c in extra],
    ).withColumn("logged", F.col("batch") % logging_steps == 0)


def pairs_from_rewards(rewards: DataFrame, min_gap: float = 0.0, key: str = "prompt_id") -> DataFrame:
    """R1 with the reward as the score (best vs worst response per prompt)."""
    s = rewards.select(key, F.col("query").alias("prompt"), "cand_idx", "response",
                       F.col("reward").alias("score"), F.lit("").alias("reason"))
    return build_pairs(s, min_gap=min_gap, key=key)

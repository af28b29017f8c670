"""Preference pairs from scored candidates, outcomes and generation stats.

One shuffle: a group-by on ``prompt_id`` with partial (map-side) aggregation, so a
prompt holding a third of all candidates is reduced on every map task before the
exchange. Winners are picked with ``max_by``/``min_by`` over a struct ordering key,
which carries the text in the aggregation buffer: only one row per prompt and map
task crosses the shuffle, never the full candidate set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.functions.judge import JUDGE_ERROR_PREFIX
from prefloom.functions.text import is_blank

PAIR_COLUMNS = [
    "prompt", "chosen", "rejected", "chosen_score", "rejected_score", "score_gap",
    "chosen_reason", "rejected_reason",
]


def drop_blank_candidates(scored: DataFrame, response: str = "response") -> DataFrame:
    """a candidate whose ``strip()`` is empty never enters a pair."""
    return scored.where(~is_blank(response))


def eligible(scored: DataFrame) -> DataFrame:
    """The candidates that pairs and outcomes count alike: not blank, and with a score (a
    candidate without one was never judged, so it cannot be best or worst)."""
    return drop_blank_candidates(scored).where(F.col("score").isNotNull())


def _pick(scored: DataFrame, key: str) -> DataFrame:
    """Per prompt: count of non-blank candidates, the earliest best and the latest worst."""
    # ordering key (score, -cand_idx): max -> best score, earliest index on ties;
    # min -> worst score, latest index on ties (stable descending sort semantics).
    order = F.struct(F.col("score"), (-F.col("cand_idx")).alias("neg_idx"))
    payload = F.struct("response", "score", "reason", "cand_idx")
    return (
        eligible(scored)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n_candidates"),
            F.min("prompt").alias("prompt"),  # one text per prompt; min is deterministic
            F.max_by(payload, order).alias("best"),
            F.min_by(payload, order).alias("worst"),
        )
    )


def _pick_narrow(scored: DataFrame, key: str) -> DataFrame:
    """Alternative to :func:`_pick`: winners' indices from a text-free aggregate, texts
    joined back by (key, cand_idx). Kept for measurement (see README): it shuffles the
    candidate rows with their text for the join-back."""
    nb = eligible(scored)
    order = F.struct(F.col("score"), (-F.col("cand_idx")).alias("neg_idx"))
    w = nb.groupBy(key).agg(F.count(F.lit(1)).alias("n_candidates"),
                            F.max_by("cand_idx", order).alias("_bi"), F.min_by("cand_idx", order).alias("_wi"))
    payload = nb.select(key, "cand_idx", "prompt", F.struct("response", "score", "reason", "cand_idx").alias("p"))
    b = payload.withColumnsRenamed({"cand_idx": "_bi", "p": "best"})
    r = payload.select(key, F.col("cand_idx").alias("_wi"), F.col("p").alias("worst"))
    return w.join(b, [key, "_bi"]).join(r, [key, "_wi"]).select(key, "n_candidates", "prompt", "best", "worst")


def build_pairs(scored: DataFrame, min_gap: float = 2.0, key: str = "prompt_id", strategy: str = "carry") -> DataFrame:
    """R1+R2: chosen = best, rejected = worst; needs >= 2 non-blank candidates and
    ``gap >= min_gap`` (equality kept).

    Input: ``key, prompt, cand_idx, response, score, reason``. Output: ``key`` + the
    eight pair columns in the reference's order. ``strategy='carry'`` (default) carries
    the winners' text through one partial aggregation; ``'narrow'`` aggregates indices
    only and joins the texts back.
    """
    g = _pick(scored, key) if strategy == "carry" else _pick_narrow(scored, key)
    pairs = g.select(
        key,
        "prompt",
        F.col("best.response").alias("chosen"),
        F.col("worst.response").alias("rejected"),
        F.col("best.score").alias("chosen_score"),
        F.col("worst.score").alias("rejected_score"),
        (F.col("best.score") - F.col("worst.score")).alias("score_gap"),
        F.col("best.reason").alias("chosen_reason"),
        F.col("worst.reason").alias("rejected_reason"),
        "n_candidates",
    )
    return gap_filter(pairs.where(F.col("n_candidates") >= 2), min_gap).drop("n_candidates")


def gap_filter(pairs: DataFrame, min_gap: float) -> DataFrame:
    """R2: pairs whose gap is below ``min_gap`` are skipped; equality is kept."""
    return pairs.where(F.col("score_gap") >= F.lit(float(min_gap)))


def pair_outcomes(prompts: DataFrame, scored: DataFrame, min_gap: float = 2.0,
                  prompt_key: str = "ord", key: str = "prompt_id", errors: DataFrame | None = None,
                  judge_failures: bool = False) -> DataFrame:
    """One status per prompt: ``pair`` / ``too_few`` / ``low_gap`` / ``error``.

    The reference counts ``too_few`` and ``low_gap`` together as ``skipped_low_gap``;
    they are kept apart here and summed in :func:`generation_stats`. ``errors`` (optional)
    holds the keys of prompts whose processing failed. With ``judge_failures`` the column of that
    name counts a prompt's candidates whose judge failed (their reason says so, C3).
    """
    # only the count and the score range matter here: fixed-width buffers, so this is a
    # hash aggregation that carries no text (best - worst score == max - min score)
    g = eligible(scored).groupBy(F.col(key).alias("_k")).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        (F.max("score") - F.min("score")).alias("score_gap"),
        *([F.count_if(F.startswith("reason", F.lit(JUDGE_ERROR_PREFIX))).alias("judge_failures")] if judge_failures else []),
    )
    p = prompts.select(F.col(prompt_key).alias(key))
    out = p.join(g, p[key] == g["_k"], "left")
    status = (
        F.when(F.coalesce(F.col("n_candidates"), F.lit(0)) < 2, F.lit("too_few"))
        .when(F.col("score_gap") < F.lit(float(min_gap)), F.lit("low_gap"))
        .otherwise(F.lit("pair"))
    )
    if errors is not None:
        e = errors.select(F.col(key).alias("_e"), F.lit(True).alias("_err")).distinct()
        out = out.join(e, out[key] == e["_e"], "left")
        status = F.when(F.col("_err"), F.lit("error")).otherwise(status)
    failures = [F.coalesce("judge_failures", F.lit(0)).cast("bigint").alias("judge_failures")] if judge_failures else []
    return out.select(key, F.coalesce(F.col("n_candidates"), F.lit(0)).cast("bigint").alias("n_candidates"),
                      status.alias("status"), *failures)


def generation_stats(outcomes: DataFrame) -> DataFrame:
    """The reference's counters plus the success rate ``ok / max(total, 1) * 100``, and the
    candidates whose judge failed if the outcomes count them."""
    s = F.col("status")
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_prompts"),
        F.count_if(s == "pair").alias("successful_pairs"),
        F.count_if(s.isin("too_few", "low_gap")).alias("skipped_low_gap"),
        F.count_if(s == "too_few").alias("skipped_too_few"),
        F.count_if(s == "error").alias("errors"),
        *([F.coalesce(F.sum("judge_failures"), F.lit(0)).alias("judge_failures")] if "judge_failures" in outcomes.columns else []),
    ).withColumn(
        "success_rate",
        F.col("successful_pairs") / F.greatest(F.col("total_prompts"), F.lit(1)) * 100.0,
    )

"""Run-log tables (the reference's charts as tables), diversity, mode collapse,
inference rollups and the offline preference objective.

Inputs are long tables: ``(method, step, metric, value)`` logs, β results, inference
runs, logged log-probs. Every operator is one partial aggregation; small per-method /
per-β tables are finished with windows over those bounded tables, never with a cross
join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.functions.text import collapse_ws, dedup_key, words

# --- fixed values -----------------------------------------------------------
METHODS = ["sft", "dpo", "ppo"]
STAGES = ["base", "sft", "dpo", "ppo"]
BASE_ACCURACY = 0.22
RISK_HIGH, RISK_MEDIUM = 0.5, 0.2          # mode-collapse score thresholds
GPU_LIMIT_GB = 15.0
GIB = 1024 ** 3
KV_DTYPE_BYTES = 2
LOSS_TYPES = ["sigmoid", "hinge", "ipo"]
DEFAULT_BETAS = [0.05, 0.1, 0.2, 0.5]
SKETCH_LG_K = 14
# frequent n-grams (at most so many, found so often in such a share of the texts) are dealt to so many parts
FREQUENT, FREQUENT_FROM, SAMPLE, PARTS = 1000, 10, 0.01, 64
# ---------------------------------------------------------------------------


def loss_curves(logs: DataFrame, metric: str = "train_loss", methods=METHODS) -> DataFrame:
    """G1: mean loss per step, one column per method; ``other_rows`` counts the rows of
    methods that are not listed."""
    listed = F.coalesce(F.col("method").isin(*methods), F.lit(False))
    return logs.where(F.col("metric") == metric).groupBy("step").agg(
        *[F.avg(F.when(F.col("method") == m, F.col("value"))).alias(m) for m in methods],
        F.count_if(~listed).alias("other_rows"))


def final_values(logs: DataFrame, metric: str) -> DataFrame:
    """Per method, the mean value logged at the method's last step."""
    m = logs.where(F.col("metric") == metric).groupBy("method", "step").agg(F.avg("value").alias("v"))
    return m.groupBy("method").agg(F.max_by("v", "step").alias("final"), F.max("step").alias("last_step"))


def accuracy_progression(logs: DataFrame, base: float = BASE_ACCURACY, metric: str = "eval_accuracy") -> DataFrame:
    """Final accuracy by stage base -> sft -> dpo -> ppo, gain over the previous stage
    and over base. A method that is no stage keeps its row, with ``stage_no`` and
    ``gain_prev`` NULL. One row per method in one task."""
    f = final_values(logs, metric).select("method", F.col("final").alias("accuracy"))
    order = F.create_map(*[x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))])
    base_row = f.sparkSession.range(1).select(F.lit("base").alias("method"), F.lit(float(base)).alias("accuracy"))
    t = f.unionByName(base_row).withColumn("stage_no", F.try_element_at(order, F.col("method")))
    w = Window.partitionBy(F.col("stage_no").isNull()).orderBy("stage_no")
    return t.select(
        F.col("method").alias("stage"), "stage_no",
        "accuracy",
        (F.col("accuracy") - F.when(F.col("stage_no").isNotNull(), F.lag("accuracy").over(w))).alias("gain_prev"),
        (F.col("accuracy") - F.lit(float(base))).alias("gain_base"),
    )


def reward_margins(logs: DataFrame, method: str = "dpo") -> DataFrame:
    """Mean chosen and rejected reward per step and their difference."""
    d = logs.where((F.col("method") == method) & F.col("metric").isin("rewards_chosen", "rewards_rejected"))
    g = d.groupBy("step").agg(
        F.avg(F.when(F.col("metric") == "rewards_chosen", F.col("value"))).alias("chosen"),
        F.avg(F.when(F.col("metric") == "rewards_rejected", F.col("value"))).alias("rejected"),
    )
    return g.select("step", F.col("chosen").alias("rewards_chosen"), F.col("rejected").alias("rewards_rejected"),
                    (F.col("chosen") - F.col("rejected")).alias("margin"))


def beta_ablation(results: DataFrame) -> DataFrame:
    """One row per β (sorted) with a mode-collapse risk bucket."""
    s = F.col("mode_collapse_score")
    risk = F.when(s > RISK_HIGH, "high").when(s > RISK_MEDIUM, "medium").otherwise("low")
    cols = ["accuracy", "diversity", "mode_collapse_score", "train_loss"]
    return results.select("beta", *cols, risk.alias("risk")).orderBy("beta")


def beta_sweep_status(sweep: DataFrame) -> DataFrame:
    """Per β, runs that succeeded and failed (failures isolated per run)."""
    failed = F.col("status").startswith("failed")
    return sweep.groupBy("beta").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(~failed).alias("succeeded"),
        F.count_if(failed).alias("failed"),
    ).withColumn("status", F.when(F.col("failed") == 0, "success").otherwise("partial"))


def resource_efficiency(summary: DataFrame, baseline: str = "ppo", limit_gb: float = GPU_LIMIT_GB) -> DataFrame:
    """Memory, time and accuracy per method, an over-limit flag and percent deltas
    against a baseline method (a window over the per-method table)."""
    allm = Window.partitionBy(F.lit(0))

    def base(c):
        return F.max(F.when(F.col("method") == baseline, F.col(c))).over(allm)

    return summary.select(
        "method",
        "memory_gb", "training_time_min",
        "final_accuracy",
        (F.col("memory_gb") > F.lit(limit_gb)).alias("over_limit"),
        ((F.col("memory_gb") - base("memory_gb")) / base("memory_gb") * 100.0).alias("memory_delta_pct"),
        ((F.col("training_time_min") - base("training_time_min")) / base("training_time_min") * 100.0)
        .alias("time_delta_pct"),
        ((F.col("final_accuracy") - base("final_accuracy")) * 100.0).alias("accuracy_delta_points"),
    )


def analysis_summary(summary: DataFrame, betas: DataFrame, best_of=("dpo", "ppo")) -> DataFrame:
    """Best method and accuracy, optimal β and DPO-vs-PPO deltas, computed from the
    tables (the reference hard-codes them). One aggregate over a tagged union."""
    m = summary.select(F.lit("m").alias("kind"), "method", F.col("final_accuracy").alias("acc"),
                       "memory_gb", F.col("training_time_min").cast("double").alias("time"),
                       F.lit(None).cast("double").alias("beta"))
    b = betas.select(F.lit("b").alias("kind"), F.lit(None).cast("string").alias("method"),
                     F.col("accuracy").alias("acc"), F.lit(None).cast("double").alias("memory_gb"),
                     F.lit(None).cast("double").alias("time"), "beta")
    u = m.unionByName(b)
    a, p = best_of

    def of(method, c):
        return F.max(F.when((F.col("kind") == "m") & (F.col("method") == method), F.col(c)))

    g = u.agg(
        F.max_by(F.when(F.col("kind") == "m", F.col("method")),
                 F.when(F.col("kind") == "m", F.struct("acc", "method"))).alias("best_method"),
        F.max(F.when(F.col("kind") == "m", F.col("acc"))).alias("best_accuracy"),
        F.max_by(F.when(F.col("kind") == "b", F.col("beta")),
                 F.when(F.col("kind") == "b", F.struct("acc", F.col("beta")))).alias("optimal_beta"),
        of(a, "acc").alias("_a_acc"), of(p, "acc").alias("_p_acc"),
        of(a, "memory_gb").alias("_a_mem"), of(p, "memory_gb").alias("_p_mem"),
        of(a, "time").alias("_a_t"), of(p, "time").alias("_p_t"),
    )
    return g.select(
        "best_method", "best_accuracy", "optimal_beta",
        ((F.col("_a_acc") - F.col("_p_acc")) * 100.0).alias("accuracy_gain_points"),
        ((F.col("_p_mem") - F.col("_a_mem")) / F.col("_p_mem") * 100.0).alias("memory_saving_pct"),
        ((F.col("_p_t") - F.col("_a_t")) / F.col("_p_t") * 100.0).alias("time_saving_pct"),
    )


def ngrams(df: DataFrame, text: str = "response", n: int = 4, hashed: bool = False) -> DataFrame:
    """Whitespace tokens -> all contiguous n-grams (one row each). With ``hashed`` the
    n-gram is kept as two independent 64-bit xxhash values (128 bits: collisions are
    negligible even for 10^12 distinct n-grams) to cut shuffle bytes at scale."""
    x = df.withColumn("_t", words(text))
    starts = F.sequence(F.lit(0), F.size("_t") - n)
    x = x.withColumn("_i", F.explode(F.when(F.size("_t") >= n, starts).otherwise(F.array().cast("array<int>"))))
    parts = [F.get("_t", F.col("_i") + k) for k in range(n)]
    hashes = F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("\u0001"), *parts).alias("h2"))
    return x.withColumn("ngram", hashes if hashed else F.concat_ws(" ", *parts)).drop("_t", "_i")


def _frequent(grams: DataFrame) -> list[int]:
    """First hashes of n-grams that are frequent among ``grams``, at most ``FREQUENT`` of them."""
    often = grams.groupBy(F.col("ngram.h1").alias("h")).count().where(F.col("count") >= FREQUENT_FROM)
    return [r["h"] for r in often.orderBy(F.desc("count"), "h").limit(FREQUENT).collect()]


def distinct_n(responses: DataFrame, by=("group",), n: int = 4, hashed: bool = False) -> DataFrame:
    """Distinct-n = distinct n-grams / all n-grams per group. Spark plans the
    distinct count by shuffling on (group, ngram), so a hot group is spread out. Exact; see
    :func:`distinct_n_sketch` for a bounded state per group.

    ``hashed`` is for texts whose n-grams hardly recur: a task that combined them before the
    shuffle would hold all n-grams of its split, so they are dealt out first and counted in parts
    of the shuffle's size. n-grams that a sample of the texts shows to be frequent are dealt to
    several tasks and merged; the sample decides nothing else, all n-grams are counted."""
    g = ngrams(responses, n=n, hashed=hashed)
    if hashed:
        frequent = _frequent(ngrams(responses.sample(SAMPLE, seed=1), n=n, hashed=True))
        often = F.col("_h1").isin(frequent) if frequent else F.lit(False)
        key = [*by, "_h1", "_h2", "_part"]
        g = g.select(*by, F.col("ngram.h1").alias("_h1"), F.col("ngram.h2").alias("_h2"))
        g = g.withColumn("_part", F.when(often, F.spark_partition_id() % PARTS).otherwise(0))
        counts = g.repartition(*key).groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
        merged = F.collect_set(F.when(often, F.struct("_h1", "_h2")))
        out = counts.groupBy(*by).agg(F.sum("_c").alias("ngrams"), (F.count_if(~often) + F.size(merged)).alias("distinct_ngrams"))
    else:
        out = g.groupBy(*by).agg(
            F.count(F.lit(1)).alias("ngrams"),
            F.count_distinct("ngram").alias("distinct_ngrams"),
        )
    return out.withColumn("distinct_n", F.col("distinct_ngrams") / F.col("ngrams"))


def distinct_n_sketch(responses: DataFrame, by=("group",), n: int = 4, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """G8 at scale, first half: (by, ngrams, sketch) with a mergeable sketch (HyperLogLog) of the distinct
    n-grams. A task sends 2**lg_k bytes a group at most instead of its n-grams, and sketches of
    shards, days or models add up by :func:`merge_sketches`."""
    g = ngrams(responses, n=n)
    return g.groupBy(*by).agg(F.count(F.lit(1)).alias("ngrams"), F.hll_sketch_agg(F.xxhash64("ngram"), F.lit(lg_k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by=("group",)) -> DataFrame:
    """Sketches of parts -> one per ``by``."""
    return sketches.groupBy(*by).agg(F.sum("ngrams").alias("ngrams"), F.hll_union_agg("sketch").alias("sketch"))


def sketch_error(lg_k: int = SKETCH_LG_K) -> float:
    """Three standard errors of a sketch's count, relative to it: 2.4 % with the default."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def distinct_n_estimate(sketches: DataFrame) -> DataFrame:
    """G8 at scale, second half: the columns of :func:`distinct_n`, with estimated distinct n-grams."""
    x = sketches.withColumn("distinct_ngrams", F.hll_sketch_estimate("sketch")).drop("sketch")
    return x.withColumn("distinct_n", F.col("distinct_ngrams") / F.col("ngrams"))


def mode_collapse(responses: DataFrame, by=("group",), prompt: str = "prompt_id", text: str = "response") -> DataFrame:
    """G9 (our definition): share of responses whose normalised text (whitespace
    collapsed, stripped, lower-cased) occurs under at least two prompts of the group.
    :func:`prefloom.operators.near.near_mode_collapse` counts nearly identical ones too."""
    norm = dedup_key(collapse_ws(text))
    x = responses.withColumn("_h", norm)
    per = x.groupBy(*by, "_h").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(prompt).alias("_p"))
    return per.groupBy(*by).agg(
        F.sum("_n").alias("responses"),
        F.sum(F.when(F.col("_p") >= 2, F.col("_n")).otherwise(0)).alias("collapsed"),
    ).withColumn("mode_collapse", F.col("collapsed") / F.col("responses"))


def throughput_rollup(runs: DataFrame) -> DataFrame:
    """Per model, ratio of means: tokens/s = avg tokens / avg latency; ms per token."""
    ok = runs.where(F.col("status") == "success")
    g = ok.groupBy("model").agg(F.count(F.lit(1)).alias("num_runs"), F.avg("latency_sec").alias("lat"),
                                F.avg("generated_tokens").alias("tok"))
    return g.select(
        "model", "num_runs",
        F.round("lat", 3).alias("avg_latency_sec"),
        F.round("tok", 1).alias("avg_tokens_generated"),
        F.round(F.when(F.col("lat") > 0, F.col("tok") / F.col("lat")).otherwise(0.0), 2).alias("throughput_tokens_per_sec"),
        F.round(F.when(F.col("tok") > 0, F.col("lat") / F.col("tok") * 1000.0).otherwise(0.0), 2)
        .alias("time_per_output_token_ms"),
    )


def batch_impact(runs: DataFrame) -> DataFrame:
    """Per batch size: peak memory (GB), mean time, tokens x batch / time, and
    'OOM' if any run of that size ran out of memory."""
    oom = F.col("status") == "OOM"
    g = runs.groupBy("batch_size").agg(
        F.max(F.when(~oom, F.col("peak_mem_bytes"))).alias("_peak"),
        F.avg(F.when(~oom, F.col("latency_sec"))).alias("_t"),
        F.sum(F.when(~oom, F.col("generated_tokens") * F.col("batch_size"))).alias("_tok"),
        F.sum(F.when(~oom, F.col("latency_sec"))).alias("_tt"),
        F.count_if(oom).alias("oom_runs"),
        F.count(F.lit(1)).alias("runs"),
    )
    return g.select(
        "batch_size", "runs", "oom_runs",
        F.round(F.col("_peak") / GIB, 3).alias("peak_memory_gb"),
        F.round("_t", 3).alias("total_time_sec"),
        F.round(F.when(F.col("_tt") > 0, F.col("_tok") / F.col("_tt")), 2).alias("throughput_tokens_per_sec"),
        F.when(F.col("oom_runs") > 0, "OOM").otherwise("success").alias("status"),
    )


def kv_cache_estimate(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """2 * layers * kv_heads * head_dim * tokens * 2 bytes in GB; head_dim =
    hidden // attention heads.

    The estimate is linear in tokens, so requests are first reduced to (max, sum,
    count) of tokens per model (partial aggregation, no row-level join); only that
    one-row-per-model table meets the shape table, whose join strategy the planner
    picks from its measured size.
    """
    tokens = F.col("prompt_tokens") + F.col("generated_tokens")
    per_model = runs.groupBy("model").agg(F.max(tokens).alias("_max_t"), F.sum(tokens).alias("_sum_t"),
                                          F.count(F.lit(1)).alias("requests"))
    j = per_model.join(shapes, "model", "inner")
    head_dim = F.floor(F.col("hidden_size") / F.col("num_attention_heads"))
    bytes_per_token = (F.lit(2) * F.col("num_hidden_layers") * F.col("num_key_value_heads") * head_dim
                       * F.lit(KV_DTYPE_BYTES)).cast("double")
    return j.select(
        "model",
        F.round(bytes_per_token * F.col("_max_t") / GIB, 6).alias("max_kv_cache_gb"),
        F.round(bytes_per_token * (F.col("_sum_t") / F.col("requests")) / GIB, 6).alias("avg_kv_cache_gb"),
        "requests",
    )


def memory_overhead(runs: DataFrame) -> DataFrame:
    """Peak minus model memory in GB (rounded to 3), per model."""
    ov = (F.col("peak_mem_bytes") - F.col("model_mem_bytes")) / GIB
    return runs.groupBy("model").agg(
        F.round(F.avg(F.col("model_mem_bytes") / GIB), 3).alias("model_memory_gb"),
        F.round(F.max(F.col("peak_mem_bytes") / GIB), 3).alias("peak_inference_memory_gb"),
        F.round(F.avg(ov), 3).alias("avg_overhead_gb"),
        F.round(F.max(ov), 3).alias("max_overhead_gb"),
    )


def _log_sigmoid(x):
    # log(sigmoid(x)) = -(max(-x, 0) + log1p(exp(-|x|))), no overflow
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def preference_objective(logps: DataFrame, betas=DEFAULT_BETAS, label_smoothing: float = 0.0) -> DataFrame:
    """Offline DPO-family loss over logged log-probs for every β and loss type in
    ONE aggregation pass (no join with a β table), then unpivoted to rows.

    h = (pc - rc) - (pr - rr); sigmoid: -(1-ε)·logσ(βh) - ε·logσ(-βh);
    hinge: max(0, 1 - βh); ipo: (h - 1/(2β))². Reward accuracy: β(pc-rc) > β(pr-rr).
    """
    if any(float(b) <= 0 for b in betas):
        raise ValueError(f"beta must be > 0, got {list(betas)}")
    h = (F.col("policy_chosen") - F.col("ref_chosen")) - (F.col("policy_rejected") - F.col("ref_rejected"))
    eps = float(label_smoothing)
    aggs, rows = [], []
    for i, b in enumerate(betas):
        b = float(b)
        bh = F.lit(b) * h
        losses = {
            "sigmoid": -_log_sigmoid(bh) * F.lit(1.0 - eps) - _log_sigmoid(-bh) * F.lit(eps),
            "hinge": F.greatest(F.lit(0.0), F.lit(1.0) - bh),
            "ipo": F.pow(h - F.lit(1.0 / (2.0 * b)), 2),
        }
        acc = F.avg(((F.lit(b) * (F.col("policy_chosen") - F.col("ref_chosen")))
                     > (F.lit(b) * (F.col("policy_rejected") - F.col("ref_rejected")))).cast("double"))
        aggs.append(acc.alias(f"acc_{i}"))
        aggs.append(F.avg(bh).alias(f"margin_{i}"))
        for lt in LOSS_TYPES:
            aggs.append(F.avg(losses[lt]).alias(f"loss_{i}_{lt}"))
            rows.append(F.struct(F.lit(b).alias("beta"), F.lit(lt).alias("loss_type"),
                                 F.col(f"loss_{i}_{lt}").alias("loss"),
                                 F.col(f"acc_{i}").alias("reward_accuracy"),
                                 F.col(f"margin_{i}").alias("reward_margin")))
    aggs.append(F.count(F.lit(1)).alias("pairs"))
    return logps.agg(*aggs).select("pairs", F.inline(F.array(*rows))).select(
        "beta", "loss_type", "loss", "reward_accuracy", "reward_margin", "pairs")

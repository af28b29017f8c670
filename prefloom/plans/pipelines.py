"""The reference's stage pipelines as lazy DataFrame compositions.

Each returns one DataFrame with a ``split`` column; writing it (``partitionBy('split')``)
is the only action, and stats come from one aggregate over the written table.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.operators import prep
from prefloom.operators.candidates import fan_out, generate_candidates, judge_candidates
from prefloom.operators.pairs import build_pairs, generation_stats, pair_outcomes
from prefloom.operators.split import train_val_split
from prefloom.sources.sinks import persist as _persist

# --- fixed values -----------------------------------------------------------
VAL_RATIO, SEED = 0.1, 42
TRAINER_VAL_RATIO = 0.05
# the pairs table: ten columns in this order (also when empty)
PAIRS_TABLE = ["prompt", "chosen", "rejected", "chosen_score", "rejected_score", "score_gap",
               "chosen_reason", "rejected_reason", "id", "category"]
# ---------------------------------------------------------------------------


def cleaned_rows(df: DataFrame, order: str = "ord") -> DataFrame:
    """P2 with everything that L1's later stages decide by, in one projection: the cleaned rows,
    a row number (fixed once the table is written), the stage flags and a content hash. A row that
    the filters remove still takes part in dedup, but needs no text: its columns are NULL."""
    x = prep.clean_columns(df)
    x = x.withColumns({**prep.stage_flags(x, order=order), "_sig": F.xxhash64(*x.columns), "_row": F.monotonically_increasing_id()})
    x = x.withColumn("_ok", F.col("_len") & F.col("_valid"))
    return x.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in df.columns})


def process_preference_data(df: DataFrame, val_ratio: float = VAL_RATIO, seed: int = SEED,
                            order: str = "ord", key: str | None = None, cleaned: DataFrame | None = None) -> DataFrame:
    """L1: clean -> dedup(prompt) -> length filter -> validate -> DPO format -> split.
    Dedup precedes the length filter (a short first copy removes a later good copy).

    The cleaned rows are written once (``cleaned``, if the caller has them already). Dedup,
    filters and split read only their narrow columns (key, order, flags); one join by row
    number brings the survivors' split back to the texts.
    """
    rows = cleaned if cleaned is not None else _persist(cleaned_rows(df, order), "cleaned")
    key = key or order
    narrow = rows.select("_row", "_key", "_order", "_sig", F.col(key).alias("_by"), "_ok")
    first = prep.first_rows(narrow, "_order").withColumnRenamed("_key", "_k")
    same = narrow["_key"].eqNullSafe(first["_k"]) & narrow["_order"].eqNullSafe(first["_first"])
    kept = narrow.join(first, same, "left_semi").where("_ok").select("_row", "_by", "_sig")
    kept = train_val_split(kept, ratio=val_ratio, seed=seed, key="_by", materialize=True, tie=["_sig"])
    out = rows.where("_ok").select(*df.columns, "_row").join(kept.select("_row", "split"), "_row").drop("_row")
    return prep.format_for_dpo(out)


def process_sft_data(df: DataFrame, val_ratio: float = VAL_RATIO, seed: int = SEED, key: str = "ord") -> DataFrame:
    """L2: SFT format -> split; no cleaning or dedup (as in the reference)."""
    return train_val_split(prep.format_for_sft(df), ratio=val_ratio, seed=seed, key=key)


def dpo_training_table(df: DataFrame, already_split: bool = False, seed: int = SEED, key: str = "ord",
                       materialize: bool = False) -> DataFrame:
    """L3: require columns -> instruction prefix -> split(0.05). A set that already has
    splits is returned as is, without the prefix (the reference's early return)."""
    if already_split or "split" in df.columns:
        return df
    x = prep.ensure_instruction(prep.require_columns(df, prep.DPO_FIELDS))
    return train_val_split(x, ratio=TRAINER_VAL_RATIO, seed=seed, key=key, materialize=materialize)


def sft_training_table(df: DataFrame, already_split: bool = False, seed: int = SEED, key: str = "ord") -> DataFrame:
    """L4: ChatML text -> split(0.05); a processed set is returned as is."""
    if already_split or "split" in df.columns:
        return df
    x = prep.format_chatml(df, keep=(key,))
    return train_val_split(x, ratio=TRAINER_VAL_RATIO, seed=seed, key=key).drop(key)


def preference_pipeline(prompts: DataFrame, generate: Callable, judge: Callable, num_candidates: int = 4,
                        min_gap: float = 2.0, max_samples: int | None = None, persist: Callable | bool | None = None,
                        partitions: int | None = None, indexed: bool = False, judge_failures: bool = False):
    """Prompts -> N candidates (user fn) -> judge (user fn) -> parse -> pairs + stats.

    ``max_samples`` cuts prompts (by ordinal), not pairs. Model outputs are written
    before reuse (by default :func:`prefloom.sources.sinks.persist`, a parquet table under
    ``spark.checkpoint.dir``), so pairs and stats -- two actions -- never call the model
    twice for one candidate; ``persist=False`` keeps everything lazy. ``indexed``: the generator
    also gets the candidates' numbers (C2); ``judge_failures``: the stats also count the candidates
    whose judge failed. Returns (pairs, stats).
    """
    if persist is None or persist is True:
        persist = _persist
    elif persist is False:
        persist = None
    p = prompts if max_samples is None else prompts.where(F.col("ord") < max_samples)
    reqs = fan_out(p, num_candidates)
    cands = generate_candidates(reqs, generate, partitions, indexed)
    if persist is not None:
        cands = persist(cands, "candidates")
    sc = judge_candidates(cands.withColumnRenamed("error", "generation_error"), judge, partitions)
    if persist is not None:
        sc = persist(sc, "scored")
    pairs = build_pairs(sc, min_gap=min_gap)
    ids = p.select(F.col("ord").alias("prompt_id"), *[c for c in ("id", "category") if c in p.columns], "ord")
    pairs = prep.default_identity(pairs.join(ids, "prompt_id", "left")).select(*PAIRS_TABLE)
    # a prompt none of whose generations came through failed; a single failure only costs
    # its candidate, as in the reference
    failed = sc.groupBy("prompt_id").agg(F.count_if(F.col("generation_error").isNull()).alias("_ok")).where("_ok = 0")
    stats = generation_stats(pair_outcomes(p, sc, min_gap=min_gap, errors=failed, judge_failures=judge_failures))
    return pairs, stats


# --- whole stage jobs: read -> process -> write -> stats -------------------------------

def process_preference_job(spark, input_path: str, output_path: str, val_ratio: float = VAL_RATIO,
                           seed: int = SEED, fmt: str = "parquet"):
    """L1 as a job: S4 read -> L1 -> S7 write (one folder per split) -> S9 stats, and the rows
    each stage removed (F5)."""
    from prefloom.sources.readers import read_dataset, with_ordinal
    from prefloom.sources.sinks import write_dataset, write_processing_stats, write_rows

    df = read_dataset(spark, input_path, fmt)
    if "ord" not in df.columns:
        df = with_ordinal(df)
    cleaned = _persist(cleaned_rows(df), "cleaned")
    out = process_preference_data(df, val_ratio=val_ratio, seed=seed, cleaned=cleaned)
    write_dataset(out, output_path)
    written = spark.read.schema(out.schema).parquet(output_path)   # schema given: works when empty
    write_processing_stats(written, f"{output_path.rstrip('/')}_stats")
    write_rows(prep.flags_report(cleaned), f"{output_path.rstrip('/')}_stages")
    return written


def process_sft_job(spark, input_path: str, output_path: str, val_ratio: float = VAL_RATIO, seed: int = SEED,
                    fmt: str = "parquet"):
    """L2 as a job: S4 read -> P6 -> T1 -> S7 write."""
    from prefloom.sources.readers import read_dataset, with_ordinal
    from prefloom.sources.sinks import write_dataset

    df = read_dataset(spark, input_path, fmt)
    if "ord" not in df.columns:
        df = with_ordinal(df)
    out = process_sft_data(df, val_ratio=val_ratio, seed=seed)
    write_dataset(out, output_path)
    return spark.read.schema(out.schema).parquet(output_path)


def generate_dataset_job(spark, prompts, generate: Callable, judge: Callable, output_path: str,
                         num_candidates: int = 4, min_gap: float = 2.0, max_samples: int | None = None):
    """R5 as a job: model outputs persisted under the output folder, pairs written as
    parquet and JSON lines (S7, S8), generation counters as one JSON record (S9)."""
    from prefloom.sources.sinks import persist, write_pairs_json, write_record

    base = output_path.rstrip("/")
    pairs, stats = preference_pipeline(
        prompts, generate, judge, num_candidates=num_candidates, min_gap=min_gap, max_samples=max_samples,
        persist=lambda df, name: persist(df, name, f"{base}/_work/{name}"))
    pairs.write.mode("overwrite").parquet(f"{base}/pairs")
    written = spark.read.schema(pairs.schema).parquet(f"{base}/pairs")
    write_pairs_json(written, f"{base}/pairs_json")
    write_record(stats, f"{base}/generation_stats")
    return written


def evaluate_job(spark, predictions, items, output_path: str, detail: int | None = None, numeric: bool = False):
    """E3-E8 as a job: grade predictions against items, write per-model metrics and the
    result rows, or the first ``detail`` of them (S10). Returns the metrics DataFrame read back."""
    from prefloom.operators.evaluation import eval_metrics, grade
    from prefloom.sources.sinks import persist, write_eval

    base = output_path.rstrip("/")
    results = persist(grade(predictions, items, numeric=numeric), "results", f"{base}/results")
    metrics = eval_metrics(results)
    write_eval(metrics, results, base, detail=detail)
    return spark.read.json(f"{base}/metrics")


def analysis_job(spark, logs, beta_results, resources, output_path: str, base_accuracy: float = 0.22):
    """G1-G7 as a job: the comparison tables (the reference's charts) and the summary
    record, one folder each."""
    from prefloom.operators import runs as G
    from prefloom.sources.sinks import write_analysis_summary

    base = output_path.rstrip("/")
    tables = {
        "loss_curves": G.loss_curves(logs),
        "accuracy_progression": G.accuracy_progression(logs, base=base_accuracy),
        "reward_margins": G.reward_margins(logs),
        "beta_ablation": G.beta_ablation(beta_results),
        "resource_efficiency": G.resource_efficiency(resources),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    write_analysis_summary(G.analysis_summary(resources, beta_results), f"{base}/analysis_summary")
    return {name: spark.read.parquet(f"{base}/{name}") for name in tables}

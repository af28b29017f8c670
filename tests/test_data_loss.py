"""Nothing is lost without a word: readers, splits, sinks and model failures."""

import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from prefloom import session
from prefloom.functions.judge import with_judge_scores
from prefloom.operators import candidates, evaluation, pairs, prep
from prefloom.operators.split import stratified_split, train_val_split
from prefloom.sources import readers, sinks


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="prefloom-loss-")


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


RECORDS = [{"id": "a", "prompt": "one"}, {"id": "b", "prompt": "two"}]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_padded_pretty_array(spark, folder, scheme):
    path = put(f"{folder}/p.json", " " * 80 + "\n" + json.dumps(RECORDS, indent=2))
    got = readers.read_prompts(spark, scheme + path).orderBy("ord").collect()
    assert [(r.ord, r.id, r.prompt) for r in got] == [(0, "a", "one"), (1, "b", "two")]


def test_broken_inputs_stop_the_read(spark, folder):
    array = put(f"{folder}/broken.json", '[{"id": "a"}, {"id": ')
    lines = put(f"{folder}/broken.jsonl", '{"id": "a"}\n{"id": \n')
    for fmt, path in (("json_array", array), ("json_lines", lines)):
        with pytest.raises(Exception):
            readers.read_prompts(spark, path, fmt=fmt).collect()
    with pytest.raises(ValueError):
        readers.read_prompts(spark, lines, fmt="jsonl")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_sources_in_order(spark, folder, scheme):
    raw, processed = f"{scheme}{folder}/raw", f"{scheme}{folder}/processed"
    spark.range(3).write.parquet(raw)
    assert readers.read_sft_source(spark, processed, raw).count() == 3
    spark.range(5).write.parquet(processed)
    assert readers.read_sft_source(spark, processed, raw).count() == 5
    public = f"{scheme}{folder}/public"
    spark.range(2500).select(F.col("id").cast("string").alias("instruction"), F.lit("c").alias("chosen"), F.lit("r").alias("rejected")).coalesce(1).write.parquet(public)
    none = f"{scheme}{folder}/none"
    assert readers.read_preference_source(spark, none, processed).count() == 5
    assert readers.read_preference_source(spark, none, none, public).count() == 2500
    assert readers.read_preference_source(spark, none, None, public, public_n=readers.PUBLIC_N).count() == 2000
    with pytest.raises(FileNotFoundError):
        readers.read_preference_source(spark, none, None)


def test_train_logs_keep_text_values(spark, folder):
    put(f"{folder}/dpo/trainer_state.json", json.dumps({"global_step": 3, "log_history": [
        {"step": 1, "loss": 0.5}, {"step": 2, "loss": "diverged"}, {"step": 3, "loss": float("nan")}]}))
    got = sorted((r.step, r.metric, r.value, r.text) for r in readers.read_train_logs(spark, f"{folder}/*/trainer_state.json").collect())
    assert got[0] == (1, "loss", 0.5, "0.5") and got[1] == (2, "loss", None, "diverged") and got[2][0] == 3 and math.isnan(got[2][2])
    assert readers.read_train_logs(spark, f"{folder}/none/*/trainer_state.json").count() == 0
    put(f"{folder}/ppo/trainer_state.json", '{"log_history": [')
    with pytest.raises(Exception):
        readers.read_train_logs(spark, f"{folder}/*/trainer_state.json").collect()


def test_beta_sweep_keeps_every_metric(spark, folder):
    path = put(f"{folder}/beta.json", json.dumps({"0.1": {"metrics": {"accuracy": 0.6, "train_runtime": 12.5}, "status": "success"},
                                                  "0.5": {"metrics": {}, "status": "failed: oom"}}, indent=2))
    got = {r.beta: r for r in readers.read_beta_sweep(spark, path, fmt="json_object").collect()}
    assert got[0.1].metrics == {"accuracy": 0.6, "train_runtime": 12.5} and got[0.5].status == "failed: oom" and got[0.5].metrics == {}
    rows = spark.createDataFrame([(0.1, 0.6, 12.5)], "beta double, accuracy double, train_runtime double")
    sinks.write_beta_sweep(rows, f"{folder}/out")
    long = {(r.beta, r.metric): r.value for r in readers.beta_metrics(readers.read_beta_sweep(spark, f"{folder}/out")).collect()}
    assert long == {(0.1, "accuracy"): 0.6, (0.1, "train_runtime"): 12.5}


def test_splits_keep_null_keys_and_strata(spark):
    df = spark.range(100).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("ord"), F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("s"), F.col("id").alias("x"))
    out = train_val_split(df, 0.25, key="ord", bound=1).collect()
    assert sorted(r.x for r in out) == list(range(100)) and sum(r.split == "validation" for r in out) == 25
    strata = stratified_split(df, "s", 0.1, key="ord", bound=1).collect()
    assert sorted(r.x for r in strata) == list(range(100)) and sum(r.split == "validation" for r in strata) == 10
    by = {}
    for r in strata:
        by.setdefault(r.s, []).append(r.split == "validation")
    assert set(by) == {None, 0, 1, 2} and all(abs(sum(v) - 0.1 * len(v)) < 1 for v in by.values())


def test_split_is_exact_with_equal_keys(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("ord"), (F.col("id") % 7).alias("x"))
    for ratio in (0.1, 0.333, 0.9):
        out = train_val_split(df, ratio, key="ord", bound=3)
        assert out.count() == 1000 and out.where("split = 'validation'").count() == math.ceil(1000 * ratio)


def test_many_strata(spark):
    df = spark.range(3000).select("id", (F.col("id") % 900).alias("s"))
    out = stratified_split(df, "s", 0.1, key="id", bound=1).collect()
    sizes = {}
    for r in out:
        sizes[r.s] = sizes.get(r.s, 0) + (r.split == "validation")
    # ten thirds: 900 strata of 3 or 4 rows share 300 places, the larger remainders (4 rows) first
    four = {s for s in range(900) if s < 3000 - 3 * 900}
    assert sum(sizes.values()) == 300 and all(sizes[s] == 1 for s in four)


def test_pairs_and_outcomes_agree_on_missing_scores(spark):
    rows = [(1, "p", 0, "a", 9.0), (1, "p", 1, "b", None), (1, "p", 2, "c", 1.0), (2, "q", 0, "a", None), (2, "q", 1, "b", None), (3, "r", 0, "a", 9.0), (3, "r", 1, "b", None)]
    scored = spark.createDataFrame(rows, "prompt_id long, prompt string, cand_idx int, response string, score double").withColumn("reason", F.lit(""))
    made = {r.prompt_id: (r.chosen_score, r.rejected_score) for r in pairs.build_pairs(scored).collect()}
    prompts = spark.createDataFrame([(1,), (2,), (3,)], "ord long")
    status = {r.prompt_id: r.status for r in pairs.pair_outcomes(prompts, scored).collect()}
    assert made == {1: (9.0, 1.0)} and status == {1: "pair", 2: "too_few", 3: "too_few"}


def test_model_failures_are_counted(spark):
    from prefloom.plans.pipelines import preference_pipeline

    prompts = spark.createDataFrame([(i, f"id{i}", f"prompt {i}", "cat") for i in range(6)], "ord long, id string, prompt string, category string")

    def generate(ps):
        if any(p.endswith(("1", "4")) for p in ps):
            raise RuntimeError("no such device")
        return [f"answer to {p}" for p in ps]

    out = candidates.generate_candidates(candidates.fan_out(prompts, 2), generate)
    failed = {r.prompt_id: r.error for r in out.collect() if r.error}
    assert failed == {1: "no such device", 4: "no such device"}
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    _, stats = preference_pipeline(prompts, generate, lambda ps, rs: ["9" if i % 2 else "1" for i in range(len(rs))], num_candidates=2)
    s = stats.first()
    assert s.errors == 2 and s.total_prompts == 6


def test_grade_strips_both_sides(spark):
    items = spark.createDataFrame([(1, "q", "work\n#### , 5")], "item_id long, question string, answer string")
    preds = spark.createDataFrame([("m", 1, 0, "5", None)], "model string, item_id long, sample_idx int, response string, error string")
    assert evaluation.grade(preds, items).first().correct


def test_judge_numbers(spark):
    texts = {'{"score": Infinity}': (10.0, ""), '{"score": 1e400, "reason": "big"}': (10.0, "big"), '{"score": -Infinity}': (0.0, ""),
             '{"score": 5, "reason": null}': (5.0, None), '{"score": 5}': (5.0, ""), '{"score": "Infinity"}': (10.0, "")}
    got = {r.t: (r.score, r.reason) for r in with_judge_scores(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert got == texts
    long = "Score: 7 " + "x" * 500
    one = spark.createDataFrame([(long,)], "t string")
    assert len(with_judge_scores(one, "t").first().reason) == 200 and with_judge_scores(one, "t", reason_chars=None).first().reason == long


def test_response_forms(spark):
    df = spark.sql("SELECT ' text ' AS a, array(' x ', ' last ') AS b, array(named_struct('role', 'u', 'content', 'q'), named_struct('role', 'a', 'content', ' reply ')) AS c, "
                   "array(map('content', ' m ')) AS d, CAST(array() AS ARRAY<STRING>) AS e, array(1, 42) AS f")
    got = [prep.with_normalized_response(df, c).first().response for c in "abcdef"]
    assert got == ["text", "last", "reply", "m", None, "42"]


def test_detail_rows_are_a_total_order(spark, folder):
    res = spark.createDataFrame([(m, i, 0, i % 2 == 0) for i in range(40) for m in ("b", "a", "c")], "model string, item_id long, sample_idx int, correct boolean").repartition(5)
    sinks.write_eval(spark.range(1), res, f"{folder}/all")
    assert spark.read.json(f"{folder}/all/detailed_results").count() == 120
    sinks.write_eval(spark.range(1), res, f"{folder}/some", detail=sinks.EVAL_DETAIL)
    kept = {(r.model, r.item_id) for r in spark.read.json(f"{folder}/some/detailed_results").collect()}
    assert kept == {("a", i) for i in range(40)} | {("b", i) for i in range(10)}


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, k, default=None):
            return {"spark.master": "spark://host:7077"}.get(k, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_release_deletes_scratch(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    kept = [p for p in session._SCRATCH if p != path]
    session._SCRATCH[:] = [path]
    assert session.release(spark) == 1 and not os.path.exists(path.removeprefix("file:"))
    session._SCRATCH[:] = kept

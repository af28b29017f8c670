"""Evaluation, rewards, run-log tables and model hooks."""

import math

from pyspark.sql import functions as F

from helpers import SF_CHECK
from prefloom.operators import evaluation as ev
from prefloom.operators import runs as G
from prefloom.operators.candidates import fan_out, generate_candidates, judge_candidates
from prefloom.operators.rewards import batch_reward_stats, compute_reward, pairs_from_rewards
from prefloom.plans import fixtures as FX


def test_grading_counts(spark):
    r = ev.grade(FX.predictions(spark, SF_CHECK), FX.qa_items(spark, SF_CHECK))
    assert r.count() == 15000
    assert r.where("correct").count() == 7500          # forms 0, 2, 3
    m = ev.eval_metrics(r).collect()
    assert sum(x.correct for x in m) == 7500 and sum(x.total for x in m) == 15000


def test_pass_at_1_equals_accuracy(spark):
    r = ev.grade(FX.predictions(spark, SF_CHECK), FX.qa_items(spark, SF_CHECK)).withColumn(
        "item", F.floor(F.col("item_id") / 5))
    p1 = {x.k: x.pass_at_k for x in ev.pass_at_k(r, ks=(1, 5), item="item").collect()}
    per_item = r.groupBy("item").agg(F.avg(F.col("correct").cast("double")).alias("a")).agg(F.avg("a")).first()[0]
    assert abs(p1[1] - per_item) < 1e-9
    # brute force for k=5 on one item shape: n=5, c=3 -> 1.0 (n-c < k)
    assert 0.0 <= p1[5] <= 1.0


def test_pass_at_k_formula(spark):
    df = spark.createDataFrame([(1, c) for c in [True, False, False, True]], "item_id long, correct boolean")
    out = {x.k: x.pass_at_k for x in ev.pass_at_k(df, ks=(1, 2, 3)).collect()}
    n, c = 4, 2
    for k in (1, 2, 3):
        expect = 1.0 if n - c < k else 1 - math.prod(1 - k / i for i in range(n - c + 1, n + 1))
        assert abs(out[k] - expect) < 1e-9


def test_error_rows_count_as_wrong(spark):
    preds = spark.createDataFrame([("m", 1, 0, None, "timeout"), ("m", 2, 0, "#### 3", None)],
                                  "model string, item_id long, sample_idx int, response string, error string")
    items = spark.createDataFrame([(1, "q1", "x\n#### 3"), (2, "q2", "#### 3")], "item_id long, question string, answer string")
    r = {x.item_id: x for x in ev.grade(preds, items).collect()}
    assert r[1].predicted is None and r[1].response == "ERROR: timeout" and not r[1].correct
    assert r[2].correct
    (m,) = ev.eval_metrics(ev.grade(preds, items)).collect()
    assert (m.accuracy, m.total) == (0.5, 2)


def test_rewards_and_pairs(spark):
    df = spark.createDataFrame([(0, 0, 1, 0, "q", "The answer is 4"), (0, 0, 1, 1, "q", ""), (0, 0, 2, 0, "q", "x")],
                               "epoch int, batch long, prompt_id long, cand_idx int, query string, response string")
    rw = compute_reward(df)
    assert {r.cand_idx: r.reward for r in rw.where("prompt_id = 1").collect()} == {0: -0.5, 1: -2.0}
    stats = batch_reward_stats(rw).collect()
    assert stats[0].n == 3 and stats[0].logged
    pairs = pairs_from_rewards(rw).collect()
    assert len(pairs) == 0  # the blank reply never pairs; prompt 2 has one reply
    hooked = compute_reward(df, lambda texts: [float(len(t)) for t in texts]).collect()
    assert sorted(r.reward for r in hooked) == [3.0, 4.0, 18.0]


def test_generation_and_judge_hooks_isolate_failures(spark):
    prompts = spark.createDataFrame([(0, "a"), (1, "boom"), (2, "ccc")], "ord long, prompt string")

    def gen(ps):
        if "boom" in ps:
            raise RuntimeError("model down")
        return [p * 2 + "  " for p in ps]

    c = generate_candidates(fan_out(prompts, 2), gen).collect()
    got = {(r.prompt_id, r.cand_idx): r.response for r in c}
    assert got[(0, 0)] == "aa" and got[(1, 1)] == "" and got[(2, 1)] == "cccccc"

    def judge(ps, rs):
        if any(r == "cccccc" for r in rs):
            raise ValueError("judge down")
        return ['{"score": 4}'] * len(rs)

    cands = spark.createDataFrame([(r.prompt_id, r.prompt, r.cand_idx, r.response) for r in c],
                                  "prompt_id long, prompt string, cand_idx int, response string")
    j = {(r.prompt_id, r.cand_idx): (r.score, r.reason) for r in judge_candidates(cands, judge).collect()}
    assert j[(0, 0)] == (4.0, "")
    assert j[(1, 0)] == (0.0, "Empty response")
    assert j[(2, 0)] == (0.0, "Judge error: judge down")


def test_run_tables(spark):
    logs = spark.createDataFrame(
        [("sft", 0, "eval_accuracy", 0.3), ("sft", 5, "eval_accuracy", 0.5), ("dpo", 5, "eval_accuracy", 0.7),
         ("ppo", 5, "eval_accuracy", 0.6), ("dpo", 5, "rewards_chosen", 2.0), ("dpo", 5, "rewards_rejected", -1.0)],
        "method string, step long, metric string, value double")
    acc = {r.stage: r for r in G.accuracy_progression(logs, base=0.2).collect()}
    assert acc["sft"].accuracy == 0.5 and abs(acc["dpo"].gain_prev - 0.2) < 1e-9 and acc["base"].gain_prev is None
    (m,) = G.reward_margins(logs).collect()
    assert m.margin == 3.0
    betas = spark.createDataFrame([(0.05, 0.52, 0.35, 0.78, 0.28), (0.1, 0.67, 0.72, 0.22, 0.35),
                                   (0.2, 0.64, 0.81, 0.12, 0.42)],
                                  "beta double, accuracy double, diversity double, mode_collapse_score double, train_loss double")
    assert [r.risk for r in G.beta_ablation(betas).collect()] == ["high", "medium", "low"]
    summ = spark.createDataFrame([("sft", 8.2, 45, 0.48), ("dpo", 9.8, 55, 0.67), ("ppo", 13.5, 120, 0.63)],
                                 "method string, memory_gb double, training_time_min long, final_accuracy double")
    (s,) = G.analysis_summary(summ, betas).collect()
    assert (s.best_method, s.optimal_beta) == ("dpo", 0.1)
    assert abs(s.accuracy_gain_points - 4.0) < 1e-6


def test_distinct_n_and_mode_collapse(spark):
    df = spark.createDataFrame([("g", 1, "a b c d e"), ("g", 2, "a b c d"), ("g", 3, "A  b c d")],
                               "group string, prompt_id long, response string")
    (d,) = G.distinct_n(df).collect()
    assert (d.ngrams, d.distinct_ngrams) == (4, 3)
    (h,) = G.distinct_n(df, hashed=True).collect()
    assert h.distinct_ngrams == 3
    (m,) = G.mode_collapse(df).collect()
    assert (m.responses, m.collapsed) == (3, 2)


def test_preference_objective_matches_python(spark):
    vals = [(1, -1.0, -2.0, -1.5, -1.5), (2, -3.0, -1.0, -2.0, -2.0)]
    df = spark.createDataFrame(vals, "pair_id long, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    out = {(r.beta, r.loss_type): r for r in G.preference_objective(df, betas=[0.1]).collect()}
    hs = [(pc - rc) - (pr - rr) for _, pc, pr, rc, rr in vals]
    sig = sum(-math.log(1 / (1 + math.exp(-0.1 * h))) for h in hs) / 2
    assert abs(out[(0.1, "sigmoid")].loss - sig) < 1e-9
    assert abs(out[(0.1, "ipo")].loss - sum((h - 5.0) ** 2 for h in hs) / 2) < 1e-6
    assert out[(0.1, "hinge")].reward_accuracy == 0.5


def test_beta_must_be_positive(spark):
    import pytest

    df = spark.createDataFrame([(1, -1.0, -2.0, -1.5, -1.5)],
                               "pair_id long, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    with pytest.raises(ValueError):
        G.preference_objective(df, betas=[0.0, 0.1])


def test_preference_pipeline_end_to_end(spark):
    """R5 with stand-in model functions: prompts -> candidates -> judge -> pairs + stats;
    max_samples cuts prompts; model outputs are written before reuse."""
    from prefloom.plans.pipelines import preference_pipeline
    from prefloom.sources.sinks import persist

    prompts = spark.createDataFrame([(i, f"p{i}", f"prompt {i}" * (i + 1), None) for i in range(6)],
                                    "ord long, id string, prompt string, category string")

    def gen(ps):
        return [p[: (len(p) % 7) + 3] for p in ps]

    calls = []

    def judge(ps, rs):
        calls.append(len(rs))
        return [f'{{"score": {len(r) % 10}}}' for r in rs]

    pairs, stats = preference_pipeline(prompts, gen, judge, num_candidates=3, min_gap=0.0, max_samples=4,
                                       persist=persist)
    st = stats.collect()[0]
    assert st.total_prompts == 4
    got = pairs.collect()
    assert st.successful_pairs == len(got)
    assert all(r.category == "unknown" and r.id.startswith("p") for r in got)


def test_attach_scores_arrays_truncates_like_zip(spark):
    from prefloom.operators.candidates import attach_scores_arrays

    df = spark.createDataFrame(
        [(1, "p", ["a", "b", "c"], [(5.0, "x"), (7.0, "y")]), (2, "q", ["d"], [(1.0, "z"), (2.0, "w")])],
        "prompt_id long, prompt string, candidates array<string>, scores array<struct<score:double,reason:string>>")
    got = sorted((r.prompt_id, r.cand_idx, r.response, r.score) for r in attach_scores_arrays(df).collect())
    assert got == [(1, 0, "a", 5.0), (1, 1, "b", 7.0), (2, 0, "d", 1.0)]


def test_pipeline_pairs_table_shape(spark):
    from prefloom.plans.pipelines import PAIRS_TABLE, preference_pipeline

    prompts = spark.createDataFrame([(0, None, "What is 1+1?", None)], "ord long, id string, prompt string, category string")
    pairs, _ = preference_pipeline(prompts, lambda ps: ["x"] * len(ps), lambda ps, rs: ['{"score": 1}'] * len(rs))
    assert pairs.columns == PAIRS_TABLE and pairs.count() == 0


def test_pipeline_calls_models_once_across_actions(spark):
    """Pairs and stats are two actions; the judge still runs once per non-blank candidate."""
    import os
    import tempfile

    from prefloom.plans.pipelines import preference_pipeline

    log = os.path.join(tempfile.mkdtemp(prefix="prefloom-calls-"), "judge.log")
    prompts = spark.createDataFrame([(i, None, f"prompt number {i}", None) for i in range(8)],
                                    "ord long, id string, prompt string, category string")

    def gen(ps):
        return [f"{p} answer {i}" for i, p in enumerate(ps)]

    def judge(ps, rs, _log=log):
        with open(_log, "a") as f:
            f.write("x\n" * len(rs))
        return [f'{{"score": {len(r) % 10}}}' for r in rs]

    pairs, stats = preference_pipeline(prompts, gen, judge, num_candidates=3, min_gap=0.0)
    pairs.collect()
    stats.collect()
    with open(log) as f:
        assert len(f.read().splitlines()) == 8 * 3

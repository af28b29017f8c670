"""Trainer logs entry by entry, R5 with candidates that differ, sketches against exact counts."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from helpers import SF_CHECK
from prefloom.operators import runs as G
from prefloom.operators.candidates import generate_candidates
from prefloom.sources import sinks
from prefloom.sources.json_array import array_objects
from prefloom.sources.readers import read_train_logs


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "120", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def state(rnd, n):
    """A trainer state with other arrays and objects of objects around the log."""
    log = [{"step": k, "loss": round(rnd.random(), 4), 'odd "}{[" name': "text }", "nested": {"a": [1, {"b": 2}]}} for k in range(n)]
    return {"best_metric": None, "others": [{"step": 1, "loss": 9.0}], "note": '"log_history": [', "log_history": log,
            "stateful_callbacks": {"Control": {"args": {"log_history": [{"step": 5, "loss": 1.0}]}}, "list": [{"step": 7}]}, "global_step": n}


@pytest.mark.parametrize("indent", [None, 1])
def test_logs_in_splits(spark, small_splits, tmp_path, indent):
    rnd = random.Random(1)
    states = {m: state(rnd, n) for m, n in (("sft", 14), ("dpo", 1), ("ppo", 0))}
    for m, s in states.items():
        (tmp_path / m).mkdir()
        (tmp_path / m / "trainer_state.json").write_text(json.dumps(s, indent=indent))
    found = array_objects(spark, f"{tmp_path}/*/trainer_state.json", "log_history").collect()
    for m, s in states.items():
        own = [json.loads(r["value"]) for r in sorted(found, key=lambda r: r["ord"]) if f"/{m}/" in r["file"]]
        assert own == s["log_history"]
    logs = read_train_logs(spark, f"{tmp_path}/*/trainer_state.json").where("metric = 'loss'")
    got = sorted((r["method"], r["step"], r["value"]) for r in logs.collect())
    assert got == sorted((m, e["step"], e["loss"]) for m, s in states.items() for e in s["log_history"])


def test_logs_round_trip(spark, tmp_path):
    """Written row by row in the order of the steps, one JSON document per method."""
    rows = [(m, k, "loss", k / 7) for m in ("sft", "d p/o") for k in range(500)] + [("sft", 3, "eval", None)]
    path = str(tmp_path / "logs")
    sinks.write_train_logs(spark.createDataFrame(rows, "method string, step long, metric string, value double").repartition(5), path)
    files = list((tmp_path / "logs").glob("method=*/*.txt"))
    assert len(files) == 2
    steps = [e["step"] for e in json.loads(files[0].read_text())["log_history"][1:]]
    assert steps == sorted(steps)
    got = sorted((r["method"], r["step"], r["metric"], r["value"]) for r in read_train_logs(spark, f"{path}/*/*.txt").collect())
    assert [g for g in got if g[2] == "loss"] == sorted(rows[:-1]) and len(got) == len(rows)


def test_no_logs(spark, tmp_path):
    assert read_train_logs(spark, f"{tmp_path}/none/*.json").collect() == []


# --- R5 ------------------------------------------------------------------------------------

def test_every_counter_is_reached(spark):
    r = E.queries()["preference_pipeline_varied_stats"](spark, SF_CHECK).first()
    counters = ["successful_pairs", "skipped_low_gap", "skipped_too_few", "errors", "judge_failures"]
    assert all(r[c] > 0 for c in counters)
    assert r["skipped_low_gap"] > r["skipped_too_few"]
    assert r["total_prompts"] == r["successful_pairs"] + r["skipped_low_gap"] + r["errors"]
    pairs = E.queries()["preference_pipeline_varied"](spark, SF_CHECK).collect()
    assert len(pairs) == r["successful_pairs"]
    assert all(p["chosen"] != p["rejected"] and p["score_gap"] >= 2.0 for p in pairs)


def test_generator_gets_the_candidates_number(spark):
    reqs = spark.createDataFrame([(1, "p", 0), (1, "p", 1), (2, "bad", 0)], "prompt_id long, prompt string, cand_idx int")

    def fn(prompts, which):
        if "bad" in prompts:
            raise RuntimeError("refused")
        return [f"{p}{k}" for p, k in zip(prompts, which)]

    out = generate_candidates(reqs, fn, partitions=1, indexed=True).collect()
    assert sorted((r["prompt_id"], r["cand_idx"], r["response"], r["error"]) for r in out) == [(1, 0, "p0", None), (1, 1, "p1", None), (2, 0, "", "refused")]


# --- G8 ------------------------------------------------------------------------------------

def test_sketch_within_its_bound_for_every_group(spark):
    from prefloom.plans import fixtures as FX

    docs = FX.documents(spark, SF_CHECK).select(F.concat_ws(":", "lang", "source").alias("group"), (F.col("doc_id") % 3).alias("part"), F.col("text").alias("response"))
    parts = G.distinct_n_sketch(docs, by=("group", "part"))
    found = {r["group"]: r for r in G.distinct_n_estimate(G.merge_sketches(parts)).collect()}
    exact = G.distinct_n(docs).collect()
    assert len(exact) == len(found) > 50
    for r in exact:
        assert r["ngrams"] == found[r["group"]]["ngrams"]
        assert abs(found[r["group"]]["distinct_ngrams"] - r["distinct_ngrams"]) <= max(1, G.sketch_error() * r["distinct_ngrams"])


def hashed_counts(df):
    return sorted(((r["group"] or "", r["ngrams"], r["distinct_ngrams"], r["distinct_n"]) for r in G.distinct_n(df, hashed=True).collect()), key=str)


@pytest.mark.parametrize("sample, at_most", [(0.0, 1000), (1.0, 1000), (1.0, 3)])
def test_hashed_counts_with_frequent_ngrams(spark, monkeypatch, sample, at_most):
    """The sample decides where n-grams are counted, not what is counted: none, all and few frequent ones."""
    monkeypatch.setattr(G, "SAMPLE", sample)
    monkeypatch.setattr(G, "FREQUENT", at_most)
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), "a common first line \u2003 of all " + " ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(30)))) for _ in range(300)]
    df = spark.createDataFrame([*rows, ("c", "too short"), ("a", None), ("a", "")], "group string, response string").repartition(7)
    exact = sorted(((r["group"] or "", r["ngrams"], r["distinct_ngrams"], r["distinct_n"]) for r in G.distinct_n(df).collect()), key=str)
    assert hashed_counts(df) == exact and len(exact) == 3


def test_hashed_ngrams_are_dealt_out_before_they_are_counted(spark):
    """No task holds all n-grams of its split: nothing is aggregated below the first shuffle."""
    df = spark.createDataFrame([("a", "one two three four five")], "group string, response string")
    plan = G.distinct_n(df, hashed=True)._jdf.queryExecution().executedPlan().toString()
    dealt = plan.rindex("Exchange hashpartitioning")
    assert "_h1" in plan[dealt:].split("\n")[0] and "Aggregate" not in plan[dealt:]

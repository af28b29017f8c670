"""Streaming jobs (closed windows = batch; redelivered judgements dropped), readers and sinks."""

import json
import math
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import SF_CHECK, SF_SMALL
from prefloom.plans import fixtures as FX
from prefloom.sources import readers, sinks
from prefloom.streaming import jobs as ST


def test_reward_monitor_closed_windows_equal_batch(spark):
    ev = ST.read_table_stream(spark, SF_CHECK, "events")
    out = ST.run_available_now(ST.reward_monitor(ev.select("ts", F.col("event_type").alias("method"), "value")), "t-mon")
    got = {(r.window_start, r.method): (r.n, round(r.mean_value, 9)) for r in out.collect()}
    # batch: hourly buckets of epoch seconds; closed = end <= max(ts) - 10 minutes
    b = FX.table(spark, SF_CHECK, "events").withColumn("t", F.unix_seconds(ST.as_utc_instant("ts", T.TimestampNTZType())))
    mx = b.agg(F.max("t")).first()[0]
    g = b.groupBy((F.floor(F.col("t") / 3600) * 3600).alias("ws"), F.col("event_type").alias("method")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("m"))
    closed = g.where(F.col("ws") + 3600 <= mx - 600).collect()
    expect = {(r.ws, r.method): (r.n, r.m) for r in closed}
    assert got == expect and len(got) == 3380
    # the closing step of a finite source adds the windows that were still open
    logs = FX.table(spark, SF_CHECK, "events").select("ts", F.col("event_type").alias("method"), "value")
    every = {(r.ws, r.method): (r.n, r.m) for r in g.collect()}
    full = {(r.window_start, r.method): (r.n, round(r.mean_value, 9)) for r in ST.close_windows(out, logs).collect()}
    assert full == every and len(full) == 3385


def test_reward_monitor_ignores_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        ev = ST.read_table_stream(spark, SF_SMALL, "events")
        a = ST.run_available_now(ST.reward_monitor(ev.select("ts", F.col("event_type").alias("method"), "value")), "tz1")
        ka = sorted(tuple(r) for r in a.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    ev = ST.read_table_stream(spark, SF_SMALL, "events")
    b = ST.run_available_now(ST.reward_monitor(ev.select("ts", F.col("event_type").alias("method"), "value")), "tz2")
    assert ka == sorted(tuple(r) for r in b.collect())


def test_scored_stream_drops_redeliveries(spark):
    d = tempfile.mkdtemp(prefix="prefloom-stream-")
    rows = [(1, 0, "a", '{"score": 3}', None, "2024-01-01 00:00:00"),
            (1, 0, "a", '{"score": 9}', None, "2024-01-01 00:01:00"),   # redelivery: dropped
            (1, 1, "  ", None, None, "2024-01-01 00:02:00"),
            (2, 0, "b", None, "timeout", "2024-01-01 00:03:00")]
    spark.createDataFrame(rows, "prompt_id long, cand_idx int, response string, judge_text string, error string, ts string") \
        .withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{d}/judged")
    schema = spark.read.parquet(f"{d}/judged").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/judged")
    out = ST.run_available_now(ST.scored_stream(stream), "t-scored")
    got = sorted((r.prompt_id, r.cand_idx, r.score, r.reason) for r in out.collect())
    assert got == [(1, 0, 3.0, ""), (1, 1, 0.0, "Empty response"), (2, 0, 0.0, "Judge error: timeout")]


def test_read_prompts_json_array_keeps_order(spark):
    d = tempfile.mkdtemp(prefix="prefloom-src-")
    recs = [{"id": "p1", "prompt": "What is 2+2?", "category": "arithmetic", "difficulty": "easy"},
            {"prompt": "Solve x² = 4", "difficulty": "medium"},
            {"id": "p3", "prompt": "π ≈ ?", "category": "geometry"}]
    path = os.path.join(d, "prompts.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(recs, f, ensure_ascii=False, indent=2)
    df = readers.read_prompts(spark, path)
    got = [(r.ord, r.id, r.prompt, r.category) for r in df.orderBy("ord").collect()]
    assert got == [(0, "p1", "What is 2+2?", "arithmetic"), (1, None, "Solve x² = 4", None), (2, "p3", "π ≈ ?", "geometry")]
    from prefloom.operators.prep import default_identity

    ids = [r.id for r in default_identity(df).orderBy("ord").collect()]
    assert ids == ["p1", "gen_2", "p3"]


def test_with_ordinal_follows_file_order(spark):
    d = tempfile.mkdtemp(prefix="prefloom-ord-")
    for i in range(3):
        spark.createDataFrame([(f"f{i}-{j}",) for j in range(4)], "v string").coalesce(1).write.parquet(f"{d}/part{i}")
    df = readers.with_ordinal(spark.read.parquet(f"{d}/part0", f"{d}/part1", f"{d}/part2"))
    got = [r.v for r in df.orderBy("ord").collect()]
    assert got == [f"f{i}-{j}" for i in range(3) for j in range(4)]
    assert [r.ord for r in df.orderBy("ord").collect()] == list(range(12))


def test_prompts_from_qa_and_head(spark):
    qa = FX.qa_items(spark, SF_SMALL)
    p = readers.prompts_from_qa(qa, 5, order="item_id").orderBy("ord").collect()
    assert [r.id for r in p] == [f"gsm8k_{i}" for i in range(5)]
    assert {r.category for r in p} == {"gsm8k"} and {r.difficulty for r in p} == {"medium"}


def test_train_logs_reader(spark):
    d = tempfile.mkdtemp(prefix="prefloom-logs-")
    for m, base in (("sft", 1.0), ("dpo", 0.5)):
        os.makedirs(f"{d}/{m}")
        state = {"global_step": 10, "log_history": [{"step": 5, "loss": base, "learning_rate": 1e-4},
                                                    {"step": 10, "loss": base / 2, "eval_accuracy": 0.4}]}
        with open(f"{d}/{m}/trainer_state.json", "w") as f:
            json.dump(state, f)
    logs = readers.read_train_logs(spark, f"{d}/*/trainer_state.json")
    got = sorted((r.method, r.step, r.metric, r.value) for r in logs.collect())
    assert ("dpo", 10, "loss", 0.25) in got and ("sft", 10, "eval_accuracy", 0.4) in got
    assert len(got) == 8


def test_sinks_round_trip(spark):
    d = tempfile.mkdtemp(prefix="prefloom-sink-")
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "validation"), (3, None, "train")],
                               "ord long, prompt string, split string")
    sinks.write_dataset(df, f"{d}/ds")
    back = spark.read.parquet(f"{d}/ds")
    assert back.where("split = 'validation'").count() == 1
    assert {"split=train", "split=validation"} <= set(os.listdir(f"{d}/ds"))
    sinks.write_pairs_json(df, f"{d}/js")
    text = "".join(open(os.path.join(f"{d}/js", f), encoding="utf-8").read()
                   for f in os.listdir(f"{d}/js") if f.endswith(".json"))
    assert '"prompt":null' in text
    sinks.write_processing_stats(df, f"{d}/stats")
    st = spark.read.json(f"{d}/stats").first()
    assert (st.train_size, st.val_size, st.columns) == (2, 1, ["ord", "prompt"])
    betas = spark.createDataFrame([(0.1, 0.67, 0.72, 0.22, 0.35, "success"), (0.5, 0.55, 0.89, 0.05, 0.58, "failed: x")],
                                  "beta double, accuracy double, diversity double, mode_collapse_score double, "
                                  "train_loss double, status string")
    sinks.write_beta_sweep(betas, f"{d}/beta")
    rb = {r.beta: r for r in readers.read_beta_sweep(spark, f"{d}/beta").collect()}
    assert rb[0.5].status == "failed: x" and rb[0.1].metrics["accuracy"] == 0.67 and len(rb[0.1].metrics) == 4


def test_persist_cuts_lineage(spark):
    df = FX.scored(spark, SF_SMALL)
    p = sinks.persist(df, "t-persist")
    assert "Scan parquet" in p._jdf.queryExecution().executedPlan().toString() or p.count() == df.count()
    assert p.count() == df.count()


def test_stage_jobs_write_splits_and_stats(spark):
    from prefloom.plans.pipelines import generate_dataset_job, process_preference_job, process_sft_job

    d = tempfile.mkdtemp(prefix="prefloom-job-")
    prompts = FX.prompts(spark, SF_SMALL)
    pairs = generate_dataset_job(
        spark, prompts, lambda ps: [f"Step 1. The answer is: {len(p)}. " * (1 + i % 4) for i, p in enumerate(ps)],
        lambda ps, rs: [f'{{"score": {len(r) % 11}}}' for r in rs], f"{d}/gen", num_candidates=3, min_gap=1.0)
    st = spark.read.json(f"{d}/gen/generation_stats").first()
    assert st.successful_pairs == pairs.count() > 0 and st.total_prompts == prompts.count()
    pairs.write.parquet(f"{d}/pairs_in")
    out = process_preference_job(spark, f"{d}/pairs_in", f"{d}/processed")
    stats = spark.read.json(f"{d}/processed_stats").first()
    assert stats.train_size + stats.val_size == out.count()
    qa = FX.qa_items(spark, SF_SMALL)
    qa.write.parquet(f"{d}/qa")
    sft = process_sft_job(spark, f"{d}/qa", f"{d}/sft")
    assert sft.where("split = 'validation'").count() == math.ceil(qa.count() * 0.1)


def test_reward_monitor_drops_late_rows_across_runs(spark):
    """Second run resumes from the checkpoint: rows older than the watermark are dropped,
    rows inside it still update their (not yet emitted) window."""
    d = tempfile.mkdtemp(prefix="prefloom-late-")
    schema = "ts timestamp, method string, value double"

    def put(name, rows):
        spark.createDataFrame([(dt, m, v) for dt, m, v in rows], schema).coalesce(1).write.parquet(f"{d}/in/{name}")

    import datetime as dt

    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    put("a", [(t(0, 5), "dpo", 1.0), (t(0, 50), "dpo", 3.0), (t(2, 30), "dpo", 10.0)])
    base = f"{d}/job"
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/in")
    ST.run_available_now(ST.reward_monitor(read()), "late", base=base)
    # watermark is now 02:20: a row at 00:30 is late (dropped); 02:40 joins the open 02:00 window
    put("b", [(t(0, 30), "dpo", 100.0), (t(2, 40), "dpo", 20.0), (t(4, 0), "dpo", 0.0)])
    out = ST.run_available_now(ST.reward_monitor(read()), "late", base=base)
    got = {(r.window_start, r.method): (r.n, r.mean_value) for r in out.collect()}
    h = lambda x: int(dt.datetime(2024, 1, 1, x, tzinfo=dt.timezone.utc).timestamp())
    assert got[(h(0), "dpo")] == (2, 2.0)      # the late 100.0 never counted
    assert got[(h(2), "dpo")] == (2, 15.0)
    assert (h(4), "dpo") not in got            # still open


def test_with_ordinal_json_lines_many_splits(spark):
    """JSON lines cut into many small splits (packed several per partition) keep file order."""
    d = tempfile.mkdtemp(prefix="prefloom-jsonl-")
    expect = []
    for i in range(3):
        with open(f"{d}/part-{i}.jsonl", "w", encoding="utf-8") as f:
            for j in range(400):
                v = f"f{i}-{j:04d}-" + "x" * (j % 37)
                f.write(json.dumps({"prompt": v}) + "\n")
                expect.append(v)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        df = readers.read_prompts(spark, d + "/", fmt="json_lines")
        assert spark.read.json(d).rdd.getNumPartitions() > 3
        got = [r.prompt for r in df.orderBy("ord").collect()]
        ords = [r.ord for r in df.orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == expect and ords == list(range(len(expect)))


def test_evaluate_and_analysis_jobs(spark):
    from prefloom.plans.pipelines import analysis_job, evaluate_job

    d = tempfile.mkdtemp(prefix="prefloom-eval-")
    m = evaluate_job(spark, FX.predictions(spark, SF_SMALL), FX.qa_items(spark, SF_SMALL), f"{d}/eval", detail=50)
    rows = m.collect()
    assert sum(r.total for r in rows) == FX.qa_items(spark, SF_SMALL).count()
    detail = spark.read.json(f"{d}/eval/detailed_results")
    assert detail.count() == 50
    out = analysis_job(spark, FX.run_logs(spark, SF_SMALL), FX.beta_results(spark, SF_SMALL),
                       FX.method_resources(spark, SF_SMALL), f"{d}/analysis")
    assert out["accuracy_progression"].count() == 6  # base and a method per event type
    assert spark.read.json(f"{d}/analysis/analysis_summary").count() == 1


def test_head_dense_equals_top_n(spark):
    df = readers.with_ordinal(FX.table(spark, SF_SMALL, "documents").select("doc_id"))
    a = sorted(r.doc_id for r in readers.head_by_ordinal(df, 37, dense=True).collect())
    b = sorted(r.doc_id for r in readers.head_by_ordinal(df, 37).collect())
    assert a == b and len(a) == 37

"""Pairs and first rows on streams: equal to the batch, for any order and batch size; timers bound
the state; a resumed run goes on where it stopped."""

import random

import pytest
from pyspark.sql import functions as F

from prefloom.operators.pairs import build_pairs
from prefloom.operators.prep import deduplicate
from prefloom.streaming import jobs as ST
from prefloom.streaming import stateful as SS

START = 1704067200
SCORED = "prompt_id long, prompt string, cand_idx int, response string, score double, reason string, at long"
FIRST = "ord long, prompt string, note string, at long"


def with_ts(df):
    return df.withColumn("ts", F.timestamp_seconds("at")).drop("at")


def stream_of(spark, tmp_path, batches, schema, per_trigger=1, name="in"):
    """A file stream: one file per batch of rows, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/b={k:04d}")
    own = SS.stateful_session(spark, 2)
    return with_ts(own.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{tmp_path}/{name}/*"))


def scored_rows(rnd, prompts, spread):
    rows = []
    for p in range(prompts):
        for i in range(rnd.randrange(0, 6)):
            rows.append((p, f"prompt {p}" if p % 5 else None, i, rnd.choice([f"r{p}.{i}", " ", "same"]), rnd.choice([None, 0.0, 3.0, 5.0, 5.0, 9.5]),
                         rnd.choice([None, "why"]), START + p * 60 + rnd.randrange(spread)))
    return rows


def cut(rows, n):
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


@pytest.mark.parametrize("batches,per_trigger", [(1, 1), (7, 1), (7, 3)])
def test_pairs_equal_the_batch(spark, tmp_path, batches, per_trigger):
    rnd = random.Random(batches * 10 + per_trigger)
    rows = scored_rows(rnd, 30, 100)
    rnd.shuffle(rows)  # any order within the watermark
    stream = stream_of(spark, tmp_path, cut(rows, batches), SCORED, per_trigger)
    emitted = ST.run_available_now(SS.pairs_stream(stream, watermark="1 hour"), "t-pairs")
    batch = with_ts(spark.createDataFrame(rows, SCORED))
    want = sorted(map(tuple, build_pairs(batch, 2.0).collect()))
    assert sorted(map(tuple, SS.close_pairs(emitted, batch).collect())) == want
    assert len(want) > 5


def test_pairs_are_emitted_when_their_prompt_closes(spark, tmp_path):
    """Prompts an hour apart: all but the last ones come out of the stream itself, and only open prompts
    are in the state."""
    rnd = random.Random(3)
    rows = [(p, q, i, r, s, w, START + p * 3600 + i) for p, q, i, r, s, w, _ in scored_rows(rnd, 40, 1)]
    stream = stream_of(spark, tmp_path, cut(rows, 8), SCORED)
    base = str(tmp_path / "out")
    emitted = ST.run_available_now(SS.pairs_stream(stream), "t-pairs", base=base)
    want = {r["prompt_id"]: tuple(r) for r in build_pairs(with_ts(spark.createDataFrame(rows, SCORED)), 2.0).collect()}
    got = {r["prompt_id"]: tuple(r) for r in emitted.collect()}
    assert got == {k: v for k, v in want.items() if k in got}
    assert len(want) - len(got) <= 2 < len(got)
    # what is left of a state that has seen 40 prompts
    state = spark.newSession()
    state.conf.set("spark.sql.streaming.stateStore.providerClass", SS._ROCKSDB)
    left = state.read.format("statestore").option("stateVarName", "pair").load(f"{base}/_checkpoint").count()
    assert left <= 2


def test_resumed_pairs(spark, tmp_path):
    """A prompt whose candidates come in two runs of the stream."""
    first = [(1, "p", 0, "a", 9.0, "x", START), (2, "q", 0, "b", 1.0, "x", START)]
    second = [(1, "p", 1, "c", 2.0, "y", START + 5), (2, "q", 1, "d", 8.0, "y", START + 6), (3, "z", 0, "late", 1.0, "", START + 90_000)]
    third = [(4, "z", 0, "later", 1.0, "", START + 190_000)]
    base = str(tmp_path / "out")
    for rows, seen in ((first, 0), (second, 2), (third, 2)):
        stream = stream_of(spark, tmp_path, [rows], SCORED, name=f"in/{rows[0][0]}{len(rows)}")
        own = with_ts(SS.stateful_session(spark, 2).readStream.schema(SCORED).parquet(f"{tmp_path}/in/*/*"))
        out = ST.run_available_now(SS.pairs_stream(own), "t-pairs", base=base)
        assert stream.isStreaming and out.count() == seen
    assert sorted((r["prompt_id"], r["chosen"], r["rejected"]) for r in out.collect()) == [(1, "a", "c"), (2, "d", "b")]


def first_rows(rnd, n):
    texts = ["Same text", " same TEXT ", "other", None, "", "x"] + [f"single {k}" for k in range(10)]
    return [(k, rnd.choice(texts), rnd.choice([None, f"n{k}"]), START + rnd.randrange(300)) for k in range(n)]


@pytest.mark.parametrize("batches,per_trigger", [(1, 1), (9, 1), (9, 4)])
def test_first_rows_equal_the_batch(spark, tmp_path, batches, per_trigger):
    rnd = random.Random(batches + per_trigger)
    rows = first_rows(rnd, 80)
    rnd.shuffle(rows)
    stream = stream_of(spark, tmp_path, cut(rows, batches), FIRST, per_trigger)
    emitted = ST.run_available_now(SS.first_rows_stream(stream, watermark="1 hour"), "t-first")
    batch = spark.createDataFrame(rows, FIRST).drop("at")
    want = sorted(map(tuple, deduplicate(batch, unique_order=False).collect()), key=str)
    assert sorted(map(tuple, SS.close_first_rows(emitted, batch).collect()), key=str) == want


def test_first_rows_close_and_are_remembered(spark, tmp_path):
    hour = 3600
    batches = [[(5, "a", "late copy", START + 10)], [(1, "a", "first", START + 20)], [(9, "z", "moves time", START + hour)],
               [(0, "a", "after closing", START + hour + 1)], [(10, "y", "moves time", START + 50 * hour)], [(2, "A", "forgotten", START + 50 * hour)],
               [(11, "w", "moves time", START + 90 * hour)], [(12, "v", "moves time", START + 95 * hour)]]
    stream = stream_of(spark, tmp_path, batches, FIRST)
    out = ST.run_available_now(SS.first_rows_stream(stream, remember="1 day"), "t-first")
    notes = [r["note"] for r in sorted(out.collect(), key=lambda r: r["ord"]) if r["note"] != "moves time"]
    assert notes == ["first", "forgotten"]  # in the order of ord

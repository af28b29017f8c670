"""Cuts found by refining a histogram: skewed values, equal rows, many strata; and L1 and F5
over one cleaning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from prefloom.operators import prep, split
from prefloom.operators.split import find_cut, find_cuts, stratified_split, train_val_split
from prefloom.plans import pipelines as L


def skewed(n, seed):
    """Hexadecimal texts of one length, most of them with long common prefixes."""
    rnd = random.Random(seed)
    heads = ["a" * 28, "a" * 12 + "b" * 16, "0" * 20 + "c" * 8]
    return [rnd.choice(heads) + f"{rnd.randrange(1 << 16):04x}" if rnd.random() < 0.9 else f"{rnd.getrandbits(128):032x}" for _ in range(n)]


@pytest.mark.parametrize("bound", [1, 50])
def test_cut_of_skewed_values(spark, bound):
    values = skewed(600, 1) + ["f" * 32] * 40
    df = spark.createDataFrame([(v,) for v in values], "o string").repartition(3)
    ordered = sorted(values)
    for need in (1, 2, 77, 300, 599, 600, 639, 640):
        cut, take, equal = find_cut(df, "o", need, bound)
        assert cut == ordered[need - 1]
        assert (take, equal) == (need - sum(v < cut for v in values), values.count(cut))
    assert find_cut(df, "o", 0, bound) == ("", 0, 0)


def test_only_small_buckets_are_collected(spark, monkeypatch):
    """The last step reads a bucket of at most ``bound`` rows, however skewed the hashes are."""
    df = spark.createDataFrame([(v,) for v in skewed(2000, 2)], "o string")
    seen = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    find_cut(df, "o", 1000, 20)
    assert len(seen) > 2 and sum(r["n"] for r in seen[-1]) <= 20


@pytest.mark.parametrize("bound", [1, 10])
def test_cuts_of_many_strata(spark, bound):
    rnd = random.Random(3)
    rows = [(None if (k := rnd.randrange(12)) == 0 else f"s{k}", v) for v in skewed(900, 4)] + [("hot", v) for v in skewed(600, 5)] + [("hot", "b" * 32)] * 5
    df = spark.createDataFrame(rows, "s string, o string").repartition(4)
    groups = {}
    for s, o in rows:
        groups.setdefault(s, []).append(o)
    needs = {s: rnd.randrange(len(v) + 1) for s, v in groups.items()}
    got = {r["s"]: (r["_cut"], r["_take"], r["_equal"]) for r in find_cuts(df, "o", "s", spark.createDataFrame(list(needs.items()), "s string, _need long"), bound).collect()}
    want = {}
    for s, v in groups.items():
        if needs[s]:
            cut = sorted(v)[needs[s] - 1]
            want[s] = (cut, needs[s] - sum(x < cut for x in v), v.count(cut))
    assert got == want


@pytest.mark.parametrize("materialize", [True, False])
def test_equal_rows_at_the_cut(spark, materialize):
    """A third of the rows is one row repeated, and the cut falls among them."""
    df = spark.createDataFrame([(None, "same")] * 300 + [(i, f"t{i}") for i in range(20)], "ord long, t string").repartition(5)
    out = train_val_split(df, ratio=0.5, key="ord", materialize=materialize, bound=7)
    assert (out.count(), out.where("split = 'validation'").count()) == (320, 160)
    out = stratified_split(df, by="t", ratio=0.5, key="ord", materialize=materialize, bound=7)
    assert (out.count(), out.where("split = 'validation'").count()) == (320, 160)
    assert out.where("t = 'same' AND split = 'validation'").count() == 150


def test_split_needs_no_join(spark):
    df = spark.range(1000).withColumnRenamed("id", "ord")
    plan = train_val_split(df, bound=10)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("kind", ["long", "date", "string", "boolean", "double"])
def test_shares_by_type(spark, kind):
    """Largest remainders, ties by the stratum's value; NULL first."""
    n = {"boolean": 2}.get(kind, 9)
    df = spark.range(47).select(F.col("id").alias("ord"), (F.col("id") % n).alias("k"))
    value = {"long": F.col("k") - 4, "date": F.date_add(F.lit("2020-01-01"), F.col("k").cast("int")), "string": F.col("k").cast("string"),
             "boolean": F.col("k") == 1, "double": F.col("k") / 4}[kind]
    df = df.select("ord", "k", F.when(F.col("k") > 0, value).alias("s"))
    got = {r["k"]: r["n"] for r in stratified_split(df, by="s", ratio=0.25).where("split = 'validation'").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {k: sum(i % n == k for i in range(47)) for k in range(n)}
    quota = {k: math.floor(v * 0.25) for k, v in sizes.items()}
    extra = math.ceil(47 * 0.25) - sum(quota.values())
    for k in sorted(sizes, key=lambda k: (-(sizes[k] * 0.25 % 1), k))[:extra]:
        quota[k] += 1
    assert got == {k: v for k, v in quota.items() if v}


# --- L1, D1, F5 over one cleaning --------------------------------------------------------

def pairs_table(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(120):
        p = rnd.choice(["What is  2 + 2 ?", " what is 2 + 2 ? ", f"Prompt number {i}", "short", "", None, "x" * 1030])
        rows.append((i, p, rnd.choice(["A good long answer\tof words", "tiny", None, "“Quoted” long answer \x07 here"]), rnd.choice(["Another long enough answer", "no"])))
    return spark.createDataFrame(rows, "ord long, prompt string, chosen string, rejected string").repartition(4)


def test_cleaning_once_per_column(spark):
    """Three columns: one collapse and three translations each in the whole plan, and none in what
    reads the written rows."""
    df = pairs_table(spark)
    plan = L.cleaned_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("regexp_replace"), plan.count("translate(")) == (3, 9)
    after = L.process_preference_data(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in after and "md5" not in after


def test_process_preference_equals_the_stages(spark):
    df = pairs_table(spark)
    x = prep.clean_columns(df)
    x = prep.deduplicate(x, unique_order=False)
    x = prep.validate_format(prep.filter_by_length(x))
    want = train_val_split(prep.format_for_dpo(x), ratio=0.1, seed=42, key="ord")
    cols = ["ord", "prompt", "chosen", "rejected", "split"]
    got = L.process_preference_data(df)
    assert got.columns == cols
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*cols).collect())) != []


def test_dedup_by_ordinal_and_by_key(spark):
    df = pairs_table(spark)
    a, b = (sorted(r["ord"] for r in prep.deduplicate(df, unique_order=u).collect()) for u in (True, False))
    assert a == b
    plan = prep.deduplicate(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_report_in_one_scan(spark, tmp_path):
    df = pairs_table(spark)
    path = str(tmp_path / "pairs")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    report = prep.filter_report(df)
    assert report._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    kept = prep.deduplicate(df)
    short = prep.filter_by_length(kept)
    want = [120, kept.count(), short.count(), prep.validate_format(short).count()]
    got = report.orderBy("stage_no").collect()
    assert [(r["rows_in"], r["rows_out"]) for r in got] == list(zip(want[:-1], want[1:]))


def test_empty_tables(spark):
    df = pairs_table(spark).where("ord < 0")
    assert L.process_preference_data(df).collect() == []
    assert [r["rows_in"] for r in prep.filter_report(df).collect()] == [0, 0, 0]
    assert stratified_split(df, by="prompt").collect() == []
    assert split.split_stats(train_val_split(df)).collect() == []

"""Toxicity: held-out accuracy, and that held-out labels are never learned."""

import zlib

import pytest
from pyspark.sql import functions as F

from prefloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def scored(tables):
    return {r["doc_id"]: r for r in toxicity.query(*tables).collect()}


def test_held_out_accuracy(tables, scored):
    docs, labels = tables
    assert len(scored) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in scored.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored.values())
    held = [(scored[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if scored[r["doc_id"]]["held_out"]]
    assert auc(held) > 0.9


def test_held_out_labels_are_not_learned(tables, scored):
    docs, labels = tables
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.query(docs, wrong).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in scored.items())


def test_drop(tables, scored):
    docs, labels = tables
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in scored.items() if not r["predicted"]}


def test_rows(spark, tables, docs):
    _, labels = tables
    more = labels.union(spark.createDataFrame([(2_000_000, None, None), (None, 1, 1)], labels.schema))
    text = "you are a stupid worthless idiot, loser! " * 3
    full = tables[0].union(docs([(-1, None), (-2, ""), (-3, " "), (-4, text), (-4, text), (None, text), (-5, "word " * 100_000)]))
    got = {}
    for r in toxicity.query(full, more).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert got[-1] == got[-2] == got[-3] and len(got[-4]) == 2 and got[-4][0] == got[-4][1] == got[None][0] > 0.5


def test_nothing_to_learn(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.query(docs([]), none).collect() == []
    assert [r["score"] for r in toxicity.query(docs([(1, "a")]), none).collect()] == [0.0]
    one = spark.createDataFrame([(1, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.query(docs([(1, "a"), (4, "b")]), one).collect()} == {1.0}


def test_obfuscation():
    assert toxicity.words_of("You 1diot, l0ser st@b") == ["you", "idiot", "loser", "stab"]
    f = dict(zip(toxicity.FEATURES, toxicity.text_features("you IDIOT!! sooooo b@d", toxicity.Lexicon({"bad": 2.0})), strict=True))
    assert f["insults"] > 0 and f["learned"] > 0 and f["near_second_person"] > 0 and f["stretched"] > 0 and f["mixed"] > 0 and f["capital_words"] > 0

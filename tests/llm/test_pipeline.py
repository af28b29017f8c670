"""The pipeline: every stage on its own input, and the whole."""

import pytest

import corpus_pipeline as P
from prefloom.llm import decontaminate, jaccard, linedup, toxicity
from test_decontaminate import brute as contaminated
from test_jaccard import brute as near
from test_linedup import brute as lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        result = f(spark, docs, SF)
        rows = result.collect()
        out.append((name, docs, result, rows))
        docs = spark.createDataFrame(rows, result.schema)
    return out


def test_columns(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, *_ in stages] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    assert all(r.columns == want for _, _, r, _ in stages[:-1])


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_toxicity(spark, stages):
    _, docs, _, rows = stages[0]
    scores = toxicity.query(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in scores if not r["predicted"]}


def test_lines(stages):
    _, docs, _, rows = stages[1]
    every = lines(pairs(docs))
    want = {i: (kept, sha) for i, _, gone, kept, sha in every if kept or not gone}  # what nothing is left of goes
    assert len(every) - len(want) < len(every) // 4
    import hashlib

    assert {r["doc_id"]: (len(r["text"].encode()), hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_near_copies(stages):
    _, docs, _, rows = stages[2]
    assert sorted(r["doc_id"] for r in rows) == sorted({c for _, _, c in near(pairs(docs), 5, 80)})


def test_contamination(spark, stages):
    _, docs, _, rows = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in contaminated(pairs(docs), items) if r[5]}
    assert {r["doc_id"] for r in rows} == {i for i, _ in pairs(docs)} - dirty


def test_run_equals_stages(spark, stages):
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, P.run(spark, SF).collect())) == sorted(map(key, stages[-1][3]))


def test_registered(spark):
    import __spark_entry__ as E

    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert set(E.oracle_sql()) <= set(E.queries())
    assert all(m for m in (decontaminate, jaccard, linedup))

"""Benchmark decontamination against a word-by-word scan."""

import hashlib
import random
import re

import pytest

from prefloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            for win in [v[k : k + 13] for k in range(max(1, len(v) - 12))] if v else []:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        found |= {str(item)} if item is not None else set()
        names = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case(spark, docs):
    rnd = random.Random(5)
    vocab = ["ant", "Bee", "çat", "dog9", "élan", "Fox", "日本", "x"]
    text = lambda n: rnd.choice([" ", ", ", "-"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([1, 3, 12, 13, 14, 30]))) for i in range(2, 12)] + [(20, None), (21, ""), (22, "..."), (None, text(15)), (4, text(20))]
    rows = [(i, text(rnd.randint(0, 60))) for i in range(30)]
    rows += [(100 + k, f"{text(40)} {x.upper()}! {text(200)}") for k, (_, x) in enumerate(items) if x]
    rows += [(200, None), (201, ""), (202, " .,;"), (None, items[5][1]), (3, items[6][1]), (3, items[6][1]), (300, "z" * 200_000 + " " + items[3][1])]
    return rows, items, docs(rows), spark.createDataFrame(items, "item_id long, text string")


def test_against_scan(case):
    rows, items, d, b = case
    assert sorted((tuple(r) for r in D.query(d, b).collect()), key=str) == brute(rows, items)


def test_blocks_give_the_same(case):
    rows, items, d, b = case
    key = lambda r: (str(r["doc_id"]), r["text"] or "", str(r["report"]))
    one = sorted(map(key, D.scan(d, b).collect()))
    assert sorted(map(key, D.scan(d, b, block_windows=12).collect())) == one


def test_cut_and_drop(case):
    rows, items, d, b = case
    dirty = {r[0] for r in brute(rows, items) if r[5]}
    kept = D.drop_documents(d, b)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - dirty
    spans = {(r["doc_id"], r["text"]): r["report"]["spans"] for r in D.scan(d, b).collect()}
    before = dict(rows)
    for r in D.cut_spans(d, b).collect():
        if r["doc_id"] is None or r["doc_id"] == 3:
            continue
        raw = (before[r["doc_id"]] or "").encode()
        for s in reversed(spans[(r["doc_id"], before[r["doc_id"]])] if r["doc_id"] in dirty else []):
            raw = raw[: s["from_byte"]] + raw[s["to_byte"] :]
        assert (r["text"] or "") == raw.decode()


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.query(docs([]), none).collect() == []
    assert [r["n_hit"] for r in D.query(docs([(1, "a b c")]), none).collect()] == [0]


def test_clashing_columns(spark, docs):
    d = docs([(1, "a b c")]).withColumnRenamed("lang", "report").withColumnRenamed("source", "spans")
    b = spark.createDataFrame([(1, "b c", "x")], "item_id long, text string, doc_id string")
    assert D.drop_documents(d, b).collect() == []
    assert D.cut_spans(d, b).collect()[0]["text"] == "a "

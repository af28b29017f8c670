"""Best-fit packing against the tokenizer itself, and the plan against best fit by document."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from prefloom.llm import common, packing

PATH = packing.default_tokenizer()


def ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def best_fit_by_piece(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            free.append(capacity - n)
    return sorted(free)


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return by


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_best_fit_by_piece(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 16, 50])
    lengths = [rnd.randint(1, capacity) if seed % 2 else rnd.choice([1, 2, capacity // 2, capacity]) for _ in range(rnd.randint(0, 300))]
    plan = packing.best_fit_plan(dict(Counter(lengths)), capacity)
    used = Counter()
    for length, _, n, per, first, offset in plan:
        for i in range(n):
            used[first + i // per] += length
            assert offset + (i % per + 1) * length <= capacity
    assert sorted(capacity - u for u in used.values()) == best_fit_by_piece(lengths, capacity)
    ranks = defaultdict(list)
    for length, rank, n, *_ in plan:
        ranks[length] += range(rank, rank + n)
    assert {k: len(v) for k, v in ranks.items()} == Counter(lengths) and all(v == list(range(len(v))) for v in ranks.values())


def test_texts_and_ties(spark, docs):
    texts = [None, "", "Hello, World!", "naïve Ärger ²³ ¼ x_y 5'll we'LL", "日本 text", "<|endoftext|> in a text", "a" * 3000, "word " * 5000,
             "tab\tand\nline\x0b\x1c", *["the same text"] * 40]
    rows = list(enumerate(texts)) + [(3, "other text of a repeated id"), (None, "no id"), (3, "other text of a repeated id")]
    got = packing.pack(docs(rows), PATH, capacity=64).collect()
    want = Counter()
    for i, t in rows:
        x = ids(t)
        for k, at in enumerate(range(0, len(x), 64)):
            p = x[at : at + 64]
            want[(i, k, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = check_layout(got, 64)
    assert len(by) == len(best_fit_by_piece([r["length"] for r in got], 64))


def test_empty_table(spark, docs):
    assert packing.pack(docs([]), PATH).collect() == []


def test_sequences_hold_the_tokens(spark, docs):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(30)]
    seqs = packing.sequences(docs(rows), PATH, capacity=16).collect()
    found = defaultdict(dict)
    for s in seqs:
        assert len(s["tokens"]) <= 16
        for d in s["documents"]:
            found[d["key"]].setdefault("ids", []).extend(s["tokens"][d["offset"] : d["offset"] + d["length"]])
    for i, t in rows:
        assert Counter(found[i]["ids"]) == Counter(ids(t))


def test_cache_limit_changes_nothing(monkeypatch):
    texts = [f"alpha{i} beta gamma{i}, delta." for i in range(200)]
    want = list(packing.token_bytes(texts, PATH))
    monkeypatch.setattr(packing, "_CACHE_ENTRIES", 3)
    common._HELD.clear()
    assert list(packing.token_bytes(texts, PATH)) == want


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.query(docs).collect()
    check_layout(rows, 2048)
    n = {r["doc_id"]: len(ids(r["text"])) for r in docs.select("doc_id", "text").collect()}
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
        assert r["start"] == 2048 * r["piece"]
    assert total == n

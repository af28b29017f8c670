"""Jump consistent hashing against the published loop."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from prefloom.llm import shard


def jump(key, n):
    k, b, j = int(hashlib.md5(("null" if key is None else str(key)).encode()).hexdigest()[:16], 16), -1, 0
    while j < n:
        b = j
        k = (k * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((k >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 9, 200])
def test_equals_loop(spark, n):
    df = spark.range(-500, 1500).withColumnRenamed("id", "k")
    got = shard.assign_shards(df, "k", n).collect()
    assert all(r["shard"] == jump(r["k"], n) for r in got)


def test_late_keys_take_all_steps(spark, monkeypatch):
    monkeypatch.setattr(shard, "STEPS", 3)
    got = shard.assign_shards(spark.range(300), "id", 40).collect()
    assert all(r["shard"] == jump(r["id"], 40) for r in got)


def test_growth_moves_only_into_the_new_shard(spark):
    got = shard.assign_shards(spark.range(20000), "id", 8, grown="g").collect()
    moved = [r for r in got if r["shard"] != r["g"]]
    assert all(r["g"] == 8 for r in moved) and 0.08 < len(moved) / 20000 < 0.145
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_query_slots(spark, docs):
    rows = [(i, "x" * (i % 5)) for i in range(300)] + [(7, "same")] * 500 + [(None, None), (None, ""), (9, "é")]
    got = shard.query(docs(rows)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump(i, 8), jump(i, 9)) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_and_extra_columns(spark, docs):
    assert shard.query(docs([])).collect() == []
    df = docs([(1, "a")]).withColumnRenamed("lang", "shard")
    assert shard.assign_shards(df, "doc_id", 4).columns.count("shard") == 1


def test_write_shards(spark, docs, tmp_path):
    shard.write_shards(docs([(i, str(i)) for i in range(50)]), "doc_id", 4, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert {(r["doc_id"], r["shard"]) for r in back} == {(i, jump(i, 4)) for i in range(50)}

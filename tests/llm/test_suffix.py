"""Substring deduplication against a table of all 50-byte strings."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from prefloom.llm import suffix


def brute(rows):
    key = lambda i: (i is None, i or 0)
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone[k : k + 50] = b"\x01" * 50
        runs = sum(1 for z in range(len(b)) if gone[z] and (z == 0 or not gone[z - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def noise(rnd, n, letters="abcdefgh éü"):
    return "".join(rnd.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_shared_passages(docs, seed):
    rnd = random.Random(seed)
    shared = [noise(rnd, rnd.choice([49, 50, 51, 75, 76, 77, 120, 400])) for _ in range(6)]
    rows = []
    for i in range(60):
        t = noise(rnd, rnd.randint(0, 120))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a, b = sorted((rnd.randint(0, len(s)), rnd.randint(0, len(s))))
            t += rnd.choice([s, s[a:b]]) + noise(rnd, rnd.choice([0, 1, 30]))
        rows.append((i, t))
    rnd.shuffle(rows)
    assert got(suffix.query(docs(rows))) == brute(rows)


def test_edges(docs):
    rnd = random.Random(3)
    s, long = noise(rnd, 200), noise(rnd, 300_000, "abc ")
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 49), (5, "y" * 50), (6, "y" * 50), (7, "z" * 500), (8, "z" * 120), (9, s), (9, s), (9, s[:100] + "!"),
            (None, s), (None, s + "tail"), (10, s), (11, long), (12, "head" + long[1000:] + "tail"), (13, "ab" * 300), (14, "ba" * 200), (15, "日本" * 40), (16, "x" + "日本" * 40)]
    assert got(suffix.query(docs(rows))) == brute(rows)


def test_parts_do_not_matter(docs):
    rnd = random.Random(8)
    p = noise(rnd, 90)
    rows = [(i, noise(rnd, 30) + p + noise(rnd, 30)) for i in range(200)]
    want = brute(rows)
    narrow = lambda df: sorted((r[0], r[1], sum(x["end"] - x["start"] for x in r[2]), len(r[2]), hashlib.sha256(r[3]).hexdigest()) for r in df.collect())
    assert narrow(suffix.removed_spans(docs(rows, 7), part_rows=3)) == sorted(want)
    assert narrow(suffix.removed_spans(docs(rows, 1), part_rows=1000)) == sorted(want)


def test_empty(docs):
    assert suffix.query(docs([])).collect() == []


@pytest.mark.parametrize("piece", [50, 64, 200])
def test_long_texts_in_pieces(docs, monkeypatch, piece):
    """Pieces of a few bytes: every string is still seen once, with its runs cut anywhere."""
    monkeypatch.setattr(suffix, "_PIECE", piece)
    monkeypatch.setattr(suffix, "_HELD", 40)
    monkeypatch.setattr(suffix, "_SLICE", 30)
    rnd = random.Random(piece)
    shared = [noise(rnd, n) for n in (50, 90, 300)]
    rows = [(i, noise(rnd, rnd.randint(0, 300)) + rnd.choice(shared) + noise(rnd, rnd.randint(0, 90)) + rnd.choice(shared)) for i in range(20)] + [(30, "ab"), (31, None)]
    assert got(suffix.query(docs(rows))) == brute(rows)


def test_one_very_long_text(docs):
    """9 MB in one row, half of it in another document."""
    rnd = random.Random(1)
    long = "".join(f"{rnd.getrandbits(40):x} " for _ in range(850_000))
    half = long[: len(long) // 2]
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.query(docs([(1, half), (2, long)])).collect()}
    assert out == {1: (len(half), 0, 0), 2: (len(long), len(half), 1)}


def test_phrase_in_many_neighbourhoods(docs):
    """One sample with as many runs as documents; their single heads go to different buckets."""
    rnd = random.Random(2)
    phrase = noise(rnd, 45)
    rows = [(i, noise(rnd, 60) + phrase + noise(rnd, 60)) for i in range(400)] + [(500 + i, f"{'x' * 10}{phrase}same end of it all {i}") for i in range(40)]
    assert got(suffix.query(docs(rows))) == brute(rows)


def test_answers_that_cannot_be_seen_stop_the_query(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix, "qualified", lambda spark, path: "file:/nowhere/else")
    with pytest.raises(Exception, match="not visible"):
        suffix.query(docs([(1, "a" * 60), (2, "a" * 60)])).collect()


def test_repeats_in_many_neighbourhoods(docs):
    """Samples of more runs than a part sends: what repeats of them is still found, head by head."""
    rnd = random.Random(4)
    phrase = noise(rnd, 40)
    around = [(noise(rnd, 40), noise(rnd, 40)) for _ in range(300)]
    rows = [(i, a + phrase + b) for i, (a, b) in enumerate(around)] + [(1000 + i, f"{i} {a[20:]}{phrase}{b[:20]} {i}") for i, (a, b) in enumerate(around)]
    rows += [(-1 - i, f"{a[35:]}{phrase}{b[:5]}") for i, (a, b) in enumerate(around[:90])]
    rnd.shuffle(rows)
    assert got(suffix.query(docs(rows, 2))) == brute(rows)


def test_a_part_sends_few_runs_of_a_sample():
    rnd = random.Random(6)
    phrase = noise(rnd, 45, "abcdefgh ")
    texts = [noise(rnd, 60, "abcdefgh ") + phrase + noise(rnd, 60, "abcdefgh ") for _ in range(400)]
    batch = pa.record_batch([pa.array([0] * 400), pa.array(range(400)), pa.array(texts)], names=["part", "id", "text"])
    samples = [np.cumsum(suffix._unpack(data, n, 4)[0], dtype=np.uint64) for b in suffix._first_pass(iter([batch]), 128) for n, data in zip(b["n"].to_pylist(), b["data"].to_pylist(), strict=True)]
    assert np.unique(np.concatenate(samples), return_counts=True)[1].max() <= suffix._KINDS + 1


def strings(parts, n, bucket, buckets, seed=5):
    """A bucket's table: ``n`` strings of each part, of which other parts have some."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(-(-(bucket << 40) // buckets), ((bucket + 1) << 40) // buckets, 4 * n).astype(np.uint64)
    found = [(p, (rng.choice(pool, n), rng.integers(0, 3, n).astype(np.uint64), rng.integers(p * 50, p * 50 + 50, n))) for p in range(parts)]
    return pa.Table.from_batches([b for p, f in found for b in suffix._blocks(p, [f], buckets, True)])


def answers(table):
    return sorted((part, *x) for part, n, data in zip(*(table.column(c).to_pylist() for c in ("part", "n", "data")), strict=True) for x in zip(*(c.tolist() for c in suffix._unpack(data, n, 3)), strict=True))


def test_a_bucket_sorted_in_pieces(monkeypatch):
    table = strings(4, 3000, 5, 8, seed=9)
    whole = answers(suffix._sort_bucket(table, 8))
    monkeypatch.setattr(suffix, "_SORTED", 700)
    assert whole and answers(suffix._sort_bucket(table, 8)) == whole


def test_memory_of_a_large_bucket():
    """Three million strings: it was over 400 MB when all were sorted at a time."""
    table = strings(60, 50_000, 5, 128)
    assert set(table["bucket"].to_pylist()) == {5}
    tracemalloc.start()
    try:
        suffix._sort_bucket(table, 128)
        assert tracemalloc.get_traced_memory()[1] < 250e6
    finally:
        tracemalloc.stop()

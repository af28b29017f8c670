"""SimHash: fingerprints and components against plain Python over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from prefloom.llm import simhash


def naive_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def least(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def all_pairs(fps, errors=3):
    return [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= errors]


def naive(rows):
    fps = [naive_fingerprint(t) for _, t in rows]
    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    edges = [(a, b) for a, b in all_pairs(fps) if a in known and b in known]
    edges += [(a, b) for a in known for b in known if rows[a][0] == rows[b][0]]
    root = least(len(rows), edges)
    comp = {}
    for k in known:
        comp[root[k]] = min(comp.get(root[k], rows[k][0]), rows[k][0])
    return sorted(((i, f"{fps[k]:016x}", comp[root[k]] if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def near_fps(rnd, n, centres=20, spread=5):
    out = set()
    base = [rnd.getrandbits(64) for _ in range(centres)]
    while len(out) < n:
        x = rnd.choice(base)
        for _ in range(rnd.randrange(spread + 1)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("errors", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("spread", [2, 6])
def test_traversal_of_one_node(errors, spread):
    rnd = random.Random(errors * 10 + spread)
    fps = near_fps(rnd, 400, spread=spread)
    want = all_pairs(fps, errors)
    got = {frozenset(p) for turn in (0, 32) for p in forest(fps, turn, errors)}
    assert least(len(fps), want) == least(len(fps), [tuple(p) for p in got])


def forest(fps, turn, errors):
    turned = np.array([(x << turn | x >> (64 - turn)) & (1 << 64) - 1 for x in fps], dtype=np.uint64)
    order = np.argsort(turned)
    label = simhash.traverse(turned[order], len(fps), 0, errors)
    return [(int(order[i]), int(order[k])) for i, k in enumerate(label) if i != k]


def test_spark_join_at_every_depth(spark, monkeypatch):
    """Tiny bounds send dense groups down through all depths, in both halves."""
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "LIMIT", 24)
    rnd = random.Random(5)
    fps = sorted({*near_fps(rnd, 150, centres=2, spread=4), *near_fps(rnd, 150, centres=100)})
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    edges = [(r["u"], r["v"]) for r in simhash.links(nodes).collect()]
    assert all(bin(fps[a] ^ fps[b]).count("1") >= 1 for a, b in edges)
    assert least(len(fps), edges) == least(len(fps), all_pairs(fps))


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


def test_documents_against_all_pairs(docs):
    rnd = random.Random(7)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{rnd.randrange(80)}" for _ in range(rnd.choice([3, 40, 300, 900]))]
        for _ in range(rnd.choice([1, 4, 15])):
            rows.append((i, edited(rnd, base, rnd.choice([0, 0, 1, 2, 5]))))
            i += 1
    rnd.shuffle(rows)
    assert got(simhash.query(docs(rows))) == naive(rows)


def test_odd_rows(docs):
    text = "One  two\tthree\nFOUR five"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, text), (6, text), (7, "one two three four five"), (8, "Ärger über é"),
            (9, "a b c d e f"), (9, "completely other words stand in here"), (10, "a b c d e f"), (11, "completely other words stand in here"),
            (None, "a b c d e f"), (None, None), (12, "x\x00y z w"), (13, "zwei drei vier fünf")]
    assert got(simhash.query(docs(rows))) == naive(rows)


def test_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{k % 977}" for k in range(120_000))
    df = spark.createDataFrame([(1, long, 0, 0), (2, long, 1, 1), (3, "short", 2, 2)], "doc_id long, text string, fp int, rep int")
    out = got(simhash.query(df))
    assert [r[2] for r in out] == [1, 1, 3]
    assert out[0][1] == f"{naive_fingerprint(long):016x}"


def test_empty_table(docs):
    assert simhash.query(docs([])).collect() == []


def test_whole_test_table(spark, sf):
    from prefloom.llm.common import table

    df = table(spark, sf, "documents").select("doc_id", "text")
    assert got(simhash.query(df)) == naive([tuple(r) for r in df.collect()])

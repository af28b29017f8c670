"""Jaccard join against all pairs; connected components against a union-find."""

import random
import re

import pytest

from prefloom.llm import jaccard
from prefloom.llm.components import components


def shingles(t, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def union(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, size=4, percent=85):
    sets = [(i, shingles(t, size)) for i, t in rows]
    known = [(i, s) for i, s in sets if i is not None and s]
    edges = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if 100 * len(x & y) >= percent * len(x | y)]
    comp = union({i for i, _ in sets if i is not None}, edges)
    return sorted(((i, len(s), comp.get(i)) for i, s in sets), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_of_near_copies(docs, seed):
    rnd = random.Random(seed)
    rows, i = [], 0
    for group in range(6):
        base = [f"w{rnd.randrange(60)}" for _ in range(rnd.choice([5, 20, 60, 150]))]
        for _ in range(rnd.choice([1, 3, 30])):
            rows.append((i, edited(rnd, base, rnd.choice([0, 1, 1, 2, 3, 4, 6]))))
            i += 1
    # a chain, each link just near enough, without a common middle
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        rows.append((1000 - k, " ".join(chain[k : k + 60])))
    rnd.shuffle(rows)
    assert got(jaccard.query(docs(rows))) == brute(rows)


def test_group_without_its_base(docs):
    """Members of one group that mostly do not link with each other: the open pairs."""
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(140)]
    rows = [(k, edited(rnd, base, rnd.choice([1, 2, 3]))) for k in range(60)]
    assert got(jaccard.query(docs(rows))) == brute(rows)


def test_rows(docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three four"), (7, "one two three four five"), (None, "one two"),
            (8, "x y z"), (8, "one two"), (8, "one two"), (9, "x Y z"), (10, "long " * 30000), (11, "long " * 20000), (12, "é É"), (13, "é É")]
    assert got(jaccard.query(docs(rows))) == brute(rows)


def test_many_equal_rows(docs):
    rows = [(k, "a b c d e f g") for k in range(400)] + [(500, "a b c d e f g h"), (5, "a b c d e f g")] + [(600 + k, f"t{k} u v w x y z") for k in range(50)]
    assert got(jaccard.query(docs(rows, 8))) == brute(rows)


def test_other_sizes(docs):
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, edited(rnd, base, k % 5)) for k in range(25)]
    assert got(jaccard.join_components(docs(rows), size=5, percent=80)) == brute(rows, 5, 80)
    kept = jaccard.deduplicate(docs(rows), size=5, percent=80)
    assert kept.columns == docs(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute(rows, 5, 80)}


def test_empty(docs):
    assert jaccard.query(docs([])).collect() == []
    assert got(jaccard.query(docs([(3, "only one")]))) == [(3, 1, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)] + [(500, k) for k in range(501, 600)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = union({x for e in edges for x in e}, edges)
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in found} == {n: want[n] for n in nodes} and len(found) == len(nodes)


def test_deduplicate_repeated_rows(docs):
    """Rows repeated with one id and text stay once; another text under the id stays with it."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words are in here"), (3, "other words are in here"), (4, ""), (4, ""), (5, None)]
    kept = jaccard.deduplicate(docs(rows)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, "a b c d e f"), (3, "other words are in here"), (4, ""), (5, "")]

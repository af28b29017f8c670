"""Near mode collapse against all pairs: precision is exact, recall is measured."""

import random
import re

import pytest
from pyspark.sql import functions as F

from prefloom.operators import near
from prefloom.operators.near import near_mode_collapse, near_nodes, near_pairs
from prefloom.operators.runs import mode_collapse
from prefloom.sources.sinks import persist


def frame(spark, rows):
    return spark.createDataFrame(rows, "group string, prompt_id long, response string").repartition(4)


def shingles(text):
    w = re.findall(r"\S+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def naive(rows, percent=80):
    """{group: (responses, collapsed)} by all pairs."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [(p, re.sub(r"\s+", " ", t).strip().lower() if t is not None else None, shingles(t)) for x, p, t in rows if x == g]

        def near(a, b):
            if a[1] is not None and a[1] == b[1]:
                return True
            return bool(a[2]) and bool(b[2]) and 100 * len(a[2] & b[2]) >= percent * len(a[2] | b[2])

        hit = sum(any(near(a, b) and a[0] != b[0] and None not in (a[0], b[0]) for b in own) for a in own)
        out[g] = (len(own), hit)
    return out


def got(df):
    return {r["group"]: (r["responses"], r["collapsed"]) for r in df.collect()}


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


def families(rnd, n, most=6, edits=(0, 1, 2, 3)):
    rows = []
    for i in range(n):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([4, 30, 80, 150]))]
        rows += [(rnd.choice("ab"), rnd.randrange(40), edited(rnd, base, rnd.choice(edits))) for _ in range(rnd.randrange(1, most))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_families_against_all_pairs(spark, seed):
    rows = families(random.Random(seed), 60)
    assert got(near_mode_collapse(frame(spark, rows))) == naive(rows)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.84, the hardest ones: at least 0.95 found (0.99 expected), none wrong."""
    rnd, rows = random.Random(3), []
    while len(rows) < 600:
        base = [f"w{rnd.randrange(10**6)}" for _ in range(104)]
        other = edited(rnd, base, 2)
        a, b = shingles(" ".join(base)), shingles(other)
        if 0.80 <= len(a & b) / len(a | b) <= 0.84:
            rows += [("g", len(rows), " ".join(base)), ("g", len(rows) + 1, other)]
    n, collapsed = got(near_mode_collapse(frame(spark, rows)))["g"]
    assert n == 600 and 0.95 * 600 <= collapsed <= 600


def test_large_family_costs_its_number(spark):
    """3,000 near copies: comparisons stay a small multiple of the number of texts."""
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    rows = [("g", i, edited(rnd, base, 1)) for i in range(3000)]
    nodes = persist(near_nodes(frame(spark, rows)), "test-nodes")
    pairs = near_pairs(nodes)
    assert nodes.count() > 2900 and pairs.count() < 40 * 3000
    assert got(near_mode_collapse(frame(spark, rows))) == {"g": (3000, 3000)}


def test_nulls_and_odd_texts(spark):
    long = "one two three four five six seven"
    rows = [("a", 1, None), ("a", 2, None), ("a", 1, ""), ("a", 2, " \n"), ("a", 3, "short"), ("a", 4, " SHORT "), ("a", 5, long), ("a", 5, long),
            ("b", 1, long), ("b", 2, long.upper()), ("b", None, "only here and without a prompt"), ("b", 3, "only here and without a prompt"),
            (None, 1, long), (None, 2, long + "  ")]
    exact = got(mode_collapse(frame(spark, rows)))
    found = got(near_mode_collapse(frame(spark, rows)))
    assert found == exact
    assert found["a"] == (8, 6) and found["b"] == (4, 2) and found[None] == (2, 2)


def test_one_prompt_never_collapses(spark):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = [("g", 7, edited(rnd, base, 1)) for _ in range(30)]
    assert got(near_mode_collapse(frame(spark, rows))) == {"g": (30, 0)}


def test_empty_table(spark):
    assert near_mode_collapse(frame(spark, [("g", 1, "x")]).where(F.lit(False))).collect() == []


def test_only_shared_keys_are_joined(spark, monkeypatch):
    """Texts that share no key with another prompt's leave before the nodes of a key meet."""
    written = {}

    def counted(df, name):
        out = persist(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(near, "persist", counted)
    rnd = random.Random(6)
    rows = [("g", i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))) for i in range(200)]
    rows += [("g", 1000 + k, " ".join(f"c{i}" for i in range(40)) + f" end{k}") for k in range(2)] + [("g", 2000, " ".join(f"o{i + k}" for i in range(40))) for k in range(2)]
    assert got(near_mode_collapse(frame(spark, rows))) == {"g": (204, 2)}
    assert written["near-nodes"] == 204 and written["near-all-keys"] == 204 * near.BANDS
    assert 2 <= written["near-keys"] <= 2 * near.BANDS


def test_sets_and_keys_are_not_interpreted(spark):
    """The 80 least hashes of a set are not 80 interpreted passes of Spark's over it."""
    df = spark.createDataFrame([([1, 2, 3],)], "sh array<long>")
    plan = df.select(near._band_keys("sh", 16, 5).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


@pytest.mark.parametrize("block", [1, 7, 1 << 15])
def test_keys_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = [("a", list(range(k, k + k % 9 + 1))) for k in range(50)] + [("a", list(range(3)))]
    got = spark.createDataFrame(rows, "g string, sh array<long>").coalesce(1).select("sh", near._band_keys("sh", 4, 2).alias("b")).collect()
    alone = spark.createDataFrame(rows, "g string, sh array<long>").repartition(51).select("sh", near._band_keys("sh", 4, 2).alias("b")).collect()
    assert {tuple(r["sh"]): r["b"] for r in got} == {tuple(r["sh"]): r["b"] for r in alone}
    assert all(len(r["b"]) == 4 for r in got)

"""Source divergence against plain Python over every term of every group."""

import random
import re
from collections import Counter, defaultdict

import pytest

from prefloom.llm import divergence


def words(text):
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]


def naive(rows, least_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    seen, in_docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        seen[lang, source].update(words(text))
        in_docs[lang].update(set(words(text)))
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]
        sources = {s for la, s, _ in rows if la == lang}

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = shares(sum((seen[lang, s] for s in sources), Counter()))
        p = {s: shares(seen[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode(), t) for t in kept if seen[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_groups(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmn" for b in ("x", "é", "ß", "日本", "oo")] * 1
    rows = []
    for _ in range(200):
        lang = rnd.choice(["en", "en", "de", ""])
        source = rnd.choice(["hot", "hot", "b", "c", "é", ""])
        most = rnd.choice([3, 20, len(vocabulary)])
        text = " ".join(rnd.choice(vocabulary[:most]).title() for _ in range(rnd.randrange(40)))
        rows.append((lang, source, rnd.choice([text, text.upper(), text.replace(" ", "1"), None if rnd.random() < 0.1 else text])))
    assert got(divergence.audit(frame(spark, rows), least_docs=5, top=7)) == naive(rows, 5, 7)


def test_many_terms_and_counts(spark):
    """Several blocks of ids, many levels a group."""
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    rows = [("en", rnd.choice("xyz"), " ".join(rnd.choices(vocabulary, weights=[1 / (k + 1) for k in range(500)], k=400))) for _ in range(60)]
    assert got(divergence.audit(frame(spark, rows), least_docs=3)) == naive(rows, 3, 50)


def test_nulls_ties_repeats_and_groups_without_terms(spark):
    rows = [(None, None, None), (None, None, "a b a"), ("", "", "A B"), ("en", "s", ""), ("en", "t", "123 ..."), ("en", "u", "tie eit"), ("en", "u", "tie eit"),
            ("en", None, "Über über ÜBER"), ("fr", "only", "un un"), ("en", "v", "tie tie eit eit")]
    rows += rows[3:6]
    for least in (1, 2, 99):
        assert got(divergence.audit(frame(spark, rows), least_docs=least)) == naive(rows, least, 50)


def test_counts_given_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD_TERMS", 3)
    rows = [("en", s, "one two three four five six " * k) for k in range(4) for s in "ab"]
    assert got(divergence.audit(frame(spark, rows), least_docs=2)) == naive(rows, 2, 50)


def test_very_long_text_and_clashing_columns(spark):
    long = "alpha beta " * 300_000
    df = spark.createDataFrame([("en", "a", long, 1, 2, "x"), ("en", "b", "alpha", 3, 4, "y"), ("en", "c", "x" * 3_000_000, 5, 6, "z")],
                               "lang string, source string, text string, n int, p int, term string")
    assert got(divergence.audit(df, least_docs=1)) == naive([tuple(r)[:3] for r in df.collect()], 1, 50)


def test_empty_table(docs):
    assert divergence.query(docs([])).collect() == []


def test_shares_beyond_long(spark):
    """5 * 10**11 occurrences: the product has 21 digits."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence._share(F.lit(5 * 10**11), F.lit(7 * 10**12), F.lit(10**8)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (5 * 10**11 + 5) // (7 * 10**12 + 5 * 10**8)


def test_whole_test_table(spark, sf):
    from prefloom.llm.common import table

    df = table(spark, sf, "documents")
    assert got(divergence.query(df)) == naive([tuple(r) for r in df.select("lang", "source", "text").collect()], 30, 50)

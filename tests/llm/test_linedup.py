"""Line deduplication against a scan over all windows."""

import hashlib
import random

import pytest

from prefloom.llm import linedup


def windows(lines):
    for s, n in every_window(lines):
        if sum(len(x.split()) for x in lines[s : s + n]) >= 3:
            yield s, n


def every_window(lines):
    for s in range(len(lines)):
        if s + 3 <= len(lines):
            yield s, 3
        n = words = 0
        for n in (1, 2):
            if s + n > len(lines):
                break
            words += len(lines[s + n - 1].split())
            if words >= 50:
                yield s, n
                break


def brute(rows):
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in sorted(set(rows), key=lambda r: key(r[0])):
        if t is not None:
            lines = t.split("\n")
            for s, n in windows(lines):
                first.setdefault(tuple(lines[s : s + n]), key(i))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, None, None))
            continue
        lines, gone, own = t.split("\n"), set(), {}
        for s, n in windows(lines):
            k = tuple(lines[s : s + n])
            p = own.setdefault(k, s)
            if first[k] < key(i) or s >= p + n:
                gone |= set(range(s, s + n))
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone).encode()
        out.append((i, len(lines), len(gone), len(kept), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_against_scan(docs, seed):
    rnd = random.Random(seed)
    pool = [" ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.choice([0, 1, 5, 20, 30, 60]))) for _ in range(15)]
    rows = []
    for i in range(60):
        own = [rnd.choice(pool) if rnd.random() < 0.6 else f"own {i} {k}" for k in range(rnd.randint(1, 14))]
        if rnd.random() < 0.4:
            k = rnd.randrange(len(pool) - 5)
            own[1:1] = pool[k : k + rnd.randint(1, 5)]
        rows.append((i, "\n".join(own)))
    rnd.shuffle(rows)
    assert got(linedup.query(docs(rows))) == brute(rows)


def test_rows(docs):
    run = "first line\nsecond line\nthird line"
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(1, None), (2, ""), (3, "\n\n\n\n\n\n"), (4, run), (4, run), (5, f"x\n{run}\ny"), (None, f"{run}\nz"), (None, run), (6, "a\na\na\na\na\na\na"),
            (7, "b\n" * 5000), (8, passage), (9, f"q\n{passage}\nr"), (10, f"{passage}\n{passage}"), (4, f"other text\n{run}"), (11, "é\r\nü\r\nö"), (12, "é\r\nü\r\nö")]
    assert got(linedup.query(docs(rows))) == brute(rows)


def test_hot_passage(docs):
    run = "l1\nl2\nl3\nl4"
    rows = [(i, f"own {i}\n{run}\nend {i}") for i in range(300)] + [(0, f"own 0\n{run}\nend 0")] * 50
    assert got(linedup.query(docs(rows, 8))) == brute(rows)


def test_empty_and_columns(docs):
    assert linedup.query(docs([])).collect() == []
    d = docs([(1, "a\nb\nc"), (2, "a\nb\nc")]).withColumnRenamed("lang", "place").withColumnRenamed("source", "fp")
    out = linedup.dedup_lines(d)
    assert out.columns == d.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a\nb\nc", 2: ""}


def test_blank_lines_stay(docs):
    rows = [(1, "a b c\n\n\n\n\nd e f"), (2, "x y z\n\n\n\nw v"), (3, "\n\n\n\n")]
    kept = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(docs(rows)).collect()}
    assert kept == dict(rows)


def test_many_lines_cost_their_number(docs):
    """100,000 lines in one document, half of them repeated: whole windows would be 10**10 hashes."""
    import time

    def seconds(n):
        text = "\n".join(f"line number {k}" for k in range(n))
        start = time.monotonic()
        out = linedup.dedup_lines(docs([(1, text), (2, text + "\nmore")]), removed="gone").collect()
        assert sorted((r["doc_id"], r["gone"], len(r["text"])) for r in out) == [(1, 0, len(text)), (2, n, len("more"))]
        return time.monotonic() - start

    seconds(1000)
    assert seconds(100_000) < 20 * max(1.0, seconds(10_000))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c\nd\ne", 7, 8, "x", 1), (2, "a b c\nd\ne", 9, 8, "y", 2)], "doc_id long, text string, _id int, _tk int, _gone string, _parts int")
    out = {r["doc_id"]: tuple(r) for r in linedup.dedup_lines(df).collect()}
    assert out == {1: (1, "a b c\nd\ne", 7, 8, "x", 1), 2: (2, "", 9, 8, "y", 2)}

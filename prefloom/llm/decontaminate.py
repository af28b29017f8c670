"""Benchmark decontamination.

Every run of 13 consecutive words of a benchmark item is a window (an item of fewer words,
but not none, is one window as a whole). The windows' hashes are broadcast to the tasks, each
task scans the word windows of its documents against them, compares the words of every hit
with the item's, and reports or removes what is covered.

The benchmark is broadcast in blocks of at most ``block_windows`` windows (a bound on the
broadcast's size). A benchmark that fits one block is one scan of the documents; a larger one
is one scan per block, and a document's spans are united afterwards. Results are the same.

Defined results: a null text or one without words has 0 words, no hit and is clean; items
that are null or have no words match nothing; repeated items count once per item id; a null
item id is never listed, though its words are hit. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.common import lean, written
from prefloom.llm.words import ALNUM, LOW, Words, slices, window_hashes

WINDOW = 13
BLOCK_WINDOWS = 1_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BITS = 20

REPORT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("from_word", T.LongType()), T.StructField("to_word", T.LongType()),
        T.StructField("from_byte", T.LongType()), T.StructField("to_byte", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def item_windows(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The windows of one benchmark text."""
    words = _WORD.findall((text or "").encode().lower())  # bytes.lower() lowers A-Z only
    if not words:
        return []
    if len(words) < window:
        return [tuple(words)]
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class WindowSet:
    """The windows of a block of benchmark items, by length and hash."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int):
        found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in rows:
            for w in item_windows(text, window):
                found[w] |= {item} if item is not None else set()
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        for size in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == size]
            low = np.frombuffer(b"".join(b" ".join(w) + b" " for w in own), dtype=np.uint8)
            h = window_hashes(Words(low, np.array([0, len(low)]), ALNUM).hashes, size)[::size]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[h >> np.uint64(64 - _BITS)] = True
            self.by_size[size] = (bits, h[order], [(own[i], sorted(found[own[i]])) for i in order])

    def hits(self, words: Words, text_of: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of each verified occurrence inside one text."""
        for size, (bits, known, entries) in self.by_size.items():
            h = window_hashes(words.hashes, size)
            at = np.flatnonzero(bits[h >> np.uint64(64 - _BITS)])
            at = at[text_of[at] == text_of[at + size - 1]] if len(at) else at
            lo, hi = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            for i, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                own = tuple(words.word(k) for k in range(i, i + size))
                for w, items in entries[a:b]:
                    if w == own:
                        yield int(i), size, items


def _reports(texts: pa.Array, known: WindowSet) -> Iterator[dict]:
    for _, data, offsets in slices(texts):
        words = Words(LOW[data], offsets, ALNUM)
        counts = np.diff(words.first)
        text_of = np.repeat(np.arange(len(counts)), counts)
        covered = np.zeros(len(text_of) + 1, dtype=np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for i, size, names in known.hits(words, text_of):
            covered[i] += 1
            covered[i + size] -= 1
            items[int(text_of[i])] |= set(names)
        hit = np.cumsum(covered)[:-1] > 0
        spans: dict[int, list] = defaultdict(list)
        if hit.any():
            same = np.r_[False, hit[1:] & hit[:-1] & (text_of[1:] == text_of[:-1])]
            start = np.flatnonzero(hit & ~same)
            stop = np.flatnonzero(hit & ~np.r_[same[1:], False])
            for a, b in zip(start, stop, strict=True):
                d = int(text_of[a])
                f, o = words.first[d], offsets[d]
                spans[d].append({"from_word": int(a - f), "to_word": int(b - f) + 1,
                                 "from_byte": int(words.starts[a] - o), "to_byte": int(words.ends[b] - o)})
        for d, n in enumerate(counts):
            yield {"n_words": int(n), "spans": spans.get(d, []), "items": sorted(items.get(d, ()))}


def _pieces(text: str, window: int, block: int) -> Iterator[str]:
    """An item's text, cut into pieces of at most ``block`` windows that overlap by all but one
    word of a window, so that every window is in exactly one piece."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    if len(at) - window + 1 <= block:
        yield text
        return
    for k in range(0, len(at) - window + 1, block):
        yield raw[at[k][0] : at[min(k + block + window - 2, len(at) - 1)][1]].decode()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block: int) -> Iterator[list]:
    """Items in blocks of at most ``block`` windows; the driver holds one block (and one item)."""
    held, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), text_col).filter(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        for piece in _pieces(text, window, block):
            n = len(item_windows(piece, window))
            if held and size + n > block:
                yield held
                held, size = [], 0
            held.append((item, piece))
            size += n
    yield held


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", out: str = "report", window: int = WINDOW,
         block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with a struct column ``out``: word count, hit spans (in words and UTF-8
    bytes) and the ids, as strings, of the items found."""
    sc = docs.sparkSession.sparkContext
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != out], T.StructField(out, REPORT)])
    kept = [f.name for f in docs.schema.fields if f.name != out]

    def one(known, frame: DataFrame, more: bool) -> DataFrame:
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = _reports_list(b.column(text_col), known.value)
                if more:  # united with the report of the blocks before, in the row itself (no shuffle)
                    found = [_united(x, y) for x, y in zip(b.column(out).to_pylist(), found, strict=True)]
                r = pa.array(found, type=arrow_report())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], r], names=[*kept, out])

        return frame.mapInArrow(run, schema)

    # a written table between two blocks: one block's windows at a time, in the driver and in the tasks
    frame, more = docs.select(*kept), False
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_windows)
    block = next(blocks)
    while True:
        known = sc.broadcast(WindowSet(block, window))
        frame, block = one(known, frame, more), next(blocks, None)
        if block is None:
            return frame
        frame, more = written(frame, "decontaminate"), True
        known.destroy()


def _reports_list(texts: pa.Array, known: WindowSet) -> list[dict]:
    return list(_reports(texts, known))


def arrow_report() -> pa.DataType:
    span = pa.struct([(k, pa.int64()) for k in ("from_word", "to_word", "from_byte", "to_byte")])
    return pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))])


def _united(x: dict, y: dict) -> dict:
    spans: list[dict] = []
    for s in sorted([*x["spans"], *y["spans"]], key=lambda s: (s["from_word"], s["to_word"])):
        if spans and s["from_word"] <= spans[-1]["to_word"]:
            if s["to_word"] > spans[-1]["to_word"]:
                spans[-1] |= {"to_word": s["to_word"], "to_byte": s["to_byte"]}
        else:
            spans.append(dict(s))
    return {"n_words": x["n_words"], "spans": spans, "items": sorted({*x["items"], *y["items"]})}


def hit_words(report: str = "report"):
    return F.aggregate(f"{report}.spans", F.lit(0).cast("long"), lambda a, s: a + s["to_word"] - s["from_word"])


def contaminated(report: str = "report"):
    """At least one word hit, and at least a twentieth of the words."""
    n = hit_words(report)
    return (n > 0) & (20 * n >= F.col(f"{report}.n_words"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Only the documents that are not contaminated, with their columns as they were."""
    scanned = scan(docs, benchmark, out="_report", **kw)
    return scanned.filter(~contaminated("_report")).select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """All documents; the hit spans of contaminated ones are cut out of their texts."""
    scanned = scan(docs, benchmark, text_col=text_col, out="_report", **kw)
    raw = F.encode(text_col, "UTF-8")
    keep_from = F.concat(F.array(F.lit(0).cast("long")), F.col("_report.spans.to_byte"))
    keep_to = F.concat(F.col("_report.spans.from_byte"), F.array(F.octet_length(text_col).cast("long")))
    parts = F.transform(F.arrays_zip(keep_from.alias("a"), keep_to.alias("b")),
                        lambda p: F.decode(F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "UTF-8"))
    cut = F.when(contaminated("_report"), F.array_join(parts, "")).otherwise(F.col(text_col))
    return scanned.withColumn(text_col, cut).select(*docs.columns)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op2: the digest columns of the scan of whole ``documents``."""
    r = scan(docs.select("doc_id", "text"), benchmark)
    return r.select(
        "doc_id",
        F.col("report.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("report.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("report.items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN win ON win.k = dw.k AND win.m = dw.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

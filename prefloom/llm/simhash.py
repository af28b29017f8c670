"""SimHash near-duplicates: fingerprints and a Hamming self-join by a binary trie.

A document's fingerprint has 64 bits; a bit is set if it is set in over half of the 64-bit
hashes of its word shingles (repeats included). Fingerprints that differ in at most ``errors``
bits link; the result is each document's component.

1. Equal fingerprints are one node (the least id), so copies cost nothing further on.
2. Two fingerprints within the budget differ in at most ``errors // 2`` bits of their one half
   or of their other. So there are two turns, each with one half of the bits first: a pair of
   trie nodes may differ in ``errors // 2`` bits on the way through the first half and in
   ``errors`` bits altogether. Bits that tell most fingerprints apart come first in their half.
3. Pairs of trie nodes are traversed together. A pair at depth d is (lower prefix, bits in which
   the two prefixes differ). Spark goes down to the depth at which a node holds about ``LEAF``
   fingerprints, sending every fingerprint to each pair of nodes that the budget leaves; a pair
   that still holds over ``LIMIT`` goes down further, whatever holds it together. Pairs one of
   whose nodes is empty end there.
4. In a task, a pair of nodes is traversed bit by bit, all its pairs of children at once: each
   is dropped as soon as its differing bits exceed the budget, or once its fingerprints are
   tied together already. What comes out of a task is a spanning forest of its links, so a
   group of near copies costs its number, not its square.

Defined results: a null or empty text, or one without words, has fingerprint zero, which links like any
other; a very long text is hashed in pieces of ``_PIECE`` words, so that beside the text itself only
its words are held; rows repeated under one id, with equal or different texts, are one node
of the graph; a null id keeps its fingerprint but takes no part (component null); an empty table gives
an empty one. Other columns are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import LOWER, UPPER, lean, written
from prefloom.llm.components import components

SHINGLE = 3
SEED = 42
ERRORS = 3
BITS = 64
HALF = BITS // 2
#: fingerprints of a trie node on average where Spark stops, and at most in a pair of nodes
LEAF, LIMIT = 1 << 13, 1 << 15
_STEP = 4
_PIECE = 1 << 15
_FRONTIER = 1 << 18
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _hash_batches(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of ``words``, in pieces."""
    if len(words) < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    for at in range(0, len(words) - size + 1, _PIECE):
        part = words[at : at + _PIECE + size - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        yield np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned integer."""
    words = (text or "").encode().translate(_LOW).split()  # at space and tab..carriage return
    if not words:
        return 0
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for h in _hash_batches(words, size):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; ``fp`` holds the 64 bits as a long."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def bit_order(nodes: DataFrame) -> np.ndarray:
    """Bits (0 = highest) in the order of the trie: most even bits first, dealt in turn to the
    two halves. Collects one row of 65 numbers."""
    ones = [F.sum(F.shiftright("fp", BITS - 1 - k).bitwiseAND(1)).alias(f"b{k}") for k in range(BITS)]
    n, *ones = nodes.agg(F.count(F.lit(1)), *ones).first()
    even = sorted(range(BITS), key=lambda k: (abs(2 * (ones[k] or 0) - n), k))
    return np.array(even[0::2] + even[1::2])


def _permuted(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits[:, order], axis=1).reshape(-1, 8).copy().view(">u8").reshape(-1).astype(np.uint64)


def _budget(depth: int, errors: int) -> int:
    return errors // 2 if depth <= HALF else errors


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << k for k in at) for n in range(min(most, bits) + 1) for at in combinations(range(bits), n)]


def _down(depth: int, step: int, errors: int):
    """Rows (turn, m, fp, rep) of pairs of nodes at ``depth`` -> rows of the pairs of their
    children ``step`` bits further down: (turn, low, m, fp, rep, is_low)."""
    masks = {used: np.array(_masks(step, _budget(depth + step, errors) - used), dtype=np.uint64) for used in range(_budget(depth + step, errors) + 1)}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 4096) for whole in batches for at in range(0, whole.num_rows, 4096)):
            m, fp = (b.column(k).to_numpy().view(np.uint64) for k in (1, 2))
            used = np.bitwise_count(m)
            for n, more in masks.items():
                at = np.flatnonzero(used == n)
                if not len(at):
                    continue
                below = np.repeat(m[at] << np.uint64(step), len(more)) | np.tile(more, len(at))
                at = np.repeat(at, len(more))
                own = fp[at] >> np.uint64(BITS - depth - step) if depth + step else np.zeros(len(at), dtype=np.uint64)
                low = np.minimum(own, own ^ below)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), pa.array(low.view(np.int64)), pa.array(below.view(np.int64)), b.column(2).take(rows),
                     b.column(3).take(rows), pa.array(own == low)], names=["turn", "low", "m", "fp", "rep", "is_low"])

    return run


def _firm(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after tying i and j: the least index of each component."""
    while True:
        a, b = label[i], label[j]
        at = np.flatnonzero(a != b)
        if not len(at):
            return label
        i, j, a, b = i[at], j[at], a[at], b[at]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]


def traverse(fps: np.ndarray, left: int, depth: int, errors: int = ERRORS) -> np.ndarray:
    """Component labels (least index) under the links of one pair of trie nodes at ``depth``.

    ``fps`` holds the distinct fingerprints of the one node, sorted, in ``[:left]`` and of the other,
    sorted, in ``[left:]``; with ``left == len(fps)`` it is one node against itself.
    """
    n = len(fps)
    label = np.arange(n)
    start = (0, left, 0, n) if left == n else (0, left, left, n)
    used = 0 if left == n or not depth else int(np.bitwise_count((fps[0] ^ fps[left]) >> np.uint64(BITS - depth)))
    stack = [(depth, *(np.array([x]) for x in (*start, used)))]
    ones: dict[int, np.ndarray] = {}  # prefix sums of a bit; a node's ones follow its zeros
    while stack:
        d, a0, a1, b0, b1, used = stack.pop()
        if len(a0) > _FRONTIER:
            h = len(a0) // 2
            stack += [(d, *(x[k] for x in (a0, a1, b0, b1, used))) for k in (slice(h, None), slice(None, h))]
            continue
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        tied = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (label[a0] == label[b0])
        small = (a1 - a0) * (b1 - b0) <= 4
        for p in range(2):
            for q in range(2 if p else 4):
                # the few pairs of small nodes: (p, q) within the sizes 1x1..4x1, 2x2, 1x4
                for x, y in {(p, q), (q, p)}:
                    at = np.flatnonzero(small & ~tied & (a0 + x < a1) & (b0 + y < b1))
                    i, j = a0[at] + x, b0[at] + y
                    near = np.bitwise_count(fps[i] ^ fps[j]) <= errors
                    label = _firm(label, i[near], j[near])
        at = np.flatnonzero(~small & ~tied)
        if d == BITS or not len(at):
            continue
        a0, a1, b0, b1, used = a0[at], a1[at], b0[at], b1[at], used[at]
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((fps >> np.uint64(BITS - 1 - d)) & np.uint64(1)).astype(np.int64)])
        am, bm = (hi - (ones[d][hi] - ones[d][lo]) for lo, hi in ((a0, a1), (b0, b1)))
        itself = (a0 == b0) & (a1 == b1)
        most = _budget(d + 1, errors)
        kids = [(a0, am, b0, bm, used, used <= most), (am, a1, bm, b1, used, used <= most),
                (a0, am, bm, b1, used + 1, used < most), (am, a1, b0, bm, used + 1, (used < most) & ~itself)]
        keep = [np.flatnonzero(ok & (x1 > x0) & (y1 > y0) & ((x0 != y0) | (x1 != y1) | (x1 - x0 > 1))) for x0, x1, y0, y1, _, ok in kids]
        merged = [np.concatenate([kid[c][k] for kid, k in zip(kids, keep, strict=True)]) for c in range(5)]
        if len(merged[0]):
            stack.append((d + 1, *merged))
    return label


def _finish(depth: int, errors: int):
    """Spanning forest (u, v) of the links in one pair of trie nodes."""

    def run(t: pa.Table) -> pa.Table:  # at most LIMIT rows
        fp, rep, low = (t.column(c).to_numpy() for c in ("fp", "rep", "is_low"))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, ~low))
        label = traverse(fp[order], int(low.sum()), depth, errors)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": rep[order][tied], "v": rep[order][label[tied]]})

    return run


def links(nodes: DataFrame, errors: int = ERRORS) -> DataFrame:
    """Edges (u, v) of ``nodes`` (fp distinct, rep) whose components are those of all links."""
    n = nodes.count()
    order = bit_order(nodes) if n else np.arange(BITS)
    depth = min(HALF, max(0, n // LEAF).bit_length())

    @lean
    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, zeros = b.column(0).to_numpy().view(np.uint64), pa.array(np.zeros(b.num_rows, dtype=np.int64))
            for turn in range(2):
                own = _permuted(fps, np.roll(order, -HALF * turn)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, turn, dtype=np.int32)), zeros, pa.array(own), b.column(1)], names=["turn", "m", "fp", "rep"])

    rows = nodes.select("fp", "rep").mapInArrow(turns, "turn int, m long, fp long, rep long")
    pair, found, at = ["turn", "low", "m"], None, 0
    while True:
        rows = rows.mapInArrow(_down(at, depth - at, errors), "turn int, low long, m long, fp long, rep long, is_low boolean")
        at = depth
        rows = written(rows, "trie-rows")
        sizes = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_low").alias("n_low"))
        sizes = written(sizes.filter("n > 1 AND (m = 0 OR (n_low > 0 AND n_low < n))").select(*pair, (F.col("n") > LIMIT).alias("deeper")), "trie-pairs")
        # neither side has a proven bound; both are tables, so a join on a hot pair can be split
        rows = rows.join(sizes.hint("merge"), pair)
        edges = rows.filter("NOT deeper").drop("deeper").groupBy(*pair).applyInArrow(_finish(at, errors), "u long, v long")
        edges = written(edges.distinct(), "trie-links")
        found = edges if found is None else found.union(edges)
        if at == BITS or sizes.filter("deeper").isEmpty():
            return found
        rows = rows.filter("deeper").select("turn", "m", "fp", "rep")
        depth = min(at + _STEP, HALF if at < HALF else BITS)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, errors: int = ERRORS) -> DataFrame:
    """(id, fingerprint as 16 hexadecimal digits, component_id) of every row of ``docs``."""
    signed = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = written(signed.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")), "fingerprint-nodes")
    edges = links(nodes, errors)
    # an id with several texts ties their fingerprints together
    several = signed.filter("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("id")
    several = written(several, "several-texts")
    if not several.isEmpty():
        shared = signed.join(several.hint("merge"), "id").join(nodes.hint("merge"), "fp")
        edges = edges.union(shared.select(F.col("rep").alias("u"), F.col("id").alias("v")))
    known = components(edges).select(F.col("node").alias("rep"), "component")
    classes = nodes.join(known.hint("merge"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    classes = written(classes, "fingerprint-classes")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return signed.join(classes.hint("merge"), "fp", "left").select(
        F.col("id").alias(id_col), hexed.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """op12: fingerprints and components of whole ``documents``."""
    return near_copies(docs)

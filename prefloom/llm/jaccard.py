"""N-gram Jaccard join: exact set similarity join with set-relation skipping.

A document's set is its distinct word shingles (64-bit hashes). Two sets link when
100 * |intersection| >= ``percent`` * |union|. The result is each document's component.

1. Shingle frequencies of all documents are counted in a sketch of fixed size (``SKETCH``
   buckets). It only *orders* shingles, rare first, so its collisions cost time, never a link.
2. Equal sets are one node (the least id). Two sets can link only if they share a shingle
   among the first n - ceil(percent * n / 100) + 1 of each; these prefixes are the index lists.
3. Skipping by position: an entry (set of n shingles, position p) can meet another only if
   n - p of both reaches the overlap that the two sizes require; whole stretches of a list
   fail that test, or differ too much in size.
4. Skipping by answers: each list's first entry by position is its hub, and only (hub, entry)
   pairs are compared first. Entries that a hub or a chain of hubs has already tied together
   are never compared again. For the others, the overlaps with the common hub bound theirs
   from both sides: |u & v| <= min(|u & h|, |v & h|) + min(|u - h|, |v - h|) and
   >= |u & h| + |v & h| - |h|; only what the bounds leave open is compared set by set.

So a group of near copies costs its size, not its square, and no pair that could join two
components is left out. Sets are recomputed from the texts of candidate documents only.

Defined results: a null or empty text, or one without words, has 0 shingles and is its own
component; rows repeated under one id, with equal or different texts, are one node of the graph;
a null id takes no part (component null). Extra columns pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import lean, written
from prefloom.llm.components import components
from prefloom.llm.words import LOW, NONSPACE, Words, slices, window_hashes

SHINGLE = 4
PERCENT = 85
SKETCH = 22
FILTER = 25
_CHUNK = 12


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, data, offsets in slices(texts):
        words = Words(LOW[data], offsets, NONSPACE)
        full = window_hashes(words.hashes, size)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= size:
                yield np.unique(full[a : b - size + 1])
            elif b > a:
                yield window_hashes(words.hashes[a:b], int(b - a))
            else:
                yield np.empty(0, dtype=np.uint64)


def frequency_classes(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """Frequency class (eighths of a power of two) of each of 2**SKETCH shingle buckets,
    counted over all documents."""

    @lean

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH, dtype=np.uint32)
        for b in batches:
            for _, data, offsets in slices(b.column(0)):
                words = Words(LOW[data], offsets, NONSPACE)
                full = window_hashes(words.hashes, size)
                np.add.at(total, (full >> np.uint64(64 - SKETCH)).astype(np.int64), np.uint32(1))
        rows = total.reshape(-1, 1 << _CHUNK)
        used = np.flatnonzero(rows.any(axis=1))
        packed = [zlib.compress(rows[i].astype("<u4").tobytes(), 1) for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    @lean

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(packed), dtype="<u4").astype(np.int64)
                total[chunk] = total[chunk] + own if chunk in total else own
        classes = [np.ceil(8 * np.log2(c + 1.0)).astype("<u2").tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(classes, pa.binary())], names=["chunk", "classes"])

    parts = docs.select(text_col).mapInArrow(count, "chunk int, counts binary")
    out = np.zeros((1 << SKETCH - _CHUNK, 1 << _CHUNK), dtype=np.uint16)
    # 2**SKETCH classes of two bytes, whatever the corpus
    for r in parts.repartition("chunk").mapInArrow(add, "chunk int, classes binary").collect():
        out[r["chunk"]] = np.frombuffer(r["classes"], dtype="<u2")
    return out.reshape(-1)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(id, n, digest of the set, prefix in the global order) of every document, written."""
    known = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, text_col, size))

    @lean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = known.value
        for b in batches:
            n, digests, prefixes = [], [], []
            for s in shingle_sets(b.column(1), size):
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                order = np.argsort(classes[s >> np.uint64(64 - SKETCH)], kind="stable")[:keep]
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                prefixes.append(s[order].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()),
                                             pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists], names=["id", "n", "digest", "prefix"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), text_col)
    return written(src.mapInArrow(run, "id long, n long, digest binary, prefix array<long>"), "signatures")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The overlap that sets of these sizes need: (a + b) * percent / (100 + percent), rounded
    up in whole numbers."""
    over = (a + b) * percent + (99 + percent)
    return ((over - F.pmod(over, F.lit(100 + percent))) / F.lit(100 + percent)).cast("long")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Size and position tests of two entries (n, pos) of one list."""
    n1, n2, p1, p2 = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    sizes = (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1)
    return sizes & (F.least(n1 - p1, n2 - p2) >= _needed(n1, n2, percent))


def _bit(id_: str) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(1 << FILTER))


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER bits that holds every id of ``ids`` (by a hash), whatever their
    number: lets most texts without a candidate pair stay where they are."""

    def pack(bits: pa.Table) -> pa.Table:
        at = bits.column("bit").to_numpy()
        flags = np.zeros(1 << 15, dtype=bool)
        flags[at & 0x7FFF] = True
        return pa.table({"chunk": pa.array([int(at[0]) >> 15], pa.int32()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    bits = ids.select(_bit("id").alias("bit")).distinct()  # at most 2**15 in a group
    out = np.zeros((1 << FILTER - 15, 1 << 12), dtype=np.uint8)
    for r in bits.groupBy(F.shiftright("bit", 15)).applyInArrow(pack, "chunk int, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def overlaps(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``pairs`` (u, v) with nu, nv and the size of the intersection of their sets."""
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(pairs.select(F.col("u").alias("id")).union(pairs.select("v"))))

    @lean

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for b in batches:
            at = b.column(1).to_numpy()
            b = b.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                own = [s.tobytes() for s in shingle_sets(part.column(2), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["id", "set"])

    @lean

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x: np.frombuffer(x, dtype=np.uint64)
        for b in batches:
            rows = [(len(x) // 8, len(y) // 8, len(np.intersect1d(read(x), read(y), assume_unique=True)))
                    for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["u", "v", "nu", "nv", "common"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_col).select("id", _bit("id").alias("bit"), text_col)
    known = written(texts.mapInArrow(sets, "id long, set binary").distinct(), "sets")
    # neither the pairs nor the sets have a proven bound: no broadcast, at any size
    left = pairs.join(known.select(F.col("id").alias("u"), F.col("set").alias("su")).hint("merge"), "u")
    both = left.join(known.select(F.col("id").alias("v"), F.col("set").alias("sv")).hint("merge"), "v").select("u", "v", "su", "sv")
    found = both.mapInArrow(common, "u long, v long, nu long, nv long, common long")
    return found


def links(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) whose components are those of all links between different sets."""
    # written, as are the other tables of keys below: a join with a table, unlike one with an
    # aggregate in the same stage, can be split by adaptive execution where a key is hot
    entries = nodes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    # the least of (position, a few bits of the id): a hub per list, by a plain long
    rank = F.shiftleft(F.col("pos").cast("long"), 24).bitwiseOR(F.xxhash64("id").bitwiseAND(0xFFFFFF))
    lists = entries.groupBy("token").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    lists = written(lists, "lists")
    meets = written(entries.join(lists, "token").select("token", "id", "n", "pos", (rank == F.col("first")).alias("is_hub")), "meets")

    hubs = meets.filter("is_hub").drop("is_hub")
    star = meets.alias("x").join(hubs.alias("h"), "token").filter((F.col("x.id") != F.col("h.id")) & _may_link("x", "h", percent))
    star = written(star.select(F.col("x.id").alias("u"), F.col("h.id").alias("v")).distinct(), "star-pairs")
    answers = written(overlaps(star, docs, id_col, text_col, size), "answers")
    linked = 100 * F.col("common") >= percent * (F.col("nu") + F.col("nv") - F.col("common"))
    first = answers.filter(linked).select("u", "v")

    tied = components(first)
    named = meets.join(tied.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_lists = named.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min(F.when(F.col("is_hub"), F.col("component"))).alias("main"))
    open_lists = written(open_lists.filter("a <> b").select("token", "main"), "open-lists")
    named = named.join(open_lists, "token")
    # what the list's hub already knows of each entry
    hub = written(named.filter("is_hub").groupBy("token").agg(F.min("id").alias("hub")), "hubs")
    of_hub = answers.groupBy(F.col("u").alias("id"), F.col("v").alias("hub")).agg(
        F.when(F.count(F.lit(1)) == 1, F.max("common")).alias("with_hub"), F.max("nv").alias("nh"))  # unknown if an id has several sets
    of_hub = written(of_hub, "hub-answers")
    named = written(named.join(hub, "token").join(of_hub, ["id", "hub"], "left"), "open-entries")
    loose = named.filter("component <> main AND NOT is_hub")
    x, y = loose.alias("x"), named.filter("NOT is_hub").alias("y")
    need = _needed(F.col("x.n"), F.col("y.n"), percent)
    o1, o2 = F.col("x.with_hub"), F.col("y.with_hub")
    most = F.when(o1.isNotNull() & o2.isNotNull(), F.least(o1, o2) + F.least(F.col("x.n") - o1, F.col("y.n") - o2))
    left = x.join(y, "token").filter((F.col("x.component") != F.col("y.component")) & _may_link("x", "y", percent) & F.coalesce(most >= need, F.lit(True)))
    surely = F.coalesce(o1 + o2 - F.col("x.nh") >= need, F.lit(False))
    left = left.select(F.greatest("x.id", "y.id").alias("u"), F.least("x.id", "y.id").alias("v"), surely.alias("surely"))
    left = written(left.groupBy("u", "v").agg(F.max("surely").alias("surely")), "open-pairs")
    rest = overlaps(left.filter("NOT surely").select("u", "v"), docs, id_col, text_col, size)
    return first.union(left.filter("surely").select("u", "v")).union(rest.filter(linked).select("u", "v"))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    signed = signatures(docs, id_col, text_col, size, percent)
    narrow = signed.select("id", "n", "digest")
    least = signed.filter("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "n", "prefix")).alias("s"))
    nodes = written(least.select("digest", "s.*"), "nodes")
    tied = links(docs, nodes, id_col, text_col, size, percent)
    rows = narrow.join(nodes.select("digest", F.col("id").alias("rep")), "digest", "left")
    # an id with several texts ties their sets together
    shared = rows.filter("rep IS NOT NULL").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    edges = tied.union(shared.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = components(edges).select(F.col("node").alias("rep"), "component")
    return rows.join(known, "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each component (the one whose id names it) with all its columns; of rows
    repeated with one id and text one stays."""
    found = join_components(docs, id_col, text_col, **kw)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    left = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    several = written(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(id_col), "several-rows")
    if several.isEmpty():
        return left
    repeated = left.join(several, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(several, id_col, "left_anti").select(*docs.columns).unionByName(repeated.select(*docs.columns))


def query(docs: DataFrame) -> DataFrame:
    """op6: shingle counts and components of whole ``documents``."""
    return join_components(docs)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) USING (doc_id)
"""

"""Exact top-k inner products by distributed histogram selection.

Vectors are turned into integers, floor(scale * x). For a block of queries (a bounded matrix,
broadcast) every task scores its vectors against all queries of the block:

1. A first pass finds the largest norm, hence a range that holds every score.
2. Each refinement pass cuts every query's range into ``BINS`` bins and counts the scores in
   them; the summed histogram says which bin holds the k-th largest score, and that bin is the
   next range. It ends when every range is one integer wide: the exact k-th value. A task
   sends only its bins down to its own k-th score, as the global one cannot lie lower.
3. The last pass keeps scores at or above the k-th value, at most k per query and task
   (ties by smaller id), and a window ranks what is left.

All passes see all vectors; the number of queries only sets the number of blocks.

Defined results: rows with a null id, a null vector, a null or non-finite component take no
part; vectors of another length than the query's are no candidates; a query's own id is never
its candidate, however often it occurs; a repeated candidate row counts every time; of several
vectors under one query id the smallest (as an array) is the query; fewer candidates than k
give fewer rows. Scores beyond 2**61 are held at that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.session import scratch_path

BINS = 1024
BLOCK = 2048
_ROWS = 1024
_LIMIT = 1 << 61


def _vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer-valued float matrix) of a batch's valid rows, by vector length."""
    ids, vec = batch.column(0), batch.column(1)
    n = len(ids)
    if not n:
        return
    lists = vec.cast(pa.list_(pa.float64()))
    flat = lists.flatten()
    lens = np.where(lists.is_valid(), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False)  # null components become NaN
    first = np.r_[0, np.cumsum(lens)]
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    good = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid()) & (bad[first[1:]] == bad[first[:-1]])
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(lens[good]):
        rows = np.flatnonzero(good & (lens == dim))
        for at in range(0, len(rows), _ROWS):
            own = rows[at : at + _ROWS]
            yield keys[own], np.floor(scale * values[first[own][:, None] + np.arange(dim)])


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products, queries by rows."""
    most = np.abs(q).max(initial=0.0) * np.abs(v).max(initial=0.0) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = lambda a: np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape)
    exact = whole(q).dot(whole(v).T)
    return np.clip(exact, -_LIMIT, _LIMIT).astype(np.int64)


class Block:
    """A block's queries by vector length: ids and matrix; per query range and need."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], norm: dict[int, float]):
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        dims = np.array([len(v) for v in vectors], dtype=np.int64)
        self.ids = ids
        self.low = np.zeros(len(ids), dtype=np.int64)
        self.width = np.ones(len(ids), dtype=np.int64)
        self.above = np.zeros(len(ids), dtype=np.int64)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            m = np.stack([vectors[i] for i in at]) if dim else np.zeros((len(at), 0))
            self.by_dim[int(dim)] = (at, ids[at], m)
            reach = np.sqrt((m * m).sum(1)) * norm.get(int(dim), 0.0) * (1 + 1e-9) + 1
            reach = np.minimum(reach, float(_LIMIT)).astype(np.int64)
            self.low[at], self.width[at] = -reach, 2 * reach + 1

    def scored(self, batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple]:
        """(query positions, candidate ids, scores, own) for each run of vectors."""
        for b in batches:
            for keys, v in _vectors(b, scale):
                if v.shape[1] in self.by_dim:
                    at, ids, m = self.by_dim[v.shape[1]]
                    yield at, keys, _scores(m, v), ids[:, None] == keys[None, :]


def _norms(vectors: DataFrame, scale: int) -> dict[int, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for b in batches:
            for _, v in _vectors(b, scale):
                most[v.shape[1]] = max(most.get(v.shape[1], 0.0), float(np.sqrt((v * v).sum(1)).max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.float64())], names=["dim", "norm"])

    rows = vectors.mapInArrow(run, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm")).collect()
    return {r["dim"]: r["norm"] for r in rows}


def _refine(vectors: DataFrame, block: Block, k: int, scale: int) -> None:
    """One histogram pass: narrows the range of every query of ``block``."""
    step = -(-block.width // BINS)
    sent = vectors.sparkSession.sparkContext.broadcast((block, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, step = sent.value
        hist = np.zeros((len(own.ids), BINS), dtype=np.int64)
        for at, _, score, self_ in own.scored(batches, scale):
            bins = (score - own.low[at][:, None]) // step[at][:, None]
            ok = (bins >= 0) & (bins < BINS) & (score < (own.low + own.width)[at][:, None]) & ~self_
            flat = (at[:, None] * BINS + bins)[ok]
            hist += np.bincount(flat, minlength=hist.size).reshape(hist.shape)
        from_top = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]
        useful = (hist > 0) & (from_top - hist < (k - own.above)[:, None])
        q, b = np.nonzero(useful)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(hist[q, b])], names=["q", "bin", "n"])

    counts = vectors.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("q").orderBy(F.desc("bin"))
    need = F.lit(k)
    reached = counts.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("n").over(Window.partitionBy("q"))
    found = (  # at most a row per query of the block: the first bin from the top that reaches its need
        reached.withColumn("total", total)
        .select("q", "bin", "n", "upto", "total")
        .join(F.broadcast(vectors.sparkSession.createDataFrame([(int(i), int(a)) for i, a in enumerate(block.above)], "q int, above long")), "q")
        .filter((F.col("upto") + F.col("above") >= need) & (F.col("upto") - F.col("n") + F.col("above") < need))
        .select("q", "bin", (F.col("upto") - F.col("n")).alias("over"))
        .collect()
    )
    done = np.zeros(len(block.ids), dtype=bool)
    for r in found:
        q = r["q"]
        top = block.low[q] + block.width[q]
        block.low[q] += step[q] * r["bin"]
        block.width[q] = min(int(step[q]), int(top - block.low[q]))
        block.above[q] += r["over"]
        done[q] = True
    block.width[~done] = 1  # fewer candidates than k: everything from the range's start on


def _select(vectors: DataFrame, block: Block, k: int, scale: int) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(block)

    def best(q, key, score):
        order = np.lexsort((key, -score, q))
        q, key, score = q[order], key[order], score[order]
        start = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.empty(0, dtype=np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        return q[place < k], key[place < k], score[place < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        kept = tuple(np.empty(0, dtype=np.int64) for _ in range(3))
        for at, keys, score, self_ in own.scored(batches, scale):
            i, j = np.nonzero((score >= own.low[at][:, None]) & ~self_)
            kept = best(*(np.r_[a, b] for a, b in zip(kept, (at[i], keys[j], score[i, j]), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(own.ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["query_id", "vec_id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return vectors.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of ``vectors`` for each of ``queries``
    (both with ``id_col`` and ``vector_col``). ``block``: about so many queries at a time."""
    spark = vectors.sparkSession
    narrow = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = asked.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & sound).groupBy("id").agg(F.min("v").alias("v"))
    n = asked.count()
    blocks = max(1, -(-n // block))
    norm = _norms(narrow, scale) if n else {}
    path = scratch_path(spark, "topk")
    for i in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else asked
        rows = own.collect()  # one block
        ids = np.array([r["id"] for r in rows], dtype=np.int64)
        b = Block(ids, [np.floor(scale * np.array(r["v"], dtype=np.float64)) for r in rows], norm)
        while len(ids) and b.width.max() > 1:
            _refine(narrow, b, k, scale)
        _select(narrow, b, k, scale).write.mode("append").parquet(path)
    return spark.read.schema("query_id long, vec_id long, score long, rank int").parquet(path).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    """op10: queries are the rows whose vec_id is divisible by 50."""
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

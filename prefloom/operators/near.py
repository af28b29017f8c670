"""Nearly identical responses of a group (G9's near form): MinHash bands, then an exact check.

A response's set is its distinct ``size``-word shingles (lower-cased, white space collapsed; of
fewer words, the whole text). Two responses are nearly identical when the Jaccard similarity of
their sets is at least ``similarity``.

1. Equal texts are one node; what they count for is decided without any comparison.
2. A node has ``bands`` keys of ``rows`` least hashes each. Nodes of similarity s share a key
   with probability 1 - (1 - s**rows)**bands: 0.998 at 0.8, 0.99999 at 0.9 with the defaults.
   A key whose nodes all belong to one prompt is dropped first, and with it most nodes.
3. A response only has to find *one* near copy under another prompt. So every node of a key first
   meets two of its nodes, those of the least and of the largest prompt, and the sets are compared
   exactly: a family of near copies costs its number, not its square.
4. Only nodes still without a partner meet the other nodes of their keys.

Keys meet as written tables, so that a hot key's join can be split; nothing is gathered by key.
The arithmetic on hashes (shingles of word hashes, least hashes) is numpy's, over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.text import words
from prefloom.sources.sinks import persist

# --- our definition of "nearly identical" -------------------------------------
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 5
BLOCK = 1 << 15  # hashes that numpy takes at a time
# ---------------------------------------------------------------------------


def shingle_set(hashes: str, size: int = SHINGLE) -> Column:
    """Distinct shingle hashes of a column of word hashes; empty for an empty list."""

    @F.arrow_udf("array<bigint>")
    def sets(lists: pa.Array) -> pa.Array:
        odd, ends, out = np.uint64(0x9E3779B97F4A7C15), [0], []
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        at = lists.offsets.to_numpy()
        for i, j in zip(at[:-1], at[1:]):
            w = values[i:j] if j - i >= size or i == j else np.append(values[i:j], np.zeros(size - (j - i), np.uint64))
            n = max(0, len(w) - size + 1)
            h = np.zeros(n, np.uint64)
            for k in range(size if n else 0):
                h = h * odd + w[k : k + n]
            h = (h ^ (h >> np.uint64(32))) * odd
            out.append(np.unique(h ^ (h >> np.uint64(29))))
            ends.append(ends[-1] + len(out[-1]))
        flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))

    return sets(F.col(hashes))


def _band_keys(sets: str, bands: int, rows: int) -> Column:
    """The keys of a column of shingle sets that are not empty: per band a hash of ``rows`` least hashes."""

    @F.arrow_udf("array<bigint>")
    def keys(lists: pa.Array) -> pa.Array:
        rnd = np.random.default_rng(7)
        salt, odd = rnd.integers(0, 2**64, bands * rows, np.uint64), rnd.integers(0, 2**64, bands * rows, np.uint64) | np.uint64(1)
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        out = np.zeros((len(lists), bands), np.uint64)
        i = 0
        while i < len(lists):  # as many lists as fit the processor's cache, or one longer list
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
            own, starts = values[at[i] : at[j]], at[i:j] - at[i]
            h = np.empty(len(own), np.uint64)
            for k in range(bands * rows):
                np.bitwise_xor(own, salt[k], out=h)
                np.multiply(h, odd[k], out=h)
                least = np.minimum.reduceat(h, starts)
                out[i:j, k // rows] = (out[i:j, k // rows] + (least ^ (least >> np.uint64(31)))) * odd[k]
            i = j
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, bands), pa.int32()), pa.array(out.ravel().view(np.int64)))

    return keys(F.col(sets))


def _two_prompts(x: str, y: str) -> Column:
    """The two nodes' responses come from at least two prompts."""
    return F.least(f"{x}.lo", f"{y}.lo") != F.greatest(f"{x}.hi", f"{y}.hi")


def near_nodes(responses: DataFrame, by=("group",), prompt: str = "prompt_id", text: str = "response", size: int = SHINGLE) -> DataFrame:
    """One row per group and normalised text: (g, key, n responses, lo and hi prompt, sh the set)."""
    x = responses.select(F.struct(*by).alias("g"), F.col(prompt).alias("p"), F.when(F.col(text).isNotNull(), F.array_join(F.transform(words(text), F.lower), " ")).alias("t"))
    nodes = x.withColumn("key", F.md5("t")).groupBy("g", "key").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.any_value("t").alias("t"))
    hashes = F.when(F.length("t") > 0, F.transform(F.split("t", " ", -1), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return nodes.withColumn("_w", hashes).withColumn("sh", shingle_set("_w", size)).drop("t", "_w")


def near_pairs(nodes: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(g, a, b): nodes of the written table ``nodes`` that are nearly identical and come from two
    prompts. Every node that has such a partner (and shares a key with it) is in a pair; not all
    pairs are listed."""
    percent = round(100 * similarity)
    keyed = nodes.where(F.size("sh") > 0).select("g", "key", "lo", "hi", F.size("sh").alias("m"), _band_keys("sh", bands, rows).alias("_b"))
    keyed = persist(keyed.withColumn("band", F.explode("_b")).drop("_b"), "near-all-keys")
    shared = keyed.groupBy("g", "band").agg(F.count(F.lit(1)).alias("c"), F.min("lo").alias("least"), F.max("hi").alias("largest"))
    shared = persist(shared.where("c > 1 AND least <> largest").select("g", "band"), "near-shared-keys")
    keyed = persist(keyed.join(shared, ["g", "band"], "left_semi"), "near-keys")
    member = F.struct("key", "lo", "hi", "m")
    ends = persist(keyed.groupBy("g", "band").agg(
        F.count(F.lit(1)).alias("c"), F.min_by(member, F.struct("lo", "key")).alias("first"), F.max_by(member, F.struct("hi", "key")).alias("last")), "near-key-ends")

    def close(x: str, y: str) -> Column:
        a, b = F.col(f"{x}.m"), F.col(f"{y}.m")
        return (F.col(f"{x}.key") != F.col(f"{y}.key")) & _two_prompts(x, y) & (100 * F.least(a, b) >= percent * F.greatest(a, b))

    def named(x: str, y: str) -> list[Column]:
        return [F.col("g"), F.least(f"{x}.key", f"{y}.key").alias("a"), F.greatest(f"{x}.key", f"{y}.key").alias("b")]

    def equal_enough(pairs: DataFrame) -> DataFrame:
        pairs = persist(pairs.distinct(), "near-candidates")
        sets = nodes.select("g", "key", "sh")
        both = pairs.join(sets.withColumnsRenamed({"key": "a", "sh": "sa"}), ["g", "a"]).join(sets.withColumnsRenamed({"key": "b", "sh": "sb"}), ["g", "b"])
        common = F.size(F.array_intersect("sa", "sb"))
        return persist(both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("g", "a", "b"), "near-pairs")

    x = keyed.alias("x").join(ends, ["g", "band"])
    to_ends = [x.where(close("x", end)).select(*named("x", end)) for end in ("first", "last")]
    found = equal_enough(to_ends[0].union(to_ends[1]))

    settled = found.select("g", F.col("a").alias("key")).union(found.select("g", "b")).distinct()
    rest = keyed.where(F.col("lo").eqNullSafe(F.col("hi"))).join(settled, ["g", "key"], "left_anti")
    rest = persist(rest.join(ends.where("c > 2").select("g", "band"), ["g", "band"], "left_semi"), "near-rest")
    others = rest.alias("x").join(keyed.alias("y"), ["g", "band"]).where(close("x", "y")).select(*named("x", "y"))
    return found.union(equal_enough(others)).distinct()


def near_mode_collapse(responses: DataFrame, by=("group",), prompt: str = "prompt_id", text: str = "response", similarity: float = SIMILARITY,
                       size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """G9, near form: share of responses that have an equal or nearly identical response under
    another prompt of the group (NULL texts are equal, as there). Columns as those of ``mode_collapse``."""
    nodes = persist(near_nodes(responses, by, prompt, text, size), "near-nodes")
    pairs = near_pairs(nodes, similarity, bands, rows)
    near = pairs.select("g", F.col("a").alias("key")).union(pairs.select("g", "b")).distinct().withColumn("near", F.lit(True))
    x = nodes.select("g", "key", "n", "lo", "hi").join(near, ["g", "key"], "left")
    hit = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)) | F.col("near").isNotNull()
    out = x.groupBy("g").agg(F.sum("n").alias("responses"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("collapsed"))
    return out.select(*[F.col("g")[c].alias(c) for c in by], "responses", "collapsed", (F.col("collapsed") / F.col("responses")).alias("mode_collapse"))

"""Sharding by jump consistent hashing (DataFrame functions only).

The shard of a row depends on its key and the number of shards alone. A key walks the jump
sequence: with state ``k`` (64 bits, from the key's MD5) each step multiplies and increments
``k`` and jumps forward by ``2**31 / (top 31 bits of k + 1)``; the last landing below the
number of shards is the shard. Adding a shard can only add one jump, which lands in the new
shard, so the rows that move (one in n + 1) all move there. There is no ring table.

The 64-bit product is built from 16- and 32-bit halves, as SQL longs do not wrap around.

Defined results: a null key is hashed as the text ``null``; equal keys always share a shard;
empty tables give empty results; extra columns pass through (a column named like an output
is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.common import root_buckets

_MASK = 0xFFFFFFFF
#: the multiplier of the published jump hash, 2862933555777941757, as high and low 32 bits
_C_HIGH, _C_LOW = 2862933555777941757 >> 32, 2862933555777941757 & _MASK
#: so many steps serve nearly every key; a key that is not done after them takes all steps
STEPS = 64


def _low_product(a: Column, c: int) -> Column:
    """Low 32 bits of a 32-bit value times a 32-bit constant, without leaving 63 bits."""
    mid = (a * F.lit(c >> 16)).bitwiseAND(0xFFFF)
    return (a * F.lit(c & 0xFFFF) + F.shiftleft(mid, 16)).bitwiseAND(_MASK)


def _step(s: Column, shards: int) -> Column:
    """One jump of state (b, j, high, low) unless j is already beyond the last shard."""
    high, low = s["high"], s["low"]
    p0, p1 = low * F.lit(_C_LOW & 0xFFFF), low * F.lit(_C_LOW >> 16)
    lower = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(lower, 32) + F.shiftright(p1, 16)
    new_low = lower.bitwiseAND(_MASK)
    new_high = (carry + _low_product(high, _C_LOW) + _low_product(low, _C_HIGH)).bitwiseAND(_MASK)
    top = F.shiftright(new_high, 1) + F.lit(1)  # (k >> 33) + 1
    j = F.floor((s["j"] + 1).cast("double") * F.lit(float(1 << 31)) / top.cast("double")).cast("long")
    return F.when(s["j"] >= shards, s).otherwise(
        F.struct(s["j"].alias("b"), j.alias("j"), new_high.alias("high"), new_low.alias("low")))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (int, 0 to shards - 1) of a key of any type that casts to string."""
    if shards < 1:
        raise ValueError("at least one shard")
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), half(1).alias("high"), half(9).alias("low"))
    walk = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda s, _: _step(s, shards))
    end = walk(min(shards, STEPS))
    if shards > STEPS:
        end = F.when(end["j"] >= shards, end).otherwise(walk(shards))
    return end["b"].cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, out: str = "shard", grown: str | None = None) -> DataFrame:
    """``df`` with its shard, and in ``grown`` its shard when one more is appended. No shuffle."""
    df = df.withColumn(out, jump_shard(F.col(key), shards))
    return df.withColumn(grown, jump_shard(F.col(key), shards + 1)) if grown else df


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """One folder ``shard=i`` per shard; every task appends its own rows, nothing is moved."""
    assign_shards(df, key, shards).write.partitionBy("shard").parquet(path)


def with_slots(df: DataFrame, shards: int, rows: int, out: str = "slot") -> DataFrame:
    """A gapless 0-based number within each shard, ordered by the rows' own values.

    Equal rows are counted before the shuffle and expanded after it, so one repeated row, or
    one key with a third of all rows, is a single row in every task. ``rows`` (the number of
    input rows) only sets the number of buckets of the two-level rank.
    """
    cols = df.columns
    grouped = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    grouped = grouped.withColumn("_b", F.pmod(F.xxhash64(*cols), F.lit(root_buckets(rows // shards))))
    inner = grouped.groupBy("shard", "_b").agg(F.sum("_copies").alias("_n"))
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = inner.select("shard", "_b", earlier("_n", Window.partitionBy("shard").orderBy("_b")).alias("_base"))
    own = Window.partitionBy("shard", "_b").orderBy(*cols)
    placed = grouped.withColumn("_own", earlier("_copies", own)).join(base, ["shard", "_b"])
    first = F.col("_base") + F.col("_own")
    chunk = 10_000  # one row's copies are expanded so many at a time
    placed = placed.select(*cols, first.alias("_lo"), (first + F.col("_copies") - 1).alias("_hi"))
    placed = placed.select(*cols, "_hi", F.explode(F.sequence("_lo", "_hi", F.lit(chunk).cast("long"))).alias("_lo"))
    return placed.select(*cols, F.explode(F.sequence("_lo", F.least(F.col("_hi"), F.col("_lo") + chunk - 1))).alias(out))


def query(docs: DataFrame, shards: int = 8) -> DataFrame:
    """op5: shard, slot and grown shard of whole ``documents`` under the law ``key``."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = with_slots(assign_shards(narrow, "doc_id", shards, grown="grown_shard"), shards, docs.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

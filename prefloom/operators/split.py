"""Exact, deterministic train/validation splits without a global sort.

Rows are ordered by a text ``o``: md5(seed:key), then a hash of the row's other columns; the
``need`` smallest go to validation, ``need = ceil(n * ratio)`` (per stratum: largest-remainder
shares of the global need). The ``need``-th smallest ``o`` is found by refining a histogram:

1. count rows by the next four characters of ``o`` (hexadecimal digits: at most 65,536 counts),
   among the rows that share the prefix found so far; prefix sums tell the bucket of the cut;
2. go on inside that bucket until it holds at most ``bound`` rows, however the hashes are skewed;
3. the few values of that bucket give the cut itself. Every row is then decided by comparing
   its ``o`` with the cut: no row is ranked, joined or sorted.

With strata a cut is a row of a table instead of a value in the driver, and rows meet the cut of their
stratum by an equi-join. The driver holds one histogram of at most 65,536 counts at a time.

Every row comes out, whatever is NULL: a NULL key is hashed as a value of its own and
NULL is a stratum like any other. Only rows that are equal in every column can share an ``o``;
if the cut falls among such rows, the table is written and its row numbers are added to ``o``,
so sizes are exact in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
TRAIN, VALIDATION = "train", "validation"
NULL_KEY = "\0null"
# ---------------------------------------------------------------------------

#: rows of a bucket that is not refined any further
BOUND = 1 << 16
_STEP = 4
_FLIP = -(1 << 63)


def split_hash(key, seed: int) -> F.Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(k.cast("string"), F.lit(NULL_KEY))))


def _digits(number: Column, flip: bool = True) -> Column:
    """A long as 16 hexadecimal digits that sort as the numbers do."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(_FLIP)) if flip else number), 16, "0")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe equi-join; ``right``'s keys are dropped."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return left.join(right, cond).drop(*[f"_r_{k}" for k in keys])


def find_cut(rows: DataFrame, o: str, need, bound: int = BOUND, sums: tuple[str, ...] = ()) -> tuple[str, int, int]:
    """(cut, take, equal): the ``need``-th smallest value of ``o``, how many of the rows that have
    it belong to the smallest ``need``, and how many have it. ``need`` is a number, or a
    function of the number of rows and the totals of the ``sums`` columns. With ``need`` 0 the cut is ''."""
    prefix, below, first = "", 0, True
    while True:
        inside = rows.where(F.col(o).startswith(prefix)) if prefix else rows
        bucket = F.substring(o, len(prefix) + 1, _STEP).alias("b")
        totals = [F.sum(c).alias(c) for c in sums] if first else []
        found = inside.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), *totals).collect()  # at most 16**_STEP rows
        if first:
            n = sum(r["n"] for r in found)
            need = int(need(n, *(sum(r[c] or 0 for r in found) for c in sums))) if callable(need) else need
            if need <= 0:
                return "", 0, 0
            first = False
        for r in sorted(found, key=lambda r: r["b"]):
            if below + r["n"] >= need:
                break
            below += r["n"]
        if r["b"] == "":  # nothing follows the prefix: all of these rows are equal
            return prefix, need - below, r["n"]
        prefix += r["b"]
        if r["n"] <= bound:
            break
    values = rows.where(F.col(o).startswith(prefix)).groupBy(o).agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``bound`` rows
    for r in sorted(values, key=lambda r: r[o]):
        if below + r["n"] >= need:
            return r[o], need - below, r["n"]
        below += r["n"]
    raise ValueError("the table changed between its passes; write it first (materialize=True)")


def find_cuts(rows: DataFrame, o: str, by: str, needs: DataFrame, bound: int = BOUND) -> DataFrame:
    """(by, _cut, _take, _equal) of every stratum whose ``needs`` (by, _need) is above 0. One row
    per stratum, written after each round; no stratum is ever in one task."""
    from prefloom.sources.sinks import persist

    state = needs.where("_need > 0").select(by, F.col("_need").cast("bigint"), F.lit(0).cast("bigint").alias("_below"),
                                             F.lit("").alias("_prefix"), F.lit(None).cast("bigint").alias("_size"))
    done, depth = None, 0
    upto = Window.partitionBy(by)

    def within(df: DataFrame, value: str) -> DataFrame:
        """Of the counts ``_n`` by ``value`` those at the cut, with what lies below it."""
        w = upto.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        x = df.withColumn("_end", F.col("_below") + F.sum("_n").over(w))
        return x.where((F.col("_end") >= F.col("_need")) & (F.col("_end") - F.col("_n") < F.col("_need")))

    while True:
        inside = _null_safe(rows.select(by, o), state, [by]).where(F.substring(o, 1, depth) == F.col("_prefix"))
        keys = [by, "_need", "_below", "_prefix"]
        counts = inside.groupBy(*keys, F.substring(o, depth + 1, _STEP).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        found = within(counts, "_b").select(
            by, "_need", (F.col("_end") - F.col("_n")).alias("_below"), F.concat("_prefix", "_b").alias("_prefix"), F.col("_n").alias("_size"), F.col("_b"))
        found = persist(found, "split-cuts")
        over = F.col("_b") == ""
        equal = found.where(over).select(by, F.col("_prefix").alias("_cut"), (F.col("_need") - F.col("_below")).alias("_take"), F.col("_size").alias("_equal"))
        small = _null_safe(rows.select(by, o), found.where(~over & (F.col("_size") <= bound)), [by])
        small = small.where(F.col(o).startswith(F.col("_prefix"))).groupBy(by, "_need", "_below", o).agg(F.count(F.lit(1)).alias("_n"))
        exact = within(small, o).select(by, F.col(o).alias("_cut"), (F.col("_need") - F.col("_end") + F.col("_n")).alias("_take"), F.col("_n").alias("_equal"))
        ready = equal.unionByName(exact)
        done = ready if done is None else done.unionByName(ready)
        state = found.where(~over & (F.col("_size") > bound)).drop("_b")
        depth += _STEP
        if state.isEmpty():
            return persist(done, "split-cuts")


def _ordered(df: DataFrame, key: str, seed: int, tie: list[str] | None) -> DataFrame:
    rest = F.xxhash64(*(tie or df.columns))
    return df.withColumn("_o", F.concat(split_hash(key, seed), _digits(rest)))


def _numbered(keyed: DataFrame) -> DataFrame:
    """``keyed`` written, with ``_o`` made unique by row numbers: for equal rows at a cut."""
    numbered = _materialize(keyed.withColumn("_o", F.concat("_o", _digits(F.monotonically_increasing_id()))), True)
    return numbered


def _materialize(keyed: DataFrame, materialize: bool) -> DataFrame:
    """The cut reads its input three times (counts, boundary, decision). When the
    input is itself the result of shuffles (dedup, pairing), it is written once as a
    parquet table in the shared checkpoint folder, so those shuffles are not re-run per
    pass and the count pass reads only the hash column."""
    if not materialize:
        return keyed
    from prefloom.sources.sinks import persist

    return persist(keyed, "split-input")


def _named(inside: Column) -> Column:
    return F.when(inside, VALIDATION).otherwise(TRAIN)


def train_val_split(df: DataFrame, ratio: float = 0.1, seed: int = 42, key: str = "ord", bound: int = BOUND,
                    materialize: bool = False, tie: list[str] | None = None) -> DataFrame:
    """Exactly ``ceil(n * ratio)`` rows get ``split = 'validation'``, the rest 'train'.

    The decision is a comparison with one value: a projection, without a shuffle or a join.
    ``tie`` names the columns that order rows of one key (by default all).
    """
    import math

    keyed = _materialize(_ordered(df, key, seed, tie), materialize)
    need = lambda n: math.ceil(n * float(ratio))
    cut, take, equal = find_cut(keyed, "_o", need, bound)
    if take < equal:
        keyed = _numbered(keyed)
        cut, _, _ = find_cut(keyed, "_o", need, bound)
    return keyed.withColumn("split", _named(F.col("_o") <= F.lit(cut))).drop("_o")


def _sortable(df: DataFrame, by: str) -> Column:
    """A stratum's value as text that sorts as the values do: NULL, then numbers and dates by value,
    strings by their UTF-8 bytes, any other type as its text."""
    dt, c = df.schema[by].dataType, F.col(by)
    if isinstance(dt, (T.IntegralType, T.BooleanType)):
        text = _digits(c.cast("bigint"))
    elif isinstance(dt, T.DateType):
        text = _digits(F.unix_date(c).cast("bigint"))
    elif isinstance(dt, T.TimestampType):
        text = _digits(F.unix_micros(c))
    else:
        text = F.hex(F.encode(c.cast("string"), "UTF-8"))
    return F.coalesce(F.concat(F.lit("1"), text), F.lit("0"))


def _shares(keyed: DataFrame, by: str, ratio: float, bound: int) -> DataFrame:
    """(by, _need): the global need ``ceil(N * ratio)`` shared by largest remainder, ties by
    stratum value. The strata that get one more are chosen by the same refined cut, so
    no task ever holds all strata."""
    import math

    sizes = keyed.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    exact = F.col("_n") * F.lit(float(ratio))
    sizes = sizes.withColumn("_floor", F.floor(exact).cast("bigint")).withColumn("_rem", exact - F.floor(exact))
    falling = F.lit(1 << 53) - F.floor(F.col("_rem") * F.lit(float(1 << 53))).cast("bigint")
    sizes = _materialize(sizes.withColumn("_o", F.concat(_digits(falling, flip=False), _sortable(sizes, by))), True)
    cut, _, _ = find_cut(sizes, "_o", lambda _, n, floor: math.ceil(n * float(ratio)) - floor, bound, sums=("_n", "_floor"))
    return sizes.select(by, (F.col("_floor") + (F.col("_o") <= F.lit(cut)).cast("bigint")).alias("_need"))


def stratified_split(df: DataFrame, by: str, ratio: float = 0.1, seed: int = 42, key: str = "ord", bound: int = BOUND,
                     materialize: bool = False, tie: list[str] | None = None) -> DataFrame:
    """Per-stratum exact cut; the shares of the strata sum to ``ceil(N * ratio)``.

    The table of cuts has a row per stratum, so no broadcast hint is given; the planner's size
    check decides.
    """
    keyed = _materialize(_ordered(df, key, seed, tie), materialize)
    needs = _shares(keyed, by, ratio, bound)
    cuts = find_cuts(keyed, "_o", by, needs, bound)
    if not cuts.where("_take < _equal").isEmpty():
        keyed = _numbered(keyed)
        cuts = find_cuts(keyed, "_o", by, needs, bound)
    right = cuts.select(F.col(by).alias("_stratum"), "_cut")
    rows = keyed.join(right, keyed[by].eqNullSafe(right["_stratum"]), "left")
    return rows.withColumn("split", _named(F.coalesce(F.col("_o") <= F.col("_cut"), F.lit(False)))).drop("_o", "_stratum", "_cut")


def split_stats(split_df: DataFrame) -> DataFrame:
    """Rows per split (plus the column list, as the reference's stats file has)."""
    cols = ",".join(c for c in split_df.columns if c != "split")
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(cols))

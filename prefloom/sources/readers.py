"""Readers with explicit formats, schemas and an input ordinal ``ord``.

Input order is data here (dedup "first wins", tie order, ``gen_{n}`` ids, heads), so
readers attach a dense ``ord``: from the parquet row index, or for other formats from a
row's position within its split (``monotonically_increasing_id`` minus the split's
smallest id -- a position, not a global id, so it depends only on the file listing and
the split size, which one query plan fixes).

Paths are only ever opened by Spark, so any scheme it knows works. The format is an
argument, never guessed from a name or from the first bytes. Broken records stop the read
(``mode='FAILFAST'``); nothing is dropped silently. Of the exceptions only "path not found"
is handled, where a reader is defined to fall back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from prefloom.sources.json_array import array_objects, read_json_array

PROMPTS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("prompt", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("difficulty", T.StringType()),
])
BETA_SWEEP_SCHEMA = "beta STRING, metrics MAP<STRING, DOUBLE>, status STRING"

# --- fixed values -----------------------------------------------------------
QA_PROMPT_ID_PREFIX = "gsm8k_"
QA_CATEGORY, QA_DIFFICULTY = "gsm8k", "medium"
# the reference's own cuts; pass them to have them, the defaults here cut nothing
QA_FALLBACK_N = 200
PUBLIC_N = 2000
# ---------------------------------------------------------------------------


def with_ordinal(df: DataFrame) -> DataFrame:
    """``ord`` = dense position in (file, row) order, without a global sort.

    Parquet: ``_metadata.row_index`` within each file, offset by the row counts of the
    preceding files. Other file formats (JSON lines, text): a split's rows are read in
    order into one partition, so within a split ``monotonically_increasing_id`` minus its
    smallest value is the row's position; splits are ordered by (file, block start) and
    offset by the counts of the preceding splits. Either way the offset table has one row
    per file or split.
    """
    try:
        x = df.select("*", F.col("_metadata.file_path").alias("_f"), F.lit(0).cast("bigint").alias("_s"),
                      F.col("_metadata.row_index").alias("_r"))
        blocks = x.groupBy("_f", "_s").agg(F.count(F.lit(1)).alias("_n"), F.lit(0).cast("bigint").alias("_r0"))
    except AnalysisException:   # no row index for this format
        x = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"),
                      F.monotonically_increasing_id().alias("_r"))
        blocks = x.groupBy("_f", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_r0"))
    w = Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_f", "_s", "_off", "_r0")
    return x.join(offsets, ["_f", "_s"]).withColumn("ord", (F.col("_off") + F.col("_r") - F.col("_r0")).cast("bigint")) \
        .drop("_f", "_s", "_r", "_off", "_r0")


def _found(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The DataFrame of ``read``, or None if its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_prompts(spark: SparkSession, path: str, fmt: str = "json_array") -> DataFrame:
    """Prompt records: ``json_array`` (the reference's seed file), ``json_lines`` or
    ``parquet``; missing keys are NULL; ``ord`` is the record's position in input order."""
    if fmt == "parquet":
        return with_ordinal(spark.read.parquet(path))
    if fmt == "json_array":
        return read_json_array(spark, path, PROMPTS_SCHEMA)
    if fmt == "json_lines":
        return with_ordinal(spark.read.schema(PROMPTS_SCHEMA).option("mode", "FAILFAST").json(path))
    raise ValueError(f"unknown format {fmt!r}")


def prompts_from_qa(qa: DataFrame, n: int | None = None, order: str = "ord") -> DataFrame:
    """Fallback prompts from a Q/A set: ``id = gsm8k_{i}`` (0-based), category
    'gsm8k', difficulty 'medium'; with ``n`` the first n rows by ``order`` (the reference
    takes ``QA_FALLBACK_N``), else all rows, numbered by ``order`` as it is (dense)."""
    if n is None:
        number = F.col(order).cast("bigint")
    else:
        qa = head_by_ordinal(qa, n, order)
        number = (F.row_number().over(Window.orderBy(order)) - 1).cast("bigint")  # over at most n rows
    return qa.select(
        number.alias("ord"),
        F.concat(F.lit(QA_PROMPT_ID_PREFIX), number.cast("string")).alias("id"),
        F.col("question").alias("prompt"),
        F.lit(QA_CATEGORY).alias("category"), F.lit(QA_DIFFICULTY).alias("difficulty"),
    )


def head_by_ordinal(df: DataFrame, n: int, order: str = "ord", dense: bool = False) -> DataFrame:
    """S3: ``train[:n]``. With a dense 0-based ordinal (what the readers attach) this is
    the filter ``ord < n``: no sort, no gathering, pushed into the scan when ``ord`` is
    stored. Otherwise a top-n by ``order`` (TakeOrderedAndProject: each task keeps its
    n smallest rows, no global sort)."""
    if dense:
        return df.where(F.col(order) < F.lit(n))
    return df.orderBy(order).limit(n)


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A saved directory (``parquet``, optionally in split folders), ``json_lines``, a
    ``json_array`` file (read in splits, with ``ord``), or a catalog ``table``."""
    if fmt == "table":
        return spark.read.table(path)
    if fmt == "json_array":
        return read_json_array(spark, path)
    if fmt == "json_lines":
        return with_ordinal(spark.read.option("mode", "FAILFAST").json(path))
    if fmt != "parquet":
        raise ValueError(f"unknown format {fmt!r}")
    return spark.read.parquet(path)


def read_sft_source(spark: SparkSession, processed: str, raw: str, raw_fmt: str = "parquet") -> DataFrame:
    """The processed SFT directory if it exists, else the raw Q/A set."""
    found = _found(lambda: read_dataset(spark, processed))
    return read_dataset(spark, raw, raw_fmt) if found is None else found


def read_preference_source(spark: SparkSession, processed: str | None, pairs: str | None, public: str | None = None,
                           public_n: int | None = None, public_fmt: str = "parquet") -> DataFrame:
    """First of: processed split set, raw pair directory, public preference set
    (columns renamed by P12; with ``public_n`` its first rows only, the reference takes
    ``PUBLIC_N``)."""
    from prefloom.operators.prep import rename_preference

    for p in (processed, pairs):
        if p and (found := _found(lambda: read_dataset(spark, p))) is not None:
            return found
    if public is None:
        raise FileNotFoundError("no preference source found")
    df = read_dataset(spark, public, public_fmt)
    if public_n is not None:
        df = head_by_ordinal(df if "ord" in df.columns else with_ordinal(df), public_n, dense=True)
    return rename_preference(df)


def read_train_logs(spark: SparkSession, glob: str) -> DataFrame:
    """``*/trainer_state.json`` files -> long table (method, step, metric, value);
    the method is the folder name (of a ``name=value`` folder its value). Absent files give an
    empty table. A metric that is not a number keeps its row with value NULL and its text in
    ``text``. ``log_history`` is read in splits, entry by entry: no row or task holds a run."""
    raw = _found(lambda: array_objects(spark, glob, "log_history"))
    if raw is None:
        return spark.createDataFrame([], "method string, step bigint, metric string, value double, text string")
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = decoded(F.element_at(F.split("file", "/"), -2))  # file paths are URIs, and values in folder names are escaped once more
    method = F.when(folder.contains("="), decoded(F.regexp_replace(folder, "^[^=]*=", ""))).otherwise(folder)
    record = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    x = raw.select(method.alias("method"), record.alias("rec"))
    x = x.select("method", F.col("rec")["step"].try_cast("double").cast("bigint").alias("step"), F.explode_outer("rec").alias("metric", "text"))
    # the parser quotes what is a number only by an extension
    x = x.withColumn("text", F.when(F.col("text").rlike('^"(NaN|[+-]?Infinity|[+-]?INF)"$'), F.btrim("text", F.lit('"'))).otherwise(F.col("text")))
    return x.where(F.col("metric") != "step").select("method", "step", "metric", F.col("text").try_cast("double").alias("value"), "text")


def read_beta_sweep(spark: SparkSession, path: str, fmt: str = "json_lines") -> DataFrame:
    """(beta DOUBLE, metrics MAP, status): every metric is kept. ``json_lines``: rows
    (beta, metrics, status) as :func:`prefloom.sources.sinks.write_beta_sweep` writes them;
    ``json_object``: the reference's file, one object keyed by the beta text."""
    if fmt == "json_lines":
        df = spark.read.schema(BETA_SWEEP_SCHEMA).option("mode", "FAILFAST").json(path)
    elif fmt == "json_object":
        raw = spark.read.text(path, wholetext=True)
        parsed = F.from_json("value", "MAP<STRING, STRUCT<metrics: MAP<STRING, STRING>, status: STRING>>", {"mode": "FAILFAST"})
        df = raw.select(F.explode(parsed).alias("beta", "r")).select(
            "beta", F.transform_values("r.metrics", lambda _, v: v.try_cast("double")).alias("metrics"), "r.status")
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return df.select(F.col("beta").cast("double").alias("beta"), "metrics", "status")


def beta_metrics(sweep: DataFrame) -> DataFrame:
    """The long form of :func:`read_beta_sweep`: (beta, metric, value, status)."""
    return sweep.select("beta", F.explode("metrics").alias("metric", "value"), "status")

"""S7-S10, S12, S13 sinks and the ``persist`` helper that cuts lineage by writing.

All paths are on the shared folder (``spark.checkpoint.dir`` or a caller-given
location): never a machine-local temporary folder on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.session import scratch_path


def persist(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as parquet and read it back: a retry or second action re-reads the
    files instead of recomputing (e.g. calling a model again)."""
    p = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(p)
    return df.sparkSession.read.schema(df.schema).parquet(p)  # schema given: works when empty


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A split table, one folder per split (partition pruning on ``split=``)."""
    w = df.write.mode(mode)
    (w.partitionBy("split") if "split" in df.columns else w).parquet(path)


def write_pairs_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines for inspection, UTF-8, non-ASCII kept, NULL fields kept."""
    write_rows(df, path, mode)


def write_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with NULL fields kept, in as many files as there are partitions."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_record(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row aggregate (stats, summary) as one JSON file."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_processing_stats(split_df: DataFrame, path: str) -> None:
    """S9 for L1: ``train_size``, ``val_size``, ``columns`` from one aggregate."""
    cols = [c for c in split_df.columns if c != "split"]
    s = split_df.agg(
        F.count_if(F.col("split") == "train").alias("train_size"),
        F.count_if(F.col("split") == "validation").alias("val_size"),
    ).withColumn("columns", F.array(*[F.lit(c) for c in cols]))
    write_record(s, path)


# the reference's own number of detail rows
EVAL_DETAIL = 50


def write_eval(metrics: DataFrame, results: DataFrame, path: str, detail: int | None = None,
               order=("model", "item_id", "sample_idx")) -> None:
    """The metrics and the result rows; with ``detail`` only the first rows by
    ``order`` (a total order; the reference keeps ``EVAL_DETAIL``)."""
    write_rows(metrics, f"{path.rstrip('/')}/metrics")
    rows = results if detail is None else results.orderBy(*[c for c in order if c in results.columns]).limit(detail)
    write_rows(rows, f"{path.rstrip('/')}/detailed_results")


def write_beta_sweep(results: DataFrame, path: str) -> None:
    """Rows ``(beta STRING, metrics MAP<STRING,DOUBLE>, status)``; β as text like the
    reference's JSON keys."""
    cols = [c for c in results.columns if c not in ("beta", "status")]
    m = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    out = results.select(F.col("beta").cast("string").alias("beta"), m.alias("metrics"),
                         F.coalesce(F.col("status"), F.lit("success")).alias("status")
                         if "status" in results.columns else F.lit("success").alias("status"))
    write_rows(out, path)


def write_generation_stats(stats: DataFrame, path: str) -> None:
    """The generation counters record (``total_prompts``, ``successful_pairs``, ...)."""
    write_record(stats, path)


def write_analysis_summary(summary: DataFrame, path: str) -> None:
    """The analysis summary record (values computed by G7, not hard-coded)."""
    write_record(summary, path)


def write_train_logs(logs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S11's files: one trainer state per method, ``path/method=<name>/``, from (method, step, metric,
    value) rows. A run is one JSON document, so one task writes it, row by row in the order of the
    steps (sorted with spilling); no row holds a run."""
    entry = F.to_json(F.map_concat(F.create_map(F.lit("step"), F.col("step").cast("double")), F.create_map("metric", "value")))
    rows = logs.select("method", "step", "metric", F.lit(1).alias("at"), F.concat(F.lit(","), entry).alias("value"))
    # the first entry follows an empty one, so that every other begins with its comma
    runs = logs.groupBy("method").agg(F.max("step").alias("last"))
    head = F.concat(F.lit('{"global_step": '), F.coalesce(F.col("last").cast("string"), F.lit("0")), F.lit(', "log_history": [{}'))
    heads = runs.select("method", F.lit(None).cast("bigint").alias("step"), F.lit(None).cast("string").alias("metric"), F.lit(0).alias("at"), head.alias("value"))
    tails = runs.select("method", F.lit(None).cast("bigint").alias("step"), F.lit(None).cast("string").alias("metric"), F.lit(2).alias("at"), F.lit("]}").alias("value"))
    rows = rows.withColumn("step", F.col("step").cast("bigint")).unionByName(heads).unionByName(tails)
    rows.repartition("method").sortWithinPartitions("method", "at", "step", "metric").select("method", "value").write.mode(mode).partitionBy("method").text(path)

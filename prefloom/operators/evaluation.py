"""Grading, metrics per model, pass@k and format quality.

Predictions and items meet in one equi-join on ``item_id`` (the planner picks
broadcast only if the item side passes its size check); metrics are one partial
aggregation per model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.functions.answers import answer_pattern, extract_answer, extract_ground_truth
from prefloom.functions.text import basename, has_reasoning, py_strip, word_count

# --- fixed values -----------------------------------------------------------
ERROR_RESPONSE_PREFIX = "ERROR: "
# ---------------------------------------------------------------------------


def grade(predictions: DataFrame, items: DataFrame, numeric: bool = False) -> DataFrame:
    """E3+E4: results rows ``model, item_id, sample_idx, question, ground_truth, predicted,
    response, correct``. Exact match of the *stripped strings* (``numeric=True`` compares decimals);
    a failed generation is incorrect, with predicted NULL and response ``ERROR: ...``."""
    it = items.select("item_id", "question", extract_ground_truth("answer").alias("ground_truth"))
    p = predictions.join(it, "item_id", "inner")
    failed = F.col("error").isNotNull()
    predicted = F.when(~failed, extract_answer(F.coalesce(F.col("response"), F.lit(""))))
    response = F.when(failed, F.concat(F.lit(ERROR_RESPONSE_PREFIX), F.col("error"))).otherwise(F.col("response"))
    if numeric:
        same = predicted.try_cast("decimal(38,10)") == F.col("ground_truth").try_cast("decimal(38,10)")
    else:
        same = py_strip(predicted) == py_strip(F.col("ground_truth"))
    return p.select("model", "item_id", "sample_idx", "question", "ground_truth",
                    predicted.alias("predicted"), response.alias("response"),
                    F.coalesce(same, F.lit(False)).alias("correct"))


def eval_metrics(results: DataFrame, by=("model",)) -> DataFrame:
    """E5: accuracy, correct, total, mean words per response, reasoning ratio; errors
    count in every denominator and their text in the length/reasoning metrics."""
    total = F.count(F.lit(1))
    return results.groupBy(*by).agg(
        F.count_if("correct").alias("correct"),
        total.alias("total"),
        F.avg(word_count("response")).alias("_len"),
        F.count_if(has_reasoning("response")).alias("_reason"),
    ).select(
        *by,
        F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0).alias("accuracy"),
        "correct", "total",
        F.coalesce(F.col("_len"), F.lit(0.0)).alias("avg_response_length"),
        F.when(F.col("total") > 0, F.col("_reason") / F.col("total")).otherwise(0.0).alias("reasoning_ratio"),
    )


def compare_models(results: DataFrame, path_col: str = "model_path") -> DataFrame:
    """Metrics per model path, shown by base name; every model keeps its row."""
    m = eval_metrics(results, by=(path_col,))
    return m.withColumn("model_name", basename(path_col))


def pass_at_k(results: DataFrame, ks=(1, 2, 5), item: str = "item_id") -> DataFrame:
    """Unbiased pass@k per item, ``1 - prod_{i=n-c+1..n} (1 - k/i)``, averaged over
    items with ``n >= k``; items with fewer samples are counted, not scored."""
    per_item = results.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"))
    kk = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    x = per_item.select(item, "n", "c", kk)
    n, c, k = F.col("n"), F.col("c"), F.col("k")
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - k / i))
    est = F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - prod)
    return x.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(n >= k).alias("n_scored"),
        F.avg(F.when(n >= k, est)).alias("pass_at_k"),
    )


def format_quality(results: DataFrame, by=("model",)) -> DataFrame:
    """Share with a parsed answer, hits per answer pattern, reasoning and error shares."""
    pat = F.when(F.col("predicted").isNotNull(), answer_pattern(F.col("response")))
    errs = F.col("response").startswith(ERROR_RESPONSE_PREFIX) & F.col("predicted").isNull()
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg(F.col("predicted").isNotNull().cast("double")).alias("parsed_share")]
    aggs += [F.count_if(pat == i).alias(f"pattern_{i}") for i in range(1, 6)]
    aggs += [F.avg(has_reasoning("response").cast("double")).alias("reasoning_share"),
             F.avg(errs.cast("double")).alias("error_share")]
    return results.groupBy(*by).agg(*aggs)

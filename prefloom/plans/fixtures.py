"""Stage inputs derived from the test tables (the rules of FIXTURES.md §2).

Each view is written the same way here and as a CTE in :mod:`prefloom.plans.oracle`.
All of them are projections, filters, equi-joins or partial aggregations over the
whole tables, so their work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions.judge import with_judge_scores

# --- fixed values (fixture rules) --------------------------------------------
METHOD_BY_EVENT = {"view": "sft", "click": "dpo", "purchase": "ppo"}
RUN_METRICS = ["train_loss", "eval_accuracy", "rewards_chosen", "rewards_rejected"]  # by user_id % 4
BETAS = [0.05, 0.1, 0.2, 0.5]                                                     # by user_id % 4
BETA_METRIC_BY_EVENT = {"view": "accuracy", "click": "diversity", "purchase": "mode_collapse_score",
                        "signup": "train_loss"}
BETA_VALUE_SCALE = 500.0
PREDICTION_ERROR = "generation timed out"
# ---------------------------------------------------------------------------


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is inferred once per path (the inference is a Spark job)
    and given explicitly on later reads."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _case(col: str, mapping: dict) -> F.Column:
    out = None
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, F.lit(v)) if out is None else out.when(F.col(col) == k, F.lit(v))
    return out


def _by_index(idx: F.Column, values: list) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


# --- documents -----------------------------------------------------------------

def documents(spark, d) -> DataFrame:
    """documents with the ordinal ``ord = doc_id``."""
    return table(spark, d, "documents").withColumn("ord", F.col("doc_id"))


def doc_pairs(spark, d) -> DataFrame:
    """A pair per document: its first line as the prompt, its text as chosen, the text of the
    document with the next id as rejected (NULL for the last)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("rejected"))
    return docs.join(other, "doc_id", "left").select(
        F.col("doc_id").alias("prompt_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("prompt"),
        F.col("text").alias("chosen"), "rejected")


def doc_candidates(spark, d) -> DataFrame:
    """Quality pairs input: documents joined with labels; one prompt per (lang, source);
    the document is the candidate, ``score = quality * 10``."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "inner").select(
        F.concat_ws(":", "lang", "source").alias("prompt_id"),
        F.concat(F.lit("Write a text in "), F.col("lang"), F.lit(" like those from "), F.col("source")).alias("prompt"),
        F.col("doc_id").cast("bigint").alias("cand_idx"),
        F.col("text").alias("response"),
        (F.col("quality") * 10.0).cast("double").alias("score"),
        F.lit("").alias("reason"),
    )


# --- conversations ---------------------------------------------------------------

def prompts(spark, d) -> DataFrame:
    """First user turn per conversation; ``id = conv_id``, ``ord = conv_id``."""
    c = table(spark, d, "conversations").where(F.col("role") == "user")
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt")).select(
        F.col("conv_id").cast("bigint").alias("ord"),
        F.col("conv_id").cast("string").alias("id"),
        "prompt",
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("difficulty"),
    )


def candidates(spark, d) -> DataFrame:
    """Assistant turns as candidates: ``prompt_id = conv_id``, ``cand_idx = turn``."""
    c = table(spark, d, "conversations").where(F.col("role") == "assistant").select(
        F.col("conv_id").cast("bigint").alias("prompt_id"),
        F.col("turn").cast("int").alias("cand_idx"),
        F.col("text").alias("response"),
    )
    p = prompts(spark, d).select(F.col("ord").alias("prompt_id"), "prompt")
    return c.join(p, "prompt_id", "left").select("prompt_id", "prompt", "cand_idx", "response")


def judge_text_rule(prompt_id: F.Column, cand_idx: F.Column) -> F.Column:
    """Raw judge output: k = (conv_id*7 + turn*5) % 11, written in one of four forms by
    turn % 4: JSON number, JSON text, prose, malformed JSON (single quotes)."""
    k = ((prompt_id * 7 + cand_idx * 5) % 11).cast("string")
    form = cand_idx % 4
    return (
        F.when(form == 0, F.concat(F.lit('{"score": '), k, F.lit(', "reason": "json number"}')))
        .when(form == 1, F.concat(F.lit('{"score": "'), k, F.lit('", "reason": "json text"}')))
        .when(form == 2, F.concat(F.lit("Score: "), k, F.lit(" out of 10")))
        .otherwise(F.concat(F.lit("{'score': "), k, F.lit("}")))
    )


def judge_raw(spark, d) -> DataFrame:
    c = candidates(spark, d)
    return c.select("prompt_id", "cand_idx",
                    judge_text_rule(F.col("prompt_id"), F.col("cand_idx")).alias("judge_text"),
                    F.lit(None).cast("string").alias("error"))


def scored(spark, d) -> DataFrame:
    """Candidates with parsed judge scores (C3 result rule over the raw judge text)."""
    c = candidates(spark, d).withColumn("judge_text", judge_text_rule(F.col("prompt_id"), F.col("cand_idx")))
    return with_judge_scores(c, "judge_text", response="response").select(
        "prompt_id", "prompt", "cand_idx", "response", "score", "reason")


def reward_input(spark, d) -> DataFrame:
    """PPO-style logged batches: assistant replies, ``batch = conv_id div 4``, epoch 0."""
    c = candidates(spark, d)
    return c.select(
        F.lit(0).alias("epoch"),
        F.floor(F.col("prompt_id") / 4).cast("bigint").alias("batch"),
        "prompt_id", "cand_idx",
        F.coalesce(F.col("prompt"), F.lit("")).alias("query"),
        "response",
    )


# --- orders: Q/A items and predictions ---------------------------------------------

def qa_items(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("bigint").alias("item_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("question"),
        F.concat(F.lit("Work.\n#### "), F.col("o_custkey").cast("string")).alias("answer"),
    )


def predictions(spark, d) -> DataFrame:
    """One prediction per order: model = priority, form by ``o_orderkey % 6``."""
    o = table(spark, d, "orders")
    c = F.col("o_custkey").cast("string")
    form = F.col("o_orderkey") % 6
    response = (
        F.when(form == 0, F.concat(F.lit("Step 1. The answer is: "), c))
        .when(form == 1, F.concat(F.lit("The answer is: "), c, F.lit(".")))
        .when(form == 2, F.concat(F.lit("#### "), c))
        .when(form == 3, F.concat(F.lit("x = "), c))
        .when(form == 4, F.lit("no idea"))
    )
    return o.select(
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderkey").cast("bigint").alias("item_id"),
        F.lit(0).alias("sample_idx"),
        response.alias("response"),
        F.when(form == 5, F.lit(PREDICTION_ERROR)).alias("error"),
    )


# --- events: run logs, beta sweep ----------------------------------------------------

def event_method() -> F.Column:
    return F.coalesce(_case("event_type", METHOD_BY_EVENT), F.col("event_type"))


def run_logs(spark, d) -> DataFrame:
    """(method, step, metric, value): method by event type (types without one are methods of their
    own), step = props.k, metric by user_id % 4."""
    return table(spark, d, "events").select(
        event_method().alias("method"),
        F.get_json_object("props", "$.k").cast("bigint").alias("step"),
        _by_index(F.col("user_id") % 4, RUN_METRICS).alias("metric"),
        F.col("value").cast("double").alias("value"),
    )


def beta_runs(spark, d) -> DataFrame:
    """(beta, metric, value, status): one logged evaluation per event; beta by user_id % 4;
    error events are failed runs."""
    e = table(spark, d, "events")
    return e.select(
        _by_index(F.col("user_id") % 4, BETAS).alias("beta"),
        _case("event_type", BETA_METRIC_BY_EVENT).alias("metric"),
        (F.col("value") / BETA_VALUE_SCALE).alias("value"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), F.col("props")))
        .otherwise(F.lit("success")).alias("status"),
    )


def beta_results(spark, d) -> DataFrame:
    """beta -> accuracy, diversity, mode_collapse_score, train_loss (means of the logs)."""
    r = beta_runs(spark, d).where(F.col("metric").isNotNull())
    metrics = ["accuracy", "diversity", "mode_collapse_score", "train_loss"]
    return r.groupBy("beta").pivot("metric", metrics).agg(F.avg("value"))


def method_resources(spark, d) -> DataFrame:
    """Per method: peak memory (GB), training minutes and final accuracy from the logs."""
    return table(spark, d, "events").groupBy(event_method().alias("method")).agg(
        (F.max("value") / 25.0).alias("memory_gb"),
        F.count_distinct(F.get_json_object("props", "$.k")).cast("bigint").alias("training_time_min"),
        (F.avg("value") / BETA_VALUE_SCALE).alias("final_accuracy"),
    )


# --- lineitem: inference runs and logged log-probs ------------------------------------

def infer_runs(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    bs = F.expr("shiftleft(1, CAST(l_linenumber % 4 AS INT))")
    model_mem = ((F.lit(3000) + F.col("l_suppkey") % 1000) * F.lit(1048576)).cast("bigint")
    return li.select(
        F.concat(F.lit("m-"), F.col("l_returnflag"), F.col("l_linestatus")).alias("model"),
        bs.alias("batch_size"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("run"),
        (F.col("l_extendedprice") / 10000.0).alias("latency_sec"),
        (F.col("l_partkey") % 200 + 1).cast("bigint").alias("prompt_tokens"),
        (F.col("l_quantity") * 10).cast("bigint").alias("generated_tokens"),
        model_mem.alias("model_mem_bytes"),
        (model_mem + (F.col("l_discount") * 100).cast("bigint") * F.lit(268435456)).cast("bigint").alias("peak_mem_bytes"),
        F.when((bs == 8) & (F.col("l_returnflag") == "R"), F.lit("OOM")).otherwise(F.lit("success")).alias("status"),
    )


def model_shapes(spark, d) -> DataFrame:
    """One config row per model seen in the runs (bounded by the number of models)."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    return li.select(
        F.concat(F.lit("m-"), F.col("l_returnflag"), F.col("l_linestatus")).alias("model"),
        F.lit(24).alias("num_hidden_layers"),
        F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 4).otherwise(16)
        .alias("num_key_value_heads"),
        F.lit(16).alias("num_attention_heads"),
        F.lit(1536).alias("hidden_size"),
    )


def logged_logps(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("pair_id"),
        (-F.col("l_quantity") / 10.0).alias("policy_chosen"),
        (-F.col("l_extendedprice") / 10000.0).alias("policy_rejected"),
        (-F.col("l_tax") * 100.0).alias("ref_chosen"),
        (-F.col("l_discount") * 100.0).alias("ref_rejected"),
    )

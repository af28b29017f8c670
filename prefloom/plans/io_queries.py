"""Queries over sources and sinks, and the generation pipeline (S1, S4-S7, S9-S13, F4, R5):
each writes its input from a test table, in parallel and under the shared folder, and
reads it back through the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.functions.answers import answer_pattern, extract_answer, extract_ground_truth
from prefloom.functions.judge import with_judge_scores
from prefloom.operators import evaluation as ev
from prefloom.operators import prep
from prefloom.operators import runs as G
from prefloom.operators.split import stratified_split, train_val_split
from prefloom.plans import fixtures as FX
from prefloom.plans import oracle as O
from prefloom.plans import pipelines as L
from prefloom.plans.extra_queries import demo_judge
from prefloom.plans.registry import ORACLE, _pairs_sql, _split_sql, query, rounded
from prefloom.session import scratch_path
from prefloom.sources import readers, sinks


# --- sources -----------------------------------------------------------------------

@query("read_prompts", O.with_views("prompts_v") + """
SELECT count(*) AS rows, count(*) AS ordinals, CAST(count(*) - 1 AS BIGINT) AS last, count(DISTINCT id) AS ids,
       CAST(sum(length(prompt)) AS BIGINT) AS chars FROM prompts_v""")
def q_read_prompts(spark, d):
    path = scratch_path(spark, "prompts")
    sinks.write_rows(FX.prompts(spark, d).select("id", "prompt", "category", "difficulty"), path)
    p = readers.read_prompts(spark, path, fmt="json_lines")
    return p.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ord").alias("ordinals"), F.max("ord").alias("last"),
                 F.count_distinct("id").alias("ids"), F.sum(F.length("prompt")).alias("chars"))


def _write_array(rows, path: str) -> None:
    """``rows`` as one JSON array per file, without line breaks between the objects: the objects as
    lines of a comma-separated text, in a file per partition."""
    from pyspark.sql import Window

    part = F.spark_partition_id()
    lines = rows.select(part.alias("p"), F.monotonically_increasing_id().alias("i"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines = sinks.persist(lines, "array-lines")  # partition and number are fixed from here on
    ends = lines.groupBy("p").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    x = lines.join(ends, "p").select("p", "i", F.concat(F.when(F.col("i") == F.col("lo"), "[").otherwise(","), "value", F.when(F.col("i") == F.col("hi"), "]").otherwise("")).alias("value"))
    x.repartition("p").sortWithinPartitions("p", "i").select("p", "value").write.partitionBy("p").option("lineSep", " ").text(path)


@query("read_prompts_array", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS ordinals, CAST(count(*) - 1 AS BIGINT) AS last, CAST(sum(length(text)) AS BIGINT) AS chars,
       CAST(sum(length(text) - length(replace(replace(replace(text, '}', ''), '[', ''), chr(34), ''))) AS BIGINT) AS marks FROM documents""")
def q_read_prompts_array(spark, d):
    """S1, array form: whole documents as prompts, with brackets and quotes inside their strings."""
    path = scratch_path(spark, "prompt-arrays")
    docs = FX.documents(spark, d)
    _write_array(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("prompt"), F.col("lang").alias("category")), path)
    p = readers.read_prompts(spark, f"{path}/*", fmt="json_array")
    marks = F.length("prompt") - F.length(F.translate("prompt", '}["', ""))
    return p.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ord").alias("ordinals"), F.max("ord").alias("last"),
                 F.sum(F.length("prompt")).alias("chars"), F.sum(marks).alias("marks"))


@query("dataset_roundtrip", ORACLE["split_exact"])
def q_dataset_roundtrip(spark, d):
    """S7 (a folder per split), then S4."""
    path = scratch_path(spark, "dataset")
    sinks.write_dataset(train_val_split(FX.documents(spark, d), ratio=0.1, seed=42, key="ord").select("doc_id", "split"), path)
    return readers.read_dataset(spark, path).select("doc_id", "split")


@query("read_sft_source", O.with_views("qa_items_v") + "SELECT item_id, question, answer FROM qa_items_v")
def q_read_sft_source(spark, d):
    """No processed set, so the raw one."""
    raw = scratch_path(spark, "sft-raw")
    FX.qa_items(spark, d).write.parquet(raw)
    return readers.read_sft_source(spark, scratch_path(spark, "sft-none"), raw).select("item_id", "question", "answer")


@query("read_preference_source", """
SELECT split_part(a.text, chr(10), 1) AS prompt, a.text AS chosen, b.text AS rejected
FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1""")
def q_read_preference_source(spark, d):
    """Neither a processed set nor raw pairs, so the public set with its names changed."""
    public = scratch_path(spark, "public")
    FX.doc_pairs(spark, d).withColumnRenamed("prompt", "instruction").write.parquet(public)
    return readers.read_preference_source(spark, scratch_path(spark, "none"), scratch_path(spark, "none"), public)


@query("read_train_logs", O.with_views("run_logs_v") + """
SELECT method, step, metric, round(avg(value), 9) AS value FROM run_logs_v GROUP BY method, step, metric""", digits=9)
def q_read_train_logs(spark, d):
    """One trainer state per method, the mean of each metric at each step (as many
    entries as there are steps), read back from the folder names."""
    base = scratch_path(spark, "logs")
    sinks.write_train_logs(FX.run_logs(spark, d).groupBy("method", "step", "metric").agg(F.avg("value").alias("value")), base)
    return readers.read_train_logs(spark, f"{base}/*/*.txt").select("method", "step", "metric", "value")


@query("read_train_logs_entries", O.with_views("run_logs_v") + """
SELECT method, metric, count(*) AS entries, count(DISTINCT step) AS steps, CAST(min(step) AS BIGINT) AS first, CAST(max(step) AS BIGINT) AS last FROM run_logs_v GROUP BY method, metric""")
def q_read_train_logs_entries(spark, d):
    """S11 over runs with one entry per event: as long as the table."""
    base = scratch_path(spark, "long-logs")
    sinks.write_train_logs(FX.run_logs(spark, d), base)
    logs = readers.read_train_logs(spark, f"{base}/*/*.txt")
    return logs.groupBy("method", "metric").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("step").alias("steps"), F.min("step").alias("first"), F.max("step").alias("last"))


@query("beta_sweep_roundtrip", O.with_views("beta_results_v") + """
SELECT beta, metric, round(value, 9) AS value, 'success' AS status FROM
  (UNPIVOT beta_results_v ON accuracy, diversity, mode_collapse_score, train_loss INTO NAME metric VALUE value) u""", digits=9)
def q_beta_sweep_roundtrip(spark, d):
    """S12."""
    path = scratch_path(spark, "beta")
    sinks.write_beta_sweep(FX.beta_results(spark, d), path)
    return readers.beta_metrics(readers.read_beta_sweep(spark, path))


@query("require_columns", O.with_views("qa_items_v") + "SELECT item_id, question FROM qa_items_v")
def q_require_columns(spark, d):
    """the table passes; a missing column would stop the plan."""
    return prep.require_columns(FX.qa_items(spark, d), ["item_id", "question"]).select("item_id", "question")


# --- sinks ---------------------------------------------------------------------------

@query("processing_stats", f"""
SELECT CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS train_size,
       CAST(count(*) FILTER (WHERE split = 'validation') AS BIGINT) AS val_size, 'doc_id' AS columns FROM ({ORACLE['split_exact']}) s""")
def q_processing_stats(spark, d):
    """S9."""
    path = scratch_path(spark, "stats")
    sinks.write_processing_stats(train_val_split(FX.documents(spark, d), ratio=0.1, seed=42, key="ord").select("doc_id", "split"), path)
    return spark.read.json(path).select("train_size", "val_size", F.array_join("columns", ",").alias("columns"))


@query("generation_stats_record", ORACLE["generation_stats"])
def q_generation_stats_record(spark, d):
    """The generation counters."""
    from prefloom.plans.registry import QUERIES

    path = scratch_path(spark, "generation-stats")
    stats = QUERIES["generation_stats"](spark, d)
    sinks.write_generation_stats(stats, path)
    return spark.read.schema(stats.schema).json(path)


@query("eval_files", ORACLE["eval_metrics"])
def q_eval_files(spark, d):
    """The metrics of the written evaluation (its detail rows hold every result)."""
    path = scratch_path(spark, "eval")
    results = sinks.persist(ev.grade(FX.predictions(spark, d), FX.qa_items(spark, d)), "results")
    metrics = ev.eval_metrics(results)
    sinks.write_eval(metrics, results, path)
    back = spark.read.schema(results.schema).json(f"{path}/detailed_results")
    return rounded(ev.eval_metrics(back), 9)


@query("analysis_summary_record", ORACLE["analysis_summary"])
def q_analysis_summary_record(spark, d):
    """S13."""
    path = scratch_path(spark, "summary")
    summary = G.analysis_summary(FX.method_resources(spark, d), FX.beta_results(spark, d))
    sinks.write_analysis_summary(summary, path)
    return rounded(spark.read.schema(summary.schema).json(path), 9)


# --- splits over NULLs ------------------------------------------------------------------

@query("split_stratified_nulls", ORACLE["split_stratified"].replace("a.lang = d.lang", "a.lang IS NOT DISTINCT FROM d.lang")
       .replace("ORDER BY rem DESC, lang ASC", "ORDER BY rem DESC, lang ASC NULLS FIRST")
       .replace("documents_v d JOIN", "docs_n d JOIN").replace("FROM documents_v GROUP BY", "FROM docs_n GROUP BY")
       .replace("SELECT doc_id, lang, CASE", ", docs_n AS (SELECT * REPLACE (nullif(lang, 'en') AS lang) FROM documents_v) SELECT doc_id, lang, CASE", 1))
def q_split_stratified_nulls(spark, d):
    docs = FX.documents(spark, d).withColumn("lang", F.nullif("lang", F.lit("en")))
    return stratified_split(docs, by="lang", ratio=0.1, seed=42, key="ord").select("doc_id", "lang", "split")


@query("split_null_keys", O.with_views("documents_v") + """
SELECT 'validation' AS split, CAST(ceil(count(*) * 0.1::DOUBLE) AS BIGINT) AS rows FROM documents_v
UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.1::DOUBLE) AS BIGINT) FROM documents_v""")
def q_split_null_keys(spark, d):
    """Every tenth key is NULL: no row is lost, and the sizes stay exact."""
    docs = FX.documents(spark, d).withColumn("ord", F.when(F.col("ord") % 10 != 0, F.col("ord")))
    return train_val_split(docs, ratio=0.1, seed=42, key="ord").groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


# --- answers and judgements in every form -------------------------------------------------

_FORMS = ["The answer is: {}", "the answer is {} apples", "#### {}", "Answer: -{}", "total = {}", "so it costs {}", "Answers {},000", "x = +{},5 ", "no number here"]


@query("extract_answer_forms", f"""
SELECT o_orderkey AS item_id, {O.extract_answer('t')} AS answer, {O.answer_pattern('t')} AS pattern FROM (
  SELECT o_orderkey, CASE o_orderkey % 9 {" ".join(f"WHEN {i} THEN replace('{f}', '{{}}', CAST(o_custkey AS VARCHAR))" for i, f in enumerate(_FORMS))} END AS t FROM orders) x""")
def q_extract_answer_forms(spark, d):
    """E1 and E10's pattern number over texts that reach all five patterns."""
    o = FX.table(spark, d, "orders")
    text = F.lit(None).cast("string")
    for i, f in enumerate(_FORMS):
        text = F.when(F.col("o_orderkey") % 9 == i, F.replace(F.lit(f), F.lit("{}"), F.col("o_custkey").cast("string"))).otherwise(text)
    t = o.select(F.col("o_orderkey").alias("item_id"), text.alias("t"))
    return t.select("item_id", extract_answer("t").alias("answer"), answer_pattern("t").alias("pattern"))


@query("extract_answer_conversations", f"""
SELECT conv_id, turn, {O.extract_answer('text')} AS answer, {O.ground_truth('text')} AS ground_truth FROM conversations""")
def q_extract_answer_conversations(spark, d):
    """E1 and E2 over every turn of every conversation."""
    c = FX.table(spark, d, "conversations")
    return c.select("conv_id", "turn", extract_answer("text").alias("answer"), extract_ground_truth("text").alias("ground_truth"))


_VERDICTS = ['{"score": 7, "reason": null}', '{"score": "8"}', '{"score": true, "reason": "yes"}', '{"score": null}', '{"score": [1]}', 'Score 3.5 of 10', '{"score": "8/10"}',
             'nothing', 'text {"score": 99, "reason": "high"} more', '{"score": -4}', '']


@query("judge_parse_forms", O.judge_select(f"""(SELECT o_orderkey AS item_id, CASE o_orderkey % 11 {" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_VERDICTS))} END AS t FROM orders) v""", "item_id"))
def q_judge_parse_forms(spark, d):
    """C4 over JSON numbers, strings, booleans, null, arrays, prose, fractions and nothing."""
    o = FX.table(spark, d, "orders")
    text = F.lit(None).cast("string")
    for i, v in enumerate(_VERDICTS):
        text = F.when(F.col("o_orderkey") % 11 == i, F.lit(v)).otherwise(text)
    return with_judge_scores(o.select(F.col("o_orderkey").alias("item_id"), text.alias("t")), "t").select("item_id", "score", "reason")


# --- R5 -----------------------------------------------------------------------------------

def sometimes_failing(prompts: list[str]) -> list[str]:
    """A generator that refuses prompts whose length is a multiple of seven."""
    if any(len(p) % 7 == 0 for p in prompts):
        raise RuntimeError("refused")
    return [f"Step 1. Count the characters. The answer is: {len(p)}" for p in prompts]


_R5_CANDIDATES = """SELECT *, 'Step 1. Count the characters. The answer is: ' || CAST(length(prompt) AS VARCHAR) AS response FROM prompts_v WHERE length(prompt) % 7 <> 0"""


def _r5(spark, d):
    return L.preference_pipeline(FX.prompts(spark, d), sometimes_failing, demo_judge, num_candidates=2, min_gap=0.0)


@query("preference_pipeline", O.with_views("prompts_v") + f"""
SELECT prompt, response AS chosen, response AS rejected, CAST(length(response) % 11 AS DOUBLE) AS chosen_score,
  CAST(length(response) % 11 AS DOUBLE) AS rejected_score, 0.0::DOUBLE AS score_gap, 'length rule' AS chosen_reason,
  'length rule' AS rejected_reason, id, coalesce(category, 'unknown') AS category FROM ({_R5_CANDIDATES}) c""")
def q_preference_pipeline(spark, d):
    """R5 pairs: two equal candidates a prompt, a gap of 0 kept, refused prompts without one."""
    return _r5(spark, d)[0]


@query("preference_pipeline_stats", O.with_views("prompts_v") + """
SELECT count(*) AS total_prompts, count(*) FILTER (WHERE length(prompt) % 7 <> 0) AS successful_pairs, CAST(0 AS BIGINT) AS skipped_low_gap,
  CAST(0 AS BIGINT) AS skipped_too_few, count(*) FILTER (WHERE length(prompt) % 7 = 0) AS errors,
  round(count(*) FILTER (WHERE length(prompt) % 7 <> 0) / greatest(count(*), 1) * 100.0, 6) AS success_rate FROM prompts_v""", digits=6)
def q_preference_pipeline_stats(spark, d):
    """R5 counters, with the failures of the generator counted."""
    return _r5(spark, d)[1]


# R5 with candidates that differ: every counter is reached

def varied(prompts: list[str], which: list[int]) -> list[str]:
    """A generator whose three candidates differ by number; some are blank, some prompts refused."""
    if any(len(p) % 7 == 0 for p in prompts):
        raise RuntimeError("refused")

    def one(p: str, k: int) -> str:
        n = len(p)
        if k == 0:
            return f"Step 1. Count the characters. The answer is: {n}"
        if k == 1:
            return "" if n % 5 == 0 else f"About {n * 3} characters"
        return "no idea" if n % 2 and n % 5 else " "

    return [one(p, k) for p, k in zip(prompts, which, strict=True)]


def strict_judge(prompts: list[str], responses: list[str]) -> list[str]:
    """A judge that scores by both lengths and gives up on some answers."""
    if any(len(p) % 3 == 0 and r.startswith("About") for p, r in zip(prompts, responses, strict=True)):
        raise RuntimeError("no verdict")
    return [f'{{"score": {(len(p) + 3 * len(r)) % 11}, "reason": "both lengths"}}' for p, r in zip(prompts, responses, strict=True)]


_VARIED = ("varied_v", """SELECT ord AS prompt_id, prompt, k AS cand_idx, response,
  CASE WHEN length(prompt) % 3 = 0 AND starts_with(response, 'About') THEN 0.0 ELSE CAST((length(prompt) + 3 * length(response)) % 11 AS DOUBLE) END AS score,
  CASE WHEN length(prompt) % 3 = 0 AND starts_with(response, 'About') THEN 'Judge error: no verdict' ELSE 'both lengths' END AS reason
FROM (SELECT *, CASE k WHEN 0 THEN 'Step 1. Count the characters. The answer is: ' || CAST(length(prompt) AS VARCHAR)
                       WHEN 1 THEN CASE WHEN length(prompt) % 5 = 0 THEN '' ELSE 'About ' || CAST(length(prompt) * 3 AS VARCHAR) || ' characters' END
                       ELSE CASE WHEN length(prompt) % 2 = 1 AND length(prompt) % 5 <> 0 THEN 'no idea' ELSE '' END END AS response
      FROM prompts_v, range(0, 3) t(k) WHERE length(prompt) % 7 <> 0) c""")


def _r5_varied(spark, d):
    return L.preference_pipeline(FX.prompts(spark, d), varied, strict_judge, num_candidates=3, min_gap=2.0, indexed=True, judge_failures=True)


@query("preference_pipeline_varied", O.with_views("prompts_v", extra=[_VARIED]) + f"""
SELECT x.* EXCLUDE (prompt_id), p.id, 'unknown' AS category FROM ({_pairs_sql('varied_v', 2.0)}) x JOIN prompts_v p ON p.ord = x.prompt_id""")
def q_preference_pipeline_varied(spark, d):
    """R5 pairs with chosen and rejected that differ."""
    return _r5_varied(spark, d)[0]


@query("preference_pipeline_varied_stats", O.with_views("prompts_v", extra=[_VARIED]) + f"""
SELECT count(*) AS total_prompts, count(*) FILTER (WHERE s = 'pair') AS successful_pairs, count(*) FILTER (WHERE s IN ('few', 'low')) AS skipped_low_gap,
  count(*) FILTER (WHERE s = 'few') AS skipped_too_few, count(*) FILTER (WHERE s = 'error') AS errors, CAST(sum(f) AS BIGINT) AS judge_failures,
  round(count(*) FILTER (WHERE s = 'pair') / greatest(count(*), 1) * 100.0, 6) AS success_rate
FROM (SELECT ord, CASE WHEN length(any_value(p.prompt)) % 7 = 0 THEN 'error' WHEN count(v.prompt_id) < 2 THEN 'few' WHEN max(score) - min(score) < 2.0 THEN 'low' ELSE 'pair' END AS s,
             count(*) FILTER (WHERE reason LIKE 'Judge error%') AS f
      FROM prompts_v p LEFT JOIN (SELECT * FROM varied_v WHERE NOT {O.blank('response')}) v ON v.prompt_id = p.ord GROUP BY ord) o""", digits=6)
def q_preference_pipeline_varied_stats(spark, d):
    """R5 counters, none of them zero: refused prompts, too few candidates, low gaps, judge failures."""
    return _r5_varied(spark, d)[1]


# --- S5 and S6, branch by branch ----------------------------------------------------------

@query("read_sft_processed", O.with_views("qa_items_v") + "SELECT item_id, split FROM (" + _split_sql("qa_items_v", "item_id", 0.1) + ") s")
def q_read_sft_processed(spark, d):
    """A processed set (a folder per split) is there, so the raw one is not read."""
    processed = scratch_path(spark, "sft-processed")
    sinks.write_dataset(L.process_sft_data(FX.qa_items(spark, d), key="item_id"), processed)
    return readers.read_sft_source(spark, processed, scratch_path(spark, "sft-none")).select("item_id", "split")


@query("read_preference_processed", ORACLE["process_preference"])
def q_read_preference_processed(spark, d):
    """S6, first branch: the processed set, written by L1, before raw pairs and public set."""
    processed, pairs = scratch_path(spark, "dpo-processed"), scratch_path(spark, "dpo-pairs")
    sinks.write_dataset(L.process_preference_data(FX.doc_pairs(spark, d), order="prompt_id", key="prompt_id"), processed)
    found = readers.read_preference_source(spark, processed, pairs, scratch_path(spark, "none"))
    return L.dpo_training_table(found).select("prompt_id", "prompt", "chosen", "rejected", "split")


@query("read_preference_pairs", ORACLE["build_pairs"])
def q_read_preference_pairs(spark, d):
    """S6, second branch: no processed set, so the raw pairs that R1 wrote."""
    from prefloom.plans.registry import QUERIES

    pairs = scratch_path(spark, "raw-pairs")
    QUERIES["build_pairs"](spark, d).write.parquet(pairs)
    return readers.read_preference_source(spark, scratch_path(spark, "none"), pairs, scratch_path(spark, "none"))

"""Every registered query: a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where
the semantics are SQL-expressible, the DuckDB statement that must give the same rows.

Queries read the whole test tables through the fixture views; nothing is sampled,
capped or filtered to make the check cheaper. Limits appear only where the limit
is the operator (``head``, ``prompts_from_qa``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.functions import templates as tpl
from prefloom.functions.answers import extract_answer, extract_ground_truth
from prefloom.functions.judge import with_judge_scores
from prefloom.functions.reward import heuristic_reward
from prefloom.functions.text import clean_text, has_reasoning, word_count
from prefloom.operators import evaluation as ev
from prefloom.operators import prep
from prefloom.operators import runs as G
from prefloom.operators.candidates import attach_scores, fan_out
from prefloom.operators.pairs import build_pairs, drop_blank_candidates, gap_filter, generation_stats, pair_outcomes
from prefloom.operators.rewards import batch_reward_stats, pairs_from_rewards, reward_terms
from prefloom.operators.split import split_stats, stratified_split, train_val_split
from prefloom.plans import fixtures as FX
from prefloom.plans import oracle as O
from prefloom.plans import pipelines as L
from prefloom.sources.readers import head_by_ordinal, prompts_from_qa

QUERIES: dict = {}
ORACLE: dict = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Double columns rounded, for the comparison by value; operators return full doubles."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, digits: int | None = None):
    def deco(fn):
        QUERIES[name] = fn if digits is None else lambda spark, d: rounded(fn(spark, d), digits)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _messages(df: DataFrame, keys: list[str], msgs) -> DataFrame:
    return df.select(*keys, F.posexplode(msgs).alias("msg_idx", "m")).select(
        *keys, F.col("msg_idx").cast("int").alias("msg_idx"), F.col("m.role").alias("role"),
        F.col("m.content").alias("content"))


def _msgs_sql(src: str, keys: str, parts: list[tuple[str, str]]) -> str:
    """UNION ALL of one SELECT per message (role literal, content expression)."""
    sel = [f"SELECT {keys}, {i} AS msg_idx, {O.lit(role)} AS role, {content} AS content FROM {src}"
           for i, (role, content) in enumerate(parts)]
    return "\nUNION ALL\n".join(sel)


def _pairs_sql(src: str, min_gap: float, key: str = "prompt_id") -> str:
    nb = f"(SELECT * FROM {src} WHERE NOT {O.blank('response')})"
    return f"""
SELECT b.{key}, b.prompt, b.response AS chosen, w.response AS rejected, b.score AS chosen_score,
       w.score AS rejected_score, b.score - w.score AS score_gap, b.reason AS chosen_reason,
       w.reason AS rejected_reason
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, cand_idx ASC) AS rb,
             count(*) OVER (PARTITION BY {key}) AS n FROM {nb}) b
JOIN (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score ASC, cand_idx DESC) AS rw FROM {nb}) w
  ON b.{key} = w.{key} AND b.rb = 1 AND w.rw = 1
WHERE b.n >= 2 AND b.score - w.score >= {float(min_gap)}"""


# === C / R: judge text -> preference pairs =========================================

@query("build_pairs", O.with_views("scored_v", "prompts_v") + f"""
SELECT x.*, coalesce(p.id, 'gen_' || CAST(p.ord + 1 AS VARCHAR)) AS id, coalesce(p.category, 'unknown') AS category
FROM ({_pairs_sql('scored_v', 2.0)}) x LEFT JOIN prompts_v p ON p.ord = x.prompt_id""")
def q_build_pairs(spark, d):
    pairs = build_pairs(FX.scored(spark, d), min_gap=2.0)
    ids = FX.prompts(spark, d).select(F.col("ord").alias("prompt_id"), "ord", "id", "category")
    return prep.default_identity(pairs.join(ids, "prompt_id", "left")).drop("ord")


@query("judge_parse", O.with_views("judge_raw_v") + O.judge_select(
    "(SELECT *, judge_text AS t FROM judge_raw_v)", "prompt_id, cand_idx"))
def q_judge_parse(spark, d):
    j = with_judge_scores(FX.judge_raw(spark, d), "judge_text")
    return j.select("prompt_id", "cand_idx", "score", "reason")


@query("attach_scores", O.with_views("candidates_v", "judge_raw_v") + f"""
SELECT c.prompt_id, c.cand_idx, c.response, j.score, j.reason
FROM candidates_v c JOIN ({O.judge_select("(SELECT *, judge_text AS t FROM judge_raw_v)", "prompt_id, cand_idx")}) j
  ON c.prompt_id = j.prompt_id AND c.cand_idx = j.cand_idx""")
def q_attach_scores(spark, d):
    scores = q_judge_parse(spark, d)
    c = FX.candidates(spark, d).select("prompt_id", "cand_idx", "response")
    return attach_scores(c, scores)


@query("drop_blank", O.with_views("candidates_v") + f"""
SELECT prompt_id, cand_idx, response FROM candidates_v WHERE NOT {O.blank('response')}""")
def q_drop_blank(spark, d):
    return drop_blank_candidates(FX.candidates(spark, d)).select("prompt_id", "cand_idx", "response")


@query("gap_filter", O.with_views("scored_v") + f"""
SELECT prompt_id, chosen_score, rejected_score, score_gap FROM ({_pairs_sql('scored_v', 0.0)}) x
WHERE score_gap >= 4.0""")
def q_gap_filter(spark, d):
    all_pairs = build_pairs(FX.scored(spark, d), min_gap=0.0)
    return gap_filter(all_pairs, 4.0).select("prompt_id", "chosen_score", "rejected_score", "score_gap")


_OUTCOMES_SQL = f"""
SELECT p.ord AS prompt_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_candidates,
  CASE WHEN coalesce(g.n, 0) < 2 THEN 'too_few' WHEN g.gap < 2.0 THEN 'low_gap' ELSE 'pair' END AS status
FROM prompts_v p LEFT JOIN (
  SELECT prompt_id, count(*) AS n, max(score) - min(score) AS gap
  FROM scored_v WHERE NOT {O.blank('response')} GROUP BY prompt_id) g ON g.prompt_id = p.ord"""


@query("pair_outcomes", O.with_views("prompts_v", "scored_v") + _OUTCOMES_SQL)
def q_pair_outcomes(spark, d):
    return pair_outcomes(FX.prompts(spark, d), FX.scored(spark, d), min_gap=2.0)


@query("generation_stats", O.with_views("prompts_v", "scored_v") + f"""
SELECT count(*) AS total_prompts, count(*) FILTER (WHERE status = 'pair') AS successful_pairs,
  count(*) FILTER (WHERE status IN ('too_few', 'low_gap')) AS skipped_low_gap,
  count(*) FILTER (WHERE status = 'too_few') AS skipped_too_few,
  count(*) FILTER (WHERE status = 'error') AS errors,
  round(count(*) FILTER (WHERE status = 'pair') / greatest(count(*), 1) * 100.0, 6) AS success_rate
FROM ({_OUTCOMES_SQL}) o""", digits=6)
def q_generation_stats(spark, d):
    return generation_stats(q_pair_outcomes(spark, d))


@query("fan_out", O.with_views("prompts_v") + """
SELECT ord AS prompt_id, CAST(i AS INTEGER) AS cand_idx FROM prompts_v, range(0, 4) t(i)""")
def q_fan_out(spark, d):
    return fan_out(FX.prompts(spark, d), 4).select("prompt_id", F.col("cand_idx").cast("int").alias("cand_idx"))


@query("generation_messages", O.with_views("prompts_v") + _msgs_sql(
    "prompts_v", "ord AS prompt_id", [("system", O.lit(tpl.GENERATION_SYSTEM)), ("user", "prompt")]))
def q_generation_messages(spark, d):
    p = FX.prompts(spark, d).withColumnRenamed("ord", "prompt_id")
    return _messages(p, ["prompt_id"], tpl.generation_messages(F.col("prompt")))


def _judge_user_sql(p: str, r: str) -> str:
    return (f"{O.lit(tpl.JUDGE_USER_HEAD)} || coalesce({p}, '') || {O.lit(tpl.JUDGE_USER_MID)} || "
            f"coalesce({r}, '') || {O.lit(tpl.JUDGE_USER_TAIL)}")


@query("judge_messages", O.with_views("candidates_v") + _msgs_sql(
    "candidates_v", "prompt_id, cand_idx",
    [("system", O.lit(tpl.JUDGE_SYSTEM)), ("user", _judge_user_sql("prompt", "response"))]))
def q_judge_messages(spark, d):
    c = FX.candidates(spark, d)
    return _messages(c, ["prompt_id", "cand_idx"], tpl.judge_messages(F.col("prompt"), F.col("response")))


@query("default_identity", O.with_views("prompts_v") + """
SELECT ord, 'gen_' || CAST(ord + 1 AS VARCHAR) AS id, coalesce(category, 'unknown') AS category FROM prompts_v""")
def q_default_identity(spark, d):
    p = FX.prompts(spark, d).drop("id")
    return prep.default_identity(p).select("ord", "id", "category")


# === documents: cleaning, dedup, filters, splits ==================================

@query("clean_text", O.with_views("documents_v") + f"SELECT doc_id, {O.clean('text')} AS text FROM documents_v")
def q_clean_text(spark, d):
    return FX.documents(spark, d).select("doc_id", clean_text("text").alias("text"))


_DEDUP_SQL = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY md5(lower({O.strip('text')})) ORDER BY ord) AS rn FROM documents_v
) WHERE rn = 1"""


@query("dedup", O.with_views("documents_v") + f"SELECT doc_id, lang, source FROM ({_DEDUP_SQL}) x")
def q_dedup(spark, d):
    return prep.deduplicate(FX.documents(spark, d), key="text", order="ord").select("doc_id", "lang", "source")


@query("length_filter", O.with_views("documents_v") + """
SELECT doc_id FROM documents_v WHERE length(text) BETWEEN 20 AND 2048""")
def q_length_filter(spark, d):
    return prep.filter_by_length(FX.documents(spark, d), prompt_bounds=(20, 2048), prompt_col="text").select("doc_id")


def _valid_sql(cols) -> str:
    return " AND ".join(f"coalesce(regexp_matches({c}, {O.lit(O.NON_WS)}), false)" for c in cols)


@query("validate", O.with_views("documents_v") + f"""
SELECT doc_id FROM documents_v WHERE {_valid_sql(['text', 'lang', 'source'])}""")
def q_validate(spark, d):
    return prep.validate_format(FX.documents(spark, d), ["text", "lang", "source"]).select("doc_id")


@query("filter_report", O.with_views("documents_v") + f"""
SELECT * , rows_in - rows_out AS removed,
  round(CASE WHEN rows_in > 0 THEN (rows_in - rows_out) / rows_in * 100.0 ELSE 0.0 END, 6) AS removed_pct
FROM (
  SELECT 1 AS stage_no, 'dedup' AS stage, (SELECT count(*) FROM documents_v) AS rows_in, (SELECT count(*) FROM k) AS rows_out
  UNION ALL SELECT 2, 'length', (SELECT count(*) FROM k), (SELECT count(*) FROM k WHERE l)
  UNION ALL SELECT 3, 'validate', (SELECT count(*) FROM k WHERE l), (SELECT count(*) FROM k WHERE l AND v)
) s""".replace("FROM k", f"FROM (SELECT length(text) BETWEEN 20 AND 2048 AS l, {_valid_sql(['text', 'lang', 'source'])} AS v FROM ({_DEDUP_SQL}) d0) k"), digits=6)
def q_filter_report(spark, d):
    return prep.filter_report(FX.documents(spark, d), key="text", order="ord", prompt_bounds=(20, 2048),
                              fields=["text", "lang", "source"])


def _split_sql(src: str, key: str, ratio: float, seed: int = 42, keep: str = "*") -> str:
    return f"""
SELECT {keep}, CASE WHEN rn <= need THEN 'validation' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || CAST({key} AS VARCHAR))) AS rn,
         CAST(ceil(count(*) OVER () * {float(ratio)}::DOUBLE) AS BIGINT) AS need
  FROM {src}) s"""


@query("split_exact", O.with_views("documents_v") + _split_sql("documents_v", "ord", 0.1, keep="doc_id"))
def q_split_exact(spark, d):
    return train_val_split(FX.documents(spark, d), ratio=0.1, seed=42, key="ord").select("doc_id", "split")


@query("split_stratified", O.with_views("documents_v") + """
SELECT doc_id, lang, CASE WHEN rn <= need THEN 'validation' ELSE 'train' END AS split FROM (
  SELECT d.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || CAST(d.ord AS VARCHAR))) AS rn, a.need
  FROM documents_v d JOIN (
    SELECT lang, fl + CASE WHEN rk <= extra THEN 1 ELSE 0 END AS need FROM (
      SELECT lang, fl, row_number() OVER (ORDER BY rem DESC, lang ASC) AS rk,
             CAST(ceil(sum(n) OVER () * 0.1::DOUBLE) AS BIGINT) - sum(fl) OVER () AS extra
      FROM (SELECT lang, n, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS fl, n * 0.1::DOUBLE - CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS rem
            FROM (SELECT lang, count(*) AS n FROM documents_v GROUP BY lang) c) c2) c3) a ON a.lang = d.lang
) s""")
def q_split_stratified(spark, d):
    return stratified_split(FX.documents(spark, d), by="lang", ratio=0.1, seed=42, key="ord") \
        .select("doc_id", "lang", "split")


@query("split_stats", O.with_views("documents_v") + f"""
SELECT split, count(*) AS rows, 'doc_id' AS columns FROM ({_split_sql("documents_v", "ord", 0.1, keep="doc_id")}) x GROUP BY split""")
def q_split_stats(spark, d):
    return split_stats(q_split_exact(spark, d))


@query("word_count", O.with_views("documents_v") + f"SELECT doc_id, {O.words('text')} AS n_words FROM documents_v")
def q_word_count(spark, d):
    return FX.documents(spark, d).select("doc_id", word_count("text").alias("n_words"))


@query("has_reasoning", O.with_views("candidates_v") + f"""
SELECT prompt_id, cand_idx, coalesce({O.has_reasoning('response')}, false) AS has_reasoning FROM candidates_v""")
def q_has_reasoning(spark, d):
    return FX.candidates(spark, d).select("prompt_id", "cand_idx", has_reasoning("response").alias("has_reasoning"))


@query("head", O.with_views("documents_v") + """
SELECT doc_id, lang, source, n_chars FROM documents_v ORDER BY ord LIMIT 50""")
def q_head(spark, d):
    return head_by_ordinal(FX.documents(spark, d), 50).select("doc_id", "lang", "source", "n_chars")


# === preference pairs from documents: L1, L3, P2, P8, P11, P12 ========================

_DOC_PAIRS = ("doc_pairs_v", """SELECT a.doc_id AS prompt_id, split_part(a.text, chr(10), 1) AS prompt, a.text AS chosen, b.text AS rejected
  FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1""")


def _doc_pairs(spark, d) -> DataFrame:
    return FX.doc_pairs(spark, d)


@query("clean_columns", O.with_views(extra=[_DOC_PAIRS]) + f"""
SELECT prompt_id, {O.clean('prompt')} AS prompt, {O.clean('chosen')} AS chosen, {O.clean('rejected')} AS rejected
FROM doc_pairs_v""")
def q_clean_columns(spark, d):
    return prep.clean_columns(_doc_pairs(spark, d)).select("prompt_id", "prompt", "chosen", "rejected")


_L1_SQL = f"""
SELECT * FROM (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY md5(lower({O.strip('prompt')})) ORDER BY prompt_id) AS rn FROM (
      SELECT prompt_id, {O.clean('prompt')} AS prompt, {O.clean('chosen')} AS chosen, {O.clean('rejected')} AS rejected
      FROM doc_pairs_v) c) d WHERE rn = 1) e
WHERE length(prompt) BETWEEN 10 AND 1024 AND length(chosen) BETWEEN 20 AND 2048 AND length(rejected) BETWEEN 20 AND 2048
  AND {_valid_sql(['prompt', 'chosen', 'rejected'])}"""


@query("process_preference", O.with_views(extra=[_DOC_PAIRS, ("l1_v", _L1_SQL)])
       + _split_sql("l1_v", "prompt_id", 0.1, keep="prompt_id, prompt, chosen, rejected"))
def q_process_preference(spark, d):
    out = L.process_preference_data(_doc_pairs(spark, d), order="prompt_id", key="prompt_id")
    return out.select("prompt_id", "prompt", "chosen", "rejected", "split")


@query("format_dpo", O.with_views(extra=[_DOC_PAIRS]) + """
SELECT prompt_id, prompt, chosen, rejected FROM doc_pairs_v""")
def q_format_dpo(spark, d):
    p = _doc_pairs(spark, d).select("prompt_id", F.col("prompt").alias("question"),
                                    F.col("chosen").alias("chosen_response"), F.col("rejected").alias("rejected_response"))
    return prep.format_for_dpo(p).select("prompt_id", "prompt", "chosen", "rejected")


@query("rename_preference", O.with_views(extra=[_DOC_PAIRS]) + """
SELECT prompt, chosen, rejected FROM doc_pairs_v""")
def q_rename_preference(spark, d):
    p = _doc_pairs(spark, d).withColumnRenamed("prompt", "instruction")
    return prep.rename_preference(p)


def _ensure_sql(p: str) -> str:
    return f"CASE WHEN starts_with({p}, 'Solve') THEN {p} ELSE {O.lit(tpl.INSTRUCTION_PREFIX)} || coalesce({p}, '') END"


@query("ensure_instruction", O.with_views("prompts_v") + f"SELECT ord, {_ensure_sql('prompt')} AS prompt FROM prompts_v")
def q_ensure_instruction(spark, d):
    return prep.ensure_instruction(FX.prompts(spark, d)).select("ord", "prompt")


@query("dpo_training_table", O.with_views(extra=[
    _DOC_PAIRS, ("l3_v", f"SELECT prompt_id, {_ensure_sql('prompt')} AS prompt, chosen, rejected FROM doc_pairs_v")])
       + _split_sql("l3_v", "prompt_id", 0.05, keep="prompt_id, prompt, chosen, rejected"))
def q_dpo_training_table(spark, d):
    return L.dpo_training_table(_doc_pairs(spark, d), key="prompt_id", materialize=True).select(
        "prompt_id", "prompt", "chosen", "rejected", "split")


# === Q/A items: SFT/PPO formats, ground truth ====================================

def _sft_text_sql(q: str, a: str) -> str:
    return (f"{O.lit(tpl.SFT_TEXT_QUESTION)} || coalesce({q}, '') || {O.lit(tpl.SFT_TEXT_ANSWER)} || coalesce({a}, '')")


@query("format_sft", O.with_views("qa_items_v") + f"""
SELECT m.item_id, {_sft_text_sql('q.question', 'q.answer')} AS text, m.msg_idx, m.role, m.content
FROM qa_items_v q JOIN ({_msgs_sql('qa_items_v', 'item_id', [('system', O.lit(tpl.SFT_SYSTEM)), ('user', 'question'), ('assistant', 'answer')])}) m
  ON m.item_id = q.item_id""")
def q_format_sft(spark, d):
    s = prep.format_for_sft(FX.qa_items(spark, d))
    return _messages(s, ["item_id", "text"], F.col("messages")).select("item_id", "text", "msg_idx", "role", "content")


def _chatml_sql(q: str, a: str) -> str:
    s, e = tpl.CHATML_START, tpl.CHATML_END
    head = f"{s}system\n{tpl.CHATML_SYSTEM}{e}\n{s}user\n"
    mid = f"{e}\n{s}assistant\n"
    return (f"{O.chr_concat(head)} || coalesce({q}, '') || {O.chr_concat(mid)} || coalesce({a}, '') || {O.lit(e)}")


@query("format_chatml", O.with_views("qa_items_v") + f"SELECT item_id, {_chatml_sql('question', 'answer')} AS text FROM qa_items_v")
def q_format_chatml(spark, d):
    return prep.format_chatml(FX.qa_items(spark, d), keep=("item_id",))


_INSTR = f"{O.chr_concat(tpl.INSTRUCTION_PREFIX)} || coalesce(question, '')"


@query("format_ppo", O.with_views("qa_items_v") + f"SELECT item_id, question, answer, {_INSTR} AS query FROM qa_items_v")
def q_format_ppo(spark, d):
    return prep.format_for_ppo(FX.qa_items(spark, d))


@query("online_prompts", O.with_views("qa_items_v") + f"SELECT {_INSTR} AS prompt FROM qa_items_v")
def q_online_prompts(spark, d):
    return prep.online_prompts(FX.qa_items(spark, d), "prompt")


@query("eval_messages", O.with_views("qa_items_v") + _msgs_sql(
    "qa_items_v", "item_id", [("system", O.lit(tpl.EVAL_SYSTEM)), ("user", "question")]))
def q_eval_messages(spark, d):
    return _messages(FX.qa_items(spark, d), ["item_id"], tpl.eval_messages(F.col("question")))


@query("prompts_from_qa", O.with_views("qa_items_v") + """
SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS ord,
       'gsm8k_' || CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR) AS id,
       question AS prompt, 'gsm8k' AS category, 'medium' AS difficulty
FROM qa_items_v ORDER BY item_id LIMIT 200""")
def q_prompts_from_qa(spark, d):
    return prompts_from_qa(FX.qa_items(spark, d), 200, order="item_id")


@query("process_sft", O.with_views("qa_items_v") + _split_sql(
    f"(SELECT item_id, {_sft_text_sql('question', 'answer')} AS text FROM qa_items_v)", "item_id", 0.1,
    keep="item_id, text"))
def q_process_sft(spark, d):
    return L.process_sft_data(FX.qa_items(spark, d), key="item_id").select("item_id", "text", "split")


@query("sft_training_table", O.with_views("qa_items_v") + _split_sql(
    f"(SELECT item_id, {_chatml_sql('question', 'answer')} AS text FROM qa_items_v)", "item_id", 0.05,
    keep="text"))
def q_sft_training_table(spark, d):
    return L.sft_training_table(FX.qa_items(spark, d), key="item_id")


@query("ground_truth", O.with_views("qa_items_v") + f"SELECT item_id, {O.ground_truth('answer')} AS ground_truth FROM qa_items_v")
def q_ground_truth(spark, d):
    return FX.qa_items(spark, d).select("item_id", extract_ground_truth("answer").alias("ground_truth"))


# === predictions: grading and metrics ============================================

@query("extract_answer", O.with_views("predictions_v") + f"""
SELECT model, item_id, {O.extract_answer("coalesce(response, '')")} AS predicted FROM predictions_v""")
def q_extract_answer(spark, d):
    p = FX.predictions(spark, d)
    return p.select("model", "item_id", extract_answer(F.coalesce(F.col("response"), F.lit(""))).alias("predicted"))


_GRADE_SQL = f"""
SELECT p.model, p.item_id, p.sample_idx, q.question, q.ground_truth,
  CASE WHEN p.error IS NULL THEN {O.extract_answer("coalesce(p.response, '')")} END AS predicted,
  CASE WHEN p.error IS NOT NULL THEN 'ERROR: ' || p.error ELSE p.response END AS response,
  coalesce(p.error IS NULL AND {O.extract_answer("coalesce(p.response, '')")} = q.ground_truth, false) AS correct
FROM predictions_v p JOIN (SELECT item_id, question, {O.ground_truth('answer')} AS ground_truth FROM qa_items_v) q
  ON p.item_id = q.item_id"""


def _graded(spark, d):
    return ev.grade(FX.predictions(spark, d), FX.qa_items(spark, d))


@query("grade", O.with_views("predictions_v", "qa_items_v") + _GRADE_SQL)
def q_grade(spark, d):
    return _graded(spark, d)


@query("error_rows", O.with_views("predictions_v", "qa_items_v") + f"""
SELECT model, item_id, predicted, response, correct FROM ({_GRADE_SQL}) g WHERE response LIKE 'ERROR: %'""")
def q_error_rows(spark, d):
    return _graded(spark, d).where(F.col("response").startswith(ev.ERROR_RESPONSE_PREFIX)) \
        .select("model", "item_id", "predicted", "response", "correct")


def _metrics_sql(by: str) -> str:
    return f"""
SELECT {by}, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE correct) / count(*) ELSE 0.0 END, 9) AS accuracy,
  count(*) FILTER (WHERE correct) AS correct, count(*) AS total,
  round(coalesce(avg({O.words('response')}), 0.0), 9) AS avg_response_length,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE coalesce({O.has_reasoning('response')}, false)) / count(*) ELSE 0.0 END, 9) AS reasoning_ratio"""


@query("eval_metrics", O.with_views("predictions_v", "qa_items_v") + _metrics_sql("model") + f"""
FROM ({_GRADE_SQL}) g GROUP BY model""", digits=9)
def q_eval_metrics(spark, d):
    return ev.eval_metrics(_graded(spark, d))


@query("compare_models", O.with_views("predictions_v", "qa_items_v") + f"""
SELECT *, string_split(model_path, '/')[-1] AS model_name FROM (""" + _metrics_sql("model_path") + f"""
FROM (SELECT 'models/' || model AS model_path, * FROM ({_GRADE_SQL}) g0) g GROUP BY model_path) m""", digits=9)
def q_compare_models(spark, d):
    r = _graded(spark, d).withColumn("model_path", F.concat(F.lit("models/"), F.col("model")))
    return ev.compare_models(r)


@query("pass_at_k", O.with_views("predictions_v", "qa_items_v") + f"""
SELECT k, count(*) AS n_items, count(*) FILTER (WHERE n >= k) AS n_scored,
  round(avg(CASE WHEN n >= k THEN (CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0
    ELSE 1.0 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - k / i), lambda a, b: a * b) END) END), 9) AS pass_at_k
FROM (SELECT item, count(*) AS n, count(*) FILTER (WHERE correct) AS c
      FROM (SELECT item_id // 5 AS item, correct FROM ({_GRADE_SQL}) g0) g GROUP BY item) t, (VALUES (1), (2), (5)) ks(k)
GROUP BY k""", digits=9)
def q_pass_at_k(spark, d):
    r = _graded(spark, d).withColumn("item", F.floor(F.col("item_id") / 5))
    return ev.pass_at_k(r, ks=(1, 2, 5), item="item")


@query("format_quality", O.with_views("predictions_v", "qa_items_v") + f"""
SELECT model, count(*) AS n, round(avg(CAST(predicted IS NOT NULL AS DOUBLE)), 9) AS parsed_share,
""" + ",\n".join(f"  count(*) FILTER (WHERE predicted IS NOT NULL AND {O.answer_pattern('response')} = {i}) AS pattern_{i}"
                 for i in range(1, 6)) + f""",
  round(avg(CAST(coalesce({O.has_reasoning('response')}, false) AS DOUBLE)), 9) AS reasoning_share,
  round(avg(CAST(starts_with(response, 'ERROR: ') AND predicted IS NULL AS DOUBLE)), 9) AS error_share
FROM ({_GRADE_SQL}) g GROUP BY model""", digits=9)
def q_format_quality(spark, d):
    return ev.format_quality(_graded(spark, d))


# === rewards =========================================================================

@query("heuristic_reward", O.with_views("reward_input_v") + f"""
SELECT prompt_id, cand_idx, {O.reward_sql('response')} AS reward FROM reward_input_v""")
def q_heuristic_reward(spark, d):
    return FX.reward_input(spark, d).select("prompt_id", "cand_idx", heuristic_reward("response").alias("reward"))


@query("reward_terms", O.with_views("reward_input_v") + "SELECT prompt_id, cand_idx, " + ", ".join(
    f"{v} AS {k}" for k, v in O.reward_terms_sql("response").items()) + " FROM reward_input_v")
def q_reward_terms(spark, d):
    cols = ["length_term", "step_term", "answer_term", "notation_term", "repetition_term"]
    return reward_terms(FX.reward_input(spark, d)).select("prompt_id", "cand_idx", *cols)


@query("scoring_text", O.with_views("reward_input_v") + """
SELECT prompt_id, cand_idx, coalesce(query, '') || chr(10) || chr(10) || coalesce(response, '') AS text FROM reward_input_v""")
def q_scoring_text(spark, d):
    r = FX.reward_input(spark, d)
    return r.select("prompt_id", "cand_idx", tpl.scoring_text(F.col("query"), F.col("response")).alias("text"))


@query("batch_reward_stats", O.with_views("reward_input_v") + f"""
SELECT epoch, batch, count(*) AS n, round(avg({O.reward_sql('response')}), 9) AS mean_reward, batch % 5 = 0 AS logged
FROM reward_input_v GROUP BY epoch, batch""", digits=9)
def q_batch_reward_stats(spark, d):
    r = FX.reward_input(spark, d).withColumn("reward", heuristic_reward("response"))
    return batch_reward_stats(r)


@query("pairs_from_rewards", O.with_views("reward_input_v") + _pairs_sql(
    f"(SELECT prompt_id, query AS prompt, cand_idx, response, {O.reward_sql('response')} AS score, '' AS reason FROM reward_input_v)",
    0.0))
def q_pairs_from_rewards(spark, d):
    r = FX.reward_input(spark, d).withColumn("reward", heuristic_reward("response"))
    return pairs_from_rewards(r, min_gap=0.0)


@query("normalize_response", O.with_views("candidates_v") + f"""
SELECT prompt_id, cand_idx, {O.strip('response')} AS response FROM candidates_v""")
def q_normalize_response(spark, d):
    """Chat-list outputs: (previous turn, this turn) as a message array; P13 keeps the
    last message's content, stripped. The previous turn comes from an equi-join on
    (conversation, turn - 1), not from collecting a conversation."""
    conv = FX.table(spark, d, "conversations")
    c = FX.candidates(spark, d)
    prev = conv.select(F.col("conv_id").cast("bigint").alias("prompt_id"), (F.col("turn") + 1).cast("int").alias("cand_idx"),
                       F.col("role").alias("prev_role"), F.col("text").alias("prev_text"))
    j = c.join(prev, ["prompt_id", "cand_idx"], "left")
    msgs = F.when(F.col("prev_role").isNull(), F.array(tpl.message("assistant", F.col("response")))).otherwise(
        F.array(F.struct(F.col("prev_role").alias("role"), F.col("prev_text").alias("content")),
                tpl.message("assistant", F.col("response"))))
    return j.select("prompt_id", "cand_idx", prep.normalize_response(msgs).alias("response"))


# === run logs, β, diversity, inference ==============================================

@query("loss_curves", O.with_views("run_logs_v") + """
SELECT step, round(avg(value) FILTER (WHERE method = 'sft'), 9) AS sft, round(avg(value) FILTER (WHERE method = 'dpo'), 9) AS dpo,
       round(avg(value) FILTER (WHERE method = 'ppo'), 9) AS ppo,
       count(*) FILTER (WHERE coalesce(method NOT IN ('sft', 'dpo', 'ppo'), true)) AS other_rows
FROM run_logs_v WHERE metric = 'train_loss' GROUP BY step""", digits=9)
def q_loss_curves(spark, d):
    return G.loss_curves(FX.run_logs(spark, d))


@query("accuracy_progression", O.with_views("run_logs_v") + f"""
SELECT method AS stage, stage_no, round(accuracy, 9) AS accuracy,
  CASE WHEN stage_no IS NOT NULL THEN round(accuracy - lag(accuracy) OVER (PARTITION BY stage_no IS NULL ORDER BY stage_no), 9) END AS gain_prev, round(accuracy - {G.BASE_ACCURACY}::DOUBLE, 9) AS gain_base
FROM (
  SELECT method, accuracy, CASE method WHEN 'base' THEN 0 WHEN 'sft' THEN 1 WHEN 'dpo' THEN 2 WHEN 'ppo' THEN 3 END AS stage_no FROM (
    SELECT method, arg_max(v, step) AS accuracy FROM (
      SELECT method, step, avg(value) AS v FROM run_logs_v WHERE metric = 'eval_accuracy' GROUP BY method, step) s GROUP BY method
    UNION ALL SELECT 'base', {G.BASE_ACCURACY}::DOUBLE) u
) t""", digits=9)
def q_accuracy_progression(spark, d):
    return G.accuracy_progression(FX.run_logs(spark, d))


@query("reward_margins", O.with_views("run_logs_v") + """
SELECT step, round(c, 9) AS rewards_chosen, round(r, 9) AS rewards_rejected, round(c - r, 9) AS margin FROM (
  SELECT step, avg(value) FILTER (WHERE metric = 'rewards_chosen') AS c, avg(value) FILTER (WHERE metric = 'rewards_rejected') AS r
  FROM run_logs_v WHERE method = 'dpo' AND metric IN ('rewards_chosen', 'rewards_rejected') GROUP BY step) s""", digits=9)
def q_reward_margins(spark, d):
    return G.reward_margins(FX.run_logs(spark, d))


@query("beta_ablation", O.with_views("beta_results_v") + f"""
SELECT beta, round(accuracy, 9) AS accuracy, round(diversity, 9) AS diversity,
  round(mode_collapse_score, 9) AS mode_collapse_score, round(train_loss, 9) AS train_loss,
  CASE WHEN mode_collapse_score > {G.RISK_HIGH} THEN 'high' WHEN mode_collapse_score > {G.RISK_MEDIUM} THEN 'medium' ELSE 'low' END AS risk
FROM beta_results_v ORDER BY beta""", digits=9)
def q_beta_ablation(spark, d):
    return G.beta_ablation(FX.beta_results(spark, d))


@query("beta_sweep_status", O.with_views("beta_runs_v") + """
SELECT beta, count(*) AS runs, count(*) FILTER (WHERE NOT starts_with(status, 'failed')) AS succeeded,
  count(*) FILTER (WHERE starts_with(status, 'failed')) AS failed,
  CASE WHEN count(*) FILTER (WHERE starts_with(status, 'failed')) = 0 THEN 'success' ELSE 'partial' END AS status
FROM beta_runs_v GROUP BY beta""")
def q_beta_sweep_status(spark, d):
    return G.beta_sweep_status(FX.beta_runs(spark, d))


@query("resource_efficiency", O.with_views("method_resources_v") + f"""
SELECT method, round(memory_gb, 9) AS memory_gb, training_time_min, round(final_accuracy, 9) AS final_accuracy,
  memory_gb > {G.GPU_LIMIT_GB}::DOUBLE AS over_limit,
  round((memory_gb - bm) / bm * 100.0, 9) AS memory_delta_pct,
  round((training_time_min - bt) / bt * 100.0, 9) AS time_delta_pct,
  round((final_accuracy - ba) * 100.0, 9) AS accuracy_delta_points
FROM (SELECT *, max(CASE WHEN method = 'ppo' THEN memory_gb END) OVER () AS bm,
             max(CASE WHEN method = 'ppo' THEN training_time_min END) OVER () AS bt,
             max(CASE WHEN method = 'ppo' THEN final_accuracy END) OVER () AS ba FROM method_resources_v) s""", digits=9)
def q_resource_efficiency(spark, d):
    return G.resource_efficiency(FX.method_resources(spark, d))


@query("analysis_summary", O.with_views("method_resources_v", "beta_results_v") + """
SELECT (SELECT arg_max(method, final_accuracy) FROM method_resources_v) AS best_method,
  (SELECT round(max(final_accuracy), 9) FROM method_resources_v) AS best_accuracy,
  (SELECT arg_max(beta, accuracy) FROM beta_results_v) AS optimal_beta,
  round((a.final_accuracy - p.final_accuracy) * 100.0, 9) AS accuracy_gain_points,
  round((p.memory_gb - a.memory_gb) / p.memory_gb * 100.0, 9) AS memory_saving_pct,
  round((p.training_time_min - a.training_time_min) / p.training_time_min * 100.0, 9) AS time_saving_pct
FROM (SELECT * FROM method_resources_v WHERE method = 'dpo') a, (SELECT * FROM method_resources_v WHERE method = 'ppo') p""", digits=9)
def q_analysis_summary(spark, d):
    return G.analysis_summary(FX.method_resources(spark, d), FX.beta_results(spark, d))


def _responses_by_beta(spark, d) -> DataFrame:
    c = FX.candidates(spark, d)
    return c.withColumn("group", F.element_at(F.array(*[F.lit(b) for b in FX.BETAS]), (F.col("prompt_id") % 4 + 1).cast("int")))


_RESP_BY_BETA = ("resp_v", f"SELECT *, {O._by_index('prompt_id % 4', FX.BETAS)} AS grp FROM candidates_v")


@query("distinct_n", O.with_views("candidates_v", extra=[_RESP_BY_BETA]) + f"""
SELECT grp AS "group", count(*) AS ngrams, count(DISTINCT ng) AS distinct_ngrams,
  round(count(DISTINCT ng) / count(*), 9) AS distinct_n
FROM (SELECT grp, array_to_string(toks[i:i + 3], ' ') AS ng
      FROM (SELECT grp, regexp_extract_all(coalesce(response, ''), {O.lit(O.NON_WS + '+')}) AS toks FROM resp_v) t,
           range(1, len(toks) - 2) r(i)) x
GROUP BY grp""", digits=9)
def q_distinct_n(spark, d):
    return G.distinct_n(_responses_by_beta(spark, d), by=("group",), n=4)


@query("mode_collapse", O.with_views("candidates_v", extra=[_RESP_BY_BETA]) + f"""
SELECT grp AS "group", CAST(sum(n) AS BIGINT) AS responses, CAST(sum(CASE WHEN p >= 2 THEN n ELSE 0 END) AS BIGINT) AS collapsed,
  round(sum(CASE WHEN p >= 2 THEN n ELSE 0 END) / sum(n), 9) AS mode_collapse
FROM (SELECT grp, h, count(*) AS n, count(DISTINCT prompt_id) AS p FROM (
  SELECT grp, prompt_id, md5(lower({O.strip(f"regexp_replace(response, {O.lit(O.WS + '+')}, ' ', 'g')")})) AS h FROM resp_v) a
  GROUP BY grp, h) b
GROUP BY grp""", digits=9)
def q_mode_collapse(spark, d):
    return G.mode_collapse(_responses_by_beta(spark, d), by=("group",))


@query("throughput_rollup", O.with_views("infer_runs_v") + """
SELECT model, count(*) AS num_runs, round(avg(latency_sec), 3) AS avg_latency_sec, round(avg(generated_tokens), 1) AS avg_tokens_generated,
  round(CASE WHEN avg(latency_sec) > 0 THEN avg(generated_tokens) / avg(latency_sec) ELSE 0.0 END, 2) AS throughput_tokens_per_sec,
  round(CASE WHEN avg(generated_tokens) > 0 THEN avg(latency_sec) / avg(generated_tokens) * 1000.0 ELSE 0.0 END, 2) AS time_per_output_token_ms
FROM infer_runs_v WHERE status = 'success' GROUP BY model""")
def q_throughput_rollup(spark, d):
    return G.throughput_rollup(FX.infer_runs(spark, d))


@query("batch_impact", O.with_views("infer_runs_v") + f"""
SELECT batch_size, count(*) AS runs, count(*) FILTER (WHERE status = 'OOM') AS oom_runs,
  round(max(peak_mem_bytes) FILTER (WHERE status <> 'OOM') / {G.GIB}::DOUBLE, 3) AS peak_memory_gb,
  round(avg(latency_sec) FILTER (WHERE status <> 'OOM'), 3) AS total_time_sec,
  round(CASE WHEN sum(latency_sec) FILTER (WHERE status <> 'OOM') > 0 THEN
    sum(generated_tokens * batch_size) FILTER (WHERE status <> 'OOM') / sum(latency_sec) FILTER (WHERE status <> 'OOM') END, 2) AS throughput_tokens_per_sec,
  CASE WHEN count(*) FILTER (WHERE status = 'OOM') > 0 THEN 'OOM' ELSE 'success' END AS status
FROM infer_runs_v GROUP BY batch_size""")
def q_batch_impact(spark, d):
    return G.batch_impact(FX.infer_runs(spark, d))


@query("kv_cache", O.with_views("infer_runs_v", "model_shapes_v") + f"""
SELECT model, round(max(gb), 6) AS max_kv_cache_gb, round(avg(gb), 6) AS avg_kv_cache_gb, count(*) AS requests FROM (
  SELECT r.model, CAST(2 * s.num_hidden_layers * s.num_key_value_heads * (s.hidden_size // s.num_attention_heads)
         * (r.prompt_tokens + r.generated_tokens) * {G.KV_DTYPE_BYTES} AS DOUBLE) / {G.GIB}::DOUBLE AS gb
  FROM infer_runs_v r JOIN model_shapes_v s ON r.model = s.model) x GROUP BY model""")
def q_kv_cache(spark, d):
    return G.kv_cache_estimate(FX.infer_runs(spark, d), FX.model_shapes(spark, d))


@query("memory_overhead", O.with_views("infer_runs_v") + f"""
SELECT model, round(avg(model_mem_bytes / {G.GIB}::DOUBLE), 3) AS model_memory_gb,
  round(max(peak_mem_bytes / {G.GIB}::DOUBLE), 3) AS peak_inference_memory_gb,
  round(avg((peak_mem_bytes - model_mem_bytes) / {G.GIB}::DOUBLE), 3) AS avg_overhead_gb,
  round(max((peak_mem_bytes - model_mem_bytes) / {G.GIB}::DOUBLE), 3) AS max_overhead_gb
FROM infer_runs_v GROUP BY model""")
def q_memory_overhead(spark, d):
    return G.memory_overhead(FX.infer_runs(spark, d))


def _objective_sql() -> str:
    h = "((policy_chosen - ref_chosen) - (policy_rejected - ref_rejected))"
    sel = []
    for b in G.DEFAULT_BETAS:
        bh = f"({b}::DOUBLE * {h})"
        ls = lambda x: f"(-(greatest(-({x}), 0.0) + ln(1 + exp(-abs({x})))))"
        losses = {
            "sigmoid": f"(-{ls(bh)} * 1.0::DOUBLE - {ls('-' + bh)} * 0.0::DOUBLE)",
            "hinge": f"greatest(0.0, 1.0 - {bh})",
            "ipo": f"pow({h} - {1.0 / (2.0 * b)}::DOUBLE, 2)",
        }
        acc = (f"avg(CAST(({b}::DOUBLE * (policy_chosen - ref_chosen)) > ({b}::DOUBLE * (policy_rejected - ref_rejected)) "
               f"AS DOUBLE))")
        for lt, e in losses.items():
            sel.append(f"SELECT {b}::DOUBLE AS beta, '{lt}' AS loss_type, round(avg({e}), 9) AS loss, round({acc}, 9) AS reward_accuracy, "
                       f"round(avg({bh}), 9) AS reward_margin, count(*) AS pairs FROM logps_v")
    return "\nUNION ALL\n".join(sel)


@query("preference_objective", O.with_views("logps_v") + _objective_sql(), digits=9)
def q_preference_objective(spark, d):
    return G.preference_objective(FX.logged_logps(spark, d))

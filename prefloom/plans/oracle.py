"""DuckDB SQL for every oracle-checked query: the fixture views as CTEs plus one
statement per query. Patterns come from the same constants as the Spark side; only
the regex flags differ (RE2 has no ``(?d)``, and its ``(?U)`` means ungreedy).
"""

from __future__ import annotations

from prefloom.functions import answers as A
from prefloom.functions import judge as J
from prefloom.functions.text import CTRL_CLASS, NON_WS, WS
from prefloom.plans import fixtures as FX


def lit(s: str) -> str:
    """SQL string literal (DuckDB strings take backslashes literally)."""
    return "'" + s.replace("'", "''") + "'"


def chr_concat(s: str) -> str:
    """A literal that may hold newlines, spelled with chr(10) joins for readability."""
    parts = s.split("\n")
    return " || chr(10) || ".join(lit(p) for p in parts) if len(parts) > 1 else lit(s)


# --- scalar rules in SQL --------------------------------------------------------

def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def clean(x: str) -> str:
    s = f"coalesce({x}, '')"
    s = f"regexp_replace({s}, {lit(WS + '+')}, ' ', 'g')"
    s = f"trim({s}, ' ')"
    s = f"regexp_replace({s}, {lit(CTRL_CLASS)}, '', 'g')"
    return f"translate({s}, {lit('“”‘’')}, {lit(chr(34) * 2 + chr(39) * 2)})"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), {lit(NON_WS + '+')})) AS BIGINT)"


def blank(x: str) -> str:
    return f"(NOT coalesce(regexp_matches({x}, {lit(NON_WS)}), false))"


def has_reasoning(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {lit(w)})" for w in ["step", "first", "then", "therefore"]) + ")"


def extract_answer(x: str) -> str:
    hits = ", ".join(f"nullif(regexp_extract({x}, {lit(p)}, 1), '')" for p in A.ANSWER_PATTERNS)
    return f"replace(coalesce({hits}), ',', '')"


def answer_pattern(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {lit(p)}) THEN {i}" for i, p in enumerate(A.ANSWER_PATTERNS, 1))
    return f"(CASE {whens} END)"


def ground_truth(x: str) -> str:
    p = A.GROUND_TRUTH.replace("(?md)", "(?m)")
    inner = f"regexp_extract(coalesce({x}, ''), {lit(p)}, 1)"
    return f"replace({strip(inner)}, ',', '')"


JUDGE_HELPERS = f"""
  regexp_extract(coalesce(t, ''), {lit(J.JSON_SLICE)}) AS sl,
  regexp_extract(coalesce(t, ''), {lit(J.FIRST_NUMBER.replace('(?U)', ''))}, 1) AS num
"""


def judge_select(src: str, keep: str) -> str:
    """SELECT keep..., score, reason FROM src (which has a text column ``t``)."""
    numeric = J.NUMERIC_TEXT
    return f"""
SELECT {keep},
  CASE WHEN json_err THEN 0.0
       WHEN json_ok THEN (CASE WHEN isnan(js) THEN 0.0 ELSE least(greatest(js, 0.0), 10.0) END)
       WHEN num <> '' THEN least(greatest(CAST(num AS DOUBLE), 0.0), 10.0)
       ELSE 0.0 END AS score,
  CASE WHEN json_err THEN 'Judge error: score is not a number'
       WHEN json_ok THEN (CASE WHEN coalesce(rt, '') <> 'NULL' THEN coalesce(jreason, '') END)
       WHEN num <> '' THEN substring(coalesce(t, ''), 1, 200)
       ELSE 'Failed to parse judge output' END AS reason
FROM (
  SELECT *,
    valid AND coalesce(jt IN ('NULL', 'ARRAY', 'OBJECT'), false) AS json_err,
    valid AND NOT coalesce(jt IN ('NULL', 'ARRAY', 'OBJECT'), false)
      AND (coalesce(jt, '') <> 'VARCHAR' OR coalesce(regexp_matches(raw, {lit(numeric)}), false)) AS json_ok,
    CASE WHEN raw IS NULL THEN 0.0
         WHEN jt = 'BOOLEAN' THEN (CASE WHEN raw = 'true' THEN 1.0 ELSE 0.0 END)
         ELSE TRY_CAST({strip('raw')} AS DOUBLE) END AS js
  FROM (
    SELECT *,
      sl <> '' AND json_valid(sl) AS valid,
      CASE WHEN sl <> '' AND json_valid(sl) THEN json_type(sl, '$.score') END AS jt,
      CASE WHEN sl <> '' AND json_valid(sl) THEN json_extract_string(sl, '$.score') END AS raw,
      CASE WHEN sl <> '' AND json_valid(sl) THEN json_type(sl, '$.reason') END AS rt,
      CASE WHEN sl <> '' AND json_valid(sl) THEN json_extract_string(sl, '$.reason') END AS jreason
    FROM (SELECT *, {JUDGE_HELPERS} FROM {src}) s0
  ) s1
) s2
"""


def reward_terms_sql(x: str) -> dict[str, str]:
    r = f"coalesce({x}, '')"
    n = words(r)
    # stated here once more, apart from the Spark side, so that a wrong value on one side shows
    length = f"(CASE WHEN {n} >= 50 AND {n} <= 300 THEN 1.0::DOUBLE WHEN {n} < 20 THEN -2.0::DOUBLE WHEN {n} > 500 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END)"
    hits = " + ".join(f"CAST(contains(lower({r}), '{w}') AS INTEGER)" for w in "step first then next therefore so thus hence".split())
    step = f"least(CAST({hits} AS DOUBLE) * 0.3::DOUBLE, 1.5::DOUBLE)"
    answer = f"(CASE WHEN contains(lower({r}), 'the answer is') OR contains(lower({r}), 'answer:') OR contains(lower({r}), '= ') THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END)"
    notation = f"(CASE WHEN regexp_matches({r}, '[×÷+=²³]') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"
    parts = f"string_split({r}, '.')"
    ratio = f"(CAST(len(list_distinct({parts})) AS DOUBLE) / CAST(greatest(len({parts}), 1) AS DOUBLE))"
    rep = f"(CASE WHEN {ratio} < 0.5::DOUBLE THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return {"length_term": length, "step_term": step, "answer_term": answer,
            "notation_term": notation, "repetition_term": rep}


def reward_sql(x: str) -> str:
    t = reward_terms_sql(x)
    return (f"(((((0.0::DOUBLE + {t['length_term']}) + {t['step_term']}) + {t['answer_term']}) "
            f"+ {t['notation_term']}) + {t['repetition_term']})")


# --- fixture views ------------------------------------------------------------

def _case(col: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


def _by_index(idx: str, values: list) -> str:
    vals = ", ".join(lit(v) if isinstance(v, str) else f"{v!r}::DOUBLE" for v in values)
    return f"([{vals}])[{idx} + 1]"


def _judge_text(pid: str, idx: str) -> str:
    k = f"CAST(({pid} * 7 + {idx} * 5) % 11 AS VARCHAR)"
    return (f"CASE {idx} % 4 WHEN 0 THEN '{{\"score\": ' || {k} || ', \"reason\": \"json number\"}}' "
            f"WHEN 1 THEN '{{\"score\": \"' || {k} || '\", \"reason\": \"json text\"}}' "
            f"WHEN 2 THEN 'Score: ' || {k} || ' out of 10' "
            f"ELSE '{{''score'': ' || {k} || '}}' END")


VIEWS: dict[str, tuple[list[str], str]] = {
    "documents_v": ([], "SELECT *, doc_id AS ord FROM documents"),
    "doc_candidates_v": ([], f"""
SELECT concat_ws(':', d.lang, d.source) AS prompt_id,
       'Write a text in ' || d.lang || ' like those from ' || d.source AS prompt,
       CAST(d.doc_id AS BIGINT) AS cand_idx, d.text AS response,
       CAST(l.quality * 10.0 AS DOUBLE) AS score, '' AS reason
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "prompts_v": ([], """
SELECT CAST(conv_id AS BIGINT) AS ord, CAST(conv_id AS VARCHAR) AS id, arg_min(text, turn) AS prompt,
       CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS difficulty
FROM conversations WHERE role = 'user' GROUP BY conv_id"""),
    "candidates_v": (["prompts_v"], """
SELECT c.prompt_id, p.prompt, c.cand_idx, c.response
FROM (SELECT CAST(conv_id AS BIGINT) AS prompt_id, CAST(turn AS INTEGER) AS cand_idx, text AS response
      FROM conversations WHERE role = 'assistant') c
LEFT JOIN prompts_v p ON p.ord = c.prompt_id"""),
    "judge_raw_v": (["candidates_v"], f"""
SELECT prompt_id, cand_idx, {_judge_text('prompt_id', 'cand_idx')} AS judge_text, CAST(NULL AS VARCHAR) AS error
FROM candidates_v"""),
    "scored_v": (["candidates_v"], f"""
SELECT prompt_id, prompt, cand_idx, response,
       CASE WHEN {blank('response')} THEN 0.0 ELSE score END AS score,
       CASE WHEN {blank('response')} THEN {lit(J.EMPTY_REASON)} ELSE reason END AS reason
FROM ({judge_select(f"(SELECT *, {_judge_text('prompt_id', 'cand_idx')} AS t FROM candidates_v)",
                    'prompt_id, prompt, cand_idx, response')}) j"""),
    "reward_input_v": (["candidates_v"], """
SELECT 0 AS epoch, CAST(floor(prompt_id / 4) AS BIGINT) AS batch, prompt_id, cand_idx,
       coalesce(prompt, '') AS query, response
FROM candidates_v"""),
    "qa_items_v": ([], """
SELECT CAST(o_orderkey AS BIGINT) AS item_id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS question,
       'Work.' || chr(10) || '#### ' || CAST(o_custkey AS VARCHAR) AS answer
FROM orders"""),
    "predictions_v": ([], f"""
SELECT o_orderpriority AS model, CAST(o_orderkey AS BIGINT) AS item_id, 0 AS sample_idx,
  CASE o_orderkey % 6
    WHEN 0 THEN 'Step 1. The answer is: ' || CAST(o_custkey AS VARCHAR)
    WHEN 1 THEN 'The answer is: ' || CAST(o_custkey AS VARCHAR) || '.'
    WHEN 2 THEN '#### ' || CAST(o_custkey AS VARCHAR)
    WHEN 3 THEN 'x = ' || CAST(o_custkey AS VARCHAR)
    WHEN 4 THEN 'no idea' END AS response,
  CASE WHEN o_orderkey % 6 = 5 THEN {lit(FX.PREDICTION_ERROR)} END AS error
FROM orders"""),
    "run_logs_v": ([], f"""
SELECT coalesce({_case('event_type', FX.METHOD_BY_EVENT)}, event_type) AS method,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS step,
       {_by_index('user_id % 4', FX.RUN_METRICS)} AS metric,
       CAST(value AS DOUBLE) AS value
FROM events"""),
    "beta_runs_v": ([], f"""
SELECT {_by_index('user_id % 4', FX.BETAS)} AS beta,
       {_case('event_type', FX.BETA_METRIC_BY_EVENT)} AS metric,
       value / {FX.BETA_VALUE_SCALE}::DOUBLE AS value,
       CASE WHEN event_type = 'error' THEN 'failed: ' || props ELSE 'success' END AS status
FROM events"""),
    "beta_results_v": (["beta_runs_v"], """
SELECT beta,
  avg(value) FILTER (WHERE metric = 'accuracy') AS accuracy,
  avg(value) FILTER (WHERE metric = 'diversity') AS diversity,
  avg(value) FILTER (WHERE metric = 'mode_collapse_score') AS mode_collapse_score,
  avg(value) FILTER (WHERE metric = 'train_loss') AS train_loss
FROM beta_runs_v GROUP BY beta"""),
    "method_resources_v": ([], f"""
SELECT coalesce({_case('event_type', FX.METHOD_BY_EVENT)}, event_type) AS method,
  max(value) / 25.0::DOUBLE AS memory_gb,
  CAST(count(DISTINCT json_extract_string(props, '$.k')) AS BIGINT) AS training_time_min,
  avg(value) / {FX.BETA_VALUE_SCALE}::DOUBLE AS final_accuracy
FROM events
GROUP BY 1"""),
    "infer_runs_v": ([], """
SELECT 'm-' || l_returnflag || l_linestatus AS model,
  CAST(1 << (l_linenumber % 4) AS INTEGER) AS batch_size,
  CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS run,
  l_extendedprice / 10000.0::DOUBLE AS latency_sec,
  CAST(l_partkey % 200 + 1 AS BIGINT) AS prompt_tokens,
  CAST(trunc(l_quantity * 10) AS BIGINT) AS generated_tokens,
  CAST((3000 + l_suppkey % 1000) * 1048576 AS BIGINT) AS model_mem_bytes,
  CAST((3000 + l_suppkey % 1000) * 1048576 + CAST(trunc(l_discount * 100) AS BIGINT) * 268435456 AS BIGINT) AS peak_mem_bytes,
  CASE WHEN (1 << (l_linenumber % 4)) = 8 AND l_returnflag = 'R' THEN 'OOM' ELSE 'success' END AS status
FROM lineitem"""),
    "model_shapes_v": ([], """
SELECT 'm-' || l_returnflag || l_linestatus AS model, 24 AS num_hidden_layers,
  CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 4 ELSE 16 END AS num_key_value_heads,
  16 AS num_attention_heads, 1536 AS hidden_size
FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)"""),
    "logps_v": ([], """
SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS pair_id,
  -l_quantity / 10.0::DOUBLE AS policy_chosen,
  -l_extendedprice / 10000.0::DOUBLE AS policy_rejected,
  -l_tax * 100.0::DOUBLE AS ref_chosen,
  -l_discount * 100.0::DOUBLE AS ref_rejected
FROM lineitem"""),
}


def with_views(*names: str, extra: list[tuple[str, str]] = ()) -> str:
    """WITH clause holding the named views and their dependencies, in order."""
    order: list[str] = []

    def add(n):
        if n in order:
            return
        for dep in VIEWS[n][0]:
            add(dep)
        order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n][1]}\n)" for n in order] + [f"{n} AS ({q}\n)" for n, q in extra]
    return "WITH " + ",\n".join(ctes) + "\n" if ctes else ""

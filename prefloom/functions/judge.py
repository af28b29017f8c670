"""C4: parse a judge's raw text into (score, reason) with native expressions.

Rule (Python semantics kept, see README "judge parsing"):
1. the first ``{`` + non-``}`` run + ``}`` is parsed as JSON; if it is valid,
   ``score`` comes from its ``score`` key (absent -> 0) and ``reason`` from ``reason``;
   a number or boolean is taken as is, a numeric string is cast, a non-numeric
   string falls through to step 2, null/array/object is a judge error;
2. otherwise the first unsigned number in the text is the score and the first
   200 characters are the reason;
3. otherwise score 0 and a fixed reason.
Scores are clamped to [0, 10]; NaN is treated as 0 (documented deviation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.text import DIGIT, WS_CHARS, _c, is_blank, py_strip

# --- fixed values -----------------------------------------------------------
JSON_SLICE = r"\{[^}]+\}"
FIRST_NUMBER = r"(?U)\b(" + DIGIT + r"+(?:\." + DIGIT + r"+)?)\b"
FAILED_REASON = "Failed to parse judge output"
EMPTY_REASON = "Empty response"
JUDGE_ERROR_PREFIX = "Judge error: "
NOT_A_NUMBER_REASON = "Judge error: score is not a number"
REASON_CHARS = 200
SCORE_MIN, SCORE_MAX = 0.0, 10.0
# Strings Python's float() accepts (ASCII digits; '_' separators not reproduced).
NUMERIC_TEXT = (
    r"(?i)^[" + WS_CHARS + r"]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?"
    r"|inf|infinity|nan)[" + WS_CHARS + r"]*$"
)
# ---------------------------------------------------------------------------


def _clamp(x: Column) -> Column:
    x = F.when(F.isnan(x), F.lit(0.0)).otherwise(x)
    return F.least(F.greatest(x, F.lit(SCORE_MIN)), F.lit(SCORE_MAX))


def _parse_slice(sl: Column) -> Column:
    """The slice as JSON (Python-strict: single quotes invalid; bad JSON -> ``_bad``)."""
    return F.from_json(
        sl, "score STRING, reason STRING, _bad STRING",
        {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})


def _json_type(sl: Column) -> Column:
    """JSON type of the score value: VOID (null), BOOLEAN, STRING, ARRAY..., numeric;
    NULL when the key is absent or VARIANT refuses the text (e.g. duplicate keys)."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(sl), "$.score", "variant"))


def _pieces(text: Column) -> dict[str, Column]:
    """Stage 1: the JSON slice, its parse, the JSON type of ``score`` and the first number."""
    sl0 = F.regexp_extract(text, JSON_SLICE, 0)
    sl = F.when(sl0 != "", sl0)
    return {"_jt": text, "_sl": sl, "_pj": _parse_slice(sl), "_vt": _json_type(sl),
            "_num": F.regexp_extract(text, FIRST_NUMBER, 1)}


def _result(text: Column, sl: Column, parsed: Column, vtype: Column, num: Column, reason_chars: int | None = REASON_CHARS) -> tuple[Column, Column]:
    """Stage 2: score and reason from the stage-1 pieces."""
    valid = sl.isNotNull() & parsed["_bad"].isNull()
    # the JSON numbers beyond a double, and Infinity and NaN, come out of from_json in quotes
    raw = F.regexp_replace(parsed["score"], '^"(-?Infinity|NaN)"$', "$1")
    is_bool = F.coalesce(vtype == "BOOLEAN", raw.isin("true", "false"))
    is_container = F.coalesce(vtype.startswith("ARRAY") | vtype.startswith("OBJECT"), F.lit(False))
    is_null = F.coalesce(vtype == "VOID", F.lit(False))
    # strings must look like a Python float literal; so must untyped values
    needs_text_check = F.coalesce(vtype == "STRING", ~is_bool & raw.isNotNull())
    numeric_text = F.coalesce(raw.rlike(NUMERIC_TEXT), F.lit(False))
    json_score = (
        F.when(raw.isNull(), F.lit(0.0))
        .when(is_bool, F.when(F.lower(raw) == "true", 1.0).otherwise(0.0))
        .otherwise(py_strip(raw).try_cast("double"))
    )
    json_ok = valid & ~is_container & ~is_null & (~needs_text_check | numeric_text)
    json_err = valid & (is_container | is_null)
    # an absent reason is '', a JSON null reason is NULL
    has_reason = F.coalesce(F.array_contains(F.json_object_keys(sl), "reason"), F.lit(False))
    reason_json = F.when(parsed["reason"].isNull() & ~has_reason, F.lit("")).otherwise(parsed["reason"])
    score = (
        F.when(json_err, F.lit(0.0))
        .when(json_ok, _clamp(json_score))
        .when(num != "", _clamp(num.try_cast("double")))
        .otherwise(F.lit(0.0))
    )
    reason = (
        F.when(json_err, F.lit(NOT_A_NUMBER_REASON))
        .when(json_ok, reason_json)
        .when(num != "", text if reason_chars is None else F.substring(text, 1, reason_chars))
        .otherwise(F.lit(FAILED_REASON))
    )
    return score, reason


def parse_judge_output(col) -> Column:
    """C4 as one expression: ``STRUCT<score: DOUBLE, reason: STRING>``. Handy for small
    inputs; :func:`with_judge_scores` computes the same in two projections, so the JSON
    parse is not repeated inside every branch of the generated code."""
    text = F.coalesce(_c(col), F.lit(""))
    p = _pieces(text)
    score, reason = _result(text, p["_sl"], p["_pj"], p["_vt"], p["_num"])
    return F.struct(score.alias("score"), reason.alias("reason"))


def with_judge_scores(df: DataFrame, judge_text: str, response: str | None = None,
                      error: str | None = None, reason_chars: int | None = REASON_CHARS) -> DataFrame:
    """C3+C4 on a DataFrame: adds ``score`` and ``reason``.

    With ``response``: a blank candidate gets (0, 'Empty response'); with ``error``: a
    failed judgement gets (0, 'Judge error: ...'); otherwise the judge text is parsed.
    ``reason_chars``: how much of a prose judgement becomes its reason (the reference's
    200; None for all of it). The judge text itself stays in the table.
    """
    # projection 1 (generated code): the text, its JSON slice and first number, each once
    t = F.coalesce(F.col(judge_text), F.lit(""))
    sl0 = F.regexp_extract(t, JSON_SLICE, 0)
    x = df.withColumns({"_jt": t, "_num": F.regexp_extract(t, FIRST_NUMBER, 1)}) \
        .withColumn("_sl", F.when(sl0 != "", sl0))
    # projection 2: the parses of the short slice (from_json has no generated code, so it
    # stays in its own small projection)
    x = x.withColumns({"_pj": _parse_slice(F.col("_sl")), "_vt": _json_type(F.col("_sl"))})
    score, reason = _result(F.col("_jt"), F.col("_sl"), F.col("_pj"), F.col("_vt"), F.col("_num"), reason_chars)
    if error is not None:
        failed = F.col(error).isNotNull()
        score = F.when(failed, F.lit(0.0)).otherwise(score)
        reason = F.when(failed, F.concat(F.lit(JUDGE_ERROR_PREFIX), F.col(error))).otherwise(reason)
    if response is not None:
        blank = is_blank(response)
        score = F.when(blank, F.lit(0.0)).otherwise(score)
        reason = F.when(blank, F.lit(EMPTY_REASON)).otherwise(reason)
    return x.withColumns({"score": score, "reason": reason}).drop("_jt", "_sl", "_pj", "_vt", "_num")

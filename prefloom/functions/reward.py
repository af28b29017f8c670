"""The rule-based reward as one column expression (no UDF).

Terms are added in the reference's order in doubles, starting from 0.0, so the
float result is bit-equal (``3 * 0.3 = 0.8999999999999999``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.text import _c, word_count

# --- fixed values -----------------------------------------------------------
STEP_KEYWORDS = ["step", "first", "then", "next", "therefore", "so", "thus", "hence"]
STEP_WEIGHT, STEP_CAP = 0.3, 1.5
ANSWER_PHRASES = ["the answer is", "answer:", "= "]
ANSWER_BONUS = 1.5
NOTATION_CHARS = ["×", "÷", "+", "=", "²", "³"]
NOTATION_BONUS = 0.5
REPETITION_THRESHOLD, REPETITION_PENALTY = 0.5, 2.0
# length term: words in [50, 300] -> +1.0; < 20 -> -2.0; > 500 -> -0.5; else 0
LENGTH_GOOD = (50, 300)
LENGTH_SHORT, LENGTH_SHORT_TERM = 20, -2.0
LENGTH_LONG, LENGTH_LONG_TERM = 500, -0.5
# ---------------------------------------------------------------------------


def length_term(response) -> Column:
    n = word_count(F.coalesce(_c(response), F.lit("")))
    return (
        F.when(n.between(*LENGTH_GOOD), F.lit(1.0))
        .when(n < LENGTH_SHORT, F.lit(LENGTH_SHORT_TERM))
        .when(n > LENGTH_LONG, F.lit(LENGTH_LONG_TERM))
        .otherwise(F.lit(0.0))
    )


def step_term(response) -> Column:
    low = F.lower(F.coalesce(_c(response), F.lit("")))
    hits = None
    for w in STEP_KEYWORDS:
        h = low.contains(w).cast("int")
        hits = h if hits is None else hits + h
    return F.least(hits.cast("double") * F.lit(STEP_WEIGHT), F.lit(STEP_CAP))


def answer_term(response) -> Column:
    low = F.lower(F.coalesce(_c(response), F.lit("")))
    any_hit = None
    for p in ANSWER_PHRASES:
        h = low.contains(p)
        any_hit = h if any_hit is None else any_hit | h
    return F.when(any_hit, F.lit(ANSWER_BONUS)).otherwise(F.lit(0.0))


def notation_term(response) -> Column:
    r = F.coalesce(_c(response), F.lit(""))
    any_hit = None
    for ch in NOTATION_CHARS:
        h = r.contains(ch)
        any_hit = h if any_hit is None else any_hit | h
    return F.when(any_hit, F.lit(NOTATION_BONUS)).otherwise(F.lit(0.0))


def repetition_term(response) -> Column:
    """``split('.')`` keeps empty parts (trailing included); parts are not stripped."""
    parts = F.split(F.coalesce(_c(response), F.lit("")), r"\.", -1)
    ratio = F.size(F.array_distinct(parts)).cast("double") / F.greatest(F.size(parts), F.lit(1)).cast("double")
    return F.when(ratio < F.lit(REPETITION_THRESHOLD), F.lit(-REPETITION_PENALTY)).otherwise(F.lit(0.0))


def heuristic_reward(response) -> Column:
    """((((0.0 + length) + step) + answer) + notation) + repetition, in doubles."""
    r = F.lit(0.0) + length_term(response)
    r = r + step_term(response)
    r = r + answer_term(response)
    r = r + notation_term(response)
    return r + repetition_term(response)

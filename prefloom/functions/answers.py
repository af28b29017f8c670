"""Answer and ground-truth extraction as native regex expressions.

Python's ``\\d`` and ``\\s`` on ``str`` are Unicode classes; they are written as
``\\p{Nd}`` and the explicit whitespace class so Spark (Java) and the oracle (RE2)
read the same pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.text import DIGIT, WS, WS_CHARS, _c, py_strip

_NUM = "([+-]?" + DIGIT + "[" + DIGIT + ",]*\\.?" + DIGIT + "*)"
_SEP = "[:" + WS_CHARS + "]*"

# --- fixed values -----------------------------------------------------------
# The five answer patterns, tried in this order; the first match of the first
# pattern that hits wins.
ANSWER_PATTERNS = [
    "[Tt]he answer is" + _SEP + _NUM,
    "####" + WS + "*" + _NUM,
    "[Aa]nswer" + _SEP + _NUM,
    "=" + WS + "*" + _NUM + WS + "*$",
    "(" + DIGIT + "[" + DIGIT + ",]*\\.?" + DIGIT + "*)" + WS + "*$",
]
# Ground truth: text after '####' to the end of that line (Python re.MULTILINE).
GROUND_TRUTH = "(?md)####" + WS + "*(.+)$"
# ---------------------------------------------------------------------------


def _hit(text: Column, pattern: str) -> Column:
    # the captured group always starts with a digit, so '' means "no match"
    v = F.regexp_extract(text, pattern, 1)
    return F.when(v != "", v)


def extract_answer(col) -> Column:
    """First hit of the five patterns, commas removed; NULL when none hits."""
    text = _c(col)
    return F.replace(F.coalesce(*[_hit(text, p) for p in ANSWER_PATTERNS]), F.lit(","), F.lit(""))


def answer_pattern(col) -> Column:
    """Index (1..5) of the pattern that produced the answer, NULL when none."""
    text = _c(col)
    out = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(ANSWER_PATTERNS, start=1))):
        out = F.when(text.rlike(p), F.lit(i)).otherwise(out)
    return out


def extract_ground_truth(col) -> Column:
    """Text after ``####`` to end of line, stripped, commas removed; else ''."""
    v = F.regexp_extract(F.coalesce(_c(col), F.lit("")), GROUND_TRUTH, 1)
    return F.replace(py_strip(v), F.lit(","), F.lit(""))

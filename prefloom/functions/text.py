"""Column helpers for the text rules every stage depends on.

The rules are Python's: ``str.split()``/``str.strip()`` whitespace and ``re``'s
``\\s``/``\\d`` on ``str``. The whitespace set is stated once as code-point ranges;
from it we derive (a) a character list for ``translate``/``btrim``, which handle the
hot paths (strip, collapse, word count) without a regex, and (b) a regex class spelled
with ``\\x{..}`` that reads the same in Java regex (Spark) and RE2 (the DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Code points for which Python's str.isspace() is true (= re's \s on str).
WS_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
# Control characters removed by clean_text after the whitespace collapse.
CTRL_RANGES = [(0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x7F)]
# Curly quotes and their straight replacements.
CURLY_QUOTES = "“”‘’"
STRAIGHT_QUOTES = "\"\"''"
# Keywords that mark a reasoning response (substring test on lower-cased text).
REASONING_WORDS = ["step", "first", "then", "therefore"]
# ---------------------------------------------------------------------------


def _chars(ranges) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1))


def _klass(ranges) -> str:
    return "".join(f"\\x{{{a:02x}}}" if a == b else f"\\x{{{a:02x}}}-\\x{{{b:02x}}}" for a, b in ranges)


WS_LIST = _chars(WS_RANGES)            # for translate / btrim
WS_SPACES = " " * len(WS_LIST)
CTRL_LIST = _chars(CTRL_RANGES)
WS_CHARS = _klass(WS_RANGES)           # regex class body
WS = "[" + WS_CHARS + "]"
WS_RUN = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]+"  # the same set by category, which Java tests faster
NON_WS = "[^" + WS_CHARS + "]"
CTRL_CLASS = "[" + _klass(CTRL_RANGES) + "]"
DIGIT = r"\p{Nd}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing characters of the whitespace set."""
    return F.btrim(_c(col), F.lit(WS_LIST))


def spaces_only(col) -> Column:
    """Every whitespace character replaced by ' ' (length preserved)."""
    return F.translate(_c(col), WS_LIST, WS_SPACES)


def collapse_ws(col) -> Column:
    """``re.sub(r'\\s+', ' ', text)``."""
    return F.regexp_replace(spaces_only(col), "  +", " ")


def clean_text(col) -> Column:
    """Falsy -> ''; collapse whitespace runs to one space and strip; then drop
    control characters (no second collapse); then straighten curly quotes."""
    s = collapse_ws(F.coalesce(_c(col), F.lit("")))
    # after the collapse the only whitespace left is ' ', so strip == trim(' ')
    s = F.btrim(s, F.lit(" "))
    s = F.translate(s, CTRL_LIST, "")          # no counterpart -> deleted
    return F.translate(s, CURLY_QUOTES, STRAIGHT_QUOTES)


def tokens(col) -> Column:
    """``text.split()`` as an array of strings."""
    t = F.btrim(spaces_only(F.coalesce(_c(col), F.lit(""))), F.lit(" "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " +", -1))


def words(col) -> Column:
    """The words of :func:`tokens`, split once and without the copies that ``translate`` makes:
    for long columns of whole texts."""
    t = py_strip(F.coalesce(_c(col), F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RUN, -1))


def word_count(col) -> Column:
    """``len(text.split())``."""
    return F.size(tokens(col)).cast("bigint")


def is_blank(col) -> Column:
    """True when ``text.strip()`` is empty (NULL counts as blank)."""
    return F.coalesce(py_strip(col) == "", F.lit(True))


def contains_any(col, words) -> Column:
    c = _c(col)
    out = None
    for w in words:
        t = c.contains(w)
        out = t if out is None else (out | t)
    return out


def has_reasoning(col) -> Column:
    """Lower-cased text contains any reasoning keyword (substring, not word)."""
    return F.coalesce(contains_any(F.lower(_c(col)), REASONING_WORDS), F.lit(False))


def dedup_key(col) -> Column:
    """D1 key: md5 of ``text.strip().lower()`` (UTF-8)."""
    return F.md5(F.lower(py_strip(col)))


def basename(col) -> Column:
    """``os.path.basename`` for '/'-separated paths."""
    return F.element_at(F.split(_c(col), "/", -1), -1)

"""G9's near form and G8's sketch: nearly identical texts under different prompts, estimated
distinct n-grams (registered on import)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.operators import runs as G
from prefloom.operators.near import near_mode_collapse
from prefloom.plans import fixtures as FX
from prefloom.plans import oracle as O
from prefloom.plans.registry import _RESP_BY_BETA, _responses_by_beta, query


def _near_sql(source: str) -> str:
    """All pairs of distinct texts of a group that share a shingle, over (grp, prompt_id, response)."""
    key = f"md5(lower({O.strip(f'regexp_replace(response, {O.lit(O.WS + chr(43))}, chr(32), chr(103))')}))"
    return f""", n0 AS (SELECT grp, {key} AS h, count(*) AS n, min(prompt_id) AS lo, max(prompt_id) AS hi,
    regexp_extract_all(lower(coalesce(min(response), '')), {O.lit(O.NON_WS + '+')}) AS w FROM ({source}) r GROUP BY ALL),
s0 AS (SELECT DISTINCT grp, h, lo, hi, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM n0 WHERE len(w) > 0) x),
m0 AS (SELECT grp, h, count(*) AS m FROM s0 GROUP BY ALL),
p0 AS (SELECT a.grp, a.h, b.h AS other, count(*) AS c FROM s0 a JOIN s0 b ON a.grp = b.grp AND a.k = b.k AND a.h <> b.h
       WHERE least(a.lo, b.lo) <> greatest(a.hi, b.hi) GROUP BY ALL),
h0 AS (SELECT DISTINCT p0.grp, p0.h FROM p0 JOIN m0 a ON a.grp = p0.grp AND a.h = p0.h JOIN m0 b ON b.grp = p0.grp AND b.h = other
       WHERE 100 * c >= 80 * (a.m + b.m - c))
SELECT n0.grp AS "group", CAST(sum(n) AS BIGINT) AS responses, CAST(sum(CASE WHEN lo <> hi OR h0.h IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS collapsed,
  round(sum(CASE WHEN lo <> hi OR h0.h IS NOT NULL THEN n ELSE 0 END) / sum(n), 9) AS mode_collapse
FROM n0 LEFT JOIN h0 ON h0.grp = n0.grp AND h0.h = n0.h GROUP BY n0.grp"""


@query("mode_collapse_near", O.with_views("candidates_v", extra=[_RESP_BY_BETA]).rstrip() + _near_sql("SELECT grp, prompt_id, response FROM resp_v"), digits=9)
def q_mode_collapse_near(spark, d):
    return near_mode_collapse(_responses_by_beta(spark, d), by=("group",))


@query("mode_collapse_documents", O.with_views("documents_v").rstrip() + _near_sql("SELECT lang AS grp, doc_id AS prompt_id, text AS response FROM documents_v"), digits=9)
def q_mode_collapse_documents(spark, d):
    """Every document as the answer to a prompt of its own, by language: exact and near copies."""
    docs = FX.documents(spark, d).select(F.col("lang").alias("group"), F.col("doc_id").alias("prompt_id"), F.col("text").alias("response"))
    return near_mode_collapse(docs, by=("group",))


@query("distinct_n_sketch", O.with_views("documents_v").rstrip() + f"""
SELECT lang AS "group", count(*) AS ngrams, true AS within_bound
FROM (SELECT lang, regexp_extract_all(coalesce(text, ''), {O.lit(O.NON_WS + '+')}) AS toks FROM documents_v) t, range(1, len(toks) - 2) r(i) GROUP BY lang""")
def q_distinct_n_sketch(spark, d):
    """G8 by sketches of every (language, source), merged by language, held against the exact counts."""
    docs = FX.documents(spark, d).select(F.col("lang").alias("group"), "source", F.col("text").alias("response"))
    parts = G.distinct_n_sketch(docs, by=("group", "source"))
    found = G.distinct_n_estimate(G.merge_sketches(parts)).select("group", "ngrams", F.col("distinct_ngrams").alias("estimate"))
    exact = G.distinct_n(docs, hashed=True).select("group", "distinct_ngrams")
    near = F.abs(F.col("estimate") - F.col("distinct_ngrams")) <= F.lit(G.sketch_error()) * F.col("distinct_ngrams")
    return found.join(exact, "group").select("group", "ngrams", near.alias("within_bound"))

"""Fan-out, the user's generation/judge hooks, judge parsing and attaching scores.

Model calls are functions the caller passes in; they run inside ``mapInPandas`` on
Arrow batches (one model load per Python worker, cached by the caller's function).
Their output should be written (:func:`prefloom.sources.sinks.persist`) before it is
used, so a task retry or a second action never calls the model again.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.functions.judge import JUDGE_ERROR_PREFIX, with_judge_scores
from prefloom.functions.text import is_blank


def fan_out(prompts: DataFrame, n: int = 4, key: str = "ord") -> DataFrame:
    """N generation requests per prompt -> (prompt_id, cand_idx, ...)."""
    return prompts.select(
        F.col(key).alias("prompt_id"), "prompt",
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cand_idx"),
    )


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Rows dealt evenly over ``partitions`` tasks before slow model calls, by default over
    all cores of the session: an input that was read as one file (a JSON array) would
    otherwise be served by one worker. 0 leaves the input's partitions as they are."""
    if partitions == 0:
        return df
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)


def generate_candidates(requests: DataFrame, fn: Callable[..., list[str]],
                        partitions: int | None = None, indexed: bool = False) -> DataFrame:
    """Run ``fn(prompts) -> responses`` per Arrow batch (stripped output), with ``indexed``
    ``fn(prompts, cand_idx)``: a model that draws its candidates by a seed needs to know which one
    it is. When a batch fails, its rows are tried one by one, so the model may see a prompt twice;
    a row that fails again has response '' and its message in ``error``.

    ``partitions``: see :func:`spread`.
    """
    df = spread(requests, partitions)
    call = fn if indexed else lambda prompts, _: fn(prompts)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            prompts = pdf["prompt"].fillna("").tolist()
            which = pdf["cand_idx"].tolist() if indexed else [None] * len(prompts)
            errs: list[str | None] = [None] * len(prompts)
            try:
                out = [("" if r is None else str(r)).strip() for r in call(prompts, which)]
                if len(out) != len(prompts):
                    raise ValueError("model returned a different number of outputs")
            except Exception:
                out = []
                for i, (p, k) in enumerate(zip(prompts, which, strict=True)):
                    try:
                        out.append(("" if (r := call([p], [k])[0]) is None else str(r)).strip())
                    except Exception as e:
                        out.append("")
                        errs[i] = str(e) or type(e).__name__
            yield pdf.assign(response=out, error=errs)

    schema = T.StructType([*df.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
    return df.mapInPandas(run, schema)


def judge_candidates(cands: DataFrame, fn: Callable[[list[str], list[str]], list[str]],
                     partitions: int | None = None) -> DataFrame:
    """Blank candidates skip the judge (score 0, 'Empty response'); the judge's raw
    text is parsed natively (C4); a judge failure gives score 0 and 'Judge error: ...'.

    The blank filter is written before ``mapInPandas`` on purpose: Catalyst does not
    push predicates through a Python operator.
    """
    blank = cands.where(is_blank("response")).withColumns(
        {"judge_text": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    todo = spread(cands.where(~is_blank("response")), partitions)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ps = pdf["prompt"].fillna("").tolist()
            rs = pdf["response"].fillna("").tolist()
            texts, errs = [], []
            try:
                texts = [None if t is None else str(t) for t in fn(ps, rs)]
                if len(texts) != len(rs):
                    raise ValueError("judge returned a different number of outputs")
                errs = [None] * len(texts)
            except Exception:
                texts, errs = [], []
                for p, r in zip(ps, rs):
                    try:
                        texts.append(str(fn([p], [r])[0]))
                        errs.append(None)
                    except Exception as e:  # isolated per candidate
                        texts.append(None)
                        errs.append(str(e) or type(e).__name__)
            yield pdf.assign(judge_text=texts, error=errs)

    schema = T.StructType(todo.schema.fields + [T.StructField("judge_text", T.StringType()),
                                                T.StructField("error", T.StringType())])
    judged = todo.mapInPandas(run, schema).unionByName(blank)
    return with_judge_scores(judged, "judge_text", response="response", error="error")


def attach_scores(cands: DataFrame, scores: DataFrame, keys=("prompt_id", "cand_idx")) -> DataFrame:
    """Positional pairing becomes an inner equi-join on (prompt_id, cand_idx);
    candidates without a score (the shorter list) drop out, as ``zip`` truncates."""
    return cands.join(scores, list(keys), "inner")


__all__ = ["fan_out", "generate_candidates", "judge_candidates", "attach_scores", "attach_scores_arrays",
           "JUDGE_ERROR_PREFIX"]


def attach_scores_arrays(df: DataFrame, candidates: str = "candidates", scores: str = "scores",
                         keep=("prompt_id", "prompt")) -> DataFrame:
    """C5 for list-shaped input (one row per prompt with parallel arrays): positional
    pairing truncated to the shorter list, as ``zip`` does (``arrays_zip`` alone pads
    with NULLs to the longer one). Output is the long table ``keep..., cand_idx,
    response, score, reason``; ``scores`` is ``ARRAY<STRUCT<score, reason>>``."""
    n = F.least(F.size(candidates), F.size(scores))
    z = F.slice(F.arrays_zip(F.col(candidates).alias("c"), F.col(scores).alias("s")), 1, n)
    return df.select(*keep, F.posexplode(z).alias("cand_idx", "z")).select(
        *keep, F.col("cand_idx").cast("int").alias("cand_idx"), F.col("z.c").alias("response"),
        F.col("z.s.score").cast("double").alias("score"), F.col("z.s.reason").alias("reason"))

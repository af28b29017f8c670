"""Cleaning, dedup, filters, validation and format conversion.

Everything is a projection or predicate fused into whole-stage codegen, except
:func:`deduplicate`: one narrow aggregation by the md5 key and one join on the ordinal.
Column choice by presence (``example.get(a, example.get(b))``) is decided at plan
time from ``df.columns``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.functions import templates as tpl
from prefloom.functions.text import NON_WS, clean_text, dedup_key, py_strip

# --- fixed values -----------------------------------------------------------
PROMPT_BOUNDS = (10, 1024)      # inclusive, code points
RESPONSE_BOUNDS = (20, 2048)    # inclusive, code points
CLEAN_COLUMNS = ["prompt", "chosen", "rejected"]
DPO_FIELDS = ["prompt", "chosen", "rejected"]
DEFAULT_CATEGORY = "unknown"
GENERATED_ID_PREFIX = "gen_"
# ---------------------------------------------------------------------------


def pick(df: DataFrame, *names: str, default=None) -> Column:
    """First of ``names`` that exists as a column (presence, not NULL); else ``default`` or ''."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(default if default is not None else "")


def clean_columns(df: DataFrame, cols=CLEAN_COLUMNS) -> DataFrame:
    """clean_text on whichever of the columns exist."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: clean_text(c) for c in present}) if present else df


def first_rows(keys: DataFrame, order: str = "ord", key: str = "_key") -> DataFrame:
    """(key, _first): each key's least ordinal, from a table that has the key as a column."""
    return keys.groupBy(key).agg(F.min(order).alias("_first"))


def deduplicate(df: DataFrame, key: str = "prompt", order: str = "ord", unique_order: bool = True) -> DataFrame:
    """key = md5(strip(key).lower()); the first row in input order wins.

    The winners' ordinals come from a narrow aggregation (key and ``order`` only, reduced
    on every map task, so a key with a third of all rows is one row per task); the rows
    meet them by an equi-join. No text is sorted, and a key is computed once per row: the readers'
    ordinal is unique, so the other side of the join needs no key. For an order that
    repeats between keys, or is NULL, pass ``unique_order=False``: the join then compares keys too.
    """
    if unique_order:
        first = first_rows(df.select(dedup_key(key).alias("_key"), F.col(order)), order)
        return df.join(first.select(F.col("_first").alias(order)), order, "left_semi").select(*df.columns)
    keyed = df.withColumn("_key", dedup_key(key))
    first = first_rows(keyed.select("_key", order), order).withColumnRenamed("_key", "_k")
    same = keyed["_key"].eqNullSafe(first["_k"]) & keyed[order].eqNullSafe(first["_first"])
    return keyed.join(first, same, "left_semi").drop("_key")


def length_ok(df: DataFrame, prompt_bounds=PROMPT_BOUNDS, response_bounds=RESPONSE_BOUNDS,
              prompt_col: str = "prompt") -> Column:
    """F1 predicate; response bounds apply only when a ``chosen`` column exists."""
    cond = F.length(F.col(prompt_col)).between(*prompt_bounds)
    if "chosen" in df.columns:
        cond = cond & F.length("chosen").between(*response_bounds) & F.length("rejected").between(*response_bounds)
    return F.coalesce(cond, F.lit(False))


def filter_by_length(df: DataFrame, prompt_bounds=PROMPT_BOUNDS, response_bounds=RESPONSE_BOUNDS,
                     prompt_col: str = "prompt") -> DataFrame:
    """inclusive code-point bounds."""
    return df.where(length_ok(df, prompt_bounds, response_bounds, prompt_col))


def _truthy(df: DataFrame, name: str) -> Column:
    """Python truthiness of a value followed by ``str(v).strip() != ''``."""
    c = F.col(name)
    dt = df.schema[name].dataType
    if isinstance(dt, T.StringType):
        return c.rlike(NON_WS)
    if isinstance(dt, T.BooleanType):
        return c
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return F.size(c) > 0
    if isinstance(dt, T.NumericType):
        return c != 0
    return c.isNotNull()


def valid_format(df: DataFrame, fields) -> Column:
    """F2 predicate: every field present, truthy and non-blank."""
    if any(f not in df.columns for f in fields):
        return F.lit(False)
    cond = F.lit(True)
    for f in fields:
        cond = cond & F.coalesce(_truthy(df, f), F.lit(False))
    return cond


def validate_format(df: DataFrame, fields=DPO_FIELDS) -> DataFrame:
    """F2."""
    return df.where(valid_format(df, fields))


def require_columns(df: DataFrame, cols=DPO_FIELDS) -> DataFrame:
    """raise if a required column is absent (plan-time check, no action)."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"Dataset must contain columns: {sorted(cols)}; missing {missing}")
    return df


def stage_flags(df: DataFrame, key: str = "prompt", order: str = "ord", prompt_bounds=PROMPT_BOUNDS,
                response_bounds=RESPONSE_BOUNDS, fields=DPO_FIELDS) -> dict[str, Column]:
    """What the stages D1, F1 and F2 decide by, each computed once per row: the key, the
    order, and whether the row is in bounds (``_len``) and valid (``_valid``)."""
    return {"_key": dedup_key(key), "_order": F.col(order), "_len": length_ok(df, prompt_bounds, response_bounds, key),
            "_valid": valid_format(df, fields)}


def flags_report(flags: DataFrame) -> DataFrame:
    """F5 from a table of :func:`stage_flags`: one aggregation by key (count, and the flags of
    the row that D1 keeps), then one over the keys."""
    kept = F.min(F.struct(F.col("_order").isNull(), "_order", "_len", "_valid")).alias("_kept")
    keys = flags.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), kept)
    ok, valid = F.col("_kept._len"), F.col("_kept._valid")
    a = keys.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n0"), F.count(F.lit(1)).alias("n1"),
                 F.count_if(ok).alias("n2"), F.count_if(ok & valid).alias("n3"))

    def stage(no, name, a_in, a_out):
        return F.struct(F.lit(no).alias("stage_no"), F.lit(name).alias("stage"),
                        F.col(a_in).alias("rows_in"), F.col(a_out).alias("rows_out"))

    stages = F.array(stage(1, "dedup", "n0", "n1"), stage(2, "length", "n1", "n2"), stage(3, "validate", "n2", "n3"))
    return a.select(F.inline(stages)).select(
        "stage_no", "stage", "rows_in", "rows_out",
        (F.col("rows_in") - F.col("rows_out")).alias("removed"),
        F.when(F.col("rows_in") > 0, (F.col("rows_in") - F.col("rows_out")) / F.col("rows_in") * 100.0)
        .otherwise(0.0).alias("removed_pct"),
    )


def filter_report(df: DataFrame, key: str = "prompt", order: str = "ord",
                  prompt_bounds=PROMPT_BOUNDS, response_bounds=RESPONSE_BOUNDS, fields=DPO_FIELDS) -> DataFrame:
    """rows in/out and removed percent for dedup -> length -> validate, from one scan of
    the input (its ordinals are unique, as D1's)."""
    return flags_report(df.select(*[c.alias(n) for n, c in stage_flags(df, key, order, prompt_bounds, response_bounds, fields).items()]))


# --- format conversion -------------------------------------------------------

def format_for_sft(df: DataFrame) -> DataFrame:
    """question/answer by presence; adds ``text`` and ``messages``, keeps other columns."""
    q = pick(df, "question", "prompt")
    a = pick(df, "answer", "response")
    return df.withColumns({"text": tpl.sft_text(q, a), "messages": tpl.sft_messages(q, a)})


def format_chatml(df: DataFrame, keep=()) -> DataFrame:
    """ChatML text only (``keep`` lets a caller carry a key, e.g. for the split)."""
    return df.select(*keep, tpl.chatml_text(F.col("question"), F.col("answer")).alias("text"))


def format_for_dpo(df: DataFrame) -> DataFrame:
    """No-op when prompt/chosen/rejected exist; else mapped by presence, others kept."""
    if all(c in df.columns for c in DPO_FIELDS):
        return df
    return df.withColumns({
        "prompt": pick(df, "prompt", "question"),
        "chosen": pick(df, "chosen", "chosen_response"),
        "rejected": pick(df, "rejected", "rejected_response"),
    })


def format_for_ppo(df: DataFrame) -> DataFrame:
    """``query`` = instruction prefix + (prompt else question); others kept."""
    return df.withColumn("query", tpl.instruction(pick(df, "prompt", "question")))


def online_prompts(df: DataFrame, name: str = "prompt") -> DataFrame:
    """P10: only the prefixed question, named ``prompt`` (new API) or ``query`` (legacy)."""
    return df.select(tpl.instruction(F.col("question")).alias(name))


def ensure_instruction(df: DataFrame) -> DataFrame:
    """Prefix the prompt unless it starts with 'Solve' (case-sensitive)."""
    p = F.col("prompt")
    return df.withColumn("prompt", F.when(p.startswith(tpl.INSTRUCTION_MARKER), p).otherwise(tpl.instruction(p)))


def rename_preference(df: DataFrame) -> DataFrame:
    """Instruction -> prompt (else prompt), chosen, rejected."""
    return df.select(pick(df, "instruction", "prompt").alias("prompt"),
                     pick(df, "chosen").alias("chosen"), pick(df, "rejected").alias("rejected"))


def normalize_response(col) -> Column:
    """P13, message lists: the last message's content, stripped. See
    :func:`with_normalized_response` for the other forms."""
    c = F.col(col) if isinstance(col, str) else col
    return py_strip(F.element_at(c, -1)["content"])


def with_normalized_response(df: DataFrame, col: str, out: str = "response") -> DataFrame:
    """P13 by the column's type: a list of messages (structs or maps with ``content``)
    gives the last one's content, any other list its last item as text, a plain value its
    text; then strip."""
    dt, c = df.schema[col].dataType, F.col(col)
    if isinstance(dt, T.ArrayType):
        item, last = dt.elementType, F.try_element_at(c, F.lit(-1))
        if isinstance(item, T.StructType) and "content" in item.names:
            c = last["content"]
        elif isinstance(item, T.MapType):
            c = F.try_element_at(last, F.lit("content"))
        else:
            c = last
    return df.withColumn(out, py_strip(c.cast("string")))


def default_identity(df: DataFrame, order: str = "ord") -> DataFrame:
    """Missing id -> 'gen_{1-based ordinal}', missing category -> 'unknown'."""
    gen = F.concat(F.lit(GENERATED_ID_PREFIX), (F.col(order) + 1).cast("string"))
    idc = F.coalesce(F.col("id").cast("string"), gen) if "id" in df.columns else gen
    cat = F.coalesce(F.col("category"), F.lit(DEFAULT_CATEGORY)) if "category" in df.columns else F.lit(DEFAULT_CATEGORY)
    return df.withColumns({"id": idc, "category": cat})

"""Fixed prompt texts and chat-message builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.text import _c

# --- fixed values -----------------------------------------------------------
GENERATION_SYSTEM = (
    "You are a helpful math tutor. Solve the problem step by step, showing all work clearly. "
    "End with 'The answer is: [final answer]'."
)
JUDGE_SYSTEM = (
    "You are a math reasoning evaluator. Score the given response to a math problem on a scale of 1-10.\n"
    "\n"
    "Scoring criteria:\n"
    "- Correctness (0-4 points): Is the final answer correct?\n"
    "- Reasoning (0-3 points): Are the intermediate steps logical and clear?\n"
    "- Completeness (0-2 points): Are all steps shown?\n"
    "- Clarity (0-1 point): Is the explanation easy to follow?\n"
    "\n"
    'Respond with ONLY a JSON object: {"score": <number>, "reason": "<brief explanation>"}'
)
JUDGE_USER_HEAD = "Math Problem: "
JUDGE_USER_MID = "\n\nResponse to evaluate:\n"
JUDGE_USER_TAIL = '\n\nEvaluate this response. Respond with ONLY a JSON: {"score": <1-10>, "reason": "<explanation>"}'
EVAL_SYSTEM = "You are a helpful math tutor. Solve step by step. End with 'The answer is: [answer]'."
SFT_SYSTEM = "You are a helpful math tutor. Solve problems step by step."
SFT_TEXT_QUESTION = "### Question:\n"
SFT_TEXT_ANSWER = "\n\n### Answer:\n"
CHATML_SYSTEM = "You are a helpful math tutor."
CHATML_START = "<|im_start|>"
CHATML_END = "<|im_end|>"
INSTRUCTION_PREFIX = "Solve the following math problem step by step:\n\n"
INSTRUCTION_MARKER = "Solve"
SCORING_SEPARATOR = "\n\n"
# ---------------------------------------------------------------------------


def message(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), _c(content).cast("string").alias("content"))


def generation_messages(prompt) -> Column:
    """System (tutor) + user."""
    return F.array(message("system", F.lit(GENERATION_SYSTEM)), message("user", prompt))


def judge_user_text(prompt, response) -> Column:
    """P4 user turn. ``concat``, not a format string: the texts may hold ``%`` or braces."""
    return F.concat(F.lit(JUDGE_USER_HEAD), F.coalesce(_c(prompt), F.lit("")), F.lit(JUDGE_USER_MID),
                    F.coalesce(_c(response), F.lit("")), F.lit(JUDGE_USER_TAIL))


def judge_messages(prompt, response) -> Column:
    """Judge system prompt + filled user template."""
    return F.array(message("system", F.lit(JUDGE_SYSTEM)), message("user", judge_user_text(prompt, response)))


def eval_messages(question) -> Column:
    """P5: evaluation system prompt + user."""
    return F.array(message("system", F.lit(EVAL_SYSTEM)), message("user", question))


def sft_messages(question, answer) -> Column:
    return F.array(message("system", F.lit(SFT_SYSTEM)), message("user", question), message("assistant", answer))


def sft_text(question, answer) -> Column:
    """P6 text form without a tokenizer template (NULL renders as '')."""
    return F.concat(F.lit(SFT_TEXT_QUESTION), F.coalesce(_c(question), F.lit("")), F.lit(SFT_TEXT_ANSWER),
                    F.coalesce(_c(answer), F.lit("")))


def chatml_text(question, answer) -> Column:
    """P7 ChatML fallback text."""
    return F.concat(
        F.lit(f"{CHATML_START}system\n{CHATML_SYSTEM}{CHATML_END}\n{CHATML_START}user\n"),
        F.coalesce(_c(question), F.lit("")),
        F.lit(f"{CHATML_END}\n{CHATML_START}assistant\n"),
        F.coalesce(_c(answer), F.lit("")),
        F.lit(CHATML_END),
    )


def instruction(prompt) -> Column:
    """P9/P10 prefix."""
    return F.concat(F.lit(INSTRUCTION_PREFIX), F.coalesce(_c(prompt), F.lit("")))


def scoring_text(query, response) -> Column:
    """``query + "\\n\\n" + response``."""
    return F.concat(F.coalesce(_c(query), F.lit("")), F.lit(SCORING_SEPARATOR), F.coalesce(_c(response), F.lit("")))

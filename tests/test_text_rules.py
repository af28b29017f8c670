"""Goldens (FIXTURES §3) and randomised checks of the native text expressions against
plain-Python statements of the same rules."""


from hypothesis import given, settings
from hypothesis import strategies as st

from prefloom.functions.answers import extract_answer, extract_ground_truth
from prefloom.functions.judge import parse_judge_output, with_judge_scores
from prefloom.functions.reward import heuristic_reward
from prefloom.functions.text import clean_text, dedup_key, has_reasoning, is_blank, py_strip, word_count

WS_SAMPLE = [chr(c) for c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2005,
                                0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
NOT_WS = [chr(0x200B), chr(0x180E), chr(0xFEFF)]   # zero-width and similar: not whitespace in Python
ALPHABET = list("ab1 ,.x=+") + WS_SAMPLE + NOT_WS + ["\x00", "\x07", "\x7f", "“", "”", "‘", "’", "😀", "é"]


def one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.select(expr("v").alias("o"), "i").orderBy("i").select("o").collect()]


# --- independent Python statements of the rules ---------------------------------------

def expect_clean(t):
    if not t:
        return ""
    t = " ".join(t.split())            # collapse runs of whitespace, strip
    t = "".join(ch for ch in t if not (ord(ch) <= 8 or ord(ch) in (11, 12) or 14 <= ord(ch) <= 31 or ord(ch) == 127))
    return t.translate(str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"}))


def test_clean_goldens(spark):
    vals = ["  a\n\tb  ", "a \x00 b", "\x00 a", "a\x0bb", "“q” ‘r’", None]
    assert one(spark, clean_text, vals) == ["a b", "a  b", " a", "a b", "\"q\" 'r'", ""]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=20), min_size=1, max_size=60))
def test_text_rules_random(spark, texts):
    assert one(spark, clean_text, texts) == [expect_clean(t) for t in texts]
    assert one(spark, word_count, texts) == [len(t.split()) for t in texts]
    assert one(spark, py_strip, texts) == [t.strip() for t in texts]
    assert one(spark, is_blank, texts) == [not t.strip() for t in texts]


def test_dedup_key_and_reasoning(spark):
    import hashlib

    vals = ["  Hello World \n", "Then we go", "also solve"]
    assert one(spark, dedup_key, vals) == [hashlib.md5(v.strip().lower().encode()).hexdigest() for v in vals]
    assert one(spark, has_reasoning, vals + ["Step 1", "nothing"]) == [False, True, False, True, False]


# --- judge parsing ---------------------------------------------------------------------

JUDGE_GOLDEN = [
    ('{"score": 8, "reason": "ok"}', 8.0, "ok"),
    ('Sure: {"score": "8"} done', 8.0, ""),
    ('{"score": 15}', 10.0, ""),
    ('{"score": -3}', 0.0, ""),
    ('{"reason": "x"}', 0.0, "x"),
    ('{"score": true}', 1.0, ""),
    ('{"score": null}', 0.0, "Judge error: score is not a number"),
    ("{'score': 7}", 7.0, "{'score': 7}"),
    ('{"score": "8/10"}', 8.0, '{"score": "8/10"}'),
    ("Score: -5 of 10", 5.0, "Score: -5 of 10"),
    ("{}", 0.0, "Failed to parse judge output"),
    ("great", 0.0, "Failed to parse judge output"),
    ("", 0.0, "Failed to parse judge output"),
    ('{"score": 1, "score": 2}', 2.0, ""),
    ('{"score": [1]}', 0.0, "Judge error: score is not a number"),
    ('{"score": " 7 "}', 7.0, ""),
    ('{"score": 08}', 8.0, '{"score": 08}'),
]


def test_judge_goldens(spark):
    texts = [t for t, _, _ in JUDGE_GOLDEN]
    got = one(spark, parse_judge_output, texts)
    assert [(r.score, r.reason) for r in got] == [(s, r) for _, s, r in JUDGE_GOLDEN]


def test_judge_staged_equals_expression(spark):
    df = spark.createDataFrame([(i, t, "resp", None) for i, (t, _, _) in enumerate(JUDGE_GOLDEN)],
                               "i int, t string, response string, error string")
    staged = with_judge_scores(df, "t", response="response", error="error").orderBy("i").collect()
    assert [(r.score, r.reason) for r in staged] == [(s, r) for _, s, r in JUDGE_GOLDEN]


def test_judge_blank_and_error(spark):
    df = spark.createDataFrame([(" \n", '{"score": 9}', None), ("ok", None, "boom")],
                               "response string, t string, error string")
    out = with_judge_scores(df, "t", response="response", error="error").collect()
    assert [(r.score, r.reason) for r in out] == [(0.0, "Empty response"), (0.0, "Judge error: boom")]


# --- answer extraction -----------------------------------------------------------------

def test_extract_goldens(spark):
    vals = ["The answer is: 42", "The answer is: 42.", "the answer is 1,234 apples", "The answer is $42", "#### -7",
            "so x = -5", "it is -5", "none", "x = 5\n"]
    assert one(spark, extract_answer, vals) == ["42", "42.", "1234", "42", "-7", "-5", "5", None, "5"]
    gts = ["a\n#### 1,000\nq", "####\n 7 \nq", "no mark", "x\r\n#### 12\r\n"]
    assert one(spark, extract_ground_truth, gts) == ["1000", "7", "", "12"]


# (text, answer) by hand: each pattern, the order between them, signs, commas, points, blanks
ANSWERS = [
    ("The answer is 12", "12"), ("the answer is: -3.5 m", "-3.5"), ("The answer is:\n\n+7", "+7"), ("The answer is:: 8", "8"),
    ("THE ANSWER IS 9", "9"), ("The answer is x, answer: 4", "4"), ("#### 15", "15"), ("####-2", "-2"), ("#### +1,000,000.25 dollars", "+1000000.25"),
    ("### 15 apples", None), ("Answer 6 of them", "6"), ("My answer:\t-20%", "-20"), ("Answers: 3", "3"), ("Answer is 5 or so", None),
    ("answer = 5", "5"), ("x = -41", "-41"), ("x = 4 \n\n", "4"), ("x = 4 m", None), ("a = 1, b = 2", "2"), ("x =\u00a07\u00a0", "7"),
    ("so we get 1,234", "1234"), ("it costs $ 5.75", "5.75"), ("it is -5", "5"), ("it is 5.", "5."), ("5 apples", None), ("", None), ("no number", None),
    ("The answer is 1. #### 2", "1."), ("#### 2 and the answer is 1", "1"), ("#### 2 and the ANSWER is 1", "2"), ("Answer: 3 = 4", "3"),
    ("x = 5 then 6", "6"), ("12,", "12"), ("1,,2", "12"), ("\u0661", "\u0661"), ("The answer is: \u0664\u0662", "\u0664\u0662"),
]


def test_extract_by_hand(spark):
    assert one(spark, extract_answer, [t for t, _ in ANSWERS]) == [a for _, a in ANSWERS]


# --- reward ------------------------------------------------------------------------------

def test_reward_goldens(spark):
    vals = ["", "a.a.a.a", "The answer is 4", "So x = 4. So x = 4. So x = 4."]
    assert one(spark, heuristic_reward, vals) == [-2.0, -4.0, -0.5, 0.30000000000000004]

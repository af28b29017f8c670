"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic
regression.

Training uses a sample of at most about ``SAMPLE`` labelled rows (chosen by a hash of the id;
fewer if there are fewer), written once to the shared folder:

1. A lexicon is learned from it: words and word beginnings (4 to 6 letters) that are far more
   frequent, by documents, in toxic texts. Texts are in three folds; a training text's
   features come from the lexicon of the other two, so its own words do not vouch for it.
2. Features: densities of a small fixed lexicon and of the learned one, hits close to a
   second-person pronoun, capitals, punctuation, obfuscation (letters mixed with digits or
   signs, stretched letters), length.
3. Trees are fitted on two folds, the isotonic map from their output to the share of toxic texts on
   the third. The score is the isotonic value, with a thousandth of the raw probability
   to keep the order inside its steps.

Every text is then scored as a whole, in one pass without a shuffle.

Defined results: a null text is scored as empty, an empty one has all features 0 and is scored like any other;
labels that are null are ignored, of several labels for one id the largest counts, repeated
rows are scored alike; without labelled rows of both kinds, every score is the share of toxic ones
among them (0 without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import held, lean, written

SAMPLE = 12_000
CANDIDATES = 50_000
LEXICON = 2_000
MIN_SUPPORT = 3
FOLDS = 3
TREES, DEPTH = 20, 3
THRESHOLD = 0.3

# fixed values: insults, and second-person forms, of four languages
INSULTS = frozenset("""
idiot idiots idiotic moron morons moronic imbecile stupid dumb loser losers pathetic worthless scum trash garbage
disgusting clown fool foolish jerk bastard bitch ass asshole dumbass shit bullshit crap fuck fucking fucker whore slut
pig vermin filth filthy hate kill die ugly creep freak retard retarded coward
dumm dummkopf arschloch scheisse scheiße depp trottel drecksau abschaum wertlos widerlich versager
connard connasse salope merde crétin débile abruti ordure minable imbécile pute
estúpido estúpida imbécil basura mierda puta pendejo cabrón escoria asqueroso inútil patético payaso
""".split())
SECOND_PERSON = frozenset("""
you your yours yourself yourselves u ur ya thou
du dich dir dein deine deinen deiner deinem ihr euch euer eure
tu te toi ton ta tes vous votre vos
tú ti tuyo tuya usted ustedes vosotros vos
""".split())

_TOKEN = re.compile(r"[^\W_]+(?:[@$!|*0-9]+[^\W\d_]+)*")
_SIGN = re.compile(r"[@$!|*0-9]")
_MIXED = re.compile(r"[@$!|*0-9]+[^\W\d_]")
_DOTTED = re.compile(r"[.*_-][^\W\d_][.*_-][^\W\d_]")
_CAPITAL_RUN = re.compile(r"[A-Z]{2,}")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": ""})
_NEAR = 6
FEATURES = ("insults", "learned_weight", "learned", "learned_most", "learned_count", "learned_kinds", "near_second_person", "second_person",
            "capitals", "capital_words", "exclamations", "punctuation", "mixed", "stretched", "words", "word_length")


def words_of(text: str) -> list[str]:
    """Lower-case words, with digits and signs inside words read as the letters they stand for."""
    out = _TOKEN.findall(text.lower())
    return [w if w.isalpha() else w.translate(_LEET) for w in out] if _SIGN.search(text) else out


def stems(word: str) -> list[str]:
    """A word and its beginnings of 4 to 6 letters (marked by a hyphen)."""
    return [word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)]


class Lexicon(dict):
    """Weights of stems; ``heads`` are the stems' first four letters, a cheap first test."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(weights)
        self.heads = {s[:4] for s in weights}

    def weight(self, word: str) -> float:
        return max((self[s] for s in stems(word) if s in self), default=0.0)


def _stretched(text: str) -> int:
    """Places where a letter stands three times in a row (by bytes)."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    same = raw[1:] == raw[:-1]
    return int((same[1:] & same[:-1] & (raw[2:] >= 65)).sum()) if len(raw) > 2 else 0


def text_features(text: str, lexicon: Lexicon) -> list[float]:
    words = words_of(text)
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    kinds = Counter(words)
    heads = lexicon.heads
    weight = {w: v for w in kinds if w[:4] in heads and (v := lexicon.weight(w))}
    insults = kinds.keys() & INSULTS
    second_person = kinds.keys() & SECOND_PERSON
    hits = sum(kinds[w] for w in weight)
    near = 0
    if (insults or weight) and second_person:
        last, at = -n, 0
        second = [i for i, w in enumerate(words) if w in second_person]
        for i in [i for i, w in enumerate(words) if w in weight or w in insults]:
            while at < len(second) and second[at] <= i:
                last, at = second[at], at + 1
            near += i - last <= _NEAR or (at < len(second) and second[at] - i <= _NEAR)
    return [
        sum(kinds[w] for w in insults) / n,
        sum(v * kinds[w] for w, v in weight.items()) / n,
        hits / n,
        max(weight.values(), default=0.0),
        math.log1p(hits),
        math.log1p(len(weight)),
        near / n,
        sum(kinds[w] for w in second_person) / n,
        sum(map(text.count, ascii_uppercase)) / chars,
        len(_CAPITAL_RUN.findall(text)) / n,
        text.count("!") / chars,
        sum(map(text.count, ".,;:?!*#@$%&")) / chars,
        (len(_MIXED.findall(text)) + len(_DOTTED.findall(text))) / n,
        _stretched(text) / n,
        math.log1p(n),
        chars / n,
    ]


def _fold(id_: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), id_), F.lit(FOLDS)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column, most: int) -> DataFrame:
    """(text, label, fold) of at most about ``most`` labelled rows, written."""
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    n = rows.count()
    share = F.lit(min(1.0, most / max(1, n)))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_003)) < share * 1_000_003)
    # at most about `most` ids and labels: a bounded broadcast, so no text is shuffled
    own = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    return written(own.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("_label").alias("label"), _fold(F.col(id_col)).alias("fold")), "labelled")


def learn_lexicons(sample: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Log-odds weights of stems: for each fold f a lexicon learned without it, then one of all."""
    sc = sample.sparkSession.sparkContext

    @lean

    def toxic_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fold, text in zip(b.column("fold").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = sorted({s for w in set(words_of(text)) if len(w) > 2 for s in stems(w)})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([fold] * len(own), pa.int32())], names=["stem", "fold"])

    by_fold = [F.sum((F.col("fold") == f).cast("long")).alias(f"n{f}") for f in range(FOLDS)]
    found = sample.filter("label = 1").mapInArrow(toxic_stems, "stem string, fold int").groupBy("stem").agg(*by_fold, F.count(F.lit(1)).alias("n"))
    top = found.filter(F.col("n") >= MIN_SUPPORT).orderBy(F.desc("n"), "stem").limit(CANDIDATES).collect()
    names = [r["stem"] for r in top]
    toxic = np.array([[r[f"n{f}"] for f in range(FOLDS)] for r in top], dtype=np.int64).reshape(-1, FOLDS)
    known = sc.broadcast({s: i for i, s in enumerate(names)})

    @lean

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = known.value
        counts = np.zeros((len(index), FOLDS), dtype=np.int64)
        for b in batches:
            for fold, text in zip(b.column("fold").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = {index[s] for w in set(words_of(text)) if len(w) > 2 for s in stems(w) if s in index}
                counts[list(own), fold] += 1
        i, f = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(f, pa.int32()), pa.array(counts[i, f])], names=["i", "fold", "n"])

    clean = np.zeros_like(toxic)
    for r in sample.filter("label = 0").mapInArrow(clean_counts, "i int, fold int, n long").groupBy("i", "fold").agg(F.sum("n").alias("n")).collect():
        clean[r["i"], r["fold"]] = r["n"]
    texts = np.zeros((2, FOLDS))
    for r in sample.groupBy("label", "fold").count().collect():
        texts[int(r["label"] != 0), r["fold"]] += r["count"]

    def lexicon(folds: list[int]) -> dict[str, float]:
        t, c = toxic[:, folds].sum(1), clean[:, folds].sum(1)
        nt, nc = texts[1, folds].sum(), texts[0, folds].sum()
        odds = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
        good = np.flatnonzero((t >= MIN_SUPPORT) & (odds >= 1.5))
        order = good[np.argsort(-odds[good] * np.sqrt(t[good]), kind="stable")][:size]
        return {names[i]: round(float(odds[i]), 3) for i in order}

    return [lexicon([g for g in range(FOLDS) if g != f]) for f in range(FOLDS)] + [lexicon(list(range(FOLDS)))]


def _featured(df: DataFrame, text_of: Callable[[pa.RecordBatch], pa.Array], lexicons: list[dict[str, float]], fold: str | None) -> DataFrame:
    """``df`` with an array column ``_f``; by the lexicon of ``fold``, or the last."""
    known = df.sparkSession.sparkContext.broadcast([Lexicon(x) for x in lexicons])
    names = df.columns

    @lean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity", dict)  # a worker that served another operator drops its tables
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                folds = b.column(fold).to_pylist() if fold else [-1] * b.num_rows
                rows = [text_features(t or "", known.value[f]) for t, f in zip(text_of(b).to_pylist(), folds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*names, "_f"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, schema + ", _f array<double>")


class ToxicityModel:
    """A fitted lexicon, trees and calibration; ``prior`` alone if there was nothing to learn."""

    def __init__(self, prior: float, lexicon: dict[str, float] | None = None, trees=None, isotonic=None):
        self.prior, self.lexicon, self.trees, self.isotonic = prior, lexicon, trees, isotonic

    def score(self, df: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """``df`` with a score from 0 to 1."""
        if self.trees is None:
            return df.withColumn(out, F.lit(float(self.prior)))
        kept = [c for c in df.columns if c != out]
        # under one name, as the models add columns of their own
        inner = df.select(F.struct(*kept).alias("_row"))
        scored = _raw(self.trees, _featured(inner, lambda b: b.column(0).field(text_col), [self.lexicon], None))
        scored = self.isotonic.transform(scored)
        value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_iso") * 0.999 + F.col("_p") * 0.001))
        return scored.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], value.alias(out))


def _raw(trees, df: DataFrame) -> DataFrame:
    scored = trees.transform(df.withColumn("_vector", array_to_vector("_f")))
    return scored.withColumn("_p", vector_to_array("probability").getItem(1)).drop("_vector", "rawPrediction", "probability", "prediction", "_f")


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn from the labels whose row satisfies ``train`` (a condition on ``labels``)."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, F.lit(True) if train is None else train, sample)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel(prior)
    lexicons = learn_lexicons(rows)
    featured = _featured(rows, lambda b: b.column("text"), lexicons, "fold").select("_f", "fold", F.col("label").cast("double").alias("_y"))
    featured = written(featured, "toxicity-features").withColumn("_vector", array_to_vector("_f"))
    held = F.col("fold") == FOLDS - 1
    kinds = {(r["held"], r["_y"]) for r in featured.select(held.alias("held"), "_y").distinct().collect()}
    both = {(h, y) for h in (False, True) for y in (0.0, 1.0)} <= kinds  # else too few rows to hold some out
    boosting = GBTClassifier(featuresCol="_vector", labelCol="_y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=3, seed=7)
    trees = boosting.fit(featured.filter(~held if both else F.lit(True)).coalesce(4))
    raw = _raw(trees, featured.filter(held if both else F.lit(True)).drop("_vector"))
    isotonic = IsotonicRegression(featuresCol="_p", labelCol="_y", predictionCol="_iso").fit(raw.coalesce(4))
    return ToxicityModel(prior, lexicons[-1], trees, isotonic)


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learned from (a null id is none of them)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    scored = model.score(docs, "text")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    return scores(docs, labels, threshold).filter("predicted = 0").select(*docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op4: every whole text of ``documents``."""
    scored = scores(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

"""Quality classifier: document scores learned from preference pairs (Bradley-Terry), cut at a score quantile."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, own_columns

#: Labelled documents that the ranking is fitted on: the ones with the smallest hashes of their ids. The bound keeps
#: the feature rows on the driver under 4 MB.
MAX_LABELLED = 20_000
#: Opponents of the other class that each labelled document meets.
OPPONENTS = 8
HELD_OUT, FOLDS = 1, 3
_SYMBOLS = frozenset("!#$%&*+/<=>@[\\]^_`{|}~")
FEATURES = (
    "log_words", "symbol_share", "upper_share", "repeated_neighbour_share", "distinct_share", "top_word_share", "word_length",
    "digit_share", "symbol_word_share", "upper_word_share", "repeated_line_share", "line_length", "repeated_pair_share",
)


def features(text: str | None) -> list[float]:
    """What the score sees of a whole text; every share of nothing is 0."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = Counter(text)
    size = len(text)
    upper = sum(v for c, v in chars.items() if c.isupper())
    letters = sum(v for c, v in chars.items() if c.isalpha())
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    pairs = n - 1
    return [
        float(np.log1p(n)),
        sum(v for c, v in chars.items() if c in _SYMBOLS) / size,
        upper / letters if letters else 0.0,
        sum(map(str.__eq__, words, words[1:])) / pairs if pairs else 0.0,
        len(counts) / n,
        max(counts.values()) / n,
        size / n,
        sum(v for c, v in chars.items() if c.isdigit()) / size,
        sum(v for w, v in counts.items() if w[-1] in _SYMBOLS) / n,
        sum(v for w, v in counts.items() if len(w) > 1 and w.isupper()) / n,
        1.0 - len(set(lines)) / len(lines) if lines else 0.0,
        float(np.log1p(size / max(1, len(lines)))),
        1.0 - len(set(zip(words, words[1:], strict=False))) / pairs if pairs else 0.0,
    ]


@dataclass(frozen=True)
class Ranking:
    """Strength of a document: weights . (features - mean) / scale; `cut` is the strength that scores one half."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1.0 / (1.0 + np.exp(np.clip(self.cut - strength, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, opponents: int = OPPONENTS, ridge: float = 1e-2) -> Ranking:
    """Newton steps on the logistic loss of pairs (a good document is preferred to a bad one).

    The cut is the quantile of the strengths at the share of bad documents. With one class or no rows every document
    scores one half.
    """
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    winners, losers = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(winners) or not len(losers):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    dice = np.random.default_rng(0)
    a = np.concatenate([np.repeat(winners, opponents), dice.choice(winners, len(losers) * opponents)])
    b = np.concatenate([dice.choice(losers, len(winners) * opponents), np.repeat(losers, opponents)])
    d = z[a] - z[b]
    w = np.zeros(width)
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the wrong one wins
        slope = d.T @ p / len(d) - ridge * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(width)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    strength = np.sort(z @ w)
    bad = len(losers)
    return Ranking(mean, scale, w, float((strength[bad - 1] + strength[bad]) / 2))


def _vector(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return vector(text)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranking:
    """Fit on labelled documents outside the held-out fold; labels without id or quality are ignored.

    Of rows that repeat a doc_id one, chosen by the hash of its text, is fitted on.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().distinct()
    known = known.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "quality", F.xxhash64("text").alias("order"), _vector(F.col("text")).alias("x"))
    found = rows.groupBy("doc_id", "quality").agg(F.min_by("x", "order").alias("x")).toPandas()  # at most max_labelled rows
    found = found.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, found["quality"].to_numpy())


def score(text: Column, ranking: Ranking) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(ranking.scores(x))

    return scored(text)


def quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`.

    Features come from the whole text; a null or empty text has all features 0 and still gets a score. Without labels
    of both kinds every score is one half. Repeated rows are scored each; a null doc_id is not held out. Columns other
    than doc_id and text (doc_id and quality of the labels) are ignored.
    """
    ranking = learn(docs, labels, max_labelled)
    scored = docs.select("doc_id", score(F.col("text"), ranking).alias("score"))
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """`docs` without the documents that the classifier rejects; all columns stay and nothing shuffles."""
    ranking = learn(docs, labels, max_labelled)
    return own_columns(docs, "_score").withColumn("_score", score(F.col("text"), ranking)).where("_score >= 0.5").drop("_score")

"""Quality scores learned from preference pairs.

A Bradley-Terry model: of two labelled documents with different labels, the better one wins with probability
``1 / (1 + exp(-(s(better) - s(worse))))`` where ``s`` is linear in the features of a text. The weights minimise the
logistic loss on feature differences of preference pairs. The threshold is a quantile of the training scores: the share
of rejected documents among the labels. Scores are shifted so that the threshold falls on 0.7 and squashed to (0, 1).

Features see the whole text and nothing else: lengths, shares and transitions of character classes, repetition of words,
sentences and lines, compressibility. Counted ones enter as piecewise linear functions with knots at quantiles.

The model is fitted on at most ``MAX_LABELLED`` labelled rows, those with the smallest hash of their id, so a fit costs
the same at any size; all documents are scored, each where it lies, without a shuffle.

Defined results: null and empty texts get the score of a text without characters; labels that disagree about one id are
averaged, an average of 0.5 or more counting as good; labels without quality or id or document are skipped; if fewer than
two classes remain, every score is 0.5; repeated documents are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
PAIRS = 60_000
THRESHOLD = 0.7
KNOTS = (0.03, 0.1, 0.25, 0.5, 0.75, 0.9, 0.97)
LOWER, UPPER, DIGIT, SPACE, NEWLINE, POINT, SYMBOL, HIGH = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    table[128:] = HIGH
    for which, chars in ((LOWER, range(97, 123)), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (SPACE, b" \t"), (NEWLINE, b"\n\r"), (POINT, b".,;:'\"-()?")):
        table[list(chars)] = which
    return table


CLASS = _classes()
COUNTED = 19


def features(text: str | None) -> np.ndarray:
    """``COUNTED`` counted features, then 64 square roots of class transition shares."""
    body = text or ""
    raw = body.encode()
    kind = CLASS[np.frombuffer(raw, np.uint8)]
    words, lines = body.split(), [x for x in body.split("\n") if x]
    sentences = [x.strip() for x in body.replace("\n", ".").replace("!", ".").split(".") if x.strip()]
    n, size = max(1, len(words)), max(1, len(raw))
    count = np.bincount(kind, minlength=8)[:8]
    letters = max(1, count[LOWER] + count[UPPER] + count[HIGH])
    often = Counter(words)
    top = [c for _, c in often.most_common(3)]
    starts = sum(1 for s in sentences if s[0].isupper())
    counted = [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / n, len(body) / size,
        count[UPPER] / letters, count[DIGIT] / size, count[POINT] / size, count[SYMBOL] / size, count[NEWLINE] / size, count[HIGH] / size,
        len(often) / n, (top[0] / n if top else 0.0), sum(top) / n,
        len(set(sentences)) / max(1, len(sentences)), len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(sentences)), starts / max(1, len(sentences)),
        len(zlib.compress(raw, 1)) / size if raw else 1.0,
        sum(map(eq, words, words[1:])) / n,
    ]
    moves = np.bincount(kind[:-1] * 8 + kind[1:], minlength=64) if len(kind) > 1 else np.zeros(64)
    return np.concatenate([np.array(counted, float), np.sqrt(moves / size)])


@dataclass
class Model:
    knots: np.ndarray  # (counted features, knots)
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    fitted: bool = True

    def expand(self, x: np.ndarray) -> np.ndarray:
        counted = x[:, :COUNTED]
        bent = np.maximum(0.0, counted[:, :, None] - self.knots[None]).reshape(len(x), -1)
        return (np.concatenate([x, bent], axis=1) - self.mean) / self.spread

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        shift = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights - self.threshold + shift, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, steps: int = 300, seed: int = 7) -> Model:
    """Bradley-Terry weights from preference pairs between good and other rows of ``x``."""
    width = x.shape[1]
    wide = width + COUNTED * len(KNOTS)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    model = Model(np.zeros((COUNTED, len(KNOTS))), np.zeros(wide), np.ones(wide), np.zeros(wide), 0.0, bool(len(better) and len(worse)))
    if not model.fitted:
        return model
    model.knots = np.quantile(x[:, :COUNTED], KNOTS, axis=0).T
    z = model.expand(x)
    model.mean, model.spread = z.mean(axis=0), np.where(z.std(axis=0) > 1e-9, z.std(axis=0), 1.0)
    z = model.expand(x)
    draw = np.random.default_rng(seed)
    # Every labelled row takes part, the rest of the pairs is drawn; a pair is the difference of two score vectors.
    rounds = max(1, pairs // max(len(better), len(worse)))
    win = np.tile(np.resize(better, max(len(better), len(worse))), rounds)[:pairs]
    lose = draw.permutation(np.resize(worse, len(win)))
    weights, first, second = model.weights, np.zeros(wide), np.zeros(wide)
    for step in range(1, steps + 1):
        s = z @ weights
        doubt = 1 / (1 + np.exp(np.clip(s[win] - s[lose], -30, 30)))  # of each pair's outcome
        pull = np.bincount(win, doubt, len(x)) - np.bincount(lose, doubt, len(x))
        slope = penalty * weights - z.T @ pull / len(win)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights = weights
    model.threshold = float(np.quantile(z @ weights, 1 - good.mean()))
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled documents for whose ``doc_id`` the condition ``usable`` holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(usable & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # bounded by the parameter

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "good": pdf["good"], "x": [features(t) for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # A labelled id counts once, whatever its repeats, so no more than ``max_labelled`` rows come to the driver.
    table = rows.groupBy("doc_id").agg(F.first("good").alias("good"), F.min("text").alias("text")).mapInPandas(run, "doc_id long, good boolean, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(table["x"].tolist(), float).reshape(len(table), COUNTED + 64)
    return fit(x[:max_labelled], table["good"].to_numpy(bool)[:max_labelled])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (in place of a column of that name), of the texts alone.

    The other columns travel as one struct that Arrow passes through, so that no value changes on the way.
    """
    kept = [c for c in docs.columns if c != "quality_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            scores = model.score(np.array(found, float).reshape(batch.num_rows, COUNTED + 64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "quality_score"])

    from pyspark.sql import types as T

    row = F.struct(*kept)
    fields = T.StructType([docs.schema[c] for c in kept])
    schema = T.StructType([T.StructField("row", fields), T.StructField("quality_score", T.DoubleType())])
    return docs.select(row.alias("row"), F.col(text).alias("text")).mapInArrow(run, schema).select("row.*", "quality_score")

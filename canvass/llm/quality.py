"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A token is a run of letters, digits or non-ASCII bytes, or a run of other printable signs. Features are hashed single
tokens and pairs, and one for a token that follows itself, weighted 1 + log(count) and scaled to unit length. Training streams a bounded, documented sample of labelled
rows (at most ``sample`` of them, those of least hash of doc_id, ``epochs`` times) through one task; only
the weight table, of fixed size, comes back. Scoring is a sparse dot product of each whole text.

Cases: null and empty texts have the bias alone; null labels are left out of training; without labelled rows all scores are
0.5; labelled rows that match no document, or a document twice, do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.spans import PIECE, SpanHasher, U

DIMENSIONS, SAMPLE, EPOCHS, THRESHOLD = 1 << 18, 8000, 2, 0.7
_KIND = np.zeros(256, np.int8)
_KIND[33:127] = 2
for _part in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _KIND[list(_part)] = 1
_NO_TOKEN = re.compile(b"[" + re.escape(bytes(np.flatnonzero(_KIND == 0).tolist())) + b"]")


def _number(hashes: np.ndarray, dimensions: int) -> np.ndarray:
    return (hashes % U(dimensions - 2)).astype(np.int32) + 2


def features(text: str | None, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text; number 0 is the bias, 1 a repeated token."""
    data, parts = (text or "").encode("utf-8", "surrogatepass"), []
    at, last, carried = 0, -1, 0
    while at < len(data):
        # A piece ends where a token does, and the next one starts with its last token, so that cuts change nothing.
        stop = _NO_TOKEN.search(data, max(at + PIECE, last + 1))
        last = stop.start() if stop else len(data)
        piece = data[at:last]
        kinds = _KIND[np.frombuffer(piece, np.uint8)]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
        starts, ends = edges[:-1], edges[1:]
        inside = kinds[starts] > 0
        starts, ends, span = starts[inside], ends[inside], SpanHasher(piece)
        single = span(starts, ends)
        pair = span(starts[:-1], ends[1:])
        parts += [_number(single[carried:], dimensions), _number(pair, dimensions), np.ones(int((single[1:] == single[:-1]).sum()), np.int32)]
        at, carried = (last, 0) if not stop or not len(starts) else (at + int(starts[-1]), 1)
    hashed = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    index, counts = np.unique(hashed, return_counts=True)
    values = 1 + np.log(counts)
    values /= max(1e-12, math.sqrt(float(values @ values)))
    return np.concatenate([[0], index]), np.concatenate([[1.0], values])


class FollowTheRegularisedLeader:
    """FTRL-proximal logistic regression over sparse rows."""

    def __init__(self, dimensions: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dimensions), np.zeros(dimensions)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(index)
        slope = (sigmoid(float(w @ values)) - label) * values
        rate = (np.sqrt(self.n[index] + slope * slope) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += slope - rate * w
        self.n[index] += slope * slope


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _trainer(dimensions: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = FollowTheRegularisedLeader(dimensions)
        for part in parts:
            for text, label in zip(part["text"], part["label"], strict=True):
                model.learn(*features(text, dimensions), float(label))
        yield pd.DataFrame({"weights": [model.weights().tobytes()]})

    return run


def train(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """docs (doc_id, text), marks (doc_id, label) -> weights, from the ``sample`` marks of least hash of doc_id that have a document."""
    marks = marks.where("label is not null").join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = marks.withColumn("draw", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("draw", "doc_id", "label").limit(sample)
    # At most ``sample`` rows of three numbers: a proven bound.
    # Of several documents of one doc_id the least text, so that the rows are bounded as well.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "draw", "label").agg(F.min("text").alias("text"))
    rows = rows.withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in range(epochs)])))
    ordered = rows.repartition(1).sortWithinPartitions("epoch", F.xxhash64("draw", "epoch"), "label", "text")
    found = ordered.select("text", "label").mapInPandas(_trainer(dimensions), "weights binary").collect()
    return np.frombuffer(bytes(found[0][0]), np.float64) if found else np.zeros(dimensions)


def score(text: Column, weights: np.ndarray, spark) -> Column:
    """Probability of label 1 of each text."""
    table = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = table.value
        for part in parts:
            scores = []
            for x in part:
                index, values = features(x, len(known))
                scores.append(sigmoid(float(known[index] @ values)))
            yield pd.Series(scores, dtype="float64")

    return of(text)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, score and predicted added; trained on the labelled rows that are not held out."""
    marks = labels.select(F.col("doc_id"), F.col(label).alias("label")).where(~held_out(F.col("doc_id")))
    weights = train(docs, marks, sample)
    scored = docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": score(F.col("text"), weights, docs.sparkSession)})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

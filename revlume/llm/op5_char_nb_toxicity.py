"""Toxicity by character n-grams scaled with naive Bayes log-count ratios (Wang and Manning, 2012).

A text is the set of its character n-grams, hashed to ``2^BITS`` features.  From labelled texts each
feature gets the log ratio of its smoothed shares in toxic and other texts; a logistic regression is
learnt over features of that size, those whose shares hardly differ left out.  The training sample is bounded; scoring is one pass over all whole
texts without a shuffle.  Labels, language, source and id are no inputs.

Defined results: null and empty texts have no features and get the score of the intercept; without
labels of both classes every score is the share of label 1 (zero if there are none); repeated rows get
equal scores; an empty table gives an empty result; extra columns are ignored or carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from revlume.llm.cluster import ship
from revlume.llm.labelled import fold, training_sample
from revlume.llm.words import pieces

FOLDS, HELD_OUT = 3, 1
TOXIC = 0.7
LENGTHS = (4, 5, 6)
BITS = 20
#: Bound of the training sample: documents of each label, and characters of all of them together.
PER_CLASS = {0: 1600, 1: 1000}
MAX_TRAINING_CHARS = 20_000_000
#: Odds of label 1 that scores assume before the text is seen; above its share, so that toxic texts are caught.
PRIOR_ODDS = 0.5

SMOOTHING, EPOCHS, RATE, DECAY = 1.0, 10, 0.1, 1e-5
#: A feature counts if its documents of both labels differ from even by so many deviations, and are so many.
LEAST_APART, LEAST_DOCS = 2.0, 2
#: Characters hashed at a time.
STEP = 1 << 20


def gram_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Features of all n-grams of a text, repeats included, in pieces."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    for a in range(0, len(chars), STEP):
        part = chars[a : a + STEP + max(LENGTHS) - 1]
        for n in LENGTHS:
            size = min(len(part) - n + 1, STEP)
            if size <= 0:
                continue
            value = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                value = (value ^ part[k : k + size]) * np.uint32(0x01000193)
                value ^= value >> np.uint32(15)
            yield (value * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def features(text: str | None) -> np.ndarray:
    """The distinct features of a text, sorted."""
    present = np.zeros(1 << BITS, bool)
    for found in gram_hashes(text):
        present[found] = True
    return np.flatnonzero(present)


class RatioModel:
    """Weights of the features: log-count ratio times learnt weight, none where the labels hardly differ."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << BITS, np.float32)
        self.used = np.zeros(1 << BITS, bool)
        self.bias = 0.0
        self.constant: float | None = None

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        found = [h[self.used[h]] for h in gram_hashes(text)]
        distinct = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        z = float(self.weights[distinct].astype(np.float64).sum()) + self.bias
        return 1 / (1 + float(np.exp(-np.clip(z, -500, 500))))

    def fit(self, bags: list[np.ndarray], y: np.ndarray, shift: float) -> RatioModel:
        """Adaptive gradient steps, document by document; ``shift`` moves the odds from those of the sample."""
        size, n_toxic, n_other = 1 << BITS, int((y == 1).sum()), int((y == 0).sum())
        toxic, other = np.zeros(size), np.zeros(size)
        for bag, c in zip(bags, y, strict=True):
            (toxic if c == 1 else other)[bag] += 1
        ratio = np.log((toxic + SMOOTHING) / (n_toxic + SMOOTHING)) - np.log((other + SMOOTHING) / (n_other + SMOOTHING))
        apart = np.abs(toxic - other * n_toxic / n_other) / np.sqrt(toxic + other + 1)
        self.used = (apart >= LEAST_APART) & (toxic + other >= LEAST_DOCS)
        bags = [bag[self.used[bag]] for bag in bags]
        w, seen = np.zeros(size), np.full(size, 1e-6)
        bias, bias_seen, random = 0.0, 1e-6, np.random.default_rng(3)
        for _ in range(EPOCHS):
            for d in random.permutation(len(bags)):
                bag = bags[d]
                r = ratio[bag]
                off = 1 / (1 + np.exp(-np.clip(r @ w[bag] + bias, -500, 500))) - y[d]
                g = off * r + DECAY * w[bag]
                seen[bag] += g * g
                w[bag] -= RATE * g / np.sqrt(seen[bag])
                bias_seen += off * off
                bias -= RATE * off / np.sqrt(bias_seen)
        self.weights, self.bias = (w * ratio).astype(np.float32), float(bias + shift)
        return self


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t).astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("y")], names=["x", "y"])


def train(docs: DataFrame, labels: DataFrame) -> RatioModel:
    """A model from the labels outside the held-out fold."""
    ship(docs.sparkSession)
    sample, counts = training_sample(docs, labels, "toxic", FOLDS, HELD_OUT, PER_CLASS, MAX_TRAINING_CHARS)
    table = sample.mapInArrow(_features, "x binary, y int").toArrow()
    y = table.column("y").to_numpy()
    model = RatioModel()
    if len(np.unique(y)) < 2:
        known = sum(counts.values())
        model.constant = counts.get(1, 0) / known if known else 0.0
        return model
    bags = [np.frombuffer(b.as_buffer(), np.int32) for b in table.column("x")]
    shift = np.log(PRIOR_ODDS) - np.log((y == 1).sum() / (y == 0).sum())
    return model.fit(bags, y, float(shift))


def _scores(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: RatioModel = held.value
        for batch in pieces(batches, "text", 4 << 20):
            score = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"])

    return run


def score_toxicity(docs: DataFrame, model: RatioModel) -> DataFrame:
    """All ``docs`` as a struct ``row`` with the ``score`` of the whole text."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return whole.mapInArrow(_scores(held), f"row {whole.schema['row'].dataType.simpleString()}, score double")


def op5_char_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score_toxicity(docs, train(docs, labels))
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"), F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )

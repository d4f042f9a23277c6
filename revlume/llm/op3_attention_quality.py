"""Quality classifier by attention over passages (multiple-instance learning).

A text is a bag of passages of ``PASSAGE`` words.  Each passage is encoded from its hashed words and the
make-up of its characters; a gated attention layer, learnt from labels of whole documents only, weighs
the passages, and the weighted sum of their encodings is scored (Ilse, Tomczak and Welling, 2018).

The network is trained on a bounded sample of labelled documents; scoring is one pass over all whole
texts without a shuffle.  Labels, language, source and id are no inputs.

Defined results: null, empty and blank texts are one empty passage; without labels of both classes
every score is the share of label 1 (one half if there are none); repeated rows get equal scores; an
empty table gives an empty result; extra columns are ignored or carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from revlume.llm.cluster import ship
from revlume.llm.labelled import fold, training_sample
from revlume.llm.words import LOWER, NOT_SPACE, find_words, pieces, text_bytes, word_prints

FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7
PASSAGE = 128
#: Bound of the training sample: documents of each label, and characters of all of them together.
PER_CLASS = {0: 1500, 1: 3000}
MAX_TRAINING_CHARS = 20_000_000

WORD_DIMS = 256
HIDDEN, ATTENTION = 32, 16
EPOCHS, BATCH, RATE, DECAY = 25, 64, 0.004, 1e-4
#: Passages encoded at a time.
STEP = 2048

# Classes of bytes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, 5 mark, 6 other sign, 7 not ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]] = 0, 1, 2, 3, 4
_CLASS[[33, 63, 42, 35, 36, 64]] = 5
_CLASS[128:] = 7
DIMS = WORD_DIMS + 8 + 4


def encode(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of all passages in pieces, and for each passage the number of its text; in order."""
    data, offsets = text_bytes(column)
    starts, ends, first = find_words(data, offsets, NOT_SPACE)
    words = word_prints(LOWER[data], starts, ends)
    n_words = np.diff(first)
    count = np.maximum(1, -(-n_words // PASSAGE))
    owner = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    low = first[owner] + number * PASSAGE
    high = np.minimum(low + PASSAGE, first[owner + 1])
    for a in range(0, len(owner), STEP):
        lo, hi = low[a : a + STEP], high[a : a + STEP]
        yield _features(data, starts, ends, words, lo, hi), owner[a : a + STEP]


def _features(data, starts, ends, words, low, high) -> np.ndarray:
    n, size = len(low), high - low
    out = np.zeros((n, DIMS), np.float32)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    at = np.repeat(np.arange(n), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    counts = np.bincount(at * WORD_DIMS + (words[inside] % np.uint64(WORD_DIMS)).astype(np.int64), minlength=n * WORD_DIMS)
    counts = counts.reshape(n, WORD_DIMS)
    share = counts / np.maximum(size, 1)[:, None]
    begin, stop = starts[low[full]], ends[high[full] - 1]
    length = stop - begin
    byte_at = np.repeat(full, length)
    byte = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
    kinds = np.bincount(byte_at * 8 + _CLASS[data[byte]], minlength=n * 8).reshape(n, 8)
    all_bytes = np.maximum(kinds.sum(axis=1), 1)
    widths = np.bincount(at, (ends - starts)[inside], minlength=n) / np.maximum(size, 1)
    again = np.zeros(n)
    same = np.flatnonzero((words[inside][1:] == words[inside][:-1]) & (at[1:] == at[:-1]))
    np.add.at(again, at[same], 1)
    out[:, :WORD_DIMS] = np.sqrt(share)
    out[:, WORD_DIMS : WORD_DIMS + 8] = np.sqrt(kinds / all_bytes[:, None])
    out[:, WORD_DIMS + 8] = (counts > 0).sum(axis=1) / np.maximum(np.minimum(size, WORD_DIMS), 1)
    out[:, WORD_DIMS + 9] = share.max(axis=1)
    out[:, WORD_DIMS + 10] = np.sqrt(again / np.maximum(size, 1))
    out[:, WORD_DIMS + 11] = np.log1p(widths) / 4
    return out


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    np.add.at(out, owner, values)
    return out


class AttentionModel:
    """Gated attention over encoded passages, with a logistic score."""

    def __init__(self, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        draw = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        self.p = {
            "W": draw(DIMS, HIDDEN), "b": zero(HIDDEN), "V": draw(HIDDEN, ATTENTION), "bv": zero(ATTENTION),
            "U": draw(HIDDEN, ATTENTION), "bu": zero(ATTENTION), "w": draw(ATTENTION, 1)[:, 0],
            "c": draw(HIDDEN, 1)[:, 0], "b0": zero(1),
        }
        self.constant: float | None = None

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t = np.tanh(h @ p["V"] + p["bv"])
        s = 1 / (1 + np.exp(-(h @ p["U"] + p["bu"])))
        return h, t, s, (t * s) @ p["w"]

    def weights(self, e: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        top = np.full(n, -np.inf, e.dtype)
        np.maximum.at(top, owner, e)
        grown = np.exp(e - top[owner])
        return grown / _sums(grown, owner, n)[owner]

    def score(self, h: np.ndarray, e: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        z = _sums(self.weights(e, owner, n)[:, None] * h, owner, n)
        return 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["b0"]).astype(np.float64)))

    def gradient(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        h, t, s, e = self.passages(x)
        a = self.weights(e, owner, n)
        z = _sums(a[:, None] * h, owner, n)
        off = ((1 / (1 + np.exp(-(z @ p["c"] + p["b0"])))) - y).astype(np.float32) / n
        back = (off[:, None] * p["c"])[owner]
        along = (h * back).sum(axis=1)
        de = a * (along - _sums(a * along, owner, n)[owner])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * back + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {
            "W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "bv": dt.sum(axis=0), "U": h.T @ ds, "bu": ds.sum(axis=0),
            "w": (t * s).T @ de, "c": z.T @ off, "b0": off.sum(keepdims=True),
        }

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, shift: float) -> AttentionModel:
        """Adam over shuffled batches of documents; ``shift`` moves the odds to those outside the sample."""
        random = np.random.default_rng(5)
        first = np.searchsorted(owner, np.arange(len(y) + 1))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = random.permutation(len(y))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in batch])
                own = np.repeat(np.arange(len(batch)), first[batch + 1] - first[batch])
                step += 1
                for k, g in self.gradient(x[rows], own, y[batch]).items():
                    g = g + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p["b0"] += np.float32(shift)
        return self


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            x = np.concatenate([f for f, _ in encode(batch.column("text").slice(k, 1))])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.astype(np.float16).tobytes()], pa.binary()), batch.column("y").slice(k, 1)], names=["x", "y"]
            )


def train(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """A model from the labels outside the held-out fold."""
    ship(docs.sparkSession)
    sample, counts = training_sample(docs, labels, "quality", FOLDS, HELD_OUT, PER_CLASS, MAX_TRAINING_CHARS)
    table = sample.mapInArrow(_encoded, "x binary, y int").toArrow()
    y = table.column("y").to_numpy()
    model = AttentionModel()
    if len(np.unique(y)) < 2:
        known = sum(counts.values())
        model.constant = counts.get(1, 0) / known if known else 0.5
        return model
    bags = [np.frombuffer(b.as_buffer(), np.float16).reshape(-1, DIMS) for b in table.column("x")]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    shift = np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return model.fit(np.concatenate(bags).astype(np.float32), owner, y.astype(np.float32), float(shift))


def _scores(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: AttentionModel = held.value
        for batch in pieces(batches, "text", 2 << 20):
            parts = [(*model.passages(x)[::3], owner) for x, owner in encode(batch.column("text"))]
            h, e, owner = (np.concatenate([p[k] for p in parts]) for k in range(3))
            score = model.score(h, e, owner, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"])

    return run


def score_quality(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """All ``docs`` as a struct ``row`` with the ``score`` of the whole text."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return whole.mapInArrow(_scores(held), f"row {whole.schema['row'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """``docs`` that the model accepts, columns unchanged."""
    return score_quality(docs, model).where(F.col("score") >= ACCEPT).select("row.*")


def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, train(docs, labels))
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"), F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )

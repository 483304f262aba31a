"""Quality of documents: random-indexing word vectors pooled per document, and a two-layer network.

Every word is seen twice: as it is spelled in lower case, and as its shape (letter classes, digits and signs, runs as one).
Both are hashed into slots. A slot has a sparse random index vector, and its word vector is the sum of the index vectors
around its occurrences, at length 1 (random indexing). A document is the mean and the spread of its words' vectors. A
network with one hidden layer gives a logit; a temperature, fitted on sample documents the network has not
seen, makes it a probability. All models are numpy and trained here.

Fitted on at most `per_class` labelled documents of each label, weighted to their shares among all labelled rows. Of these
the hashed words are gathered, not the texts. Scoring is one pass over whole texts without a shuffle.

Defined cases: null and empty texts, and texts of white space, have a zero vector and get the score the network gives that.
Without labels every score is 0.5. Null ids and labels teach nothing. A document given twice has two rows, and
counts once in the sample. Very long texts are scored whole; those beyond `longest` characters teach nothing. An empty table
gives no rows. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from hearthline.llm.common import blocks, counts_per_text, mix, taken, text_bytes, word_bounds, word_hashes, word_table
from hearthline.llm.labelled import LONGEST, labelled_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOTS, WIDTH, NONZERO, REACH, HIDDEN, PER_CLASS = 1 << 14, 32, 4, 2, 32, 2000
BLOCK = 1 << 19


def shape_table() -> np.ndarray:
    """The class of each byte: small and capital letters, digits, letters beyond ASCII; a sign is its own class."""
    b = np.arange(256)
    out = np.where((b >= 97) & (b <= 122), 97, np.where((b >= 65) & (b <= 90), 65, np.where((b >= 48) & (b <= 57), 48, b)))
    return np.where(b >= 128, 200, out).astype(np.uint8)


def word_slots(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words' spellings and of their shapes, and each text's first word."""
    starts, ends = word_bounds(data, at, (data == 32) | ((data >= 9) & (data <= 13)))
    spelled = word_hashes(word_table("space")[data], starts, ends)
    shape = shape_table()[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shaped = word_hashes(shape[keep], place[starts], place[ends])
    last = np.uint64(SLOTS - 1)
    return (spelled & last).astype(np.int32), (shaped & last).astype(np.int32), counts_per_text(at, starts)


def index_vectors() -> np.ndarray:
    """A fixed sparse random vector per slot: a few elements are 1 or -1."""
    out = np.zeros((SLOTS, WIDTH), np.float32)
    slots = np.arange(SLOTS)
    for i in range(NONZERO):
        h = mix(slots.astype(np.uint64) * np.uint64(NONZERO) + np.uint64(i + 1))
        np.add.at(out, (slots, (h % np.uint64(WIDTH)).astype(np.int64)), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0))
    return out


def word_vectors(docs: list[np.ndarray]) -> np.ndarray:
    """Random indexing: for each slot the sum of the index vectors of the words around it, at length 1."""
    index = index_vectors()
    total = np.zeros((SLOTS, WIDTH), np.float32)
    for words in docs:
        around = np.zeros((len(words), WIDTH), np.float32)
        for d in range(1, REACH + 1):
            around[d:] += index[words[:-d]] if d < len(words) else 0
            around[:-d] += index[words[d:]] if d < len(words) else 0
        np.add.at(total, words, around)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)


def pooled(vectors: tuple[np.ndarray, np.ndarray], slots: tuple[np.ndarray, np.ndarray], first: np.ndarray) -> np.ndarray:
    """Per text: mean and standard deviation of the vectors of its words' spellings and shapes; zeros without words."""
    n = np.diff(first)
    have = np.flatnonzero(n)
    out = np.zeros((len(n), 4 * WIDTH), np.float32)
    if len(have):
        for k, (table, own) in enumerate(zip(vectors, slots)):
            x = table[own]
            mean = np.add.reduceat(x, first[:-1][have], axis=0) / n[have, None]
            square = np.add.reduceat(x * x, first[:-1][have], axis=0) / n[have, None]
            out[have, 2 * k * WIDTH : (2 * k + 1) * WIDTH] = mean
            out[have, (2 * k + 1) * WIDTH : (2 * k + 2) * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


@dataclass
class Model:
    vectors: tuple[np.ndarray, np.ndarray]
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, decay: float = 1e-3, seed: int = 7):
    """Weights of the two layers, by Adam on the weighted log loss."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p[0] + p[1])
        g = (sigmoid(h @ p[2] + p[3]) - y) * weight
        back = np.outer(g, p[2]) * (1 - h * h)
        grads = [x.T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label and slots of each sample text."""
    for batch in batches:
        data, at, _ = text_bytes(batch.column("text"))
        for i, j in blocks(at, BLOCK):
            spelled, shaped, first = word_slots(data[at[i] : at[j]], at[i : j + 1] - at[i])
            cut = lambda s: pa.array([s[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), cut(spelled), cut(shaped)], ["label", "spelled", "shaped"])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    per_class: int = PER_CLASS,
    longest: int = LONGEST,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    label: str = "quality",
) -> Model | None:
    """A model of the labelled documents for which `learn` (over doc_id) holds; None if they don't have both labels."""
    sample, totals = labelled_sample(documents, labels, learn, per_class, doc_id, text, label_id, label, longest)
    rows = sample.mapInArrow(_gathered, "label int, spelled binary, shaped binary").toArrow()
    # In an order of their own: which task sent a row first doesn't matter.
    rows = sorted(zip(rows.column("label").to_pylist(), rows.column("spelled").to_pylist(), rows.column("shaped").to_pylist()))
    y = np.array([r[0] for r in rows], np.float64)
    if len(set(y)) < 2:
        return None
    slots = tuple([np.frombuffer(r[k], np.int32) for r in rows] for k in (1, 2))
    vectors = (word_vectors(slots[0]), word_vectors(slots[1]))
    one = lambda a, b: pooled(vectors, (a, b), np.array([0, len(a)]))
    x = np.concatenate([one(a, b) for a, b in zip(*slots)])
    centre, scale = x.mean(0), x.std(0) + 1e-3
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    order = np.random.default_rng(11).permutation(len(y))
    # A fifth, or one row, is kept from training for the temperature.
    aside = max(1, len(order) // 5)
    learnt, kept = order[:-aside], order[-aside:]
    layers = train((x[learnt] - centre) / scale, y[learnt], weight[learnt])
    model = Model(vectors, centre, scale, layers, 1.0)
    z = model.logits(x[kept])

    def loss(t: float) -> float:
        p = np.clip(sigmoid(z / t), 1e-12, 1 - 1e-12)
        return float(-(weight[kept] * (y[kept] * np.log(p) + (1 - y[kept]) * np.log(1 - p))).sum())

    model.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 60)), key=loss)
    return model


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at, _ = text_bytes(batch.column("text"))
            score = np.full(batch.num_rows, 0.5)
            for i, j in blocks(at, BLOCK) if model else ():
                spelled, shaped, first = word_slots(data[at[i] : at[j]], at[i : j + 1] - at[i])
                score[i:j] = model.scores(pooled(model.vectors, (spelled, shaped), first))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def quality(documents: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and score, the probability of label 1."""
    given = taken(documents, doc_id=doc_id, text=text)
    return given.mapInArrow(_scored(model), T.StructType([given.schema["doc_id"], T.StructField("score", T.DoubleType())]))

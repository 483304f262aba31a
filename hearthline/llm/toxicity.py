"""Toxic spans and documents: a linear-chain conditional random field over words.

Words carry label 1 (toxic) or 0. Only documents are labelled, so a sample's words are labelled from them: a word of a toxic document
is toxic if its spelling or a beginning of it is found in far more of the toxic sample documents than of the others. The
chain has weights for spelling, for the first four and five bytes, and for the step from label to label, and is trained on
the conditional likelihood by forward-backward. Sequences are lines, cut every `SEQUENCE` words; every word is in one.

Scoring computes each word's marginal. Words at 0.5 or more make spans; the document's score is a logistic function of the
largest marginal and of the expected number of toxic words, fitted on the sample. All numpy, whole texts, one pass, no shuffle.

Fitted on at most `per_class` labelled documents of each label and `sequences` of their sequences; the hashed words of the sample
are gathered, not the texts.

Defined cases: null and empty texts have no words; their score is that of a document without toxic words. Without both labels
every score is 0.5 and there are no spans. Null ids and labels teach nothing. A document given twice has two rows,
and counts once in the sample. Very long texts are scored whole; those beyond `longest` characters teach nothing. An empty
table gives no rows. Further columns, whatever their names, are not looked at.
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

SLOTS, KINDS, SEQUENCE = 1 << 20, 3, 64
PER_CLASS, SEQUENCES = 1500, 20_000
# A feature marks words as toxic if at least so many different toxic sample documents have it, and so many times the clean
# ones' share.
LEAST_DOCS, LEAST_RATIO = 3, 20.0
SPANS = "array<struct<start: bigint, stop: bigint>>"
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts, ends, three feature slots each, each text's first word, and which words begin a sequence."""
    low = word_table("word")[data]
    starts, ends = word_bounds(low, at)
    first = counts_per_text(at, starts)
    slots = np.empty((len(starts), KINDS), np.int32)
    slots[:, 0] = word_hashes(low, starts, ends) & np.uint64(SLOTS - 1)
    begin = np.zeros(len(starts), np.uint64)
    for k in range(5):
        inside = starts + k < ends
        begin = begin * np.uint64(257) + np.where(inside, low[np.where(inside, starts + k, 0)], 0).astype(np.uint64)
        if k >= 3:
            slots[:, k - 2] = SLOTS * (k - 2) + (mix(begin) & np.uint64(SLOTS - 1)).astype(np.int64)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.ones(len(starts), bool)
    new[1:] = line[1:] != line[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    head = np.flatnonzero(new)
    place = np.arange(len(starts)) - head[np.cumsum(new) - 1] if len(starts) else starts
    return starts, ends, slots, first, new | (place % SEQUENCE == 0)


@dataclass
class Model:
    weights: np.ndarray  # by feature slot
    bias: float
    steps: np.ndarray  # label, next label
    calibration: np.ndarray  # of logit of the largest marginal, of log of expected toxic words, constant


def lattice(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length: where each begins, and its length."""
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(new)))
    order = np.argsort(-length, kind="stable")
    return head[order], length[order]


def marginals(emission: np.ndarray, steps: np.ndarray, new: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """P(label 1) of each word by forward-backward, all sequences side by side. `pairs` (2 x 2) gets the expected steps."""
    out = np.zeros(len(emission))
    if not len(emission):
        return out
    head, length = lattice(new)
    t = np.exp(steps)
    x = np.exp(np.clip(emission, -30, 30))
    longest = int(length[0])
    alive = np.searchsorted(-length, -np.arange(longest), "left")  # sequences longer than the step
    forward = np.zeros((longest, len(head), 2))
    a0, a1 = np.full(len(head), 0.5), np.full(len(head), 0.5)
    for s in range(longest):
        n = alive[s]
        e = x[head[:n] + s]
        if s:
            b0, b1 = a0[:n] * t[0, 0] + a1[:n] * t[1, 0], (a0[:n] * t[0, 1] + a1[:n] * t[1, 1]) * e
        else:
            b0, b1 = np.ones(n), e
        total = b0 + b1
        a0, a1 = b0 / total, b1 / total
        forward[s, :n, 0], forward[s, :n, 1] = a0, a1
    b0, b1 = np.ones(len(head)), np.ones(len(head))
    for s in range(longest - 1, -1, -1):
        n = alive[s]
        f0, f1 = forward[s, :n, 0], forward[s, :n, 1]
        p0, p1 = f0 * b0[:n], f1 * b1[:n]
        out[head[:n] + s] = p1 / (p0 + p1)
        if s:
            e = x[head[:n] + s]
            g0, g1 = forward[s - 1, :n, 0], forward[s - 1, :n, 1]
            if pairs is not None:
                q = np.stack([g0 * t[0, 0] * b0[:n], g0 * t[0, 1] * e * b1[:n], g1 * t[1, 0] * b0[:n], g1 * t[1, 1] * e * b1[:n]])
                pairs += (q / q.sum(0)).sum(1).reshape(2, 2)
            c0, c1 = t[0, 0] * b0[:n] + t[0, 1] * e * b1[:n], t[1, 0] * b0[:n] + t[1, 1] * e * b1[:n]
            b0[:n], b1[:n] = c0 / (c0 + c1), c1 / (c0 + c1)
    return out


def train_chain(slots: np.ndarray, new: np.ndarray, label: np.ndarray, rounds: int = 100, prior: float = 0.5) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and steps with the largest conditional likelihood of the words' labels under a normal prior, by Adam.

    The prior keeps the weights of features that only a few words have near zero.
    """
    own = np.zeros((2, 2))
    follows = np.flatnonzero(~new)
    np.add.at(own, (label[follows - 1].astype(int), label[follows].astype(int)), 1)
    share = (label.sum() + 1) / (len(label) + 2)
    used, column = np.unique(slots, return_inverse=True)
    column = column.reshape(slots.shape)
    size = len(used)
    # One vector: weights of the used slots, bias, steps.
    x = np.concatenate([np.zeros(size), [np.log(share / (1 - share))], np.zeros(4)])
    penalty = np.concatenate([np.full(size, prior), [0], np.full(4, prior)])
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, rounds + 1):
        pairs = np.zeros((2, 2))
        p = marginals(x[:size][column].sum(1) + x[size], x[size + 1 :].reshape(2, 2), new, pairs)
        d = label - p
        g = np.concatenate([np.bincount(column.ravel(), np.repeat(d, KINDS), size), [d.sum()], (own - pairs).ravel()]) - penalty * x
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        rate = 0.3 if t <= rounds // 2 else 0.1
        x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    weights = np.zeros(SLOTS * KINDS, np.float32)
    weights[used] = x[:size]
    return weights, float(x[size]), x[size + 1 :].reshape(2, 2)


def document_inputs(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: logit of the largest marginal, log(1 + expected number of words above one half), 1."""
    out = np.tile([-8.0, 0.0, 1.0], (len(first) - 1, 1))
    have = np.flatnonzero(np.diff(first))
    if len(have):
        top = np.clip(np.maximum.reduceat(p, first[:-1][have]), 1e-12, 1 - 1e-12)
        out[have, 0] = np.clip(np.log(top / (1 - top)), -8, 8)
        out[have, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.5, p, 0), first[:-1][have]))
    return out


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, held back by a small penalty."""
    b = np.zeros(x.shape[1])
    weight = weight / weight.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.1 * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b))
        b += np.linalg.solve(hess, grad)
    return b


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at, _ = text_bytes(batch.column("text"))
        for i, j in blocks(at):
            _, _, slots, first, new = features(data[at[i] : at[j]], at[i : j + 1] - at[i])
            cut = lambda s: pa.array([s[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), cut(slots), cut(new)], ["label", "slots", "heads"])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    per_class: int = PER_CLASS,
    sequences: int = SEQUENCES,
    longest: int = LONGEST,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    label: str = "toxic",
) -> Model | None:
    """A model of the labelled documents for which `learn` (over doc_id) holds; None if they don't have both labels."""
    sample, totals = labelled_sample(documents, labels, learn, per_class, doc_id, text, label_id, label, longest)
    rows = sample.mapInArrow(_gathered, "label int, slots binary, heads binary").toArrow()
    # In an order of their own: which task sent a row first doesn't matter.
    rows = sorted(zip(rows.column("label").to_pylist(), rows.column("slots").to_pylist(), rows.column("heads").to_pylist()))
    y = np.array([r[0] for r in rows], np.float64)
    if len(set(y)) < 2:
        return None
    slots = [np.frombuffer(r[1], np.int32).reshape(-1, KINDS) for r in rows]
    return fitted(y, slots, [np.frombuffer(r[2], bool) for r in rows], totals, sequences)


def family(slots: np.ndarray) -> int:
    """The smallest hash of three words in a row; near copies mostly share it."""
    word = slots[:, 0].astype(np.uint64)
    if len(word) < 3:
        return int(mix(word + np.uint64(1)).sum()) if len(word) else 0
    return int(mix(word[:-2] * np.uint64(0x9E3779B1) + word[1:-1] * np.uint64(0x85EBCA77) + word[2:] * np.uint64(3)).min())


def fitted(y: np.ndarray, slots: list[np.ndarray], heads: list[np.ndarray], totals: dict[int, int], sequences: int) -> Model:
    """The model of sample documents: their labels, their words' feature slots, and which words begin a sequence."""
    # Copies of a document count once: words that only one family of toxic documents has are no sign.
    families: dict[tuple[int, float], set[int]] = {}
    for k, x in enumerate(slots):
        families.setdefault((family(x), y[k]), set()).add(k)
    toxic, clean, of_label = np.zeros(SLOTS * KINDS), np.zeros(SLOTS * KINDS), {0.0: 0, 1.0: 0}
    for (_, label_of), members in families.items():
        (toxic if label_of else clean)[np.unique(np.concatenate([slots[k].ravel() for k in members]))] += 1
        of_label[label_of] += 1
    share = (toxic / of_label[1.0]) / ((clean + 1) / of_label[0.0])
    marks = (toxic >= LEAST_DOCS) & (share >= LEAST_RATIO)
    first = np.concatenate([[0], np.cumsum([len(s) for s in slots])])
    words, new = np.concatenate(slots), np.concatenate(heads)
    marked = marks[words].any(1) & (np.repeat(y, np.diff(first)) == 1)
    # Sequences with marked words first, then the others in a fixed random order.
    sequence = np.cumsum(new) - 1
    some = np.bincount(sequence, marked) > 0 if len(sequence) else np.zeros(0, bool)
    order = np.lexsort((np.random.default_rng(3).random(len(some)), ~some))
    limit = min(sequences // 2, int(some.sum()))
    chosen = np.zeros(len(some), bool)
    chosen[order[:limit]] = True
    chosen[order[int(some.sum()) :][: max(sequences - limit, 0)]] = True
    use = chosen[sequence]
    weights, bias, steps = train_chain(words[use], new[use], marked[use].astype(np.float64))
    p = marginals(weights[words].sum(1) + bias, steps, new)
    balance = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    return Model(weights, bias, steps, calibrate(document_inputs(p, first), y, balance))


def _spans(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> list[dict]:
    """Character offsets of runs of words at 0.5 or more in one text."""
    hit = np.flatnonzero(p >= 0.5)
    if not len(hit):
        return []
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cut = np.flatnonzero(np.diff(hit) > 1)
    begins, stops = hit[np.concatenate([[0], cut + 1])], hit[np.append(cut, len(hit) - 1)]
    return [{"start": int(chars[starts[a]]), "stop": int(chars[ends[b]])} for a, b in zip(begins, stops)]


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at, _ = text_bytes(batch.column("text"))
            score = np.full(batch.num_rows, 0.5)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, j in blocks(at, 1 << 20) if model else ():
                part = data[at[i] : at[j]]
                starts, ends, slots, first, new = features(part, at[i : j + 1] - at[i])
                p = marginals(model.weights[slots].sum(1) + model.bias, model.steps, new)
                z = document_inputs(p, first) @ model.calibration
                score[i:j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                for r in np.unique(np.searchsorted(first, np.flatnonzero(p >= 0.5), "right") - 1):
                    a, b, base = first[r], first[r + 1], at[i + r] - at[i]
                    spans[i + r] = _spans(p[a:b], starts[a:b] - base, ends[a:b] - base, part[base : at[i + r + 1] - at[i]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(spans, SPANS_ARROW)], ["doc_id", "score", "spans"]
            )

    return run


def toxicity(documents: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score, spans (character offsets of the offending words)."""
    given = taken(documents, doc_id=doc_id, text=text)
    spans = T.StructType.fromDDL(f"score double, spans {SPANS}")
    return given.mapInArrow(_scored(model), T.StructType([given.schema["doc_id"], *spans.fields]))

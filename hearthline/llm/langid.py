"""Language of documents: nearest of several centroids per language, over TF-IDF vectors of character n-grams.

A vector has the 1-, 2- and 3-grams of letters (bytes of lower-case UTF-8; all other characters are one gap), hashed into
slots, weighted by 1 + log of the count and by inverse document frequency, at length 1. Each language's vectors are
clustered by spherical k-means. A document gets the language of the centroid with the largest cosine, which is its score.

Rejection is by distance: per size class (number of distinct n-grams, by powers of two) the model holds the largest distance to
the nearest centroid that a document of the sample, or a beginning of one, had, and a margin; documents beyond it are
rejected. Beginnings stand in for short documents.

The model is fitted on at most `per_language` documents of each language, the first by a hash of the id, of which the hashed
vectors are gathered, not the texts. Every language of the documents is learned. Everything else runs over whole texts in one pass
without a shuffle.

Defined cases: a null text, and one without letters, is `und` with score 0, rejected. Documents with a null lang or a null id
teach nothing. Equal scores go to the language that is first by name. If nothing can be learned every document is `und`.
A document given twice has two rows; an empty table none. Very long texts are scored whole. Rejection seldom acts on texts of a few
letters: their largest known distances are close to 1, so a foreign word or a single letter is mostly accepted as some language. Further
columns, whatever their names, are not looked at, and stay in what recognised() keeps.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import blocks, kept_in_worker, kept_rows, taken, text_bytes, word_table
from hearthline.llm.labelled import first_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOT_BITS, CENTROIDS, PER_LANGUAGE = 13, 4, 400
UNKNOWN = "und"
# Words of the beginnings that stand in for short documents, and how much more than the largest known distance is allowed.
BEGINNINGS, MARGIN = (1, 2, 4, 8, 16, 32), 0.25
VECTOR = pa.schema([("row", pa.string()), ("slots", pa.binary()), ("counts", pa.binary())])


def letters(data: np.ndarray) -> np.ndarray:
    """Lower-case letters as they are, everything else as 0: ASCII, and the capitals of the Latin-1 letters."""
    table = word_table("word")
    table[48:58] = 0
    low = table[data]
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][accented] += 32
    return low


def has_letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


def grams(data: np.ndarray, at: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: text, slot and count of every n-gram slot that occurs. A gap has no other gap beside it."""
    size = 1 << SLOT_BITS
    for i, j in blocks(at, 1 << 20, rows):
        total = np.zeros((j - i) * size, np.int64)
        # A very long text in pieces that overlap by the two bytes an n-gram may need before its last.
        for s in range(int(at[i]), int(at[j]), 1 << 20):
            e = min(int(at[j]), s + (1 << 20))
            back = min(2, s - int(at[i]))
            c = letters(data[s - back : e]).astype(np.uint32)
            # Only a text that is alone takes more than one piece.
            of = np.zeros(len(c), np.int64) if j == i + 1 else np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
            same = np.concatenate([[False], of[1:] == of[:-1]])
            one = c * np.uint32(0x9E3779B1)
            before = np.where(same, np.concatenate([[0], c[:-1]]), 0).astype(np.uint32)
            two = one ^ (before * np.uint32(0x85EBCA77))
            same2 = same & np.concatenate([[False], same[:-1]])
            first = np.where(same2, np.concatenate([[0], before[:-1]]), 0).astype(np.uint32)
            three = two ^ (first * np.uint32(0xC2B2AE3D))
            new = np.arange(len(c)) >= back
            keys = []
            for n, (h, ok) in enumerate(((one, c != 0), (two, (c != 0) | (before != 0)), (three, (before != 0) & ((c != 0) | (first != 0))))):
                ok = ok & new
                slot = ((h[ok] + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0x165667B1) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)
                keys.append(of[ok] * size + slot)
            total += np.bincount(np.concatenate(keys), minlength=len(total))
        hit = np.flatnonzero(total)
        yield i, j, hit >> SLOT_BITS, hit & (size - 1), total[hit]


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray  # slot x centroid
    of: np.ndarray  # centroid -> language
    idf: np.ndarray
    furthest: np.ndarray  # size class -> largest distance that is accepted


def weights(idf: np.ndarray, doc: np.ndarray, slot: np.ndarray, count: np.ndarray, docs: int) -> np.ndarray:
    w = (1 + np.log(count)) * idf[slot]
    norm = np.sqrt(np.bincount(doc, w * w, docs))
    return (w / np.maximum(norm, 1e-12)[doc]).astype(np.float32)


def cosines(centroids: np.ndarray, doc: np.ndarray, slot: np.ndarray, w: np.ndarray, docs: int) -> np.ndarray:
    begin = np.searchsorted(doc, np.arange(docs))
    out = np.zeros((docs, centroids.shape[1]), np.float32)
    have = np.flatnonzero(np.bincount(doc, minlength=docs))
    if len(have):
        out[have] = np.add.reduceat(centroids[slot] * w[:, None], begin[have], axis=0)
    return out


def size_class(doc: np.ndarray, docs: int) -> np.ndarray:
    return np.minimum(15, np.log2(np.maximum(1, np.bincount(doc, minlength=docs))).astype(np.int64))


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; the first centres are the mean and then, in turn, the vector furthest from all chosen."""
    centre = [x.mean(0)]
    for _ in range(1, min(k, len(x))):
        near = np.max(np.stack([x @ (c / max(np.linalg.norm(c), 1e-12)) for c in centre]), 0)
        centre.append(x[int(np.argmin(near))])
    c = np.stack(centre)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, 1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row name, slots and counts of each text."""
    for batch in batches:
        data, at, _ = text_bytes(batch.column(1))
        for i, j, doc, slot, count in grams(data, at, 64):
            begin = np.searchsorted(doc, np.arange(j - i + 1))
            rows = [(slot[a:b].astype(np.int32).tobytes(), count[a:b].astype(np.int32).tobytes()) for a, b in zip(begin, begin[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).cast(pa.string()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                schema=VECTOR,
            )


def fit(
    documents: DataFrame,
    learn: Column,
    centroids: int = CENTROIDS,
    per_language: int = PER_LANGUAGE,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Model:
    """A model of the documents for which `learn` (over doc_id) holds; `per_language` bounds the sample,
    whose vectors have at most one number per slot each, however long a text is."""
    given = taken(documents, doc_id=doc_id, lang=lang, text=text).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & learn)
    sample = first_texts(given.where("text IS NOT NULL"), "lang", per_language)
    begins = [F.concat_ws(" ", F.slice(F.split("text", " "), 1, n)) for n in BEGINNINGS]
    kinds = F.array(F.struct(F.lit("whole").alias("kind"), F.col("text").alias("t")), *[F.struct(F.lit("part").alias("kind"), b.alias("t")) for b in begins])
    named = sample.select("lang", F.explode(kinds).alias("x")).select(F.concat_ws("\x1f", "x.kind", "lang").alias("row"), F.col("x.t").alias("text"))
    rows = named.mapInArrow(_vectors, "row string, slots binary, counts binary").toArrow()
    return _fitted(rows, centroids)


def _fitted(rows: pa.Table, centroids: int) -> Model:
    size = 1 << SLOT_BITS
    name = np.array([r.split("\x1f", 1) for r in rows.column("row").to_pylist()], object).reshape(-1, 2)
    slots = [np.frombuffer(b, np.int32) for b in rows.column("slots").to_pylist()]
    counts = [np.frombuffer(b, np.int32) for b in rows.column("counts").to_pylist()]
    whole = [i for i in range(len(slots)) if name[i, 0] == "whole" and len(slots[i])]
    languages = sorted({name[i, 1] for i in whole})
    if not languages:
        return Model([], np.zeros((size, 0), np.float32), np.zeros(0, np.int64), np.ones(size), np.ones(16))
    df = np.bincount(np.concatenate([slots[i] for i in whole]), minlength=size)
    idf = np.log((1 + len(whole)) / (1 + df)) + 1
    made, of = [], []
    for k, language in enumerate(languages):
        own = [i for i in whole if name[i, 1] == language]
        x = np.zeros((len(own), size), np.float32)
        for r, i in enumerate(own):
            x[r, slots[i]] = weights(idf, np.zeros(len(slots[i]), np.int64), slots[i], counts[i], 1)
        c = cluster(x, centroids)
        made.append(c)
        of += [k] * len(c)
    table = np.ascontiguousarray(np.concatenate(made).T, dtype=np.float32)
    model = Model(languages, table, np.array(of), idf, np.zeros(16))
    furthest = np.zeros(16)
    for s, c in zip(slots, counts):
        if len(s):
            d = np.zeros(len(s), np.int64)
            best = cosines(table, d, s, weights(idf, d, s, c, 1), 1).max()
            k = size_class(d, 1)[0]
            furthest[k] = max(furthest[k], 1 - best)
    # Classes the sample lacks accept what the next smaller one does.
    for k in range(1, 16):
        furthest[k] = furthest[k] or furthest[k - 1]
    furthest[0] = furthest[0] or 1.0
    model.furthest = furthest + MARGIN * (1 - furthest)
    return model


def judged(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the place of its language among the model's (one beyond them: unknown), the score, and whether it is rejected."""
    kept_in_worker("languages")
    data, at, _ = text_bytes(texts)
    n = len(texts)
    score, pick, rejected = np.zeros(n), np.full(n, len(model.languages)), np.ones(n, bool)
    plain = word_table("word")
    plain[48:58] = 0
    plain[128:] = 0
    for i, j, doc, slot, count in grams(data, at, 64):
        if not len(model.languages) or not len(doc):
            continue
        w = weights(model.idf, doc, slot, count, j - i)
        c = cosines(model.centroids, doc, slot, w, j - i)
        best = np.argmax(c, 1)
        top = np.clip(c[np.arange(j - i), best], 0, 1)
        ascii_letters = np.add.reduceat(np.append(plain[data[at[i] : at[j]]] != 0, False).astype(np.int64), np.minimum(at[i:j] - at[i], at[j] - at[i])) > 0
        some = ascii_letters & (np.diff(at[i : j + 1]) > 0)
        # Without an ASCII letter, whether there is a letter takes a look at the characters.
        for r in np.flatnonzero(~some & (np.diff(at[i : j + 1]) > 0)):
            some[r] = has_letters(data[at[i + r] : at[i + r + 1]].tobytes().decode("utf-8", "replace"))
        pick[i:j] = np.where(some, model.of[best], len(model.languages))
        score[i:j] = np.where(some, top, 0)
        rejected[i:j] = ~some | (1 - top > model.furthest[size_class(doc, j - i)])
    return pick, score, rejected


def _named(model: Model):
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick, score, rejected = judged(model, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[pick], pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return run


def identify(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (cosine), rejected."""
    given = taken(documents, doc_id=doc_id, text=text)
    more = T.StructType.fromDDL("lang_pred string, score double, rejected boolean")
    return given.mapInArrow(_named(model), T.StructType([given.schema["doc_id"], *more.fields]))


def recognised(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents whose language is recognised, with all their columns."""
    return kept_rows(documents, text, lambda texts: ~judged(model, texts)[2])

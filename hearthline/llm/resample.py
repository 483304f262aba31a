"""Importance resampling towards a target: documents weighted by how much likelier their words are there, the best ones drawn.

Features are all runs of 1 to `longest` words, repeats counted; each falls into one of `buckets` by the crc32 of its bytes. One
pass over all documents and all target texts counts features per bucket. A bucket's gain is the logarithm of the ratio of its smoothed
shares; a document's weight is the mean gain of its features, looked up in an array. A Gumbel number made from a
hash of seed and id is added, so that the highest scores are a draw without replacement.

How many are drawn is known, so the cutoff is a rank. It is found by a weighted median of medians over the stored scores: each partition
reports how many candidates it still has on either side of the last pivot, and their median there; the side with the
wanted rank is kept, and the median of its partitions' medians, each weighted by its candidates, is the next pivot. At least
a quarter of the candidates goes each round, so there are about log(documents) rounds until one is left, which is the
exact cutoff. Every few rounds what is left is stored, so that all rounds together read a small multiple of the
scores. Only one key and two counts per partition reach the driver. Winners are dealt by ranges of their keys, sorted, and numbered
by the sizes of the ranges before theirs.

Defined cases: a null text is an empty one; without words there are no features and weight 0. Equal scores go to the smaller id, nulls
last; rows of equal id and score are told apart by a row number, so repeated rows are drawn one by one and ranks are unique.
A null id hashes as an empty one. Very long texts and words are looked at whole. An empty target, or an empty
table, has zero counts. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import blocks, counts_per_text, taken, text_bytes, word_bounds, word_table
from hearthline.runtime import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
# Words beyond this many bytes are hashed one by one.
LONG_WORD = 64
# Rounds after which the candidates that are left are stored anew.
ROUNDS = 3
START = 0xFFFFFFFF


def crc_table() -> np.ndarray:
    """What a byte does to a crc32: eight steps of the polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


def crc_more(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The states of running crc32s after each has seen its word: all words' k-th bytes in one step."""
    table, state, size = crc_table(), state.copy(), ends - starts
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    long = int(np.count_nonzero(size > LONG_WORD))
    for w in order[:long]:
        state[w] = zlib.crc32(data[starts[w] : ends[w]], int(state[w]) ^ START) ^ START
    order = order[long:]
    now, at, left = state[order], starts[order], size[order]
    alive = len(order)
    for k in range(int(left.max(initial=0))):
        alive = int(np.searchsorted(-left[:alive], -k, "left"))
        byte = data[at[:alive] + k]
        now[:alive] = table[(now[:alive] ^ byte) & np.uint32(0xFF)] ^ (now[:alive] >> np.uint32(8))
    state[order] = now
    return state


def features(data: np.ndarray, at: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of every feature, and the number of words of each text."""
    mapped = word_table("word")[data]
    starts, ends = word_bounds(mapped, at)
    first = counts_per_text(at, starts)
    words = np.diff(first)
    text = np.repeat(np.arange(len(words)), words)
    state = np.full(len(starts), START, np.uint32)
    of, found = [], []
    for run in range(longest):
        # The run that begins at word i takes in word i + run, if that is of the same text.
        begin = np.flatnonzero(text[: len(text) - run] == text[run:]) if run else np.arange(len(text))
        if run:
            space = np.full(len(begin), 32, np.uint8)
            state = crc_more(state[begin], space, np.arange(len(begin)), np.arange(1, len(begin) + 1))
        else:
            state = state[begin]
        state = crc_more(state, mapped, starts[begin + run], ends[begin + run])
        of.append(text[begin])
        found.append((state ^ np.uint32(START)).astype(np.int64) % buckets)
        whole = np.zeros(len(text), np.uint32)
        whole[begin] = state
        state = whole
    return np.concatenate(of), np.concatenate(found), words


def _counted(longest: int, buckets: int):
    """How many features of the task's texts are in each bucket: one row per bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, at, _ = text_bytes(batch.column(0))
            for i, j in blocks(at):
                _, bucket, _ = features(data[at[i] : at[j]], at[i : j + 1] - at[i], longest, buckets)
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "n": total[some]})

    return run


def counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts per bucket, added up in the tasks first."""
    found = taken(texts, text=text).where("text IS NOT NULL").mapInArrow(_counted(longest, buckets), "bucket int, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A thousand times the logarithm of each bucket's share in the target over that in the raw texts, floored. At most
    `buckets` rows of each side are fetched."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, rows in ((s, raw), (t, target)):
        for r in rows.collect():
            side[r["bucket"]] = r["n"]
    raw_total, target_total = float(s.sum()), float(t.sum())
    ratio = (t + 1) * (raw_total + buckets) / ((s + 1) * (target_total + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def gumbel(seed: int, doc_id: object) -> int:
    """A thousand times a standard Gumbel number, floored, from the first 32 bits of a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, seed: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at, _ = text_bytes(batch.column("text"))
            n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j in blocks(at):
                of, bucket, count = features(data[at[i] : at[j]], at[i : j + 1] - at[i], longest, len(gain))
                n[i:j] = np.bincount(of, minlength=j - i)
                words[i:j] = count
                # Whole numbers below 2^53 add up exactly.
                total = np.bincount(of, gain[bucket], j - i).astype(np.int64)
                weight[i:j] = total // np.maximum(n[i:j], 1)
            noise = np.array([gumbel(seed, d) for d in batch.column("doc_id").to_pylist()], np.int64)
            columns = [batch.column("doc_id"), *[pa.array(x) for x in (n, words, weight, weight + noise)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "words", "weight", "score"])

    return run


KEY = ("score", "doc_id", "row")


def _ahead(pivot: Row) -> Column:
    """Whether a row comes before the pivot or is the pivot: higher score, then smaller id, nulls last, then smaller row."""
    score, doc_id, row = (F.col(c) for c in KEY)
    if pivot["doc_id"] is None:
        same, before = doc_id.isNull(), doc_id.isNotNull()
    else:
        same, before = doc_id == F.lit(pivot["doc_id"]), doc_id < F.lit(pivot["doc_id"])
    tied = before | (same & (row <= pivot["row"]))
    return (score > pivot["score"]) | ((score == pivot["score"]) & F.coalesce(tied, F.lit(False)))


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's candidates (ahead, score, doc_id, row): on each side of the pivot their number and median."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    for side in (True, False):
        own = t.filter(pc.equal(t.column("ahead"), side))
        if own.num_rows:
            order = pc.sort_indices(own, [("score", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
            median = own.take(order.slice((own.num_rows - 1) // 2, 1)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*median.columns, pa.array([own.num_rows], pa.int64())], [*median.schema.names, "n"])


def weighted_median(medians: list[Row]) -> Row:
    """The first median, in order of the keys, by which half of all candidates are counted."""
    order = lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] if r["doc_id"] is not None else 0, r["row"])
    total, so_far = sum(r["n"] for r in medians), 0
    for r in sorted(medians, key=order):
        so_far += r["n"]
        if 2 * so_far >= total:
            return r
    raise ValueError("no candidates")


def cutoff(keys: DataFrame, rank: int, rounds: int = ROUNDS) -> Row:
    """The key (score, doc_id, row) that is at this rank, from 1, in order of score down, doc_id and row. `keys`: a stored table of
    at least that many rows. Three of any four candidates, or less, are left after each round."""
    made = T.StructType([T.StructField("ahead", T.BooleanType()), *[keys.schema[c] for c in KEY], T.StructField("n", T.LongType())])
    left, bounds, pivot, done = keys.select(*KEY), F.lit(True), None, 0
    while True:
        ahead = F.lit(True) if pivot is None else _ahead(pivot)
        medians = left.where(bounds).select(ahead.alias("ahead"), *KEY).mapInArrow(_medians, made).collect()
        first = [r for r in medians if r["ahead"]]
        within = sum(r["n"] for r in first)
        # The wanted rank is on one side of the pivot; the other side is out for good.
        if rank <= within:
            side, bounds = first, bounds & ahead
        else:
            rank -= within
            side, bounds = [r for r in medians if not r["ahead"]], bounds & ~ahead
        if sum(r["n"] for r in side) == 1:
            return side[0]
        pivot, done = weighted_median(side), done + 1
        if done % rounds == 0:
            left, bounds = durable(left.where(bounds)), F.lit(True)


def ranked(winners: DataFrame) -> DataFrame:
    """The rows with their rank in order of score down, doc_id and row. No task sorts more than a range of the keys."""
    n = int(winners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")]
    dealt = durable(winners.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    # One row per range: at most n.
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return dealt.join(starts, "part").withColumn("rank", F.col("start") + inside).drop("part", "start")


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int,
    seed: int,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = BUCKETS,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank.

    Of the documents with at least `least_words` words `percent` in a hundred (floored) are drawn and numbered by rank; the
    others have none.
    """
    docs = taken(documents, doc_id=doc_id, text=text)
    gain = gains(counts(docs, "text", longest, buckets), counts(target, target_text, longest, buckets), buckets)
    made = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_features bigint, words bigint, weight bigint, score bigint").fields])
    scored = docs.mapInArrow(_scored(gain, seed, longest), made)
    # Stored with a number for each row: from here on all passes see the same rows.
    scored = durable(scored.withColumn("row", F.monotonically_increasing_id()))
    may = F.col("words") >= least_words
    drawn = scored.where(may).count() * percent // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if drawn == 0:
        return scored.select(*shown, none)
    wins = may & _ahead(cutoff(scored.where(may), drawn))
    winners = ranked(scored.where(wins).select(*shown, "row"))
    return scored.where(~wins).select(*shown, none).union(winners.select(*shown, "rank"))

"""Benchmark passages in documents, found by Wu-Manber multi-pattern search over words.

Patterns are all windows of `window` consecutive words of the benchmark texts; a text with fewer words is one window. Per
window length, a shift table tells for each block of two words how far the search may move on when it meets the block at the
window's end; a shift of zero leads to the bucket of the windows that end in the block, whose first block and then
all words are compared with the text. Occurrences are confirmed on the words' bytes.

Words are 64-bit hashes made from the bytes of a whole Arrow batch at once. All texts of a batch, in stretches that overlap by
a window, are searched side by side: each step looks up one block per stretch and moves every stretch on by its own shift.

Benchmark texts go to the tasks in blocks of bounded size, and every block is a pass over the documents; the hits of all but the
first are stored before the next block is fetched. A worker holds the windows of one block as arrays, about 10 bytes for a
byte of text and 25 while it makes them, which it does once.

Defined cases: words are runs of ASCII letters (A-Z in lower case), digits and all characters beyond ASCII. Null and empty texts
have no words. A benchmark text that is null or has no words is never found; equal ones are found together. A text
with a null item_id is searched if `unnamed` is set, as the query and uncontaminated() do; it is never among the item_ids. A document
is its id and its text; given twice it has two rows. Very long texts are searched whole, in stretches. Empty tables give no rows, or
no hits. Further columns, whatever their names, are not looked at, and stay in what uncontaminated() keeps.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import blocks, counts_per_text, kept_in_worker, kept_rows, mix, taken, text_bytes, word_bounds, word_hashes, word_table
from hearthline.runtime import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
# Characters of benchmark text per search; words per stretch of a document that is searched as one.
ITEM_BYTES, STRETCH = 8_000_000, 256
# Slots of the shift table, a power of two: bounded whatever the number of patterns, shared slots keep the smaller shift.
SLOTS = 1 << 20
FOUND = "array<struct<start: bigint, stop: bigint, item_id: string>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("item_id", pa.string())]))


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: their lower-case bytes, where words begin and end, their hashes, and each text's first word."""
    low = word_table("word")[data]
    starts, ends = word_bounds(low, at)
    return low, starts, ends, word_hashes(low, starts, ends), counts_per_text(at, starts)


class Patterns:
    """The windows of one length: shift table, and buckets by the block that ends a window. A window is the place of its
    first word among all words of the benchmark texts; equal ones are held once, with all items they are in."""

    def __init__(self, words: np.ndarray, at: np.ndarray, items: np.ndarray, length: int) -> None:
        self.words, self.length, self.block = words, length, min(2, length)
        whole = words[at]
        for i in range(1, length):
            whole = mix(whole) * np.uint64(0x9E3779B97F4A7C15) + words[at + i]
        order = np.lexsort((items, whole))
        whole, at, items = whole[order], at[order], items[order]
        new = np.append(True, whole[1:] != whole[:-1])
        apart = new | np.append(True, items[1:] != items[:-1])
        new, at, self.items = new[apart], at[apart], items[apart]
        self.group = np.append(np.flatnonzero(new), len(new))
        self.at = at[new]
        far = length - self.block + 1
        self.shift = np.full(SLOTS, far, np.int16)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, self._block_at(self.at + end), length - 1 - end)
        suffix = self._block_at(self.at + length - 1)
        self.by_suffix = np.argsort(suffix, kind="stable").astype(np.int32)
        self.begins = np.searchsorted(suffix[self.by_suffix], np.arange(SLOTS + 1)).astype(np.int32)
        self.prefix = self._block_at(self.at + self.block - 1).astype(np.int32)

    def _block_at(self, end: np.ndarray) -> np.ndarray:
        """The slot of the block whose last word is at `end`."""
        return self.slots(np.stack([self.words[end - i] for i in range(self.block - 1, -1, -1)], 1))

    @staticmethod
    def slots(block: np.ndarray) -> np.ndarray:
        total = block[:, 0].copy()
        for i in range(1, block.shape[1]):
            total = total * np.uint64(0x9E3779B97F4A7C15) + block[:, i]
        return (mix(total) & np.uint64(SLOTS - 1)).astype(np.int64)

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (first word) and patterns that occur in the texts; `first` tells where each text's words begin."""
        m, b = self.length, self.block
        if len(words) < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks_at = self.slots(np.lib.stride_tricks.sliding_window_view(words, b))
        # Stretches: the ends of windows in [at, stop) belong to one of them.
        lengths = np.diff(first)
        parts = np.maximum(0, -(-(lengths - m + 1) // STRETCH))
        text = np.repeat(np.arange(len(lengths)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = first[:-1][text] + m - 1 + part * STRETCH
        stop = np.minimum(at + STRETCH, first[1:][text])
        places, found = [], []
        while len(at):
            slot = blocks_at[at - b + 1]
            move = self.shift[slot]
            ends = at[move == 0]
            if len(ends):
                bucket = slot[move == 0]
                sizes = self.begins[bucket + 1] - self.begins[bucket]
                where = np.repeat(ends, sizes) - m + 1
                inside = np.arange(len(where)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                which = self.by_suffix[np.repeat(self.begins[bucket], sizes) + inside]
                same = self.prefix[which] == blocks_at[where]
                where, which = where[same], which[same]
                for i in range(m):
                    same = words[where + i] == self.words[self.at[which] + i]
                    where, which = where[same], which[same]
                places.append(where)
                found.append(which)
            at = at + np.maximum(move, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(found)


@dataclass
class Benchmark:
    """The words of benchmark texts and their windows by length; an item is its place in the list."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    windows: list[Patterns]

    def spelled(self, first: int, length: int) -> bytes:
        return spelled(self.low, self.starts, self.ends, first, length)


def spelled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, length: int) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(starts[first : first + length], ends[first : first + length]))


def patterns_of(texts: list[str], window: int) -> Benchmark:
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    low, starts, ends, words, first = words_of(np.frombuffer(b"".join(raw), np.uint8), at)
    size = np.diff(first)
    length = np.minimum(size, window)
    made = []
    for n in np.unique(length[length > 0]).tolist():
        of = np.flatnonzero(length == n)
        many = size[of] - n + 1
        item = np.repeat(of, many).astype(np.int32)
        inside = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        made.append(Patterns(words, first[item] + inside, item, n))
    return Benchmark(low, starts, ends, made)


def _occurrences(made: Benchmark, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Words per text, and the occurrences in each: first word, the word after the last, item."""
    low, starts, ends, words, first = words_of(data, at)
    spans: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    for p in made.windows:
        for place, which in zip(*p.search(words, first)):
            # Compared again on the words themselves: hashes only say where to look.
            if spelled(low, starts, ends, place, p.length) != made.spelled(p.at[which], p.length):
                continue
            text = int(np.searchsorted(first, place, "right")) - 1
            begin = int(place - first[text])
            spans[text] += [
                {"start": begin, "stop": begin + p.length, "item": int(i)} for i in p.items[p.group[which] : p.group[which + 1]]
            ]
    return np.diff(first), spans


def tables(name: str, items: list[tuple[str | None, str]], window: int) -> Benchmark:
    """The windows of a block of the benchmark, made once in a worker that runs several tasks; only one block's are kept."""
    held = kept_in_worker("benchmark")
    if name not in held:
        held.clear()
        held[name] = patterns_of([t for _, t in items], window)
    return held[name]


def _searched(items: list[tuple[str | None, str]], window: int, hits_only: bool = False):
    """Words and occurrences of the items (id, text) in each document, or only in those that have some. Of a row's columns the
    last is the text."""
    name = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tables(name, items, window)
        for batch in batches:
            data, at, _ = text_bytes(batch.column(batch.num_columns - 1))
            for i, j in blocks(at):
                count, spans = _occurrences(made, data[at[i] : at[j]], at[i : j + 1] - at[i])
                new = [[{"start": s["start"], "stop": s["stop"], "item_id": items[s["item"]][0]} for s in found] for found in spans]
                names = [*batch.schema.names[:-1], "n_words", "spans"]
                columns = [c.slice(i, j - i) for c in batch.columns[:-1]]
                rows = pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(new, SPAN)], names)
                yield rows.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else rows

    return run


def _without(items: list[tuple[str | None, str]], window: int) -> Callable[[pa.Array], np.ndarray]:
    """Which texts hold no window of the items."""
    name = uuid4().hex

    def clean(texts: pa.Array) -> np.ndarray:
        made = tables(name, items, window)
        data, at, _ = text_bytes(texts)
        found = [spans for i, j in blocks(at) for spans in _occurrences(made, data[at[i] : at[j]], at[i : j + 1] - at[i])[1]]
        return np.array([not spans for spans in found], bool)

    return clean


def benchmark_blocks(benchmark: DataFrame, item_bytes: int) -> Iterator[list]:
    """The benchmark's rows, fetched partition by partition and handed on in lists of at most `item_bytes` characters
    of ids and texts; a longer text is alone."""
    some, size = [], 0
    for row in benchmark.toLocalIterator():
        more = len(row["item_id"] or "") + len(row["text"])
        if some and size + more > item_bytes:
            yield some
            some, size = [], 0
        some.append((row["item_id"], row["text"]))
        size += more
    if some:
        yield some


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    item_bytes: int = ITEM_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    unnamed: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (start and stop in words, item_id), n_hit, item_ids.

    `unnamed`: texts with a null item_id are searched too.
    """
    searches = benchmark_blocks(_items(benchmark, item_id, item_text, unnamed), item_bytes)
    t1, t2 = (F.xxhash64(F.lit(seed), "text") for seed in (3, 4))
    docs = taken(documents, doc_id=doc_id, text=text).select("doc_id", t1.alias("t1"), t2.alias("t2"), "text")
    counted = _pass(docs, _searched(next(searches, []), window))
    # Hits of further blocks: per document, which is its id and its text, however many rows have them.
    hits = counted.select("doc_id", "t1", "t2", "spans").limit(0)
    for items in searches:
        found = _pass(docs, _searched(items, window, hits_only=True)).groupBy("doc_id", "t1", "t2").agg(F.first("spans").alias("spans"))
        hits = hits.union(durable(found))
    hits = hits.groupBy("doc_id", "t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("more"))
    hits = hits.withColumnsRenamed({c: f"of_{c}" for c in ("doc_id", "t1", "t2")})
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("t1").eqNullSafe(F.col("of_t1")) & F.col("t2").eqNullSafe(F.col("of_t2"))
    spans = F.concat("spans", F.coalesce("more", F.array().cast(FOUND)))
    found = counted.join(hits, same, "left").select("doc_id", "n_words", spans.alias("spans"))
    ids = F.array_sort(F.array_distinct(F.array_compact(F.col("spans")["item_id"])))
    return found.select("doc_id", "n_words", "spans", covered(F.col("spans")).alias("n_hit"), ids.alias("item_ids"))


def _items(benchmark: DataFrame, item_id: str, item_text: str, unnamed: bool) -> DataFrame:
    items = taken(benchmark, item_id=item_id, text=item_text).select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.where("text IS NOT NULL" if unnamed else "item_id IS NOT NULL AND text IS NOT NULL")


def _pass(docs: DataFrame, search) -> DataFrame:
    more = T.StructType.fromDDL(f"n_words bigint, spans {FOUND}")
    return docs.mapInArrow(search, T.StructType([*docs.schema.fields[:-1], *more.fields]))


def covered(spans):
    """Words in any of the spans: sorted by start, each adds what lies behind the furthest end so far."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("sum"))

    def add(state, s):
        more = F.greatest(F.lit(0).cast("bigint"), s["stop"] - F.greatest(s["start"], state["end"]))
        return F.struct(F.greatest(state["end"], s["stop"]).alias("end"), (state["sum"] + more).alias("sum"))

    return F.aggregate(F.array_sort(spans), start, add)["sum"]


def uncontaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    item_bytes: int = ITEM_BYTES,
    unnamed: bool = True,
) -> DataFrame:
    """The documents in which no benchmark passage occurs, with all their columns. Each block of the benchmark is a pass over
    the documents that the ones before left, which are stored in between."""
    kept = documents
    for i, items in enumerate(benchmark_blocks(_items(benchmark, item_id, item_text, unnamed), item_bytes)):
        kept = kept_rows(durable(kept) if i else kept, text, _without(items, window))
    return kept

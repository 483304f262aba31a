"""Documents whose sets of word shingles have a Jaccard similarity of at least `percent`: an exact join by universe partition.

Two linked sets of s and r tokens differ in at most (100 - percent) * (s + r) / (100 + percent) tokens. The token universe
is cut into segments by a hash, another cut for each band of sizes. A segment is worth one unit if equal subsets are looked
for, and two if subsets that differ in one token are found as well, by an index of each subset and its one-deletion
neighbourhood. If the units exceed the differences that are allowed, linked sets meet in a segment (pigeonhole).

A band's layout, which segments are worth two and how many units are spare, is the cheapest by a cost model of rows
and chance meetings. Empty subsets would be one key for many sets: they take up spare units and are not indexed.
Only sets with more empty units than are spare index them, and among those nothing is missed. A set emits as many
segments of a band's layout as its own size needs, in its own band and in the lower ones whose sets it may be linked with.

Every candidate is verified on the whole sets. Tokens are 64-bit hashes of shingles, equal sets meet by 128 bits.

Defined cases: words are runs of anything but ASCII white space, A-Z in lower case. Fewer words than a shingle has are one shingle;
null text and text without words are empty sets, linked with nothing. A doc_id given twice is one document with
two texts, of which each has its row and either may link it; a null doc_id has a size but no links and no component. Ids
are whole numbers, or texts of them; any other text ends the job. Very long texts are searched whole. An empty table gives no rows. Further
columns, whatever their names, are not looked at, and stay in what one_of_each() keeps.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import erfc, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import blocks, counts_per_text, mix, taken, text_bytes, word_bounds, word_hashes, word_table
from hearthline.llm.similar import SETS, SETS_ARROW, components, key_rows, meet, set_row, wanted
from hearthline.runtime import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, PERCENT = 5, 80
# Sizes for which layouts are made; a larger set would have more tokens than an array can hold.
LARGEST = 1 << 31
# Cost model: a row is 1; what a chance meeting of one-token subsets and of empty subsets costs in rows.
CHANCE, EMPTIES = 3.0, 50.0


def differences(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The most tokens in which two linked sets of `total` tokens together can differ."""
    return (100 - percent) * total // (100 + percent)


def more_than(count: int, mean: float) -> float:
    """The chance that a Poisson number is above `count`."""
    if mean > 30:
        return 0.5 * erfc((count + 0.5 - mean) / sqrt(2 * mean))
    below, term = 0.0, exp(-mean)
    for k in range(min(count, 200) + 1):
        below += term
        term *= mean / (k + 1)
    return max(0.0, 1.0 - below)


def layouts(percent: int, largest: int = LARGEST) -> np.ndarray:
    """One row per band: lowest and highest size of the smaller set, segments worth two, worth one, spare units."""
    rows, low = [], 1
    while differences(low + 100 * low // percent, percent) < 1:
        low += 1
    while low <= largest:
        high = max(low, int(low * 1.2))
        needed = int(differences(high + 100 * high // percent, percent)) + 1
        choices = []
        for spare in sorted({0, 1, 2, 3, *(int(needed * x) for x in (0.05, 0.1, 0.15, 0.2, 0.3))}):
            for part in (0.0, 0.25, 0.5, 0.75, 1.0):
                two = -int(-(needed + spare) * part // 2)
                one = max(0, needed + spare - 2 * two)
                m, units = two + one, 2 * two + one
                mean = low / m
                empty = m * exp(-mean) if m > 1 else 0.0
                alone = m * mean * exp(-mean) if m > 1 else 0.0
                unfit = more_than(units - needed, empty * units / m)
                cost = one + two * (1 + mean) + CHANCE * alone + EMPTIES * unfit * empty
                choices.append((cost, two, one, units - needed))
        rows.append((low, high, *min(choices)[1:]))
        low = high + 1
    return np.array(rows, np.int64).reshape(-1, 5)


def doc_tokens(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a run of texts, sorted by text and hash, and where each text's begin."""
    table = word_table("space")
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    starts, ends = word_bounds(data, at, gap)
    words = word_hashes(table[data], starts, ends)
    first = counts_per_text(at, starts)
    count = np.diff(first)
    of = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(words)) - first[:-1][of]
    # A shingle begins at each word that has enough words after it, or at the first of a short text.
    head = (place + shingle <= count[of]) | ((place == 0) & (count[of] < shingle))
    begin = np.flatnonzero(head)
    size = np.minimum(count[of[begin]], shingle)
    total = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for i in range(shingle):
        here = begin + i
        ok = i < size
        value = words[np.where(ok, here, 0)] * np.uint64(2 * i + 1)
        total += np.where(ok, mix(value + np.uint64(i)), np.uint64(0))
    token, doc = mix(total), of[begin]
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(count) + 1))


def _signatures(token: np.ndarray, begin: np.ndarray, ids: np.ndarray, percent: int, plan: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and ids of all sets, from their own band and the lower ones they need."""
    n = np.diff(begin)
    if not len(n) or n.max() == 0:
        return
    low, high, twos, ones, spares = plan.T
    own = np.searchsorted(low, n, "right") - 1
    spread = mix(token)
    for back in range(4):
        band = own - back
        partner = -(-n * percent // 100)
        # As the larger set: the smaller one is at most `most` and at least `partner`.
        ok = (band >= 0) & (n > 0)
        most = high[np.maximum(band, 0)]
        if back:
            ok &= most >= partner
        if not ok.any():
            continue
        sets = np.flatnonzero(ok)
        b, size = band[sets], n[sets]
        total = size + 100 * size // percent if back == 0 else size + np.minimum(most[sets], size)
        two, spare = twos[b], spares[b]
        m = two + ones[b]
        units = np.minimum(differences(total, percent) + 1 + spare, 2 * two + ones[b])
        emitted = np.where(units <= 2 * two, -(-units // 2), units - two)
        base = np.concatenate([[0], np.cumsum(m)])
        row = np.repeat(np.arange(len(sets)), size)
        where = np.concatenate([np.arange(begin[s], begin[s + 1]) for s in sets]) if len(sets) < len(n) else np.arange(begin[-1])
        tok = spread[where]
        salt = mix((b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
        cut = (mix(tok ^ salt[row]) >> np.uint64(20)) % m[row].astype(np.uint64)
        cut = cut.astype(np.int64)
        used = cut < emitted[row]
        row, cut, tok = row[used], cut[used], tok[used]
        flat = base[row] + cut
        size_of = np.bincount(flat, minlength=base[-1])
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, flat, tok)
        # Segment tag: band and segment; with the subset's size and sum it makes the key.
        who = np.repeat(np.arange(len(sets)), m)
        segment = np.arange(base[-1]) - base[who]
        tag = mix(salt[who] + segment.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
        worth = np.where(segment < two[who], 2, 1)
        inside = segment < emitted[who]
        lost = np.where(inside, np.maximum(0, worth - size_of), 0)
        lack = np.bincount(who, lost, len(sets)) > spare
        whole = inside & ((size_of > 0) | lack[who])
        count = np.uint64(0x589965CC75374CC3)
        yield mix(sums[whole] + tag[whole] + size_of[whole].astype(np.uint64) * count), ids[sets[who[whole]]]
        # One-deletion neighbourhoods where a segment is worth two.
        near = (cut < two[row]) & ((size_of[flat] > 1) | lack[row])
        f = flat[near]
        yield mix(sums[f] - tok[near] + tag[f] + (size_of[f] - 1).astype(np.uint64) * count), ids[sets[row[near]]]


def _keys(shingle: int, percent: int):
    plan = layouts(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, at, _ = text_bytes(batch.column(1))
            for i, j in blocks(at):
                token, begin = doc_tokens(data[at[i] : at[j]], at[i : j + 1] - at[i], shingle)
                own, n = ids[i:j], np.diff(begin)
                of = np.repeat(np.arange(j - i), n)
                key, check = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                np.add.at(key, of, mix(token ^ np.uint64(0x1D8E4E27C47D124F)))
                np.add.at(check, of, mix(token ^ np.uint64(0xEB44ACCAB455D165)))
                # An empty set is equal to nothing: its key is its own.
                lone = mix(own.astype(np.int64).view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))
                key, check = np.where(n > 0, mix(key), lone), np.where(n > 0, mix(check), mix(lone)) | np.uint64(1)
                rows = [(key, check, own, n)]
                for k, who in _signatures(token, begin, own, percent, plan):
                    rows.append((k, np.zeros(len(k), np.uint64), who, np.full(len(k), -1)))
                parts = [np.concatenate(x) for x in zip(*rows)]
                yield key_rows(parts[0].view(np.int64), parts[1].view(np.int64), parts[2].astype(np.int64), parts[3].astype(np.int32))

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, at, _ = text_bytes(batch.column(1))
            for i, j in blocks(at):
                token, begin = doc_tokens(data[at[i] : at[j]], at[i : j + 1] - at[i], shingle)
                rows = [set_row(token[begin[k] : begin[k + 1]]) for k in range(j - i)]
                yield pa.RecordBatch.from_pydict(
                    dict(zip(SETS_ARROW.names, (ids[i:j], *zip(*rows)))), schema=SETS_ARROW
                )

    return run


def _sizes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at, _ = text_bytes(batch.column(0))
            for i, j in blocks(at):
                _, begin = doc_tokens(data[at[i] : at[j]], at[i : j + 1] - at[i], shingle)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(begin), pa.int64())], ["n"])

    return run


def jaccard_components(
    documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach), copy_of (the smallest
    doc_id with the same set)."""
    given = taken(documents, id=doc_id, text=text).select(F.col("id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    named = given.where("id IS NOT NULL")
    shared = meet(named, _keys(shingle, percent))
    whole = shared.where("n IS NOT NULL")
    # A copy may be led by a copy in its block, which the original leads. Rows of copies go.
    copies = whole.groupBy("id").agg(F.max("leader").alias("original")).where("id <> original")
    originals = copies.select(F.col("id").alias("leader"), "original")
    whole = whole.join(originals, "leader", "left").select("id", "n", F.coalesce("original", "leader").alias("leader"))
    subsets = (
        shared.where("n IS NULL")
        .select("key", "id", "leader")
        .distinct()
        .join(copies, "id", "left_anti")
        .join(originals, "leader", "left")
        .select("key", "id", F.coalesce("original", "leader").alias("leader"))
    )

    def sets_of(ids: DataFrame) -> DataFrame:
        return wanted(named, ids).mapInArrow(_sets(shingle), SETS)

    roots = components(subsets, sets_of, percent)
    linked = whole.join(roots.select(F.col("id").alias("leader"), "root"), "leader", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce("root", "leader").alias("component_id"),
        F.col("leader").alias("copy_of"),
    )
    none = F.lit(None).cast("bigint")
    unnamed = given.where("id IS NULL").select("text").mapInArrow(_sizes(shingle), "n bigint")
    return linked.unionByName(unnamed.select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id"), none.alias("copy_of")))


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The documents without near duplicates: of each component one row stays, with all its columns.

    It is the one with the smallest doc_id, a null one last, and of those the one whose text has the smallest hash. Rows are
    linked by their texts, whether they share a doc_id or have none; those without words are linked with nothing.
    """
    # Stored, so that a row keeps its number. The given columns stay together in one, so none of them clashes.
    given = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
    rows = durable(documents.select(given, F.monotonically_increasing_id().alias("row")))
    own = [F.col("doc").getField(c) for c in (doc_id, text)]
    slim = rows.select("row", own[0].alias("doc_id"), own[1].alias("text"))
    found = durable(jaccard_components(slim, doc_id="row", text="text", **options).select(F.col("doc_id").alias("row"), "component_id"))
    several = found.where("row <> component_id").select("component_id").distinct()
    hashes = [F.xxhash64(F.lit(n), "text").alias(f"t{n}") for n in (1, 2)]
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *hashes, "row").alias("place")
    members = durable(found.join(several, "component_id", "left_semi").join(slim.select("row", place), "row"))
    stays = members.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.row").alias("row"))
    gone = members.join(stays, "row", "left_anti").select("row")
    return rows.join(gone, "row", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in documents.columns])

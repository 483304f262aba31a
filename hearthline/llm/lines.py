"""Fuzzy line duplicates: MinHash over character shingles, exact verification, union-find; one line of each component stays.

Lines are compared without ASCII-blank ends and in lower case. Equal ones become one class by a 128-bit hash, combined in
the map task; no text is moved for that. Each distinct line gets a signature: its shingles (runs of `width` bytes) are hashed once and dealt into bins, and each bin
keeps its smallest hash (one permutation hashing; an empty bin borrows from the next filled one). Bands of `rows` bins are
the keys. With 12 bands of 4, a pair of similarity 0.8 is found with a chance of 0.998, of 0.9 with 0.99999. Every
candidate is verified on its whole sets of shingles, and components are joined by union-find. The line that stays is the
one that comes first by doc_id and place.

Defined cases: null and empty texts have no lines. Blank lines are never duplicates. A line shorter than a shingle is
one shingle, so short lines are duplicates if equal. Different lines that share the first 64 bits of their hash (about
one pair among 6 * 10^9 lines) are duplicates of equal lines only. A null doc_id sorts last. A document is its doc_id and a
128-bit hash of its text: rows that share an id, or have none, are documents of their own if their texts differ. Of lines with the
same doc_id and place the one whose text has the smaller hash comes first. A document given twice is one document: both rows
keep the same lines. Very long lines and texts are compared whole. An empty table gives no rows. Further columns, whatever their
names, are not looked at, and stay in what without_repeats() keeps.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import PIECE, blocks, byte_values, kept_in_worker, mix, powers, taken, text_bytes
from hearthline.llm.similar import SETS, SETS_ARROW, components, key_rows, meet, set_row, wanted
from hearthline.runtime import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, BANDS, ROWS, PERCENT = 8, 12, 4, 80
BLANK = " \t\r\f\x0b"
FIRST = [np.ones(1, bool)]
# Bytes of lines whose shingles a task holds at a time; each takes about 80 bytes.
BYTES = 1 << 19
# Bytes of lines whose signatures are made together: few enough for a processor's cache.
CACHED = 1 << 16


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` bytes of each line, or of the whole of a shorter line, and where each line's begin."""
    size = np.diff(at)
    count = np.where(size == 0, 0, np.maximum(1, size - width + 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begin[-1], np.uint64)
    values, (up, down) = byte_values(), powers(max(PIECE, int(size.max(initial=0))) + 1)
    each = 0xD6E8FEB86659FD93
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        s, e = int(at[i]), int(at[j])
        total = np.zeros(e - s + 1, np.uint64)
        np.cumsum(values[data[s:e]] * up[: e - s], out=total[1:])
        # Runs from every byte, without those over a line's end; then the short lines.
        every = (total[width:] - total[:-width]) * down[: max(0, len(total) - width)] + np.uint64(width * each % (1 << 64))
        own, short = size[i:j], np.flatnonzero((size[i:j] < width) & (size[i:j] > 0))
        keep = np.ones(len(every), bool)
        over = (at[i + 1 : j + 1] - s)[:, None] - np.arange(1, width)
        over = over[over >= (at[i:j] - s)[:, None]]
        keep[over[over < len(every)]] = False
        place = np.ones(begin[j] - begin[i], bool)
        place[begin[i:j][short] - begin[i]] = False
        part = out[begin[i] : begin[j]]
        part[place] = every[keep]
        first = at[i:j][short] - s
        part[~place] = (total[first + own[short]] - total[first]) * down[first] + own[short].astype(np.uint64) * np.uint64(each)
        i = j
    return mix(out), begin


def signatures(token: np.ndarray, begin: np.ndarray, bins: int) -> np.ndarray:
    """One permutation hashing: per line and bin the smallest hash; empty bins take that of the next filled one."""
    lines = len(begin) - 1
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(lines * bins, none, np.uint64)
    bin_of = ((token >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, np.repeat(np.arange(lines), np.diff(begin)) * bins + bin_of, mix(token))
    out = out.reshape(lines, bins)
    # Where the next filled bin is, around the end: of a line without any, nowhere.
    place = np.arange(2 * bins)
    filled = np.where(np.tile(out != none, 2), place, 4 * bins)
    ahead = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1][:, :bins] - place[:bins]
    line, bin_ = np.nonzero((ahead > 0) & (ahead < bins))
    far = ahead[line, bin_]
    # The distance goes into the borrowed value, so that equal borrowings mean the same donor bin.
    out[line, bin_] = mix(out[line, (bin_ + far) % bins] + far.astype(np.uint64))
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        total += mix(signature[:, r::rows][:, :bands] * np.uint64(2 * r + 1))
    return mix(total + mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :])


def _keys(width: int, bands: int, rows: int):
    def made(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        token, begin = shingles(data[at[0] : at[-1]], at - at[0], width)
        return band_keys(signatures(token, begin, bands * rows), bands, rows).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("lines")
        for batch in batches:
            # A line's id is made from the line, so equal lines of a batch are looked at once.
            ids, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            data, at, _ = text_bytes(batch.column(1).take(pa.array(first)))
            for i, j in blocks(at, BYTES):
                key = np.concatenate([made(data, at[a + i : b + i + 1]) for a, b in blocks(at[i : j + 1], CACHED)])
                who = np.repeat(ids[i:j], bands)
                yield key_rows(key.view(np.int64), np.zeros(len(key), np.int64), who, np.full(len(key), -1, np.int32))

    return run


def distinct(token: np.ndarray) -> np.ndarray:
    """np.unique() for many short arrays."""
    token = np.sort(token)
    return token if len(token) < 2 else token[np.concatenate(FIRST + [token[1:] != token[:-1]])]


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, at, _ = text_bytes(batch.column(1))
            for i, j in blocks(at, BYTES):
                token, begin = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
                raw = [data[at[k] : at[k + 1]].tobytes() for k in range(i, j)]
                rows = [set_row(distinct(token[begin[k] : begin[k + 1]]), raw[k]) for k in range(j - i)]
                yield pa.RecordBatch.from_pydict(
                    dict(zip(SETS_ARROW.names, (ids[i:j], *zip(*rows)))), schema=SETS_ARROW
                )

    return run


def _read(width: int):
    def read(bodies: list[bytes]) -> list[np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
        token, begin = shingles(np.frombuffer(b"".join(bodies), np.uint8), at, width)
        return [distinct(token[a:b]) for a, b in zip(begin, begin[1:])]

    return read


def text_hash(text: Column) -> tuple[Column, Column]:
    """128 bits that tell a document from others of its doc_id."""
    return F.xxhash64(F.lit(3), text), F.xxhash64(F.lit(4), text)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line that isn't blank: the first columns, line_no, and the line without blank ends, of texts in the last column."""
    for batch in batches:
        _, at, _ = text_bytes(batch.column(batch.num_columns - 1))
        for i, j in blocks(at):
            part = batch.slice(i, j - i)
            split = pc.split_pattern(part.column(part.num_columns - 1), "\n")
            row, line = pc.list_parent_indices(split), pc.ascii_trim(split.flatten(), characters=BLANK)
            place = np.arange(len(line)) - (np.asarray(split.offsets)[:-1] - split.offsets[0].as_py())[row.to_numpy()]
            full = pc.not_equal(line, "")
            row = row.filter(full)
            columns = [c.take(row) for c in part.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(place, pa.int32()).filter(full), line.filter(full)], [*part.schema.names[:-1], "line_no", "norm"]
            )


def numbered_lines(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, t1 and t2 (the hash of the document's text), line_no (from 0), norm (the line as it is compared) and its
    128-bit hash, without blank lines."""
    t1, t2 = text_hash(F.col("text"))
    # No letter's lower case depends on what is beyond its line's ends, so whole texts can be lower-cased.
    given = taken(documents, doc_id=doc_id, text=text).where("text IS NOT NULL")
    given = given.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.lower("text").alias("text"))
    shape = T.StructType([*given.schema.fields[:-1], *T.StructType.fromDDL("line_no int, norm string").fields])
    lines = given.mapInArrow(_cut, shape)
    return lines.select("*", F.xxhash64(F.lit(1), "norm").alias("h1"), F.xxhash64(F.lit(2), "norm").alias("h2"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line_no", "t1", "t2")


def line_classes(
    documents: DataFrame,
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
    percent: int = PERCENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per line that isn't blank: doc_id, line_no, class_doc_id and class_line_no (the line that stays), kept."""
    found = _classes(documents, width, bands, rows, percent, doc_id, text)
    return found.select("doc_id", "line_no", "class_doc_id", "class_line_no", "kept")


def _classes(documents: DataFrame, width: int, bands: int, rows: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The rows of line_classes, and which document a line is of: t1, t2."""
    lines = numbered_lines(documents, doc_id, text)
    # Stored, so that texts are cut into lines once.
    lines = durable(lines, compression="zstd")
    places = lines.drop("norm")
    # One row per distinct line, without its text; the first half of the hash is the line's id among similar lines.
    first = F.min(_place()).alias("first")
    classes = durable(places.groupBy("h1", "h2").agg(first))
    alike = durable(classes.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"))
    named = lines.select(F.col("h1"), "norm").join(alike, "h1", "left_anti").withColumnRenamed("h1", "id")

    def sets_of(ids: DataFrame) -> DataFrame:
        once = wanted(named, ids).groupBy("id").agg(F.first("norm").alias("norm"))
        return once.mapInArrow(_sets(width), SETS)

    shared = meet(named, _keys(width, bands, rows))
    roots = components(shared.select("key", "id", "leader"), sets_of, percent, _read(width), small=True)
    linked = classes.join(roots, F.col("h1") == F.col("id"))
    stays = linked.groupBy("root").agg(F.min("first").alias("stays"))
    moved = durable(linked.join(stays, "root").select("h1", "stays"))
    classes = classes.join(moved, "h1", "left").select("h1", "h2", F.coalesce("stays", "first").alias("stays"))
    return (
        places.join(classes, ["h1", "h2"])
        .select(
            "doc_id",
            "t1",
            "t2",
            "line_no",
            F.col("stays.doc_id").alias("class_doc_id"),
            F.col("stays.line_no").alias("class_line_no"),
            (_place() == F.col("stays")).alias("kept"),
        )
    )


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None, **options: int) -> DataFrame:
    """The documents with only the lines that stay, and all their columns; `length` names a column to set to the new length.

    A document that had lines and loses them all goes; one that had none stays as it is.
    """
    given = {"width": WIDTH, "bands": BANDS, "rows": ROWS, "percent": PERCENT} | options
    gone = (
        _classes(documents, doc_id=doc_id, text=text, **given)
        .where("NOT kept")
        .groupBy("doc_id", "t1", "t2")
        .agg(F.collect_set("line_no").alias("gone"))
    )
    # The given columns stay together in one, so none of them clashes.
    doc = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
    body = F.col("doc").getField(text)
    t1, t2 = text_hash(body)
    same = F.col("doc").getField(doc_id).eqNullSafe(F.col("doc_id")) & (t1 == F.col("t1")) & (t2 == F.col("t2"))
    lines = F.split(body, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(F.array_sort(left), lambda i: F.element_at(lines, i + 1)), "\n")
    cut = documents.select(doc).join(gone, same, "left").select("doc", "gone", F.when(F.col("gone").isNull(), body).otherwise(kept).alias("new"))
    stays = F.col("gone").isNull() | (F.trim(F.translate("new", "\n\t\r\f\x0b", "     ")) != "")
    made = {text: F.col("new")} | ({length: F.length("new").cast(documents.schema[length].dataType)} if length else {})
    return cut.where(stays).select(*[(made[c] if c in made else F.col("doc").getField(c)).alias(c) for c in documents.columns])

"""What the operators share: folds, input columns, and words of Arrow batches without a Python object per word."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The functions that run in tasks travel with them, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of text that are looked at together; a longer text is a block of its own.
BLOCK = 1 << 21
# Bytes of words that are hashed together.
PIECE = 1 << 18


def taken(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed to the keywords; further columns, whatever their names, are left behind."""
    return df.select(*[F.col(f"`{given}`").alias(name) for name, given in columns.items()])


def _held() -> dict:
    """What lasts as long as a worker."""
    return sys.modules.setdefault("hearthline_kept", ModuleType("hearthline_kept")).__dict__


def kept_in_worker(owner: str) -> dict:
    """What an operator keeps in a worker that runs several of its tasks; what another operator kept there is let go."""
    held = _held()
    if held.get("owner") != owner:
        held.clear()
        held.update(owner=owner, kept={})
        pa.default_memory_pool().release_unused()
    return held["kept"]


def kept_rows(documents: DataFrame, text: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text `keep` wants, with all their columns. Rows go to the task's Python once, as they are, in parts of
    bounded bytes, so it doesn't matter what columns are called."""
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * BLOCK // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                yield part.filter(pa.array(keep(part.column(place)), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits (a fixed, invertible mapping)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each begins and ends, and which are not null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0], column.is_valid().to_numpy(zero_copy_only=False)


def blocks(at: np.ndarray, size: int = BLOCK, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most `size` bytes and `rows` texts; a longer text is alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def word_table(letters: str = "word") -> np.ndarray:
    """What each byte becomes: its lower-case form if words hold it, else 0.

    "word" takes ASCII letters and digits and all bytes beyond ASCII, "space" all but ASCII white space.
    """
    b = np.arange(256, dtype=np.uint8)
    low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    if letters == "word":
        keep = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (b >= 128)
    else:
        keep = ~((b == 32) | ((b >= 9) & (b <= 13)))
    return np.where(keep, low, 0).astype(np.uint8)


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2^64. A worker makes those that pieces need once."""
    held = _held()
    if n <= PIECE + 1 and "powers" in held:
        return held["powers"][0][:n], held["powers"][1][:n]
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(max(n, PIECE + 1), b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= PIECE + 1:
        held["powers"] = out
    return out[0][:n], out[1][:n]


def word_bounds(mapped: np.ndarray, at: np.ndarray, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end. No word runs over the end of a text. `gap`: bytes outside words (default: mapped to 0)."""
    inside = mapped != 0 if gap is None else ~gap
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    # A text's end cuts a word that touches the next text.
    cut = at[(at > 0) & (at < len(inside))]
    edge[cut] = True
    borders = np.flatnonzero(edge)
    starts, ends = borders[:-1], borders[1:]
    real = inside[starts] if len(inside) else np.zeros(0, bool)
    return starts[real], ends[real]


def word_hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    out = np.empty(len(starts), np.uint64)
    values, (up, down) = byte_values(), powers(max(PIECE, int((ends - starts).max(initial=0))))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        s, e = starts[i], ends[j - 1]
        total = np.empty(e - s + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[mapped[s:e]] * up[: e - s], out=total[1:])
        a, b = starts[i:j] - s, ends[i:j] - s
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def counts_per_text(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each text's words begin in the list of words, and where the last one's end."""
    return np.searchsorted(starts, at)


def as_batch(schema: pa.Schema, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )

"""Packing of tokenised documents into sequences of a fixed length: patterns by non-negative least squares.

Documents are tokenised, ended with an id of their own and, only if longer than a sequence, cut into pieces of that length. What is
packed is the histogram of piece lengths, whose size does not grow with the data: lengths are put into classes of equal width, all
patterns of a few classes that fill a sequence are enumerated, repeat counts are fitted to the histogram by non-negative least squares
and rounded down, the patterns are filled with exact lengths, and the rest is packed best-fit, longest first, into the gaps
that are left and into new sequences. Every step works on (pattern, repeats), never on single pieces.

Pieces get their place by rank among the pieces of their length: a piece knows its rank within its task, and ranks of the tasks are
added up per length. The plan of a few thousand (length, first rank) entries then gives sequence and offset. A length
that a third of all pieces have is split over all tasks.

Runs are tokenised once per worker: what a run of non-blank characters becomes does not depend on its neighbours, since the
tokenizer drops white space; runs, and the words and signs they are made of, are kept in tables that are emptied when full.

Defined cases: a null or empty text is one piece, the end id alone. A document given twice is packed twice. Any doc_id may be null.
Very long texts are cut into as many
pieces as they need. An empty table gives no rows. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import blocks, kept_in_worker, taken, text_bytes
from hearthline.runtime import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST, END_ID = 4096, 1
# Width of a length class, and pieces in a pattern; entries of each table that a worker keeps (about 200 bytes each).
CLASS, PARTS, REMEMBERED = 64, 4, 800_000


Tables = tuple[dict[bytes, bytes], dict[bytes, bytes]]  # runs, and stems and signs that runs are made of


def remembered(path: str) -> tuple[tokenizers.Tokenizer, Tables]:
    """The tokenizer and its tables, which outlive a task in a worker that is used again."""
    kept = kept_in_worker("packing")
    if path not in kept:
        kept[path] = (tokenizers.Tokenizer.from_file(path), ({}, {}))
    return kept[path]


# A word of ASCII or Latin-1 letters, and ASCII signs after it, but no apostrophe, which may begin a piece with letters.
# Whatever the two are, the tokenizer cuts between them: letters and signs are pieces of their own to it.
STEM = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def learn_runs(tokenizer: tokenizers.Tokenizer, tables: Tables, runs: list[bytes], remembered: int = REMEMBERED) -> None:
    """Adds the ids of the runs to the table. Runs that are a word and signs are made of these, which many runs share; ASCII
    letters may be in lower case, as the tokenizer takes them so."""
    table, pieces = tables
    stems, signs = [], []
    for run in runs:
        # bytes.isalpha() knows ASCII letters only.
        m = None if run.isalpha() else STEM.fullmatch(run)
        stems.append(m[1].lower() if m else run.lower() if run.isalpha() else run)
        signs.append(m[2] if m else b"")
    needed = {*stems, *signs}
    needed.discard(b"")
    if len(pieces) + len(needed) > remembered:
        pieces.clear()
    new = needed.difference(pieces)
    plain = plain_words(tokenizer)
    words = list(filter(bytes.isalpha, new)) if plain else []
    for at in range(0, len(words), 500):
        word_ids(plain, pieces, words[at : at + 500])
    ids_of(tokenizer, pieces, list(new.difference(words)))
    pieces[b""] = b""
    table.update(zip(runs, [pieces[p] + pieces[q] for p, q in zip(stems, signs)]))


# Normalizers that leave ASCII letters in lower case as they are, and patterns that take a run of letters as one piece.
KEEPS_WORDS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
CUTS_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def plain_words(tokenizer: tokenizers.Tokenizer) -> tokenizers.Tokenizer | None:
    """The same tokenizer without the steps that do nothing to ASCII words in lower case but cut them at blanks; None for a tokenizer
    that may do more, or that has words of its own (added tokens)."""
    kept = kept_in_worker("packing").setdefault("plain", {})
    if id(tokenizer) not in kept:
        made = json.loads(tokenizer.to_str())
        normalizer, cutter = made["normalizer"] or {}, made["pre_tokenizer"] or {}
        steps = cutter.get("pretokenizers", [{}])
        cuts = {"type": "Split", "pattern": {"Regex": CUTS_WORDS}, "behavior": "Removed", "invert": True}
        known = all(n in KEEPS_WORDS for n in normalizer.get("normalizers", [None])) and steps == [cuts, BYTES]
        known &= not made["added_tokens"] or all(not t["content"].isalpha() for t in made["added_tokens"])
        if known:
            made |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, BYTES]}}
        # The tokenizer is kept with it, so that its id stays its own.
        kept[id(tokenizer)] = (tokenizers.Tokenizer.from_str(json.dumps(made)) if known else None, tokenizer)
    return kept[id(tokenizer)][0]


def word_ids(plain: tokenizers.Tokenizer, pieces: dict[bytes, bytes], words: list[bytes]) -> None:
    """Tokenises many ASCII words in lower case at once."""
    made = plain.encode(b" ".join(words).decode(), add_special_tokens=False)
    ids = np.array(made.ids, "<u4").tobytes()
    cut = (4 * np.searchsorted(np.array(made.word_ids, np.int64), np.arange(len(words) + 1))).tolist()
    for w, a, z in zip(words, cut, cut[1:]):
        pieces[w] = ids[a:z]


def ids_of(tokenizer: tokenizers.Tokenizer, pieces: dict[bytes, bytes], new: list[bytes]) -> None:
    """Tokenises many pieces at once: joined by spaces, with offsets to tell which ids are whose."""
    for at in range(0, len(new), 2000):
        some = new[at : at + 2000]
        text = [p.decode("utf-8", "replace") for p in some]
        begin = np.cumsum([0] + [len(t) + 1 for t in text])
        made = tokenizer.encode(" ".join(text), add_special_tokens=False)
        ids = np.array(made.ids, "<u4").tobytes()
        cut = (4 * np.searchsorted(np.array([a for a, _ in made.offsets], np.int64), begin)).tolist()
        for p, a, z in zip(some, cut, cut[1:]):
            pieces[p] = ids[a:z]


def _pieces(path: str, longest: int, end_id: int, with_ids: bool, most: int = REMEMBERED):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, tables = remembered(path)
        table = tables[0]
        task = TaskContext.get().partitionId()
        seen = np.zeros(longest + 1, np.int64)
        for batch in batches:
            data, at, _ = text_bytes(batch.column("text"))
            for i, j in blocks(at):
                split = [data[at[r] : at[r + 1]].tobytes().split() for r in range(i, j)]
                unknown = set().union(*split).difference(table)
                if len(table) + len(unknown) > most:
                    table.clear()
                    unknown = set().union(*split)
                learn_runs(tokenizer, tables, list(unknown), most)
                of, piece, start, length, crc, rank, held = [], [], [], [], [], [], []
                for r, words in enumerate(split):
                    ids = b"".join(map(table.__getitem__, words)) + end
                    n = len(ids) // 4
                    for k in range(0, n, longest):
                        part = ids[4 * k : 4 * (k + longest)]
                        size = len(part) // 4
                        of.append(i + r)
                        piece.append(k // longest)
                        start.append(k)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        rank.append(seen[size])
                        seen[size] += 1
                        held.append(np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)
                columns = [
                    batch.column("doc_id").take(pa.array(of, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(of), task), pa.int64()),
                    pa.array(rank, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    columns, names = [*columns, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The non-negative x with the smallest |a x - b|: columns enter one at a time where the residual gains most, and leave at zero."""
    x, chosen = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1]):
        gain = a.T @ (b - a @ x)
        gain[chosen] = -np.inf
        enter = int(np.argmax(gain))
        if gain[enter] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        chosen[enter] = True
        while True:
            own = np.flatnonzero(chosen)
            fit = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if fit.min() > 0:
                x[:] = 0
                x[own] = fit
                break
            below = fit <= 0
            old = x[own]
            step = np.min(old[below] / np.maximum(old[below] - fit[below], 1e-300))
            x[own] = old + step * (fit - old)
            leave = own[below & (x[own] <= 1e-12)]
            if not len(leave):
                leave = own[below][[int(np.argmin(x[own[below]]))]]
            chosen[leave] = False
            x[leave] = 0
    return x


def patterns(classes: int, parts: int) -> np.ndarray:
    """All ways to fill `classes` with up to `parts` whole numbers; a row per way: how often it has each number."""
    rows: list[list[int]] = []

    def extend(rest: int, largest: int, own: list[int]) -> None:
        if rest == 0:
            rows.append(own)
        elif len(own) < parts:
            for c in range(min(rest, largest), 0, -1):
                if c * (parts - len(own)) < rest:
                    break
                extend(rest - c, c, [*own, c])

    extend(classes, classes, [])
    out = np.zeros((len(rows), classes + 1), np.int64)
    for r, own in enumerate(rows):
        np.add.at(out[r], own, 1)
    return out


Pattern = tuple[tuple[int, int], ...]  # (length, how often), in the order of their places


def plan(histogram: dict[int, int], longest: int = LONGEST, width: int = CLASS, parts: int = PARTS) -> list[tuple[Pattern, int]]:
    """Patterns of exact lengths and how often each is repeated; together they hold every piece of the histogram.

    A class is as long as its longest piece, so patterns leave gaps, which short pieces fill if enough of them are kept out of
    the fit. How many are enough depends on the histogram: of the fits without the shortest 0, 1, 2, 4, ... classes, down to best-fit
    alone, the one with the fewest sequences is taken, the one with most pieces in patterns among equals. All of it is work on at
    most `longest` lengths, however many pieces there are.
    """
    classes = -(-longest // width)
    ways = patterns(longest // width, parts)[:, : classes + 1]
    best: list[tuple[Pattern, int]] | None = None
    for aside in [0, *(1 << i for i in range(classes.bit_length() - 1)), classes]:
        found = _planned(histogram, longest, width, ways, aside)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
    return best or []


def _planned(histogram: dict[int, int], longest: int, width: int, ways: np.ndarray, aside: int) -> list[tuple[Pattern, int]]:
    """The plan whose patterns hold no piece of the shortest `aside` classes; these are packed by best fit."""
    classes = -(-longest // width)
    left: dict[int, list[list[int]]] = defaultdict(list)  # class -> [length, count], longest last
    for length in sorted(histogram):
        left[-(-length // width)].append([length, histogram[length]])
    counts = np.zeros(classes + 1)
    for c, rows in left.items():
        counts[c] = sum(n for _, n in rows)
    counts[: aside + 1] = 0
    ways = ways[~(ways[:, 1 : aside + 1] > 0).any(1)]
    x = nnls(ways[:, 1:].T.astype(np.float64), counts[1:]) if counts.any() and len(ways) else np.zeros(len(ways))
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # room -> patterns with that much room

    def put(p: Pattern, repeats: int) -> None:
        if repeats:
            open_[longest - sum(length * n for length, n in p)].append((p, repeats))

    for w in np.argsort(-x, kind="stable"):
        own = np.flatnonzero(ways[w])
        repeats = int(min([np.floor(x[w] + 1e-9), *(counts[c] // ways[w][c] for c in own)]))
        if repeats <= 0:
            continue
        slots = [int(c) for c in own[::-1] for _ in range(ways[w][c])]
        counts[own] -= repeats * ways[w][own]
        # Each slot takes `repeats` pieces of its class, longest first; runs of equal lengths stay together.
        runs = []
        for c in slots:
            need, run = repeats, []
            while need:
                length, n = left[c][-1]
                use = min(n, need)
                run.append([length, use])
                need -= use
                left[c][-1][1] -= use
                if left[c][-1][1] == 0:
                    left[c].pop()
            runs.append(run)
        while repeats:
            together = min(run[0][1] for run in runs)
            put(tuple((run[0][0], 1) for run in runs), together)
            repeats -= together
            for run in runs:
                run[0][1] -= together
                if run[0][1] == 0:
                    run.pop(0)
    # Best fit, longest first: the smallest room that holds the piece, as often as it goes in.
    room = np.zeros(longest + 1, bool)
    room[[r for r in open_ if open_[r]]] = True
    for length, count in sorted(((length, n) for rows in left.values() for length, n in rows), reverse=True):
        while count:
            fits = np.flatnonzero(room[length:])
            gap = int(fits[0]) + length if len(fits) else longest
            p, repeats = open_[gap].pop() if len(fits) else ((), count)
            times = min(gap // length, count)
            use = min(repeats, count // times)
            new = gap - times * length
            open_[new].append(((*p, (length, times)), use))
            room[new] = True
            if len(fits) and repeats > use:
                open_[gap].append((p, repeats - use))
            room[gap] = bool(open_[gap])
            count -= times * use
    return [(p, n) for rows in open_.values() for p, n in rows if n]


def placements(packed: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows sorted by length and first rank: length, first rank, pieces per sequence, first sequence, offset."""
    rows, next_rank, sequence = [], defaultdict(int), 0
    for p, repeats in packed:
        offset = 0
        for length, times in p:
            rows.append((length, next_rank[length], times, sequence, offset))
            next_rank[length] += times * repeats
            offset += length * times
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(table: np.ndarray):
    length, first, times, sequence, offset = table.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.searchsorted(length, np.arange(length.max() + 2 if len(length) else 1))
        for batch in batches:
            own, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "global_rank"))
            row = np.empty(len(own), np.int64)
            for value in np.unique(own):
                here = own == value
                a, b = begin[value], begin[value + 1]
                row[here] = a + np.searchsorted(first[a:b], rank[here], "right") - 1
            nth = rank - first[row]
            seq, place = sequence[row] + nth // times[row], offset[row] + nth % times[row] * own
            keep = [n for n in batch.schema.names if n != "global_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(seq), pa.array(place)], [*keep, "sequence_id", "offset"])

    return run


def pack(
    documents: DataFrame,
    tokenizer: str,
    longest: int = LONGEST,
    end_id: int = END_ID,
    with_ids: bool = False,
    most: int = REMEMBERED,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves if wanted.

    `tokenizer` is the path of a tokenizers file that every machine has; white space must not matter to it. `most`: entries of
    each table that a worker keeps; fewer take less memory and more time, and change no result.
    """
    given = taken(documents, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    more = "piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint" + (", ids array<int>" if with_ids else "")
    shape = T.StructType([given.schema["doc_id"], *T.StructType.fromDDL(more).fields])
    pieces = durable(given.mapInArrow(_pieces(tokenizer, longest, end_id, with_ids, most), shape))
    by_task = durable(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("pieces")))
    # At most `longest` rows.
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    table = placements(plan(histogram, longest))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("global_rank", F.col("before") + F.col("rank"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*columns, "global_rank")
    shape = T.StructType([*ranked.select(*columns).schema.fields, *T.StructType.fromDDL("sequence_id bigint, offset bigint").fields])
    return ranked.mapInArrow(_placed(table), shape)

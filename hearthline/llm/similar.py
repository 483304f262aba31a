"""Components of similar sets: candidates that share keys, exact Jaccard verification, union-find.

Items are sets of 64-bit tokens. Whoever calls provides rows (key, id): two sets are candidates if they share a key.
What happens to them does not depend on where the keys come from:

1. Keys meet after one shuffle, in which the rows that a map task has for one bucket of keys are one row of arrays.
   Within a block of a map task all but the first row of a key are set aside next to that first row, so a key that a third
   of all sets have is one row per block there. Each row learns a leader, a smaller id with its key.
2. Pairs (leader, id) are verified and joined into components; in keys that still hold several components, pairs with
   another row are, twice. Copies of a kind mostly end up in one component, by as many pairs as there are rows. Near
   copies share many keys, so keys that the same rows have are one key from here on.
3. Keys whose sets are still in different components are looked at again: all pairs across components, in cells of
   bounded size, are compared by an upper bound of their overlap, and those that pass are verified.

No pair that shares a key is left out, and pairs within a component never become rows. The upper bound counts tokens
per cell of a fixed partition of their universe; it never falls below the true overlap.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import as_batch, mix
from hearthline.llm.components import union_find
from hearthline.runtime import durable, durable_by

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows (key, check, id, n, leader). A row with n stands for a whole set: key and check are its 128-bit hash. Other rows
# have check 0; before they meet, n is LEADS for those that lead rows of their block, which have the same key.
# leader: an earlier row of the same block of the map task, else null.
KEYS = "key bigint, check bigint, id bigint, n int, leader bigint"
KEYS_ARROW = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("leader", pa.int64())])
SETS = "id bigint, n int, tokens binary, sketch binary"
SETS_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("sketch", pa.binary())])
# KEYS rows of one bucket as arrays; check, n, leader and led (whether there is a leader) only if some row has more than key and id.
PACKED = "bucket int, key binary, id binary, check binary, n binary, leader binary, led binary"
PACKED_TYPES = {"key": np.int64, "id": np.int64, "check": np.int64, "n": np.int32, "leader": np.int64, "led": np.bool_}
PAIRS = "a bigint, b bigint"
PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])
# Cells of the upper bound, and rows of a key that are compared in one go.
CELLS, TILE = 256, 512
# Cells' counts up to here are compared one by one in a large tile; a tile of fewer rows is compared together with others.
LEVELS, LARGE = 4, 48
# What n says of a row that leads others, and that there is no n; groups of rows that a task remembers.
LEADS, NO_N, REMEMBERED = -1, -2, 500_000
# Rows that a map task gathers before it deals them to buckets; buckets there are for a partition, and at least in all.
GATHERED, BUCKETS, LEAST_BUCKETS = 1_000_000, 8, 1024
# Rounds of pairs with another row of a key, before all pairs across components are compared.
TURNS = 2


def _sorted(key: np.ndarray, check: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by (key, check, id). Few rows share a key, so only those are sorted by all three."""
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    at = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(k) else order
    some = order[at]
    order[at] = some[np.lexsort((ids[some], check[some], key[some]))]
    return order


def key_rows(key: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of one block; of equal (key, check) all but the smallest id point at it. n < 0 stands for null."""
    order = _sorted(key, check, ids)
    key, check, ids, n = key[order], check[order], ids[order], n[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    leader = ids[first][np.cumsum(first) - 1] if len(ids) else ids
    # A row that leads others comes twice: once to meet other blocks, once to stay whatever it meets.
    leads = np.flatnonzero(first & ~np.append(first[1:], True) & (n < 0))
    key, check, ids, n = (np.concatenate([x, x[leads]]) for x in (key, check, ids, n))
    leader, first = np.concatenate([leader, leader[leads]]), np.concatenate([first, np.zeros(len(leads), bool)])
    mask = n < 0
    n[leads], mask[leads] = LEADS, False
    return as_batch(KEYS_ARROW, key, check, ids, pa.array(n, pa.int32(), mask=mask), pa.array(leader, pa.int64(), mask=first))


def _named_by_rows(key: np.ndarray, ids: np.ndarray, begin: np.ndarray, fit: np.ndarray, seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of runs of rows, and which rows stay: a run that is `fit` gets a key made from all of its ids, and goes if one like it
    was `seen`. Runs that get the same key by chance become one, so nothing is lost."""
    of = np.cumsum(begin) - 1
    total = np.zeros(int(of[-1]) + 1, np.uint64)
    np.add.at(total, of, mix(ids.view(np.uint64) ^ np.uint64(0x8EBC6AF09C88C6E3)))
    name = mix(total + np.bincount(of).astype(np.uint64))
    stays = np.ones(len(name), bool)
    for r in np.flatnonzero(fit).tolist():
        own = int(name[r])
        stays[r] = own not in seen
        seen.add(own)
    if len(seen) > REMEMBERED:
        seen.clear()
    return np.where(fit[of], name[of].view(np.int64), key), stays[of]


def _with_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, check, id): the leader of each, without keys that only one row has.

    Rows that have a leader already, and rows for whole sets, always stay. The others' keys are named by the rows that have them,
    unless one of these leads rows elsewhere or the run is longer than a batch. State: the last row, and names of runs.
    """
    held = None  # key, check, id, n, the run's first id; a first row that may still be alone
    alone = False
    seen: set[int] = set()
    for batch in batches:
        if not batch.num_rows:
            continue
        key, check, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        led = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        n = batch.column(3).fill_null(NO_N).to_numpy(zero_copy_only=False)
        given = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
        if held is not None:
            key, check, ids, n = (np.concatenate([[h], x]) for h, x in zip(held[:4], (key, check, ids, n)))
            led, given = np.concatenate([[False], led]), np.concatenate([[0], given])
        whole = n >= 0
        # Runs among the rows without a leader; the others only pass. Of equal rows one is enough.
        own = np.flatnonzero(~led)
        again = (key[own][1:] == key[own][:-1]) & (check[own][1:] == check[own][:-1]) & (ids[own][1:] == ids[own][:-1])
        own = own[np.concatenate([[True], ~again | whole[own][1:]])] if len(own) else own
        keep = led.copy()
        leader = given.astype(np.int64)
        if len(own):
            k, c = key[own], check[own]
            begin = np.ones(len(own), bool)
            begin[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            heads = ids[own][begin][np.cumsum(begin) - 1]
            if held is not None and len(own):
                heads = np.where((k == held[0]) & (c == held[1]), held[4], heads)
            leader[own] = heads
            single = begin & np.append(begin[1:], True)
            single[0] &= held is None or alone
            keep[own] = ~single
            last = own[-1]
            held_key = key[last]
            of = np.cumsum(begin) - 1
            fit = (np.bincount(of, whole[own] | (n[own] == LEADS)) == 0) & (np.bincount(of) > 1)
            fit[0] &= held is None or alone
            fit[-1] = False
            key = key.astype(np.int64)
            key[own], stays = _named_by_rows(key[own], ids[own].astype(np.int64), begin, fit, seen)
            keep[own] &= stays
            # The last row waits: the next batch tells whether it is alone.
            alone = bool(single[-1])
            held = (held_key, check[last], ids[last], n[last], heads[-1])
            keep[last] = False
        keep |= whole
        if len(own):
            keep[own[-1]] = False
        yield as_batch(KEYS_ARROW, key[keep], check[keep], ids[keep], pa.array(n[keep], pa.int32(), mask=n[keep] < 0), leader[keep])
    if held is not None and (not alone or held[3] >= 0):
        one = [np.array([x]) for x in held]
        yield as_batch(KEYS_ARROW, one[0], one[1], one[2], pa.array(one[3], pa.int32(), mask=one[3] < 0), one[4])


def _packed(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], buckets: int):
    """The KEYS rows that `make` gives, dealt to buckets: those without a leader by key, the others anywhere."""

    def dealt(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(kept)
        own = {c: t.column(c).fill_null(v).to_numpy() for c, v in (("key", 0), ("id", 0), ("check", 0), ("n", NO_N), ("leader", 0))}
        own["led"] = t.column("leader").is_valid().to_numpy()
        place = np.where(own["led"], own["leader"] ^ mix(own["id"].view(np.uint64)).view(np.int64), own["key"]).view(np.uint64)
        bucket = (mix(place) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        plain = (own["check"] == 0) & (own["n"] == NO_N) & ~own["led"]
        for few, rows in ((True, np.flatnonzero(plain)), (False, np.flatnonzero(~plain))):
            if not len(rows):
                continue
            rows = rows[np.argsort(bucket[rows], kind="stable")]
            which = bucket[rows].astype(np.int32)
            begin = np.concatenate([[0], np.flatnonzero(which[1:] != which[:-1]) + 1, [len(rows)]])
            columns = [pa.array(which[begin[:-1]])]
            for c, kind in PACKED_TYPES.items():
                if few and c not in ("key", "id"):
                    columns.append(pa.nulls(len(begin) - 1, pa.binary()))
                    continue
                body = own[c][rows].astype(kind, copy=False)
                offsets = pa.py_buffer((begin * body.itemsize).astype(np.int32))
                columns.append(pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, offsets, pa.py_buffer(body)]))
            yield pa.RecordBatch.from_arrays(columns, ["bucket", *PACKED_TYPES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0
        for rows in make(batches):
            kept.append(rows)
            count += rows.num_rows
            if count >= GATHERED:
                yield from dealt(kept)
                kept, count = [], 0
        if count:
            yield from dealt(kept)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """KEYS rows sorted by (key, check, id) within each bucket, of PACKED rows sorted by bucket. State: one bucket."""

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        bodies = {c: t.column(c).to_pylist() for c in PACKED_TYPES}
        size = [len(b) // 8 for b in bodies["key"]]
        missing = {"check": 0, "n": NO_N, "leader": 0, "led": False}
        key, ids, check, n, leader, led = (
            np.concatenate([np.full(k, missing[c], kind) if b is None else np.frombuffer(b, kind) for b, k in zip(bodies[c], size)])
            for c, kind in PACKED_TYPES.items()
        )
        order = _sorted(key, check, ids)
        key, ids, check, n, leader, led = (x[order] for x in (key, ids, check, n, leader, led))
        return as_batch(KEYS_ARROW, key, check, ids, pa.array(n, pa.int32(), mask=n == NO_N), pa.array(leader, pa.int64(), mask=~led))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        begin = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, z in zip(begin, begin[1:]):
            if a == z:
                continue
            if held and held[-1].column(0)[0].as_py() != bucket[a]:
                yield whole(held)
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield whole(held)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _with_leaders(_unpacked(batches))


def meet(items: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Of the KEYS rows that `make` gives for the items: every row whose key another row has, and every whole set's row, with its
    leader (itself if it is the first)."""
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = items.mapInArrow(_packed(make, max(LEAST_BUCKETS, BUCKETS * n)), PACKED)
    return durable(packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_met, KEYS))


def wanted(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The items whose id is in the stored `ids`, dealt by id, as the sets made from them are stored."""
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return items.repartition(n, "id").join(ids, "id", "left_semi")


def set_row(tokens: np.ndarray, body: bytes | None = None) -> tuple[int, bytes, bytes]:
    """Size, tokens (or the body they can be read from) and overlap sketch of a set of sorted distinct tokens."""
    cells = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS)
    return len(tokens), tokens.tobytes() if body is None else body, np.minimum(cells, 255).astype(np.uint8).tobytes()


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def may_be_similar(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and sketches allow 100 * overlap >= percent * union. A full cell may hold more than it says."""
    least = np.minimum(sa, sb)
    most = least.sum(1, dtype=np.int64)
    both = np.minimum(na, nb)
    most = np.where((least == 255).any(1), both, np.minimum(most, both))
    return 100 * most >= percent * (na.astype(np.int64) + nb - most)


def may_all_be_similar(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray, percent: int) -> np.ndarray:
    """may_be_similar() of each with each, as products of matrices: one for every count up to LEVELS that a cell can hold. What
    is above counts as if it were all in the same cells, so a few more may pass."""
    most = np.zeros((len(na), len(nb)), np.float32)
    for level in range(1, min(LEVELS, int(min(sa.max(initial=0), sb.max(initial=0)))) + 1):
        most += (sa >= level).astype(np.float32) @ (sb >= level).astype(np.float32).T
    above = [np.where(s > LEVELS, s - LEVELS, 0).sum(1).astype(np.float32) for s in (sa, sb)]
    most += np.minimum(above[0][:, None], above[1])
    both = np.minimum(na[:, None], nb).astype(np.float32)
    full = (sa == 255).any(1)[:, None] & (sb == 255).any(1)
    most = np.where(full, both, np.minimum(most, both)).astype(np.int64)
    return 100 * most >= percent * (na[:, None].astype(np.int64) + nb - most)


def _bounded(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b, na, nb = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                ok = may_be_similar(na, nb, _sketches(part.column(4)), _sketches(part.column(5)), percent)
                yield as_batch(PAIRS_ARROW, a[ok], b[ok])

    return run


def plain_tokens(bodies: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in bodies]


Reader = Callable[[list[bytes]], list[np.ndarray]]


def _verified(percent: int, read: Reader) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                a, b = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                bodies = list(dict.fromkeys([*left, *right]))
                sets = dict(zip(bodies, read(bodies)))
                ok = np.zeros(len(a), bool)
                for i, (p, q) in enumerate(zip(left, right)):
                    x, y = sets[p], sets[q]
                    merged = np.concatenate([x, y])
                    merged.sort()
                    both = int((merged[1:] == merged[:-1]).sum())
                    ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield as_batch(PAIRS_ARROW, a[ok], b[ok])

    return run


def _ends(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs with the named columns of both their sets."""
    side = lambda end: sets.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
    shown = [F.col(f"{end}_{c}") for c in columns for end in ("a", "b")]
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", *shown)


def verify(pairs: DataFrame, sets: DataFrame, percent: int, read: Reader = plain_tokens, bounded: bool = False) -> DataFrame:
    """Those of the pairs (a, b) whose sets satisfy 100 * intersection >= percent * union. `bounded`: may_be_similar() let them pass."""
    near = durable(pairs if bounded else _ends(pairs, sets, "n", "sketch").mapInArrow(_bounded(percent), PAIRS))
    return _ends(near, sets, "tokens").mapInArrow(_verified(percent, read), PAIRS)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place among the rows of its key; rows are sorted by key."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        place = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        if last is not None and key[0] == last:
            head = slice(0, begin[1] if len(begin) > 1 else len(key))
            place[head] += count
        last, count = key[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])


def _tile_pairs(percent: int, read: Reader | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by tile: pairs across components that the upper bound lets pass. A tile has at most 2 * TILE rows.

    With a reader the rows carry their sets: pairs are verified here, and only those that join components which the
    tile's earlier pairs have not joined yet come out.
    """

    def small(rows: np.ndarray, tile: np.ndarray, own: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs of many small tiles, by their distance in the table."""
        root, n, row, col, block, sketch = own
        for d in range(1, len(rows)):
            at = np.flatnonzero(tile[rows[d:]] == tile[rows[:-d]])
            if not len(at):
                break
            i, j = rows[at], rows[at + d]
            # Off the diagonal only rows of different blocks meet: the others meet on it.
            apart = (root[i] != root[j]) & ((row[i] == col[i]) | (block[i] != block[j]))
            i, j = i[apart], j[apart]
            for k in range(0, len(i), 4096):
                a, b = i[k : k + 4096], j[k : k + 4096]
                ok = may_be_similar(n[a], n[b], sketch[a], sketch[b], percent)
                yield a[ok], b[ok]

    def large(first: int, end: int, own: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Possible pairs of one tile."""
        root, n, row, col, block, sketch = own
        rows = np.arange(first, end)
        left, right = (rows, rows) if row[first] == col[first] else (rows[block[rows] == row[first]], rows[block[rows] == col[first]])
        ok = may_all_be_similar(n[left], n[right], sketch[left], sketch[right], percent) & (root[left][:, None] != root[right])
        if row[first] == col[first]:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        for k in range(0, len(i), 4096):
            a, b = left[i[k : k + 4096]], right[j[k : k + 4096]]
            # Large sets fill most cells beyond LEVELS; the bound cell by cell tells more of them apart.
            near = may_be_similar(n[a], n[b], sketch[a], sketch[b], percent)
            yield a[near], b[near]

    def joining(body: pa.ChunkedArray, tile: np.ndarray, root: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the pairs found those that are similar and join what no earlier one has joined."""
        tokens: dict[int, np.ndarray] = {}
        # Rows of one tile and component have a number.
        _, of = np.unique(np.stack([tile, root]), axis=1, return_inverse=True)
        of = of.ravel()
        above = np.arange(int(of.max()) + 1)

        def read_all(rows: np.ndarray) -> None:
            new = [i for i in np.unique(rows).tolist() if i not in tokens]
            tokens.update(zip(new, read(body.take(pa.array(new, pa.int64())).to_pylist())) if new else ())

        def tops(x: np.ndarray) -> np.ndarray:
            while not np.array_equal(above[x], x):
                x = above[x]
            return x

        for a, b in found:
            # Most pairs of a group of near copies are joined by earlier ones.
            apart = tops(of[a]) != tops(of[b])
            a, b = a[apart], b[apart]
            # Many are joined by earlier ones of the same run, so sets are read for a part of the pairs at a time.
            for at, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
                if at % 256 == 0:
                    read_all(np.concatenate([x[at : at + 256][tops(of[a[at : at + 256]]) != tops(of[b[at : at + 256]])] for x in (a, b)]))
                p, q = of[i], of[j]
                while above[p] != p:
                    p = above[p]
                while above[q] != q:
                    q = above[q]
                if p == q:
                    continue
                x, y = tokens[i], tokens[j]
                merged = np.concatenate([x, y])
                merged.sort()
                both = int(np.count_nonzero(merged[1:] == merged[:-1]))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    above[max(p, q)] = min(p, q)
                    yield np.array([i]), np.array([j])

    def pairs(t: pa.Table) -> pa.RecordBatch:
        ids, root, n, row, col, block = (t.column(c).to_numpy() for c in ("id", "root", "n", "row", "col", "block"))
        own = (root, n, row, col, block, _sketches(t.column("sketch")))
        begin = np.ones(len(ids), bool)
        key = t.column("key").to_numpy()
        begin[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])
        tile, starts = np.cumsum(begin) - 1, np.append(np.flatnonzero(begin), len(ids))
        size = np.diff(starts)

        def possible() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from small(np.flatnonzero(size[tile] < LARGE), tile, own)
            for k in np.flatnonzero(size >= LARGE):
                yield from large(starts[k], starts[k + 1], own)

        found = list(possible() if read is None else joining(t.column("tokens"), tile, root, possible()))
        both = ids[np.concatenate([np.stack(p) for p in found], 1)] if found else np.zeros((2, 0), np.int64)
        both = np.unique(np.sort(both, 0), axis=1) if both.size else both
        return as_batch(PAIRS_ARROW, both[0], both[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        told: set[tuple[int, int]] = set()

        def new(found: pa.RecordBatch) -> pa.RecordBatch:
            """Near copies share many keys of a task; their pair comes out once."""
            both = list(zip(*(found.column(i).to_pylist() for i in range(2))))
            fresh = pa.array([p not in told for p in both], pa.bool_())
            if len(told) > REMEMBERED:
                told.clear()
            told.update(both)
            return found.filter(fresh)

        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = pa.Table.from_batches([batch.slice(at, 8192)])
                kept = part if kept is None else pa.concat_tables([kept, part])
                last = [kept.column(c)[-1].as_py() for c in ("key", "row", "col")]
                same = np.ones(kept.num_rows, bool)
                for c, v in zip(("key", "row", "col"), last):
                    same &= kept.column(c).to_numpy() == v
                done = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if done:
                    yield new(pairs(kept.slice(0, done)))
                    kept = kept.slice(done)
        if kept is not None and kept.num_rows:
            yield new(pairs(kept))

    return run


def mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, id, root) of keys with more than one root."""
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return rows.join(several, "key", "left_semi").select("key", "id", "root").distinct()


def with_one(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of different components: each row with one row of its key, another one every turn."""
    lot = F.struct(F.xxhash64("id", F.lit(turn)).alias("lot"), F.col("id").alias("a"), F.col("root").alias("other"))
    one = rows.groupBy("key").agg(F.min(lot).alias("one")).select("key", "one.a", "one.other")
    return rows.join(one, "key").where("root <> other").select("a", F.col("id").alias("b")).distinct()


def across(left: DataFrame, sets: DataFrame, percent: int, read: Reader | None = None) -> DataFrame:
    """Pairs (a, b) of different components that share a key and may be similar; with a reader, verified links that
    join the same components as all such links do. left: key, id, root."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = left.select("key", "id", "root").repartition(n, "key").sortWithinPartitions("key", "root", "id")
    placed = durable(sorted_rows.mapInArrow(_numbered, "key bigint, id bigint, root bigint, place bigint"))
    placed = placed.withColumn("block", F.floor(F.col("place") / TILE).cast("int"))
    # Rows are in order of their roots: two blocks meet unless both hold one and the same root.
    blocks = placed.groupBy("key", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    later = blocks.select("key", F.col("block").alias("col"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    tiles = blocks.join(later, "key").where((F.col("block") <= F.col("col")) & (F.least("low", "low2") < F.greatest("high", "high2")))
    sides = F.explode(F.array_distinct(F.array("block", "col"))).alias("block")
    tiled = placed.select("key", "id", "root", "block").join(
        tiles.select("key", F.col("block").alias("row"), "col", sides), ["key", "block"]
    )
    with_sketch = tiled.join(sets.select("id", "n", "sketch", *(["tokens"] if read else [])), "id")
    dealt = with_sketch.repartition(n, "key", "row", "col").sortWithinPartitions("key", "row", "col")
    return dealt.mapInArrow(_tile_pairs(percent, read), PAIRS).distinct()


def components(
    shared: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, read: Reader = plain_tokens, small: bool = False
) -> DataFrame:
    """(id, root) of every id that is similar to another. `shared`: rows (key, id, leader) as meet() gives them, of one of
    equal sets each. `sets_of` gives the SETS rows of stored ids; `read` makes sorted distinct tokens of their `tokens`.
    `small` sets go with the rows that are compared, and are verified there; others are fetched for the pairs that may be similar."""
    shared = durable(shared.distinct())
    led = shared.where("id <> leader")
    ids = durable(shared.select("id").distinct())
    sets = durable_by(sets_of(ids), "id")
    links = durable(verify(led.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), sets, percent, read))
    roots = union_find(links)
    # Rows of keys that still hold several components; few, as copies of a kind are one by now.
    rows = shared.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    rows = durable(mixed(rows))
    for turn in range(TURNS):
        if rows.isEmpty():
            break
        more = durable(verify(with_one(rows, turn), sets, percent, read))
        roots = union_find(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(more))
        new = roots.select("id", F.col("root").alias("new"))
        rows = durable(mixed(rows.join(new, "id", "left").select("key", "id", F.coalesce("new", "root").alias("root"))))
    more = durable(across(rows, sets, percent, read) if small else verify(across(rows, sets, percent), sets, percent, read, bounded=True))
    return union_find(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(more))

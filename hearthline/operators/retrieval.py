"""Documents, chunks, nearest chunks by cosine, and the text handed to an answering step."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthline.functions import text, vectors
from hearthline.operators.ordering import first_per_group
from hearthline.runtime import durable
from hearthline.schema import require

# The functions that run in tasks travel with them, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_SIZE = 300
CHUNK_OVERLAP = 50
# Where a text is cut, most preferred first; the last one means between characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def assemble(areas: DataFrame, with_availability: bool = False) -> DataFrame:
    """One document per area profile: its fields as text, and the area and source as metadata.

    with_availability gives the older layout: whether flats exist there, and no amenities.
    """
    require(areas, ["area", "hdb_price_range", "pros", "cons"])
    # The wording of a document and the names of its metadata.
    lines = [F.concat(F.lit("Area: "), F.col("area"))]
    if with_availability:
        lines.append(F.concat(F.lit("HDB Available: "), F.initcap(F.col("has_hdb").cast("string"))))
    lines += [
        F.concat(F.lit("HDB Price range: "), F.col("hdb_price_range")),
        F.concat(F.lit("Pros: "), text.shown_list(F.col("pros"))),
        F.concat(F.lit("Cons: "), text.shown_list(F.col("cons"))),
    ]
    metadata = [F.lit("Area"), F.col("area")]
    if not with_availability:
        amenities = F.coalesce(F.col("nearby_amenities"), F.array().cast("array<string>"))
        lines.append(F.concat(F.lit("Nearby Amenities: "), text.shown_list(amenities)))
        metadata += [F.lit("Source"), F.col("source")]
    return areas.select("*", F.concat_ws("\n", *lines).alias("page_content"), F.create_map(*metadata).alias("metadata"))


def stride_chunks(df: DataFrame, content: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of `size` characters, each starting `overlap` before the end of the last one.

    No window lies wholly inside the overlap of the one before; empty text has none. The
    text is cut into strides in one pass and each stride takes the head of the next one,
    so that the work grows with the length of a text and not with its square.
    """
    if 2 * overlap > size:
        raise ValueError("the overlap may be at most half a chunk")
    strides = F.regexp_extract_all(content, F.lit(f"(?s).{{1,{size - overlap}}}"), F.lit(0))
    kept = [c for c in df.columns if c != content]
    cut = df.where(F.length(content) > 0).select(*kept, strides.alias("_strides"))
    mine, count = F.col("_strides"), F.size("_strides")
    heads = F.slice(mine, F.lit(2), count)
    windows = F.zip_with(
        mine, heads, lambda stride, following: F.concat(stride, F.coalesce(F.substring(following, 1, overlap), F.lit("")))
    )
    covered = (count > 1) & (F.length(F.element_at(mine, -1)) <= overlap)
    chunks = F.slice(windows, F.lit(1), count - F.when(covered, 1).otherwise(0))
    return cut.select(*kept, F.posexplode(chunks).alias("chunk_no", "chunk"))


def _pieces(body: str, size: int, separators: tuple[str, ...]) -> Iterator[str | None]:
    """Cuts text at the first separator it holds, and pieces still too long at the next ones.

    A separator stays at the start of the piece it precedes. None marks a border that
    chunks must not span: the edges of a piece that had to be cut further.
    """
    level = next(i for i, mark in enumerate(separators) if not mark or mark in body)
    mark, finer = separators[level], separators[level + 1 :]
    parts = body.split(mark) if mark else list(body)
    for i, part in enumerate(parts):
        piece = mark + part if i else part
        if len(piece) < size:
            if piece:
                yield piece
        elif finer:
            yield None
            yield from _pieces(piece, size, finer)
            yield None
        else:
            yield None
            yield piece
            yield None


def split_text(body: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """One text's chunks, without Spark: pieces packed into at most `size` characters that repeat up to `overlap` of the last one."""
    chunks: list[str] = []
    held: deque[str] = deque()
    total = 0

    def emit() -> None:
        chunk = "".join(held).strip()
        if chunk:
            chunks.append(chunk)

    for piece in [*_pieces(body, size, SEPARATORS), None]:
        if piece is None:
            emit()
            held.clear()
            total = 0
            continue
        if held and total + len(piece) > size:
            emit()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    return chunks


# What counts as white space at the ends of a chunk.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Characters that are packed in one go: what is left of a text is copied for every chunk, and this bounds it.
PACKED = 2000
# Where a run may end, by the mark it was cut at: before a mark. Of several line breaks in a row, marks are every other one.
BORDERS = {"\n\n": r"(?=\n\n)(?<=(?:^|[^\n])(?:\n\n){0,%d})", "\n": r"(?=\n)", " ": "(?= )", "": ""}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cut_open(runs: Column, mark: str, size: int) -> Column:
    """One level of cutting: open runs that hold the mark are cut there, the others stay as they are.

    A run is (text, mark, open), and no chunk spans two runs. Neighbours shorter than `size` become one run, to be packed at that
    mark; a longer one is an open run by itself.
    """

    def run(text_: Column, open_: bool) -> Column:
        return F.struct(text_.alias("text"), F.lit(mark).alias("mark"), F.lit(open_).alias("open"))

    def grouped(parts: Column) -> Column:
        count = F.size(parts)
        too_long = lambda part, i: F.length(part) + F.when(i > 0, len(mark)).otherwise(0) >= size
        places = F.filter(F.transform(parts, lambda part, i: F.when(too_long(part, i), i + 1)), lambda i: i.isNotNull())

        def joined(first: Column, past: Column) -> Column:
            text_ = F.array_join(F.slice(parts, first, past - first), mark)
            return F.concat(F.when((first > 1) & (past > first), mark).otherwise(""), text_)

        def around(ends: Column, n: Column) -> Column:
            place = F.get(ends, n)
            short = _let(F.when(n > 0, F.get(ends, n - 1) + 1).otherwise(1), lambda since: joined(since, place))
            return F.array(run(short, False), run(F.when(place <= count, joined(place, place + 1)).otherwise(""), True))

        def between(ends: Column) -> Column:
            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends) - 1), lambda n: around(ends, n)))

        return F.filter(_let(F.concat(places, F.array(count + 1)), between), lambda r: r["text"] != "")

    def cut(piece: Column) -> Column:
        whole = F.array(run(piece["text"], False))
        if not mark:
            return F.when(piece["open"], whole).otherwise(F.array(piece))
        made = _let(F.split(piece["text"], mark, -1), grouped)
        if len(mark) == 1:
            made = F.when(piece["text"].rlike(f"[^{mark}]{{{max(1, size - 1)}}}"), made).otherwise(whole)
        return F.when(piece["open"] & F.contains(piece["text"], F.lit(mark)), made).otherwise(F.array(piece))

    return F.flatten(F.transform(runs, cut))


def _packed(text_: Column, mark: Column, size: int, overlap: int) -> Column:
    """A run's chunks, by a fold whose state is the text that is left, which begins with what the next chunk repeats."""
    none = F.array().cast("array<string>")
    pattern = lambda shape: F.coalesce(
        *[F.when(mark == m, F.lit(shape % (size, border % (size // 2 + 1) if "%" in border else border))) for m, border in BORDERS.items()]
    )
    first_of = lambda t, shape: F.get(F.regexp_extract_all(t, pattern(shape), F.lit(0)), 0)
    # Of any two chunks in a row, the new characters are more than this.
    gained = size - min(overlap, size - 1)

    def shown(chunk: Column) -> Column:
        return _let(F.trim(chunk, F.lit(WHITE)), lambda c: F.when(c != "", F.array(c)).otherwise(none))

    def repeated(chunk: Column, most: Column) -> Column:
        """The last pieces that together have at most so many characters."""
        last, before = F.right(chunk, most), F.left(chunk, F.length(chunk) - most)
        breaks = F.length(before) - F.length(F.rtrim(before, F.lit("\n")))
        # Cut amid a mark of two line breaks: the second one is no piece's beginning.
        amid = (mark == "\n\n") & F.startswith(last, F.lit("\n")) & (breaks % 2 == 1)
        whole = F.when(amid, F.substr(last, F.lit(2))).otherwise(last)
        return _let(whole, lambda w: _let(F.position(mark, w), lambda at: F.when(at > 0, F.substr(w, at)).otherwise("")))

    def step(s: Column) -> Column:
        def after(chunk: Column) -> Column:
            rest = F.substr(s["left"], F.length(chunk) + 1)
            following = F.length(first_of(F.left(rest, F.lit(size + 2)), r"(?s)^.{1,%d}?(?:%s|\z)"))
            tail = _let(F.least(F.lit(overlap), F.lit(size) - following), lambda most: repeated(chunk, most))
            return F.struct(F.concat(tail, rest).alias("left"), F.concat(s["out"], shown(chunk)).alias("out"))

        return _let(first_of(F.left(s["left"], F.lit(size + 2)), r"(?s)^.{1,%d}%s"), after)

    def packed(left: Column, until: int) -> Column:
        """(left, out): chunks are cut off until no more than so many characters are left."""
        start = F.struct(left.alias("left"), none.alias("out"))
        steps = F.floor((F.length(left) - until) * 2 / (gained + 1)).cast("int") + 2
        return F.when(F.length(left) <= until, start).otherwise(
            F.aggregate(F.sequence(F.lit(1), steps), start, lambda s, _: F.when(F.length(s["left"]) > until, step(s)).otherwise(s))
        )

    def next_block(s: Column, block: Column) -> Column:
        # A chunk and the piece behind it are seen whole.
        made = _let(F.concat(s["left"], block), lambda left: packed(left, 2 * size + 4))
        return _let(made, lambda m: F.struct(m["left"].alias("left"), F.concat(s["done"], F.array(m["out"])).alias("done")))

    def end(s: Column) -> Column:
        last = _let(packed(s["left"], size), lambda m: F.concat(m["out"], shown(m["left"])))
        return F.flatten(F.concat(s["done"], F.array(last)))

    blocks = F.regexp_extract_all(text_, F.lit(f"(?s).{{1,{PACKED}}}"), F.lit(0))
    start = F.struct(F.lit("").alias("left"), F.array().cast("array<array<string>>").alias("done"))
    return F.aggregate(blocks, start, next_block, end)


def recursive_chunks(df: DataFrame, content: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks cut at paragraphs, then lines, then words, then characters: split_text as column expressions.

    Every text is cut level by level into runs, and these are packed chunk by chunk, within its row; null and empty texts have no chunks.
    """
    kept = [c for c in df.columns if c != content]
    body = F.struct(F.col(content).alias("text"), F.lit("").alias("mark"), F.lit(True).alias("open"))
    cut = df.where(F.length(content) > 0).select(*kept, F.array(body).alias("_runs"))
    for mark in SEPARATORS:
        cut = cut.withColumn("_runs", _cut_open(F.col("_runs"), mark, size))
    chunks = F.flatten(F.transform("_runs", lambda run: _packed(run["text"], run["mark"], size, overlap)))
    return cut.select(*kept, F.posexplode(chunks).alias("chunk_no", "chunk"))


def normalised(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, vectors.unit(F.col(vector)))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One vector per key: the mean of its vectors, combined per map task before the shuffle."""
    given = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    means = given.groupBy(key).agg(Summarizer.mean(array_to_vector(F.col(vector))).alias(vector))
    return means.withColumn(vector, vector_to_array(vector))


# Bytes of query vectors, and of stored ones, that a task compares with each other.
BLOCK_BYTES = 4 << 20
CELL_BYTES = 32 << 20
MOST_PIVOTS = 64
# Distances are taken from cosines, whose last digits are lost near 0; rounded similarities make equal vectors tie.
SLACK, DIGITS = 1e-6, 12


def nearest(
    store: DataFrame,
    queries: DataFrame,
    store_id: str,
    query_id: str,
    vector: str = "embedding",
    k: int = 2,
    block_bytes: int = BLOCK_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """query_id, store_id, similarity, rank: the k stored vectors closest to each query by cosine.

    Exact. Queries are grouped around at most MOST_PIVOTS of them, and one scan of the store notes each vector's nearest
    pivot and its distance from it. From the k smallest distances around each pivot follows how far the kth neighbour of any query of a
    group can be, and by the triangle inequality which stored vectors can be that near: only these go to the group. Groups are cut into
    blocks of queries and the store into shards, both of bounded bytes; each pair of a block and a shard is a cell of a
    cogrouped job, which compares them by one matrix product and passes on k rows per query. The driver sees the pivots
    and a few numbers per pair of pivots, however many queries there are.

    Queries with the same id are answered one by one; null and zero vectors on either side, and stored rows without an
    id, are left out. Equal similarities go to the smaller id.
    """
    asked = queries.where(vectors.length(F.col(vector)) > 0).select(query_id, F.col(vector).alias("_v"))
    asked = durable(asked.withColumn("_query", F.monotonically_increasing_id()))
    many, size = asked.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    per_block = max(1, block_bytes // (8 * (size or 1)))
    count = min(MOST_PIVOTS, max(1, -(-many // per_block)))
    chosen = asked.orderBy(F.xxhash64("_query"), "_query").limit(count).select("_v").collect()
    pivots = _unit(np.array([r["_v"] for r in chosen], dtype="float64").reshape(len(chosen), -1)) if chosen else np.zeros((1, 1))

    usable = store.where(F.col(store_id).isNotNull() & (vectors.length(F.col(vector)) > 0))
    held = usable.select(F.col(store_id).alias("_id"), F.col(vector).alias("_v")).withColumn("_row", F.monotonically_increasing_id())
    if not chosen:
        held = held.limit(0)
    asked, held = durable(_by_pivot(asked, pivots)), durable(_by_pivot(held, pivots, k))
    groups = {r["_pivot"]: r for r in asked.groupBy("_pivot").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("far")).collect()}
    closest = first_per_group(held.select("_pivot", "_far", "_row"), ["_pivot"], [F.col("_far"), F.col("_row")], k, "_place").collect()
    shards = max(1, -(-held.count() * 8 * (size or 1) // cell_bytes))
    reach = _reach(pivots, groups, [(r["_pivot"], r["_far"]) for r in closest], k, per_block)

    # At most MOST_PIVOTS^2 rows, and MOST_PIVOTS rows.
    spark = store.sparkSession
    within = spark.createDataFrame(reach, "_group int, _blocks int, _pivot int, _least double, _most double")
    blocks = spark.createDataFrame(sorted({row[:2] for row in reach}), "_group int, _blocks int")
    near = held.join(within, "_pivot").where(F.col("_far").between(F.col("_least"), F.col("_most")))
    near = near.select(
        "_group", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"),
        F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int").alias("_shard"), "_id", "_v",
    )
    dealt = asked.join(blocks, F.col("_pivot") == F.col("_group")).select(
        "_group", F.pmod(F.xxhash64("_query"), F.col("_blocks")).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), "_query", query_id, "_v",
    )
    cell = ["_group", "_block", "_shard"]
    made = T.StructType(
        [
            T.StructField("_query", T.LongType()),
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(store_id, store.schema[store_id].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    found = dealt.groupBy(*cell).cogroup(near.groupBy(*cell)).applyInArrow(_compared(k, to_arrow_schema(made)), made)
    order = [F.desc("similarity"), F.col(store_id)]
    return first_per_group(found, ["_query", query_id], order, k).drop("_query")


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, one per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return _unit(flat.reshape(len(column), -1))


def _first_of_equal(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """Without rows that can't be among the k nearest of anything: k rows beside them have the same vector and smaller ids."""
    given = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    run = np.concatenate([[0], np.cumsum((given[1:] != given[:-1]).any(1))])
    rank = np.empty(len(run), np.int64)
    rank[_order(pa.chunked_array([batch.column("_id")]))] = np.arange(len(run))
    return batch.take(pa.array(np.sort(_best(run, np.zeros(len(run)), rank, k))))


def _by_pivot(df: DataFrame, pivots: np.ndarray, k: int | None = None) -> DataFrame:
    """Adds the pivot that is nearest to `_v` and its distance. With k, of equal vectors in a row only those of the k smallest ids stay."""
    made = T.StructType([*df.schema.fields, T.StructField("_pivot", T.IntegerType()), T.StructField("_far", T.DoubleType())])
    shape = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                batch = _first_of_equal(batch, k) if k else batch
                cosines = _matrix(batch.column("_v")) @ pivots.T
                pick = np.argmax(cosines, 1)
                far = np.sqrt(np.maximum(0, 2 - 2 * cosines[np.arange(len(pick)), pick]))
                columns = [*batch.columns, pa.array(pick.astype(np.int32)), pa.array(far)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)

    return df.mapInArrow(run, made)


def _reach(pivots: np.ndarray, groups: dict, closest: list[tuple[int, float]], k: int, per_block: int) -> list[tuple]:
    """(group, blocks, pivot, least, most): how far from each pivot a vector may be to be among the k nearest of a query of the group.

    For a query within `far` of its pivot p, a stored vector at distance d from pivot o is at most far + |po| + d away: the kth
    smallest of these is the limit. It is at least | |po| - d | - far away.
    """
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    rows = []
    for group, figures in groups.items():
        most = sorted(figures["far"] + apart[group, o] + d for o, d in closest)
        limit = (most[k - 1] if len(most) >= k else 4.0) + figures["far"] + SLACK
        blocks = -(-figures["n"] // per_block)
        rows += [(group, blocks, o, float(apart[group, o] - limit), float(apart[group, o] + limit)) for o in range(len(pivots))]
    return rows


def _best(query: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Of (query, score, rank of the id) triples, where the k highest scores of each query are, lower ids first among equals."""
    order = np.lexsort((rank, -score, query))
    sorted_query = query[order]
    begin = np.searchsorted(sorted_query, sorted_query)
    return order[np.arange(len(order)) - begin < k]


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    """Where the ids are in ascending order; ids of several fields go by the first, then the next."""
    fields = pa.table(ids.combine_chunks().flatten(), [f.name for f in ids.type]) if pa.types.is_struct(ids.type) else pa.table({"id": ids})
    return pc.sort_indices(fields, [(name, "ascending") for name in fields.column_names]).to_numpy()


def _compared(k: int, shape: pa.Schema):
    """The k best of a shard's vectors for each query of a block."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return shape.empty_table()
        matrix, stored = _matrix(asked.column("_v")), _matrix(held.column("_v"))
        rank = np.empty(len(stored), np.int64)
        rank[_order(held.column("_id"))] = np.arange(len(stored))
        query, score, at = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        # A few rows at a time, so that the table of scores stays small.
        step = max(k, (1 << 22) // len(matrix))
        for i in range(0, len(stored), step):
            scores = np.round(stored[i : i + step] @ matrix.T, DIGITS)
            least = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.full(len(matrix), -np.inf)
            r, q = np.nonzero(scores >= least)
            query, score, at = np.concatenate([query, q]), np.concatenate([score, scores[r, q]]), np.concatenate([at, r + i])
            keep = _best(query, score, rank[at], k)
            query, score, at = query[keep], score[keep], at[keep]
        columns = [asked.column("_query").take(query), asked.column(1 + asked.schema.get_field_index("_query")).take(query)]
        columns += [held.column("_id").take(at), pa.chunked_array([pa.array(score)])]
        return pa.table([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)

    return run


def shown_metadata(entries: dict[str, Column]) -> Column:
    """Metadata as Python shows a dict of strings."""
    shown = [F.concat(text.quoted(F.lit(k)), F.lit(": "), text.quoted(v)) for k, v in entries.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *shown), F.lit("}"))


def context(found: DataFrame, query_id: str, metadata: Column, content: Column) -> DataFrame:
    """One text per query: its retrieved chunks in rank order, a blank line between them.

    `found` holds at most k chunks per query, so the text of one query is bounded.
    """
    entry = F.concat(F.lit("Source: "), metadata, F.lit("\nContent: "), content)
    return (
        found.select(query_id, "rank", entry.alias("entry"))
        .groupBy(query_id)
        .agg(F.expr("listagg(entry, '\\n\\n') WITHIN GROUP (ORDER BY rank)").alias("context"))
    )

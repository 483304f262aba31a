"""Repair of conversations: the cheapest edits that make a sequence of turns legal, found by streaming over sorted turns.

A legal conversation is empty, or an optional system turn followed by pairs of user and assistant. Edits, in order of turns:
keep (K, free), rerole to user or assistant (R, 3), delete (D, 4; a must for blank and repeated turns) and insert an empty
user or assistant turn (I, 3); a truncated turn that isn't deleted costs 3 more. Of equally cheap sequences of edits the one
that is least as a text of their initials is taken; together with the turns it says what the conversation becomes.

How it runs: turns are dealt by conversation and sorted by turn, and get their place and faults from window functions in that
order. A first stream goes through each conversation from its last turn to its first and carries four numbers across Arrow
batches: the least cost of what follows, for each state the conversation may be in (nothing yet, after system, user, assistant).
What to do in each state is one byte a turn. These bytes leave the task as rows of at most `BLOCK` turns each, stored in
the shared folder, so that a task never holds a conversation, however long, and a lost one is run again. A second stream
meets a block right before its turns and walks forward. A conversation is still one task's work in either stream, as its
digest can only be made in order; tasks hold one batch, one block and, for a report, one letter per turn.

Defined cases: null roles and texts are one space, which makes a text blank. Roles go by their first character; other roles than
s, u, a, and an empty one, can't be kept. Turns are whole numbers; null turns come first. Rows of equal turn are ordered by
role and text; rows that are equal in all columns follow each other, and all but the first are repeated turns. A null conv_id is a
conversation of its own. Empty and very long texts need nothing special. An empty table gives no rows. Further columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.common import taken
from hearthline.runtime import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Turns whose decisions leave a task as one row.
BLOCK = 1 << 16
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
COST = {DELETE: 4, INSERT: 3, REROLE: 3, "truncated": 3}
# Faults, and role initials. Together they are a turn's kind: 4 * fault + initial.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS = "sua"
# States: nothing yet, after system, after user, after assistant. Where an initial leads, and which role must come next.
NOWHERE = 9
LEADS = ((1, 2, NOWHERE), (NOWHERE, 2, NOWHERE), (NOWHERE, NOWHERE, 3), (NOWHERE, 2, NOWHERE))
NEXT = (1, 1, 2, 1)
ROLES = ("system", "user", "assistant")
# What it costs to end in each state, by inserted turns.
AT_END = (0, 6, 3, 0)
BLANKS = " \t\n\x0b\f\r"


@cache
def decided(after: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int, int]:
    """The least cost from before a turn of this kind on, for each state, given the costs from after it on; and what to do
    in each state, two bits each. Costs are less by the smallest, which is the second value."""
    fault, initial = divmod(kind, 4)
    far = 1 << 40
    options = []
    for state in range(4):
        found = {DELETE: COST[DELETE] + after[state]}
        if fault in (SOUND, TRUNCATED):
            more = COST["truncated"] if fault == TRUNCATED else 0
            if initial < 3 and LEADS[state][initial] != NOWHERE:
                found[KEEP] = more + after[LEADS[state][initial]]
            found[REROLE] = COST[REROLE] + more + after[LEADS[state][NEXT[state]]]
        options.append(found)
    best = [min(o.values()) for o in options]
    # Insertions stay before the same turn; two in a row lead back to where the first one led from.
    for _ in range(2):
        for state in range(4):
            options[state][INSERT] = COST[INSERT] + best[LEADS[state][NEXT[state]]]
        best = [min(b, o.get(INSERT, far)) for b, o in zip(best, options)]
    todo = 0
    for state, o in enumerate(options):
        # The letters are in order, so the first of the cheapest is the least.
        todo |= min(k for k in o if o[k] == best[state]) << (2 * state)
    least = min(best)
    return tuple(b - least for b in best), least, todo


def _backwards(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (conv_id, pos, kind), each conversation from its last turn to its first, to rows (conv_id, pos, todo, cost): what
    to do at the turns from pos on; cost only with a conversation's first block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, total, todo, before = AT_END, 0, bytearray(), None
        for batch in batches:
            out = []
            for conv, pos, kind in zip(*[c.to_pylist() for c in batch.columns]):
                costs, more, byte = decided(costs, kind)
                total += more
                todo.append(byte)
                if pos == 1 or len(todo) == BLOCK:
                    todo.reverse()
                    out.append((conv, pos, bytes(todo), total + costs[0] if pos == 1 else None))
                    todo = bytearray()
                if pos == 1:
                    costs, total = AT_END, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _inserts(state: int) -> Iterator[int]:
    """The roles that are inserted after the last turn."""
    while AT_END[state]:
        yield NEXT[state]
        state = LEADS[state][NEXT[state]]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Of rows (conv_id, pos, last, initial, role, text, todo, cost), blocks before their turns: (conv_id, letter, role, text,
    cost) for every edit in order, and (conv_id, None, None, None, cost) after a conversation's last edit."""
    todo, begin, state, cost = b"", 1, 0, 0
    for batch in batches:
        out = []
        for conv, pos, last, initial, role, text, block, whole in zip(*[c.to_pylist() for c in batch.columns]):
            if block is not None:
                todo, begin = block, pos
                if pos == 1:
                    state, cost = 0, whole
                continue
            while (do := (todo[pos - begin] >> (2 * state)) & 3) == INSERT:
                out.append((conv, "I", ROLES[NEXT[state]], "", None))
                state = LEADS[state][NEXT[state]]
            if do == KEEP:
                state = LEADS[state][initial]
                out.append((conv, "K", role, text, None))
            elif do == REROLE:
                out.append((conv, "R", ROLES[NEXT[state]], text, None))
                state = LEADS[state][NEXT[state]]
            else:
                out.append((conv, "D", None, None, None))
            if last:
                out += [(conv, "I", ROLES[r], "", None) for r in _inserts(state)]
                out.append((conv, None, None, None, cost))
        yield out


def _turns(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for edits in _walked(batches):
            out = []
            for conv, letter, role, text, _ in edits:
                place += letter is not None
                if letter is None:
                    place = 0
                else:
                    out.append((conv, place, letter, role, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _reports(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, digest, empty = bytearray(), hashlib.sha256(), True
        for edits in _walked(batches):
            out = []
            for conv, letter, role, text, cost in edits:
                if letter is None:
                    out.append((conv, cost, audit.decode(), digest.hexdigest()))
                    audit, digest, empty = bytearray(), hashlib.sha256(), True
                    continue
                audit += letter.encode()
                if role is not None:
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def in_order(conversations: DataFrame, **columns: str) -> DataFrame:
    """All turns with their place: conv_id, turn, role, text, pos (from 1), last, initial (0 to 3), fault, illegal, new_turn.

    `columns` names the given columns for conv_id, turn, role and text, where they are called otherwise.
    """
    given = taken(conversations, **{c: columns.get(c, c) for c in ("conv_id", "turn", "role", "text")})
    filled = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    # Dealt once; both windows and their orders live within these partitions.
    dealt = given.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *filled).repartition("conv_id")
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy("turn"))
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text", "seen")
    fault = (
        F.when(F.col("end") == "", BLANK)
        .when(F.col("seen") > 1, DUPLICATE)
        .when(F.col("end").isin(".", "!", "?"), SOUND)
        .otherwise(TRUNCATED)
    )
    pair = F.concat(F.lag(first).over(order), first)
    before = F.lag("turn").over(order)
    return dealt.select("*", seen.alias("seen"), F.substring(body, -1, 1).alias("end")).select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.row_number().over(order).cast("bigint").alias("pos"),
        F.lead(F.lit(1)).over(order).isNull().alias("last"),
        initial.alias("initial"),
        fault.alias("fault"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn")))).alias("new_turn"),
    )


def _with_blocks(turns: DataFrame) -> DataFrame:
    """The turns, and before them the stored decisions about them, dealt by conversation and sorted."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv = turns.schema["conv_id"]
    kinds = turns.select("conv_id", "pos", (4 * F.col("fault") + F.col("initial")).alias("kind"))
    back = kinds.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("pos"))
    made = T.StructType([conv, *T.StructType.fromDDL("pos bigint, todo binary, cost bigint").fields])
    blocks = durable(back.mapInArrow(_backwards(arrow(made)), made))
    rows = turns.select("conv_id", "pos", "last", "initial", "role", "text").unionByName(blocks, allowMissingColumns=True)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "pos", F.col("todo").isNull())


def arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repaired_turns(conversations: DataFrame, **columns: str) -> DataFrame:
    """Every edit of every conversation: conv_id, place (from 1), edit (D, I, K or R), and the role and text that the
    turn has afterwards; null if it is deleted."""
    rows = _with_blocks(durable(in_order(conversations, **columns)))
    made = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL("place bigint, edit string, role string, text string").fields])
    return rows.mapInArrow(_turns(arrow(made)), made)


def repair_report(conversations: DataFrame, **columns: str) -> DataFrame:
    """One row per conversation: conv_id, gaps (numbers missing among its turns), blank, duplicate, truncated, illegal
    (neighbouring roles that can't be), cost, audit (initials of the edits) and repaired_sha256 (of the repaired turns as
    `role:text`, joined by newlines)."""
    turns = durable(in_order(conversations, **columns))
    rows = _with_blocks(turns)
    made = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL("cost bigint, audit string, repaired_sha256 string").fields])
    edits = rows.mapInArrow(_reports(arrow(made)), made)
    is_fault = lambda f: F.count_if(F.col("fault") == f)
    missing = F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn")
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(missing, F.lit(0)).cast("bigint").alias("gaps"),
        is_fault(BLANK).alias("blank"),
        is_fault(DUPLICATE).alias("duplicate"),
        is_fault(TRUNCATED).alias("truncated"),
        F.count_if("illegal").alias("illegal"),
    )
    counts = counts.withColumnRenamed("conv_id", "of")
    return edits.join(counts, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def damaged(conversations: DataFrame, code: Column) -> DataFrame:
    """The turns with one damage by `code`: 0 is dropped, 1 loses its text, 2 its `.!?`, 3 comes twice, 4 gets role user.

    For trials: what repair makes of known faults. Columns conv_id, turn, role, text; nulls in role and text are one space.
    """
    rows = taken(conversations, conv_id="conv_id", turn="turn", role="role", text="text").withColumn("code", code)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("code IS NULL OR code <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        copies.alias("copy"),
    ).drop("copy")

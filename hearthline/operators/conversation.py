"""Conversations as tables of messages: history export and the messages an answer builds on.

A conversation may hold a large part of all messages, so it is never gathered in one row: lists and joined texts
come as rows with their place, in the same shape for any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthline.operators.ordering import by_chunk, chunks, to_chunk, with_position
from hearthline.schema import require

MESSAGE_COLUMNS = ["conv_id", "turn", "role", "text"]


def append(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The messages with new ones placed after each conversation's last turn, in their given order."""
    require(new, ["conv_id", "turn", "role", "text"])
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    first = new.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    shift = F.coalesce(F.col("_last") + 1 - F.col("_first"), F.lit(0))
    moved = new.join(first.join(last, "conv_id", "left"), "conv_id").withColumn("turn", F.col("turn") + shift)
    return messages.unionByName(moved.select(*new.columns), allowMissingColumns=True)


def latest_message(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of each conversation's last message."""
    last = F.max_by(F.struct("turn", "role", "text"), "turn").alias("m")
    return messages.groupBy("conv_id").agg(last).select("conv_id", "m.*")


def history(messages: DataFrame) -> DataFrame:
    """Messages of human and ai with their place in the conversation; one row each."""
    require(messages, MESSAGE_COLUMNS)
    spoken = messages.where(F.col("role").isin("human", "ai")).select(*MESSAGE_COLUMNS)
    return with_position(spoken, ["conv_id"], "turn", "place").select(
        "conv_id", "place", F.col("role").alias("type"), F.col("text").alias("content")
    )


def history_lists(messages: DataFrame) -> DataFrame:
    """conv_id, messages, place, entry: the entries (type, content) of each conversation's list and the list's length."""
    require(messages, MESSAGE_COLUMNS)
    spoken = messages.where(F.col("role").isin("human", "ai")).select(*MESSAGE_COLUMNS)
    entry = F.struct(F.col("role").alias("type"), F.col("text").alias("content"))
    placed = with_position(spoken, ["conv_id"], "turn", "place", total="messages")
    return placed.select("conv_id", "messages", "place", entry.alias("entry"))


def trailing_tool_messages(messages: DataFrame) -> DataFrame:
    """The unbroken run of tool messages that ends each conversation; none if another message comes last."""
    other = F.max(F.when(~F.col("role").eqNullSafe("tool"), F.col("turn")))
    cut = chunks(messages, "turn")
    found = by_chunk(messages, ["conv_id"], cut, {"_other": other})
    last_other = F.max("_other").over(W.partitionBy("conv_id"))
    figures = found.select("conv_id", "_chunk", last_other.alias("_other"))
    tools = messages.where(F.col("role") == "tool")
    run = to_chunk(tools, figures, ["conv_id"], cut)
    return run.where(F.col("_other").isNull() | (F.col("turn") > F.col("_other"))).drop("_chunk", "_other")


def tool_context(messages: DataFrame) -> DataFrame:
    """conv_id, messages, place, context: the trailing tool texts in order; a blank line goes between them."""
    require(messages, MESSAGE_COLUMNS)
    run = trailing_tool_messages(messages).select(*MESSAGE_COLUMNS)
    placed = with_position(run, ["conv_id"], "turn", "place", total="messages")
    return placed.select("conv_id", "messages", "place", F.col("text").alias("context"))


def prompt_messages(messages: DataFrame) -> DataFrame:
    """Human and system messages, and ai messages without tool calls, with their place."""
    require(messages, [*MESSAGE_COLUMNS, "tool_calls"])
    answered = (F.col("role") == "ai") & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0)
    kept = messages.where(F.col("role").isin("human", "system") | answered).select(*MESSAGE_COLUMNS)
    return with_position(kept, ["conv_id"], "turn", "place").select(
        "conv_id", "place", F.col("role").alias("type"), F.col("text").alias("content")
    )


def answer_context(messages: DataFrame) -> DataFrame:
    """What an answer is generated from, in order: the tool context as system text, then the messages."""
    parts = tool_context(messages).select(
        "conv_id",
        F.lit("context").alias("section"),
        F.col("place").cast("bigint").alias("place"),
        F.lit("system").alias("type"),
        F.col("context").alias("content"),
    )
    spoken = prompt_messages(messages).select(
        "conv_id", F.lit("message").alias("section"), F.col("place").cast("bigint").alias("place"), "type", "content"
    )
    return parts.unionByName(spoken)

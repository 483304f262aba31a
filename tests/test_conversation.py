import pytest

from hearthline.operators import conversation, ordering

SCHEMA = "conv_id bigint, turn bigint, role string, text string, tool_calls array<string>"


@pytest.fixture()
def messages(spark):
    rows = [
        (1, 0, "system", "be kind", []),
        (1, 1, "human", "hello", []),
        (1, 2, "ai", "let me look", ["retrieve"]),
        (1, 3, "tool", "early", []),
        (1, 4, "human", "again", []),
        (1, 5, "ai", "call", ["retrieve"]),
        (1, 7, "tool", "first", []),
        (1, 9, "tool", "second", []),
        (2, 0, "tool", "only", []),
        (2, 1, "tool", "tools", []),
        (3, 0, "tool", "old", []),
        (3, 1, "ai", "done", None),
        (4, 0, "human", "x", []),
        (4, 1, None, "who", []),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("rows_per_chunk", [1 << 20, 2])
def test_answer_context(spark, messages, monkeypatch, rows_per_chunk):
    monkeypatch.setattr(ordering, "CHUNK_ROWS", rows_per_chunk)
    rows = conversation.answer_context(messages).collect()
    context = {}
    for r in sorted((r for r in rows if r["section"] == "context"), key=lambda r: r["place"]):
        context.setdefault(r["conv_id"], []).append(r["content"])
    assert {k: "\n\n".join(v) for k, v in context.items()} == {1: "first\n\nsecond", 2: "only\n\ntools"}
    said = sorted((r["conv_id"], r["place"], r["type"], r["content"]) for r in rows if r["section"] == "message")
    assert said == [
        (1, 1, "system", "be kind"),
        (1, 2, "human", "hello"),
        (1, 3, "human", "again"),
        (3, 1, "ai", "done"),
        (4, 1, "human", "x"),
    ]


def test_history(spark, messages):
    made = sorted(tuple(r) for r in conversation.history(messages).collect())
    assert made[:2] == [(1, 1, "human", "hello"), (1, 2, "ai", "let me look")]
    assert [r[0] for r in made] == [1, 1, 1, 1, 3, 4]
    lists = sorted((r["conv_id"], r["place"], r["messages"], *r["entry"]) for r in conversation.history_lists(messages).collect())
    assert lists == [
        (1, 1, 4, "human", "hello"),
        (1, 2, 4, "ai", "let me look"),
        (1, 3, 4, "human", "again"),
        (1, 4, 4, "ai", "call"),
        (3, 1, 1, "ai", "done"),
        (4, 1, 1, "human", "x"),
    ]


def test_a_long_conversation_has_the_same_shape(spark):
    rows = [(1, t, "tool" if t > 20 else "human", f"m{t}", []) for t in range(2500)] + [(2, 0, "tool", "short", [])]
    long = spark.createDataFrame(rows, SCHEMA).repartition(5)
    context = conversation.tool_context(long).collect()
    assert sorted((r["conv_id"], r["place"], r["messages"], r["context"]) for r in context) == [
        *[(1, t - 20, 2479, f"m{t}") for t in range(21, 2500)],
        (2, 1, 1, "short"),
    ]
    assert conversation.history_lists(long).count() == 21


def test_append_and_latest(spark, messages):
    new = spark.createDataFrame([(1, 0, "human", "more"), (1, 1, "human", "and more"), (9, 0, "human", "new")], "conv_id bigint, turn bigint, role string, text string")
    longer = conversation.append(messages, new)
    assert longer.count() == 17
    latest = {r["conv_id"]: (r["turn"], r["text"]) for r in conversation.latest_message(longer).collect()}
    assert latest[1] == (11, "and more") and latest[9] == (0, "new") and latest[2] == (1, "tools")

"""Repair against all sequences of edits, cheapest first."""

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from hearthline.llm import turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost bigint, pos string, fault string"
BLANKS = " \t\n\x0b\f\r"


def ordered(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def legal(roles, done):
    """Whether initials may begin, or be, a legal conversation."""
    body = roles[1:] if roles[:1] == "s" else roles
    whole = all(c == "ua"[i % 2] for i, c in enumerate(body))
    return whole and (not done or not roles or (len(body) > 0 and len(body) % 2 == 0))


def brute(rows):
    """The cheapest edits, by cost and then text, from a heap of all beginnings."""
    found = faults(rows)
    heap = [(0, "", 0, "", ())]
    best = None
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and legal(roles, True):
            best = min(best, (cost, audit, out)) if best else (cost, audit, out)
            continue
        for who in ("user", "assistant"):
            if legal(roles + who[0], False) and not audit.endswith("III"):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + who[0], (*out, f"{who}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, out))
            if found[i] in ("", "truncated"):
                more = 3 if found[i] else 0
                for kind, who, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if who[:1] and legal(roles + who[0], False):
                        heapq.heappush(heap, (cost + more + price, audit + kind, i + 1, roles + who[0], (*out, f"{who}:{text}")))
    return best


def expected(rows):
    rows = ordered(rows)
    found = faults(rows)
    cost, audit, out = brute(rows)
    numbers = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        *[found.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def conversations(n, longest, seed=3):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "umpire"]
    texts = ["Yes.", "No!", "And so on", None, "", " \t", "Long ago? ", "é.\n", "x" * 40, "Fine."]
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            turn = None if rng.random() < 0.05 else t + rng.randrange(2)
            if rng.random() < 0.6:
                role, text = ("user", "assistant")[t % 2], f"Turn {rng.randrange(6)}."
            else:
                role, text = rng.choice(roles), rng.choice(texts)
            out += [(c if c else None, turn, role, text)] * (1 + (rng.random() < 0.1))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(5)


def grouped(rows):
    of = {}
    for c, *rest in rows:
        of.setdefault(c, []).append(tuple(rest))
    return of


def test_reports_are_the_cheapest(spark):
    rows = conversations(150, 9)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.repair_report(frame(spark, rows)).collect()}
    assert got == {c: expected(own) for c, own in grouped(rows).items()}


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_do_not_matter(spark, monkeypatch, block):
    rows = conversations(40, 9, seed=8)
    monkeypatch.setattr(turns, "BLOCK", block)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.repair_report(frame(spark, rows)).collect()}
    assert got == {c: expected(own) for c, own in grouped(rows).items()}


def test_repaired_turns(spark):
    rows = conversations(40, 8, seed=5)
    made = turns.repaired_turns(frame(spark, rows)).collect()
    for c, own in grouped(rows).items():
        edits = sorted((r for r in made if r["conv_id"] == c), key=lambda r: r["place"])
        _, audit, out = brute(ordered(own))
        assert [e["place"] for e in edits] == [*range(1, len(edits) + 1)] and "".join(e["edit"] for e in edits) == audit
        assert tuple(f"{e['role']}:{e['text']}" for e in edits if e["edit"] != "D") == out


def test_one_giant_conversation(spark):
    """A hundred thousand turns over several Arrow batches and blocks: every other reply is missing."""
    n = 100_000
    rows = spark.range(n).selectExpr("1 AS conv_id", "id AS turn", "CASE WHEN id % 3 < 2 THEN 'user' ELSE 'assistant' END AS role", "concat('Turn ', id, '.') AS text")
    [r] = turns.repair_report(rows).collect()
    audit = r["audit"]
    assert audit == "KIKK" * (n // 3) + "KI" and r["cost"] == 3 * (n // 3 + 1) and r["illegal"] == n // 3


def test_damage(spark):
    given = spark.createDataFrame([(1, i, "assistant", "A. B!") for i in range(6)] + [(1, 9, None, None)], "conv_id bigint, turn bigint, role string, text string")
    got = sorted(tuple(r)[1:] for r in turns.damaged(given, F.col("turn")).collect())
    a = "assistant"
    assert got == [(1, a, ""), (2, a, "A B"), (3, a, "A. B!"), (3, a, "A. B!"), (4, "user", "A. B!"), (5, a, "A. B!"), (9, " ", " ")]


def test_empty_table(spark):
    empty = frame(spark, [])
    assert turns.repair_report(empty).count() == 0 and turns.repaired_turns(empty).count() == 0


def test_other_names(spark):
    given = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho.")], "id string, n int, who string, said string")
    [r] = turns.repair_report(given, conv_id="id", turn="n", role="who", text="said").collect()
    assert (r["conv_id"], r["audit"], r["cost"]) == ("a", "KK", 0)

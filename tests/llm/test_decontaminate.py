import random
import re

import pytest
from pyspark.sql import functions as F

from hearthline.llm import decontaminate

from .helpers import frame, odd_texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(texts, items, window):
    out = {}
    for i, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for item, b in items:
            b = words(b)
            n = min(window, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item))
        out[i] = (len(w), len(hit), sorted(ids))
    return out


def benchmark(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, spans string")


def run(spark, texts, items, **options):
    made = decontaminate.contamination(frame(spark, texts), benchmark(spark, items), **options)
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in made.collect()}


@pytest.mark.parametrize("window,item_bytes", [(3, 10**6), (10, 10**6), (4, 30)])
def test_same_as_brute_force(spark, window, item_bytes):
    rng = random.Random(window)
    # Few different words, so that blocks, prefixes and suffixes recur everywhere.
    some = lambda n: " ".join(rng.choice("a b ab é 7".split()) for _ in range(n))
    items = [(k, some(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14]))) for k in range(12)]
    texts = [some(rng.choice([0, 1, 2, 5, 30, 300, 700])) for _ in range(30)]
    texts += ["- " + items[k][1].upper().replace(" ", ", ") + "!" for k in range(12)]
    assert run(spark, texts, items, window=window, item_bytes=item_bytes) == brute(texts, items, window)


def test_shift_table_skips():
    made = decontaminate.patterns_of([" ".join(f"w{i}" for i in range(10))], 10).windows[0]
    assert made.length == 10 and int(made.shift.max()) == 9 and (made.shift == 9).mean() > 0.99


def test_odd_rows(spark):
    texts = [*odd_texts(), "alpha"]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, "??"), (4, "Ünïcödé wörds ärē"), (None, "nul")]
    got = run(spark, texts, items)
    wanted = brute(texts, [i for i in items if i[0] is not None and i[1]], 10)
    assert got == wanted
    assert run(spark, [], items) == {}
    assert run(spark, ["a b"], []) == {0: (2, 0, [])}
    twice = decontaminate.contamination(frame(spark, [(7, "alpha"), (7, "alpha"), (None, "alpha")]), benchmark(spark, items))
    assert twice.where("n_hit = 1").count() == 3


def test_uncontaminated_keeps_columns(spark):
    df = frame(spark, ["alpha beta", "gamma", None]).withColumn("text with space", F.lit(1))
    made = decontaminate.uncontaminated(df, benchmark(spark, [(1, "Beta")]))
    assert made.columns == df.columns and sorted(r["doc_id"] for r in made.collect()) == [1, 2]
    assert made.where("doc_id = 1").first() == df.where("doc_id = 1").first()


def test_blocks_are_fetched_and_searched_one_by_one(spark, monkeypatch):
    """Each search's patterns are stored before the block after the next one is fetched."""
    events, given, stored = [], decontaminate.benchmark_blocks, decontaminate.durable

    def fetched(*args):
        for some in given(*args):
            events.append("fetch")
            yield some

    def kept(df):
        events.append("store")
        return stored(df)

    monkeypatch.setattr(decontaminate, "benchmark_blocks", fetched)
    monkeypatch.setattr(decontaminate, "durable", kept)
    items = [(k, f"w{k} v{k}") for k in range(4)]
    texts = ["w0 v0 w3 v3", "w1 v1", "none", None]
    assert run(spark, texts, items, item_bytes=6) == brute(texts, items, 10)
    assert events == ["fetch", "fetch", "store", "fetch", "store", "fetch", "store"]


def test_texts_without_an_item_id(spark):
    items, texts = [(1, "alpha"), (None, "beta gamma")], ["alpha beta", "beta gamma alpha", "beta gamma", "delta"]
    assert run(spark, texts, items, unnamed=True) == {0: (2, 1, ["1"]), 1: (3, 3, ["1"]), 2: (2, 2, []), 3: (1, 0, [])}
    made = decontaminate.uncontaminated(frame(spark, texts), benchmark(spark, items))
    assert [r["doc_id"] for r in made.collect()] == [3]

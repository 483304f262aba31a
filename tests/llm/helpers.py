"""Small frames with what real tables have: nulls, empty and very long texts, repeated rows, clashing names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use themselves.
EXTRA = ["score", "doc", "id", "n", "key", "root", "spans", "line_no", "kept", "rank", "text_", "rejected", "label", "length"]
EXTRA += ["row", "gone", "t1", "t2", "new", "place", "kind", "__row", "__text", "__gone", "__doc", "__t1", "__t2"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def frame(spark, texts, clash=True):
    """documents with ids 0, 1, ... (or given pairs), and columns whose names operators use too."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in EXTRA})
    return df


def odd_texts():
    """Null, empty, blank, one word, signs only, repeated, and a very long text."""
    rng = random.Random(5)
    long = "\n".join(sentence(rng, 200) for _ in range(400))
    return [None, "", "   \n\t ", "alpha", "!!! ???", "alpha", "Ünïcödé wörds ärē héré öf cöürsé", long, long, "a" * 300_000, "0\x000 nul"]

import random
import re

import numpy as np
import pytest

from hearthline.llm import jaccard
from hearthline.llm.common import text_bytes

from .helpers import frame, odd_texts, sentence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], ["new%d" % rng.randrange(999)], [w[i], "more"]])
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    texts = []
    for n in (3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 80, 120, 200, 400):
        base = sentence(rng, n)
        texts += [base, base.upper()]
        for _ in range(5):
            base = edited(rng, base, max(1, n // 60)) or "x"  # a chain: ends may not be linked themselves
            texts.append(base)
        texts.append(edited(rng, base, max(1, n // 30)))
        texts.append(passage + " " + sentence(rng, n))  # shares a passage only
    hot = sentence(rng, 90)
    texts += [hot] * 60 + [edited(rng, hot, 1) for _ in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_same_as_brute_force(spark, seed):
    texts = corpus(seed)
    made = jaccard.jaccard_components(frame(spark, texts).repartition(7)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in made} == brute(texts)


def test_every_linked_pair_shares_a_key():
    """The pigeonhole argument itself, on many pairs at and above the threshold."""
    rng = random.Random(9)
    plan = jaccard.layouts(80)
    tried = 0
    for _ in range(400):
        n = rng.choice([4, 5, 6, 8, 9, 11, 14, 20, 33, 47, 80, 150, 333, 700])
        take = rng.randrange(0, n // 4 + 1)
        a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        cut = rng.randrange(0, take + 1)
        b = np.concatenate([a[cut:], np.array([rng.getrandbits(64) for _ in range(take - cut)], np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        tried += 1
        token, begin = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        keys = {0: set(), 1: set()}
        for key, who in jaccard._signatures(token, begin, np.array([0, 1]), 80, plan):
            for k, w in zip(key, who):
                keys[w].add(int(k))
        assert keys[0] & keys[1], (len(a), len(b), both)
    assert tried > 100


def test_odd_texts(spark):
    texts = odd_texts()
    made = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert made == brute(texts)
    twice = jaccard.jaccard_components(frame(spark, [(4, "a b"), (4, "a b"), (None, "a b"), (5, "a b")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in twice if r["doc_id"]) == [(4, 1, 4), (4, 1, 4), (5, 1, 4)]
    assert [(r["n_shingles"], r["component_id"]) for r in twice if r["doc_id"] is None] == [(1, None)]
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


def test_one_of_each_keeps_all_columns(spark):
    df = frame(spark, ["a b c", "A b c", "other", None])
    made = jaccard.one_of_each(df)
    assert made.columns == df.columns and sorted(r["doc_id"] for r in made.collect()) == [0, 2, 3]


def test_one_of_each_of_rows_that_share_an_id(spark):
    rows = [(4, "a b"), (4, "a b"), (None, "a b"), (None, "only here"), (None, "only here"), (3, "x y"), (5, "x y"), (5, "its own text"), (6, None)]
    made = jaccard.one_of_each(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in made) == [(-1, "only here"), (3, "x y"), (4, "a b"), (5, "its own text"), (6, None)]


def test_tokens_of_slices(spark):
    import pyarrow as pa

    whole = pa.array(["zero", None, "one two three four five six", ""])
    data, at, valid = text_bytes(whole.slice(1))
    assert list(valid) == [False, True, True]
    token, begin = jaccard.doc_tokens(data, at, 5)
    assert list(begin) == [0, 0, 2, 2]

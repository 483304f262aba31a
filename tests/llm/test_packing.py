import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthline.llm import packing

from .helpers import frame, odd_texts, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, longest):
    t = Tokenizer.from_file(PATH)
    wanted = []
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), longest):
            part = ids[k : k + longest]
            wanted.append((i, k // longest, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    gapless(rows, longest)


def gapless(rows, longest):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= longest
    return len(places)


@pytest.mark.parametrize("longest", [4096, 64])
def test_pieces_are_the_tokenizers(spark, longest):
    rng = random.Random(1)
    texts = [sentence(rng, rng.choice([1, 3, 30, 300])) for _ in range(60)]
    texts += ["it's <|endoftext|> İstanbul ΣΑΣ a\u0301 e\u0301 \u00a0x\u2003y don't I'LL 'd", *odd_texts()]
    texts += ["naïve…!! É!! ÉTÉ,, ß. STRASSE, ǆ, ﬁ, Σ!! ς. x\u0327!! a😀!! foo<|endoftext|> foo<| |>endoftext", "1st. a1!! a_b a-b --a 'S x'S, [x] ×÷ a×, \u00aa."]
    rows = packing.pack(frame(spark, texts).repartition(5), PATH, longest).collect()
    check(rows, texts, longest)


def test_runs_do_not_depend_on_how_they_are_cut():
    t = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    letters = "abcXYZéÉßñÑüÜ.,!'*#1<|>…\u0301"
    runs = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))).encode() for _ in range(3000)]
    tables = ({}, {})
    packing.learn_runs(t, tables, list(dict.fromkeys(runs)))
    for r in runs:
        assert tables[0][r] == np.array(t.encode(r.decode(), add_special_tokens=False).ids, "<u4").tobytes(), r


def test_ids_can_be_had(spark):
    rows = packing.pack(frame(spark, ["alpha beta", None]), PATH, 4, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)


def test_hot_length_and_empty_table(spark):
    texts = [None] * 500 + ["alpha"] * 100
    rows = packing.pack(frame(spark, texts).repartition(9), PATH, 50).collect()
    assert gapless(rows, 50) == -(-sum(r["length"] for r in rows) // 50)
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_plan_holds_every_piece_in_few_sequences():
    rng = np.random.default_rng(2)
    for _ in range(8):
        lengths = np.clip(rng.lognormal(rng.uniform(2, 7.5), 1.2, 5000).astype(int), 1, 4096)
        histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
        packed = packing.plan(histogram)
        held = {}
        for p, n in packed:
            assert sum(length * times for length, times in p) <= 4096
            for length, times in p:
                held[length] = held.get(length, 0) + n * times
        assert held == histogram
        # Never far above what the tokens need, or the pieces over half a sequence.
        least = max(-(-int(lengths.sum()) // 4096), int((lengths > 2048).sum()))
        assert sum(n for _, n in packed) <= 1.03 * least + 1
    assert packing.plan({}) == []


def test_nnls_finds_the_least_squares():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = rng.random((8, 15))
        b = rng.normal(size=8)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        # The conditions that hold at the minimum only.
        assert (x >= 0).all() and (gain <= 1e-6).all() and abs(gain[x > 1e-9]).max(initial=0) < 1e-6


def test_patterns_fill_exactly():
    made = packing.patterns(12, 4)
    assert (made @ np.arange(13) == 12).all() and (made.sum(1) <= 4).all()
    assert len({tuple(r) for r in made}) == len(made) == 34


def best_fit_decreasing(histogram, longest):
    room = [0] * (longest + 1)
    total = 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            gap = next((r for r in range(length, longest + 1) if room[r]), None)
            if gap is None:
                total, gap = total + 1, longest
            else:
                room[gap] -= 1
            room[gap - length] += 1
    return total


@pytest.mark.parametrize("seed", range(10))
def test_plan_is_never_above_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(3 + 0.4 * seed, 0.4 + 0.15 * (seed % 4), 1500), 1, 512).astype(int)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
    made = packing.plan(histogram, longest=512, width=16)
    held = {}
    for pattern, times in made:
        assert sum(length * n for length, n in pattern) <= 512
        for length, n in pattern:
            held[length] = held.get(length, 0) + n * times
    assert held == histogram and sum(n for _, n in made) <= best_fit_decreasing(histogram, 512)

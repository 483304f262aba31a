"""Base spans against the plain patterns, discovered ones against the same graph in plain Python."""

import math
import random
import re
from collections import defaultdict

import pytest

from hearthline.llm import personal, queries
from hearthline.llm.personal import KINDS, Trust
from tests.llm.helpers import frame, odd_texts, sentence

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, x):
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 13 <= len(digits(x)) <= 19 and luhn(digits(x))
    return kind != "phone" or 9 <= len(digits(x)) <= 15


def base(text):
    out = []
    for k, kind in enumerate(KINDS):
        out += [(k, m.start(), m.end()) for m in re.finditer(PLAIN[kind], text) if valid(kind, m[0])]
    return out


def plain(text):
    return re.sub("[0-9]+", "0", text.lower())


def candidates(text):
    out = []
    for k, kind in enumerate(KINDS):
        end = 0
        for n, m in enumerate(re.finditer(personal.LOOSE[kind], text)):
            left = ("0" if n else "") + text[end : m.start()]
            end = m.end()
            words = re.split(personal.BETWEEN, plain(left[-personal.NEARBY :]))
            value = digits(m[0]) if kind in personal.LOOSE_DIGITS else m[0].lower()
            if kind in personal.LOOSE_DIGITS and not personal.LOOSE_DIGITS[kind][0] <= len(value) <= personal.LOOSE_DIGITS[kind][1]:
                continue
            contexts = []
            if words[-1] == "" and len(words) > 1 and words[-2]:
                contexts.append(words[-2])
                if len(words) > 2 and words[-3]:
                    contexts.append(f"{words[-3]} {words[-2]}")
            sure = re.fullmatch(PLAIN[kind], m[0]) is not None and valid(kind, m[0])
            out.append((k, m.start(), m.end(), value, sure, contexts))
    return out


def brute(texts, trust):
    edges, seeds, different = defaultdict(int), set(), defaultdict(set)
    found = [candidates(t) for t in texts]
    for own in found:
        for k, _, _, value, sure, contexts in own:
            for c in contexts:
                edges[k, c, value] += 1
                different[k, c].add(value)
                if sure:
                    seeds.add((k, value))
    totals = defaultdict(int)
    for t in texts:
        words = [w for w in re.split(personal.BETWEEN, plain(t)) if w]
        for c in [*words, *map(" ".join, zip(words, words[1:]))]:
            totals[c] += 1
    edges = {e: n for e, n in edges.items() if any(len(different[k, e[1]]) >= trust.support for k in range(4))}
    values, patterns, certain = set(seeds), {}, {}
    for _ in range(trust.rounds):
        seen, kinds = defaultdict(int), defaultdict(int)
        for (k, c, v), n in edges.items():
            if (k, v) in values:
                seen[k, c] += n
                kinds[k, c] += 1
        patterns = {p: round(n / max(totals[p[1]], n), 9) for p, n in seen.items() if kinds[p] >= trust.support and totals[p[1]]}
        patterns = {p: s for p, s in patterns.items() if s >= trust.confidence}
        doubt = defaultdict(float)
        for k, c, v in edges:
            if (k, c) in patterns:
                doubt[k, v] += math.log(max(1 - patterns[k, c], 1e-6))
        certain = {v: s for v, x in doubt.items() if (s := round(1 - math.exp(x), 9)) >= trust.certain}
        values = seeds | set(certain)
    out = []
    for text, own in zip(texts, found):
        sure, best = base(text), {}
        for k, start, end, value, is_known, contexts in own:
            clash = any(s < end and start < e for _, s, e in sure)
            if not is_known and not clash and (k, value) in certain and any((k, c) in patterns for c in contexts):
                best[start] = max(best.get(start, (0, -9, 0)), (certain[k, value], -k, end))
        out.append((sure, sorted(sure + [(-k, start, end) for start, (_, k, end) in best.items()])))
    return out


def card(rng):
    n = str(rng.randrange(10**14, 10**15))
    return next(n + d for d in "0123456789" if luhn(n + d))


def corpus():
    """Seeds behind labels, unseen forms behind the same ones, and the same unseen forms elsewhere."""
    rng = random.Random(4)
    phone = lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    ip = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    mail = lambda: f"user{rng.randrange(999)}@mail.example.com"
    texts = []
    for i in range(60):
        made = [f"Call: {phone()}", f"charged to card {card(rng)}", f"server IP={ip()}", f"Write to: {mail()}", sentence(rng, 12)]
        rng.shuffle(made)
        texts.append(". ".join(made) + ".")
    texts += ["Call: 017 555 7713 now", "é" * 70 + " Call: (017) 555-7714", "I saw 017 555 7713 birds, really: 017 555 7715"]
    texts += ["charged to card 4111 1111 1111 1112.", "server IP=2001:db8:0:0:0:0:0:1", "server IP=10.300.2.1"]
    texts += ["Write to: ann (at) example.com", "Write to: bob@localhost", "ann (at) home", "Write to: nobody", 'token = "5551234567"']
    return texts


def spans(rows, column):
    return [(s["kind"], s["start"], s["end"]) for s in rows[column]]


@pytest.mark.parametrize("trust", [Trust(), Trust(support=2, confidence=0.1, certain=0.3, rounds=4), Trust(support=10**6)])
def test_same_as_plain_python(spark, trust):
    # The plain patterns take quadratic time on the longest run.
    texts = [*corpus(), *[t for t in odd_texts() if t is not None and set(t) != {"a"}]]
    made = personal.personal_data(frame(spark, texts), trust).collect()
    got = {r["doc_id"]: (spans(r, "base"), spans(r, "spans")) for r in made}
    assert got == dict(enumerate(brute(texts, trust)))


def test_unseen_forms_are_found_behind_labels(spark):
    texts = corpus()
    made = {r["doc_id"]: r for r in personal.personal_data(frame(spark, texts)).collect()}
    new = {texts[i][s:e] for i, r in made.items() for k, s, e in set(spans(r, "spans")) - set(spans(r, "base"))}
    assert {"017 555 7713", "(017) 555-7714", "4111 1111 1111 1112", "10.300.2.1", "bob@localhost", "ann (at) example.com"} <= new
    assert "017 555 7715" not in new and "5551234567" not in new and "ann (at) home" not in new


def odd_forms(rng):
    """Texts of the characters that the forms are made of, with pieces that nearly match."""
    signs = ["+", "-", ".", " ", "(", ")", "@", "_", "%", "x", "Q", "1", "25", "255", "256", "0", "4111 1111-1111 1111", "a@b.c", "1.2.3.4", "\n", "é", "😀", ":"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]


def test_base_is_what_the_plain_patterns_find(spark):
    texts = odd_forms(random.Random(9)) + ["a@b.com_x@y.zz", "1.2.3.4.5.6.7.8", "4" * 16 + " " + "0" * 16, "+1" + "0 " * 9, "0001.002.03.0255"]
    made = personal.personal_data(frame(spark, texts), Trust(support=10**6)).collect()
    assert {r["doc_id"]: spans(r, "base") for r in made} == {i: base(t) for i, t in enumerate(texts)}
    assert all(r["base"] == r["spans"] for r in made)


def test_long_runs_and_many_matches(spark):
    rng = random.Random(1)
    parts = [f"{rng.randrange(256)}.1.2.{rng.randrange(300)}" for _ in range(3000)]
    many = " ".join(parts)
    long = 300_000
    texts = ["a" * long, "1" * long, "a@" + "b." * long, "x@" + "b" * long, "1." * 30_000, "+1" + " " * long, "1 " * long, many]
    made = {r["doc_id"]: spans(r, "base") for r in personal.personal_data(frame(spark, texts)).collect()}
    assert [made[i] for i in (0, 1, 3, 5, 6)] == [[]] * 5
    assert made[2] == [(0, 0, 2 * long + 1)] and made[4] == [(1, 8 * i, 8 * i + 7) for i in range(7_500)]
    assert made[7] == [(1, m.start(), m.end()) for m in re.finditer(r"\S+", many) if valid("ip", m[0])]


def test_nulls_repeats_and_names(spark):
    texts = [(None, "a@b.cd"), (None, "a@b.cd"), (1, None), (1, "1.1.1.1"), (2, "")]
    made = personal.personal_data(frame(spark, texts)).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, spans(r, "spans")) for r in made)
    assert got == [(False, 1, []), (False, 1, [(1, 0, 7)]), (False, 2, []), (True, 0, [(0, 0, 6)]), (True, 0, [(0, 0, 6)])]
    assert personal.personal_data(frame(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, brute([*texts.values()], Trust())))
    import hashlib

    for r in queries.op13_personal_data(spark, sf).collect():
        first, every = want[r["doc_id"]]
        shown = [",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in x) for x in (first, every)]
        counts = [sum(k == i for k, _, _ in first) for i in range(4)]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert (r["base_sha256"], r["spans"]) == (hashlib.sha256(shown[0].encode()).hexdigest(), shown[1])


def test_no_python_in_the_plan(spark):
    plan = queries.op13_personal_data(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan

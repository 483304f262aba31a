import random

from hearthline.llm import lines
from hearthline.llm.similar import SETS_ARROW  # noqa: F401

from .helpers import frame, odd_texts, sentence


def shingles(line):
    b = line.encode()
    return {b[i : i + 8] for i in range(max(1, len(b) - 7))}


def brute(texts):
    """Kept line of every line that isn't blank, by exact similarity of all pairs."""
    found = [((i, k), x.strip(" \t\r\f\x0b").lower()) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    found = [(p, x) for p, x in found if x]
    root = {p: p for p, _ in found}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {p: shingles(x) for p, x in found}
    for a, _ in found:
        for b, _ in found:
            if b < a:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {p: find(p) for p, _ in found}


def corpus():
    rng = random.Random(3)
    base = [sentence(rng, n) for n in (1, 2, 5, 8, 12, 20, 40, 80)]
    texts = []
    for _ in range(40):
        some = []
        for line in rng.sample(base, 4):
            w = line.split()
            if len(w) >= 20 and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(99)
            some.append(" ".join(w) if rng.random() < 0.8 else "  " + " ".join(w).upper())
        texts.append("\n".join([*some, "", sentence(rng, 6)]))
    return texts


def test_same_as_brute_force(spark):
    texts = corpus()
    made = lines.line_classes(frame(spark, texts).repartition(5)).collect()
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in made}
    wanted = brute(texts)
    assert got == wanted
    assert all(r["kept"] == (wanted[(r["doc_id"], r["line_no"])] == (r["doc_id"], r["line_no"])) for r in made)


def test_recall_at_the_threshold():
    """Pairs at similarities from 0.8 to 0.85 share a band in all but few cases."""
    import numpy as np

    rng = np.random.default_rng(4)
    found = 0
    for _ in range(500):
        n = int(rng.integers(60, 400))
        shared = int(n * 0.9)
        own = n - shared
        a = rng.integers(0, 2**63, n + own).astype(np.uint64)
        token = np.concatenate([a[:n], a[own:]])
        sig = lines.signatures(token, np.array([0, n, 2 * n]), lines.BANDS * lines.ROWS)
        keys = lines.band_keys(sig, lines.BANDS, lines.ROWS)
        found += (keys[0] == keys[1]).any()
    assert found >= 490


def test_short_sets_borrow_alike():
    import numpy as np

    rng = np.random.default_rng(6)
    found = 0
    for _ in range(500):
        a = rng.integers(0, 2**63, 21).astype(np.uint64)
        token = np.concatenate([a[:19], a[2:]])  # 17 of 21 in common
        keys = lines.band_keys(lines.signatures(token, np.array([0, 19, 38]), 48), 12, 4)
        found += (keys[0] == keys[1]).any()
    assert found >= 450


def test_documents_without_repeats(spark):
    df = frame(spark, ["one line here\nsecond line there", "ONE line here", "third\n\none line here\nlast", None, "", "one line here\nnew"])
    made = lines.without_repeats(df, length="n_chars")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in made.collect()}
    assert made.columns == df.columns and made.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    assert got == {
        0: ("one line here\nsecond line there", 31),
        2: ("third\n\nlast", 11),
        3: (None, None),
        4: ("", 0),
        5: ("new", 3),
    }


def test_odd_texts(spark):
    texts = odd_texts()
    made = lines.line_classes(frame(spark, texts)).collect()
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in made}
    # The long text's lines are all different; its copy and the copy of the word go.
    assert got[(5, 0)] == (3, 0) and all(got[(8, k)] == (7, k) for k in range(400)) and got[(9, 0)] == (9, 0)
    some = lines.line_classes(frame(spark, [(None, "x y"), (2, "x y"), (2, "x y"), (None, "z")])).collect()
    assert sorted((r["doc_id"] or -1, r["class_doc_id"] or -1, r["kept"]) for r in some) == [(-1, -1, True), (-1, 2, False), (2, 2, True), (2, 2, True)]
    assert lines.line_classes(frame(spark, [])).count() == 0
    assert lines.without_repeats(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_lose_their_own_lines(spark):
    rows = [(None, "x y"), (2, "x y"), (None, "z"), (None, "x y\nown line of it"), (None, "first\nx y")]
    rows += [(7, "kept as it is\nx y"), (7, "stays\nmore"), (7, "x y\nstays"), (8, "the same\nleft"), (8, "the same\nright")]
    made = [(r["doc_id"] or -1, r["text"]) for r in lines.without_repeats(frame(spark, rows)).collect()]
    assert sorted(x for x in made if x[0] != 8) == [(-1, "first"), (-1, "own line of it"), (-1, "z"), (2, "x y"), (7, "kept as it is"), (7, "stays\nmore")]
    # Both are line 0 of the same doc_id: one of them stays.
    assert sorted(x for i, t in made if i == 8 for x in t.split("\n")) == ["left", "right", "the same"]

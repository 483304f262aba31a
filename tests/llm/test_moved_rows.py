import numpy as np
import pyarrow as pa

from hearthline.llm import lines, similar

from .helpers import frame


def test_rows_of_a_bucket_travel_as_one_and_come_back_sorted():
    rng = np.random.default_rng(3)
    key, ids = rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(0, 900, 5000)
    key[rng.random(5000) < 0.3] = 7
    check, n = np.where(ids < 100, 5, 0), np.where(ids < 100, 3, -1).astype(np.int32)
    given = similar.key_rows(key, check, ids, n)
    packed = list(similar._packed(lambda batches: batches, 16)(iter([given.slice(0, 2000), given.slice(2000)])))
    assert sum(b.num_rows for b in packed) <= 32
    dealt = pa.Table.from_batches(packed).sort_by("bucket")
    made = list(similar._unpacked(iter(dealt.to_batches(max_chunksize=3))))
    assert sorted(map(str, given.to_pylist())) == sorted(str(r) for b in made for r in b.to_pylist())
    for b in made:
        own = [(r["key"], r["check"], r["id"]) for r in b.to_pylist()]
        assert own == sorted(own)
    # Rows without a leader that share a key are in one bucket.
    places = [{r["key"] for r in b.to_pylist() if r["leader"] is None} for b in made]
    assert sum(map(len, places)) == len(set().union(*places))


def test_lines_are_cut_once_and_as_spark_cuts_them(spark):
    texts = ["", "\n\n", " a \tB\r\n\x0b\f\nΑΣ\nİx \n\nΟΔΟΣ Σ", None, "one", "\n last ", "x\n"]
    found = lines.numbered_lines(frame(spark, texts), "doc_id", "text")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    lower = lambda t: spark.createDataFrame([(t,)], "t string").selectExpr("lower(t)").first()[0]
    wanted = [(k, lower(x.strip(lines.BLANK))) for t in texts if t is not None for k, x in enumerate(t.split("\n")) if x.strip(lines.BLANK)]
    assert sorted((r["line_no"], r["norm"]) for r in found.collect()) == sorted(wanted)


def test_shingles_of_short_lines():
    texts = [b"", b"ab", b"abcdefgh", b"abcdefghi", b"", b"xabcdefgh", b"ab"]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    token, begin = lines.shingles(np.frombuffer(b"".join(texts), np.uint8), at, 8)
    own = [token[a:z].tolist() for a, z in zip(begin, begin[1:])]
    assert [len(x) for x in own] == [0, 1, 1, 2, 0, 2, 1]
    assert own[1] == own[6] and own[2] == own[3][:1] == own[5][1:] and own[1] != own[2]

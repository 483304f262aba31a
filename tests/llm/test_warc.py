import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from hearthline.llm import warc

SCHEMA = "page_id bigint, url string, html string, header string, sha256 string"
PAGES = [
    (5, "http://a/x", "<p>é</p>"),
    (2, "http://a/y", "<p>é</p>"),
    (3, None, None),
    (1, "http://b/\r\nWARC-Type: forged", ""),
    (7, "http://c", "long " * 50_000),
    (None, "http://d", "<p>é</p>"),
    (9, "u", "\r\n\r\nWARC/1.1\r\n"),
    (9, "u", "\r\n\r\nWARC/1.1\r\n"),
]


def archive(spark, tmp_path, pages, **options):
    folder = f"file:{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame([(*p, "x", "y") for p in pages], SCHEMA), folder, **options)
    return folder, warc.read_archive(spark, folder)


def parse(raw):
    out = []
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        assert raw[n : n + 4] == b"\r\n\r\n"
        out.append((fields, raw[:n]))
        raw = raw[n + 4 :]
    return out


def test_records_come_back_exactly(spark, tmp_path):
    folder, read = archive(spark, tmp_path, PAGES)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    got = sorted((r["page_id"] or 99, bytes(r["record"])) for r in warc.records(read).collect())
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        first[h or ""] = min(first.get(h or "", 99), i or 99)
    for (i, url, html), (_, raw) in zip(sorted(PAGES, key=lambda p: (p[0] or 99)), got):
        [(fields, block)] = parse(raw)
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = (i or 99) > first[html or ""]
        assert fields["WARC-Type"] == ("revisit" if revisit else "response")
        assert fields["WARC-Payload-Digest"] == f"sha1:{digest}" and block == (b"" if revisit else payload)
        assert fields.get("WARC-Refers-To") == (f"<urn:x-page:{first[html or '']}>" if revisit else None)
        assert fields.get("WARC-Target-URI") == (url and url.replace("\r", "%0D").replace("\n", "%0A"))


def test_files_are_warc(spark, tmp_path):
    _, read = archive(spark, tmp_path, PAGES)
    warc.write_warc(read, f"file:{tmp_path}/files")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "files").glob("*.gz"))
    assert len(parse(raw)) == len(PAGES)


def test_small_payloads_do_not_refer(spark, tmp_path):
    _, read = archive(spark, tmp_path, PAGES, least_bytes=10)
    kinds = {r["page_id"]: r["t"] for r in read.select("page_id", warc.field("WARC-Type").alias("t")).collect()}
    assert kinds[5] == "response" and kinds[3] == "response"


def test_damage_is_found(spark, tmp_path):
    folder, _ = archive(spark, tmp_path, PAGES)
    damaged = spark.read.parquet(f"{folder}/payloads").selectExpr("sha256", "payload_bytes", "concat(payload, X'00') AS payload", "sha1", "first_id", "several")
    damaged.write.parquet(f"file:{tmp_path}/other/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"file:{tmp_path}/other/headers")
    with pytest.raises(PySparkException, match="damaged payload"):
        warc.read_archive(spark, f"file:{tmp_path}/other").collect()


def test_empty_table(spark, tmp_path):
    assert archive(spark, tmp_path, [])[1].count() == 0

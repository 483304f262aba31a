"""Content-addressed WARC archive.

Two tables: `payloads` holds the bytes of every distinct payload once, under its SHA-256, and `headers` the exact header
text of every record. Joined on the digest they give back the original records. Of records with equal payloads of at
least `least_bytes` the one with the smallest page_id is a response and the others revisit it.

Copies are combined in the map task before payloads are shuffled, so a payload that a third of all pages share is
one row per task. Reading recomputes SHA-256 of what is stored and stops the job at any difference; two payloads with
one SHA-256 but different SHA-1 stop it too. Revisits join only the short digests unless bytes are asked for.

Defined cases: null html is an empty payload. A null page_id sorts after all others and its record id says "null". A
page given twice is two equal records, both response or both revisit. Line breaks in a url are written as %0D and %0A; a
null url has no target line. Very long payloads are stored whole. Page ids are whole numbers, or texts of them; any other
text ends the job. An empty table gives an empty archive. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import taken

# Fixed values of the formats: the digits of base 32, and what WARC calls its records and profiles.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"

PAYLOADS = "sha256 string, payload_bytes bigint, payload binary, sha1 string, first_id bigint, several int"
HEADERS = "page_id bigint, header string, sha256 string, payload_bytes bigint"


def base32(hexed: Column) -> Column:
    """A SHA-1 in hexadecimal as 32 digits of base 32: five hexadecimal digits make four."""
    digits = []
    for part in range(8):
        bits = F.conv(F.substring(hexed, 5 * part + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def header(kind: Column, page_id: Column, url: Column, digest: Column, length: Column, refers_to: Column, date: str) -> Column:
    """The header of a record, up to and with the empty line. Null parts leave their line out (concat_ws skips nulls)."""
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id(page_id)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(refers_to))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0).cast("bigint")).otherwise(length).cast("string")),
        F.lit(CRLF),
    ]
    return F.concat_ws(CRLF, *lines)


def write_archive(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> None:
    """Writes payloads and headers below `folder`, which must not hold an archive yet."""
    spark = pages.sparkSession
    given = taken(pages, page_id=page_id, url=url, html=html).select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    stamped = given.select("*", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    once = stamped.groupBy("sha256", "payload_bytes").agg(
        F.first("payload").alias("payload"),
        F.min("page_id").alias("first_id"),
        F.min(F.sha1("payload")).alias("sha1"),
        F.max(F.sha1("payload")).alias("other"),
    )
    once.select(
        "sha256", "payload_bytes", "payload", "sha1", "first_id", (F.col("sha1") != F.col("other")).cast("int").alias("several")
    ).write.parquet(f"{folder}/payloads")
    known = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select("sha256", "payload_bytes", "sha1", "first_id")
    joined = stamped.select("page_id", "url", "sha256", "payload_bytes").join(known, ["sha256", "payload_bytes"])
    again = (F.col("payload_bytes") >= least_bytes) & F.coalesce(F.col("page_id") > F.col("first_id"), F.col("first_id").isNotNull())
    kind = F.when(again, "revisit").otherwise("response")
    text = header(kind, F.col("page_id"), F.col("url"), base32(F.col("sha1")), F.col("payload_bytes"), F.col("first_id"), date)
    joined.select("page_id", text.alias("header"), "sha256", "payload_bytes").write.parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, header, payload, payload_bytes, sha1; every payload is checked against its digests."""
    stored = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("payload_bytes")) & (F.col("several") == 0)
    checked = stored.select(
        F.when(sound, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))).alias("sha256"),
        "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("sha1"),
    )
    return spark.read.schema(HEADERS).parquet(f"{folder}/headers").select("page_id", "header", "sha256").join(checked, "sha256")


def records(archive: DataFrame) -> DataFrame:
    """page_id and the exact bytes of each WARC record. A revisit's block is empty; its payload is the response's."""
    block = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    end = F.lit(CRLF + CRLF).cast("binary")
    return archive.select("page_id", F.concat(F.col("header").cast("binary"), block, end).alias("record"))


def write_warc(archive: DataFrame, folder: str) -> None:
    """WARC files of the records, gzipped. The records are UTF-8, and each ends with two line breaks as the format asks."""
    body = F.when(field("WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    lines = archive.select(F.concat(F.col("header"), body).alias("value"))
    lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(folder)


def field(name: str) -> Column:
    """A header field of an archive row; null where the record has no such line."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)

"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import decontaminate, hamming, jaccard, langid, lines, packing, personal, quality, reputation, resample, toxicity, turns, warc
from hearthline.llm.common import fold
from hearthline.runtime import workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOKENIZER = "word_bpe_49k.json"
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(parts: int, remainder: int) -> Column:
    """Whether the document's fold is the one that nothing is learned from; false for a null id."""
    return F.coalesce(fold(F.col("doc_id"), parts) == remainder, F.lit(False))


@query
def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest codes of every 20th vector's code: query_id, rank, id, distance."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.nearest_codes(codes, codes.where("vec_id % 20 = 0"), row_id="vec_id", query_id="vec_id")


@query
def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages and reads the archive back."""
    folder = f"{workspace(spark)}/warc/{uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    archive = warc.read_archive(spark, folder)
    refers = F.regexp_extract(warc.field("WARC-Refers-To"), r"^<urn:x-page:(-?\d+)>$", 1)
    return archive.select(
        "page_id",
        "payload_bytes",
        warc.base32(F.col("sha1")).alias("payload_digest"),
        warc.field("WARC-Type").alias("record_type"),
        F.nullif(refers, F.lit("")).cast("bigint").alias("refers_to"),
    )


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(F.col("doc_id"), 3) != 1)
    return langid.identify(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op6_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.toxicity(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", predicted, "spans")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that isn't blank, the line that stays for it, and whether it is that line."""
    return lines.line_classes(table(spark, sf_dir, "documents"))


@query
def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label that carries its number; other pages have none."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return reputation.url_filter(pages, labels, RULES, outcome_id="doc_id", good="quality")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        # As in the SQL, all texts without an id count as one item.
        F.size(F.array_distinct(F.col("spans")["item_id"])).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return quality.quality(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", predicted)


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations by a hash of their turns and repairs them; a conversation that lost all turns has a row too."""
    given = table(spark, sf_dir, "conversations")
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    report = turns.repair_report(turns.damaged(given, code))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    every = given.select(F.col("conv_id").alias("every")).distinct()
    return every.join(report, F.col("every").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every").alias("conv_id"),
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents with 20 words or more, drawn towards the benchmark."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, seed=2024)


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and hash of the spans of fixed form, and all spans."""
    found = personal.personal_data(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == personal.KINDS.index(kind)))
    return found.select(
        "doc_id",
        *[of(kind).cast("bigint").alias(f"n_{kind}") for kind in personal.KINDS],
        F.sha2(personal.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        personal.as_text(F.col("spans")).alias("spans"),
    )

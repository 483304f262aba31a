"""A bounded sample of labelled texts, and which documents are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import taken
from hearthline.operators.ordering import first_per_group
from hearthline.runtime import durable


# Characters beyond which a text is left out of samples, which are gathered on the driver.
LONGEST = 100_000


def first_texts(rows: DataFrame, kind: str, most: int, longest: int | None = None) -> DataFrame:
    """(kind, text) of at most `most` rows (doc_id, kind, text) of each kind, and `longest` characters each: the first by a
    hash of the id, then of the text. However often an id or a text is repeated, no more are taken."""
    short = rows.where(F.length("text") <= longest) if longest else rows
    ids = durable(first_per_group(short.select("doc_id", kind).distinct(), [kind], [F.xxhash64("doc_id"), F.col("doc_id")], most, "place"))
    texts = short.join(ids.select("doc_id", kind), ["doc_id", kind], "left_semi").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    return durable(first_per_group(texts, [kind], order, most, "place").select(kind, "text"))


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    per_class: int,
    doc_id: str,
    text: str,
    label_id: str,
    label: str,
    longest: int = LONGEST,
) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most `per_class` documents of each label and `longest` characters, and how many labelled rows each
    label has in all.

    `learn` (over doc_id) tells which labelled rows may teach; null ids, labels and texts teach nothing, labels other than 0 and 1
    neither.
    """
    rows = taken(labels, doc_id=label_id, label=label).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn)
    rows = durable(rows.select("doc_id", F.col("label").cast("int").alias("label")).distinct())
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Ids before texts: the texts of all other documents stay where they are.
    few = durable(first_per_group(rows, ["label"], [F.xxhash64("doc_id"), F.col("doc_id")], per_class, "place").select("doc_id", "label"))
    given = taken(documents, doc_id=doc_id, text=text).where("text IS NOT NULL").join(few, "doc_id")
    return first_texts(given, "label", per_class, longest), totals

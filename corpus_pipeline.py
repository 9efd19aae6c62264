"""Stages from raw documents to packed training sequences.

Each stage takes the rows that the one before kept, and its decisions take effect: rejected
documents, repeated lines and near copies go, the mix repeats or leaves out documents, and what is
left is packed. The last stage returns a row for each piece of a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.llm import lines, minhash, mixing, packing, quality
from lontar.llm.cluster import cut, unused


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled ones of these rows, gives a chance of KEEP or more of being good.

    Null and empty texts are graded as texts without words, rows without a doc_id like others, repeated rows
    alike. Ties with the bound stay. Without labels all rows stay; an empty table gives an empty one. All
    columns stay as they are, whatever their names.
    """
    expected, keep = (unused(docs.columns, c) for c in ("expected_grade", "p_keep"))
    grades = quality.graded(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), names=(expected, keep))
    return grades.where(F.coalesce(F.col(keep) >= quality.KEEP, F.lit(True))).drop(expected, keep)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without their repeated lines; those that lose all their lines go. n_chars, if there is one, follows the text.

    Null and empty texts are one empty line, which never repeats: they stay, null as an empty text. Of
    documents with a line in common the largest doc_id keeps it; rows without a doc_id, and repeated rows
    of one, are one document to that. All other columns stay as they are, whatever their names.
    """
    lost, every = unused(docs.columns, "n_dropped"), unused(docs.columns, "n_lines")
    clean = lines.dedup_lines(docs, counts=(every, lost)).where((F.col(lost) < F.col(every)) | (F.col(lost) == 0))
    clean = clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that with the smallest doc_id; rows without one come last.

    Rows are told apart by a number of their own, since doc_ids may be null or repeated: repeated rows are
    copies of each other, and one stays, of equal doc_ids that which the table gives first. All null and
    empty texts are one class. All columns stay as they are, whatever their names.
    """
    row = unused(docs.columns, "__row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    ids = rows.select(F.col(row).alias("node"), F.col("doc_id").alias("id"))
    first = classes.join(ids, "node").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.node").alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, by the words of its text and the weight of its source.

    Null and empty texts have no words and are taken as often as their source's whole part; rows without a
    source are a source of their own. The draw goes by what rows hold, not by their order; repeated rows are
    drawn one by one. All columns stay as they are, whatever their names.
    """
    return mixing.repeated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    Null and empty texts are one token, the end of a document; repeated rows and rows without a doc_id are each
    packed for themselves, ties by doc_id and piece. Other columns than doc_id and text are not read.
    """
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the classifier, the bands or the draw of the mix; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each cut off from the lineage of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs

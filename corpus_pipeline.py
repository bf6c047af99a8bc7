"""The corpus pipeline: quality rules, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), is written as Parquet in the shared
folder, and is read again as the next one's ``docs``. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import mixing, near_duplicates, packing, quality_rules, queries, toxicity
from driftwatch.llm.common import marks, perhaps_in, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.apply_quality_rules(docs).where("kept").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    labels = queries.toxicity_labels(spark, sf_dir).withColumnRenamed("document_id", "doc_id")
    model = toxicity.fit_chain(docs, labels, queries.CHAIN, id_col="doc_id")
    return toxicity.predict_chain(docs, model).where(~toxicity.flag(model, "toxic")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8).

    Documents without an id cannot be named as duplicates and are all kept.
    """
    found = near_duplicates.near_duplicates(docs, id_col="doc_id")
    dropped = found.where(~F.col("kept")).select("doc_id")
    bitmap = marks(dropped, "doc_id")
    named = docs.where("doc_id IS NOT NULL")
    # a document whose mark is free was not dropped; only the others are shuffled to be looked up
    clear = perhaps_in(named, bitmap, "doc_id", "left_anti")
    unclear = perhaps_in(named, bitmap, "doc_id").join(dropped, "doc_id", "left_anti")
    unnamed = docs.where("doc_id IS NULL")
    return clear.select(*docs.columns).unionByName(unclear.select(*docs.columns)).unionByName(unnamed)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the Pfair schedule of their sources."""
    mixed = mixing.mix_collections(docs, key="source", id_col="doc_id")
    order = [F.col("slot").asc_nulls_last(), F.col("doc_id")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; ``sequence_id`` follows the Pfair schedule of the sources."""
    # a written table keeps no order, so the schedule is decided again, from the same rows
    named = docs.select(F.struct("doc_id", "source").alias("who"), "text")
    pieces = packing.token_pieces(named, queries.vocabulary(), id_col="who").drop("token_ids").select("who.*", "piece", "start", "length")
    places = mixing.slot_places(docs, key="source", id_col="doc_id").select("_key", "_id", "slot")
    mine = F.col("source").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    placed = stored(pieces.join(places, mine).select("doc_id", "piece", "start", "length", "slot"))
    return packing.pack_pieces(placed, id_col="doc_id", order="slot").drop("slot")


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
# Tokenising, classifiers and iterated joins cannot be written in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A store of embeddings keyed by the hash of their text, so that no text is embedded twice.

New texts are found by an anti-join on the hash column alone, embedded once
each however often they occur, and added as one more folder of the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.operators import similar
from driftwatch.sources import tables

Embedder = Callable[[DataFrame, str, str], DataFrame]


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def digest_embedder(df: DataFrame, text: str, emb: str = "embedding", dimension: int = 384) -> DataFrame:
    """Word counts hashed by MD5, of unit length: an embedder any engine can repeat, all in the JVM."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")
    place = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint"), F.lit(dimension)).cast("string"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dimension)], "_places", "_counts")
    counted = counter.transform(df.withColumn("_places", place))
    scaled = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counted)
    return scaled.withColumn(emb, vector_to_array("_unit", "float64")).drop("_places", "_counts", "_unit")


def embed_once(path: str, texts: DataFrame, text: str, embedder: Embedder = digest_embedder, emb: str = "embedding") -> DataFrame:
    """``texts`` with an embedding each, from the store under ``path`` after the missing ones were added.

    A null text counts as an empty one. One writer at a time.
    """
    spark = texts.sparkSession
    hashed = texts.withColumn("text_hash", text_hash(F.col(text)))
    missing = hashed.groupBy("text_hash").agg(F.any_value(F.coalesce(text, F.lit(""))).alias("_text"))
    number = len(_batches(spark, path))
    if number:
        missing = missing.join(spark.read.parquet(path).select("text_hash"), "text_hash", "left_anti")
    tables.write_once(embedder(missing, "_text", emb).select("text_hash", emb), f"{path}/batch={number:09d}")
    store = spark.read.parquet(path).select("text_hash", emb)
    return hashed.join(store, "text_hash").drop("text_hash")


def _batches(spark, path: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop(path)):
        return []
    return [s.getPath().getName() for s in files.listStatus(hadoop(path)) if s.getPath().getName().startswith("batch=")]


def stored_texts(spark, path: str) -> int:
    """Number of embedded texts."""
    return spark.read.parquet(path).count() if _batches(spark, path) else 0


def text_similar_stored(
    queries: DataFrame, history: DataFrame, query_id: str, history_id: str, text: str, k: int, path: str, embedder: Embedder = digest_embedder
) -> DataFrame:
    """Text search over a history whose embeddings are kept: only texts never seen are embedded."""
    h = embed_once(path, history.select(history_id, text), text, embedder)
    q = embed_once(path, queries.select(query_id, text), text, embedder)
    return similar.nearest(q, h, query_id, history_id, "embedding", k)

"""Sources and sinks: scans, change feeds, keyed writes, dead letters.

Tables are folders of Parquet files. Writes that replace a table go to a new
version folder, so a reader, a retry or a lost executor never sees half of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.functions.text import strict_json
from driftwatch.session import keys_of, materialize

# Change operations that carry a document.
CHANGE_OPERATIONS = ["insert", "replace", "update"]


# --- reading ---------------------------------------------------------------------


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def changes(df: DataFrame, op: str = "op", doc: str = "doc") -> DataFrame:
    """Change events that carry a document; batch and streaming."""
    return df.filter(F.col(op).isin(CHANGE_OPERATIONS) & F.col(doc).isNotNull())


def change_source(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json", op: str = "op", doc: str = "doc",
    max_files: int | None = None, **options: str,
) -> DataFrame:
    """Streaming change events; resume comes from the query's checkpoint."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return changes(reader.load(path), op, doc)


# --- keyed changes as DataFrame operations -----------------------------------------


def upsert(old: DataFrame, new: DataFrame, key, order: str) -> DataFrame:
    """Rows of both sides, the highest ``order`` per key; new wins ties.

    ``max_by`` combines on the map side, so a key with many updates is cut to
    one row per task before the shuffle.
    """
    keys = keys_of(key)
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
        .select(*old.columns)
    )


def patch(df: DataFrame, updates: DataFrame, key) -> DataFrame:
    """Sets only the columns of ``updates`` (one row per key), keeps others."""
    keys = keys_of(key)
    given = [c for c in updates.columns if c not in keys]
    side = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in given])
    out = [
        F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in given else F.col(c)
        for c in df.columns
    ]
    added = [F.col(f"_{c}").alias(c) for c in given if c not in df.columns]
    return df.join(side, keys, "left").select(*out, *added)


def keep_existing(sink: DataFrame, new: DataFrame, key) -> DataFrame:
    """The new rows whose key is absent from the sink, one per key."""
    keys = keys_of(key)
    return new.dropDuplicates(keys).join(sink.select(*keys), keys, "left_anti")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not satisfy the condition; unknown keeps the row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def split_dead_letter(df: DataFrame, error: Column, failed_at: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and failed rows with error, retry count 0 and time.

    ``error`` is null for good rows, else a struct (error_type, error_message).
    """
    marked = df.withColumn("_error", error)
    good = marked.filter(F.col("_error").isNull()).drop("_error")
    bad = marked.filter(F.col("_error").isNotNull()).select(
        *df.columns,
        F.col("_error.error_type").alias("error_type"),
        F.coalesce(F.nullif(F.col("_error.error_message"), F.lit("")), F.lit("(no message)")).alias("error_message"),
        F.lit(0).alias("retry_count"),
        failed_at.alias("failed_at"),
    )
    return good, bad


def json_error(text: str) -> Column:
    """Error struct of a text column that must be JSON."""
    bad = F.col(text).isNull() | strict_json(F.col(text)).isNull()
    return F.when(
        bad,
        F.struct(
            F.lit("JSONDecodeError").alias("error_type"),
            F.when(F.col(text).isNull(), F.lit("")).otherwise(F.lit("not valid JSON")).alias("error_message"),
        ),
    )


def backfill_embeddings(df: DataFrame, embedder, emb: str = "embedding") -> DataFrame:
    """Embeds only the rows without a vector.

    The text is the description, else "type in collection".
    """
    text = F.coalesce(
        F.nullif(F.col("description"), F.lit("")),
        F.concat(F.coalesce("anomaly_type", F.lit("")), F.lit(" in "), F.coalesce("collection_name", F.lit(""))),
    )
    missing = df.filter(F.col(emb).isNull()).drop(emb).withColumn("_text", text)
    filled = embedder(missing, "_text", emb).drop("_text")
    return df.filter(F.col(emb).isNotNull()).unionByName(filled.select(*df.columns))


# --- writing ------------------------------------------------------------------------


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def merge_keep_existing(path: str, new: DataFrame, key, within: str | None = None) -> None:
    """Appends the rows whose key the table does not have yet.

    ``within`` names a column of the key, such as a time: only stored rows
    inside its range in ``new`` are read, so the cost of a merge follows the
    batch and not the age of the table.
    """
    spark = new.sparkSession
    new = materialize(new)
    if table_exists(spark, path):
        old = spark.read.parquet(path)
        if within is not None:
            low, high = new.agg(F.min(within), F.max(within)).first()
            if low is None:
                return
            old = old.filter(F.col(within).between(F.lit(low), F.lit(high)))
        new = keep_existing(old, new, key)
    else:
        new = new.dropDuplicates(keys_of(key))
    append(new, path)


def replace(df: DataFrame, path: str) -> str:
    """Writes a new version of the table and returns its folder.

    The version is complete once its ``_SUCCESS`` mark is there; earlier
    versions stay readable for jobs that already use them.
    """
    spark = df.sparkSession
    version = max([v for v, done in _versions(spark, path)], default=-1) + 1
    target = f"{path}/v={version:09d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of a replaced table."""
    done = [v for v, ok in _versions(spark, path) if ok]
    return spark.read.parquet(f"{path}/v={max(done):09d}") if done else None


def upsert_table(path: str, new: DataFrame, key, order: str) -> str:
    old = current(new.sparkSession, path)
    return replace(new if old is None else upsert(old, new, key, order), path)


def cache_card(df: DataFrame, path: str) -> str:
    """Stores a small result under one name, replacing the last."""
    return replace(df, path)


def write_once(df: DataFrame, path: str) -> bool:
    """Writes ``df`` to a folder that appears whole or not at all; an existing folder is left as it is."""
    spark = df.sparkSession
    if table_exists(spark, path):
        return False
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    parent, _, name = path.rpartition("/")
    aside = f"{parent}/_{name}-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.rename(hadoop(aside), hadoop(path))


def table_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v="):
            found.append((int(name[2:]), files.exists(hadoop(status.getPath(), "_SUCCESS"))))
    return found

"""Keyed tables in buckets: an upsert or a delete rewrites only the buckets it touches.

A row lies in the bucket of its key's hash. A write puts the new content of the
touched buckets into one version folder and then a manifest that names, for
every bucket, the version that holds it. Readers follow one manifest, so they
see a write whole or not at all; files of untouched buckets stay as they are.
Old manifests, and versions no kept manifest names, are deleted after a write.

    table/data/dw_version=000000003/dw_bucket=17/part-...   table/manifest/m=000000003/part-...
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.session import bounded, keys_of
from driftwatch.sources import tables

BUCKETS = 64
KEEP = 2


def bucket_of(key, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys_of(key)), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    hadoop, files = _files(spark, folder)
    if not files.exists(hadoop(folder)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(hadoop(folder))]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, int, dict[int, int]]:
    """(number, count of buckets, bucket -> version) of a manifest, by default the newest; at most one entry a bucket."""
    if number is None:
        number = max(_numbers(spark, f"{path}/manifest", "m="), default=-1)
    if number < 0:
        return -1, 0, {}
    rows = spark.read.parquet(f"{path}/manifest/m={number:09d}").collect()
    return number, rows[0]["buckets"], {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}


def last_tag(spark: SparkSession, path: str) -> int | None:
    """The highest tag of the writes in the table, such as the number of a stream's last batch."""
    number = max(_numbers(spark, f"{path}/manifest", "m="), default=-1)
    return None if number < 0 else spark.read.parquet(f"{path}/manifest/m={number:09d}").first()["tag"]


def _read(spark: SparkSession, path: str, places: dict[int, int]) -> DataFrame:
    folders = [f"{path}/data/dw_version={v:09d}/dw_bucket={b}" for b, v in sorted(places.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("dw_version")


def read_table(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The rows of the newest manifest, or of a kept earlier one."""
    _, _, places = manifest(spark, path, number)
    return _read(spark, path, places).drop("dw_bucket") if places else None


def lookup(spark: SparkSession, path: str, wanted: DataFrame, key) -> DataFrame | None:
    """Rows of the wanted keys; only the buckets these keys fall into are read."""
    keys = keys_of(key)
    _, buckets, places = manifest(spark, path)
    touched = {r[0] for r in wanted.select(bucket_of(keys, buckets)).distinct().collect()} if places else set()
    there = {b: v for b, v in places.items() if b in touched}
    if not there:
        return read_table(spark, path).limit(0) if places else None
    return _read(spark, path, there).drop("dw_bucket").join(bounded(wanted.select(*keys).distinct()), keys, "left_semi")


def _commit(spark: SparkSession, path: str, number: int, buckets: int, places: dict[int, int], keep: int, tag: int | None = None) -> None:
    rows = [(buckets, b, v, tag) for b, v in places.items()] or [(buckets, None, None, tag)]
    frame = spark.createDataFrame(rows, "buckets int, bucket int, version int, tag long").coalesce(1)
    if not tables.write_once(frame, f"{path}/manifest/m={number:09d}"):
        raise RuntimeError(f"another writer has changed {path}")
    hadoop, files = _files(spark, path)
    kept = _numbers(spark, f"{path}/manifest", "m=")
    for old in kept[:-keep]:
        files.delete(hadoop(f"{path}/manifest/m={old:09d}"), True)
    named = {(v, b) for m in kept[-keep:] for b, v in manifest(spark, path, m)[2].items()}
    for v in _numbers(spark, f"{path}/data", "dw_version="):
        folder = f"{path}/data/dw_version={v:09d}"
        held = _numbers(spark, folder, "dw_bucket=")
        unused = [b for b in held if (v, b) not in named]
        if len(unused) == len(held):
            files.delete(hadoop(folder), True)
            continue
        for b in unused:
            files.delete(hadoop(f"{folder}/dw_bucket={b}"), True)


def _write(rows: DataFrame, path: str, number: int, key, splits: int) -> set[int]:
    """Writes rows (with their bucket) as one version; a bucket is dealt to ``splits`` tasks by its keys."""
    part = F.pmod(F.xxhash64(F.lit(1), *keys_of(key)), F.lit(splits))
    target = f"{path}/data/dw_version={number:09d}"
    rows.repartition("dw_bucket", part).write.mode("overwrite").partitionBy("dw_bucket").parquet(target)
    return set(_numbers(rows.sparkSession, target, "dw_bucket="))


def upsert_buckets(path: str, new: DataFrame, key, order: str, buckets: int = BUCKETS, keep: int = KEEP, splits: int = 1) -> dict[int, int]:
    """Upserts ``new`` into the table and returns bucket -> version.

    Per key the row with the highest ``order`` stays, new rows winning ties.
    ``buckets`` is fixed by the first write. ``splits`` deals each bucket to so
    many tasks and files. Keys may be null; an empty ``new`` changes nothing.
    """
    spark = new.sparkSession
    keys = keys_of(key)
    last, known, places = manifest(spark, path)
    buckets = known or buckets
    marked = new.withColumn("dw_bucket", bucket_of(keys, buckets))
    touched = {r[0] for r in marked.select("dw_bucket").distinct().collect()}
    if not touched:
        return places
    there = {b: v for b, v in places.items() if b in touched}
    old = _read(spark, path, there).select(*marked.columns) if there else marked.limit(0)
    merged = tables.upsert(old, marked, ["dw_bucket", *keys], order)
    written = _write(merged, path, last + 1, keys, splits)
    places = {**places, **{b: last + 1 for b in written}}
    _commit(spark, path, last + 1, buckets, places, keep)
    return places


def merge_buckets(
    path: str, new: DataFrame, key, merge: Callable[[DataFrame, list[str]], DataFrame], tag: int, buckets: int = BUCKETS,
    keep: int = KEEP, splits: int = 1,
) -> bool:
    """Merges mergeable state, such as sums, into the table; False if the write with this tag was done before.

    ``merge(rows, by)`` combines old and new rows of the touched buckets,
    grouped by ``by`` (the bucket column and whatever it adds), and may drop
    expired ones. Tags ascend, as the batch numbers of a stream do. State and
    tag become visible together, so a repeated batch is merged once.
    """
    spark = new.sparkSession
    done = last_tag(spark, path)
    if done is not None and tag <= done:
        return False
    keys = keys_of(key)
    last, known, places = manifest(spark, path)
    buckets = known or buckets
    marked = new.withColumn("dw_bucket", bucket_of(keys, buckets))
    touched = {r[0] for r in marked.select("dw_bucket").distinct().collect()}
    there = {b: v for b, v in places.items() if b in touched}
    rows = _read(spark, path, there).select(*marked.columns).unionByName(marked) if there else marked
    written = _write(merge(rows, ["dw_bucket"]).select(*marked.columns), path, last + 1, keys, splits)
    places = {**{b: v for b, v in places.items() if b not in touched}, **{b: last + 1 for b in written}}
    _commit(spark, path, last + 1, buckets, places, keep, tag)
    return True


def delete_from_buckets(spark: SparkSession, path: str, condition: Column, key, keep: int = KEEP, splits: int = 1) -> dict[int, int]:
    """Deletes the rows that satisfy the condition; only buckets that hold such rows are rewritten."""
    last, buckets, places = manifest(spark, path)
    if not places:
        return places
    rows = _read(spark, path, places)
    touched = {r[0] for r in rows.where(condition).select("dw_bucket").distinct().collect()}
    if not touched:
        return places
    left = tables.delete_where(_read(spark, path, {b: places[b] for b in touched}), condition)
    written = _write(left, path, last + 1, key, splits)
    places = {**{b: v for b, v in places.items() if b not in touched}, **{b: last + 1 for b in written}}
    _commit(spark, path, last + 1, buckets, places, keep)
    return places

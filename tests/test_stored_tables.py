"""Bucketed tables, the stored vector index and the embedding store."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.operators import embedding_store, similar, vector_index
from driftwatch.sources import buckets, tables

ROW = "k long, v string, at int"


def rows_of(df):
    return sorted((r["k"] if r["k"] is not None else -1, r["v"], r["at"]) for r in df.collect())


def files_under(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.upsert_buckets(path, spark.createDataFrame([(i, "a", 1) for i in range(100)] + [(None, "n", 1)], ROW), "k", "at", 8)
    before = files_under(tmp_path / "t" / "data")
    places = buckets.upsert_buckets(path, spark.createDataFrame([(7, "b", 2), (7, "old", 0)], ROW), "k", "at")
    assert sorted(places.values()).count(1) == 1
    after = files_under(tmp_path / "t" / "data")
    assert before.items() <= after.items()
    assert rows_of(buckets.read_table(spark, path)) == sorted([(i, "b" if i == 7 else "a", 2 if i == 7 else 1) for i in range(100)] + [(-1, "n", 1)])
    # the manifest before is still readable
    assert (7, "a", 1) in rows_of(buckets.read_table(spark, path, 0))
    # new rows win ties, older rows lose, null keys are keys
    buckets.upsert_buckets(path, spark.createDataFrame([(7, "tie", 2), (8, "stale", 0), (None, "m", 3)], ROW), "k", "at")
    got = {r[0]: r[1] for r in rows_of(buckets.read_table(spark, path))}
    assert (got[7], got[8], got[-1]) == ("tie", "a", "m")
    assert buckets.upsert_buckets(path, spark.createDataFrame([], ROW), "k", "at") == buckets.manifest(spark, path)[2]


def test_retention_keeps_what_manifests_name(spark, tmp_path):
    path = str(tmp_path / "t")
    for at in range(5):
        buckets.upsert_buckets(path, spark.createDataFrame([(i, f"v{at}", at) for i in (range(40) if at == 0 else [3])], ROW), "k", "at", 4)
    held = sorted(p.name for p in (tmp_path / "t" / "data").iterdir())
    assert held == ["dw_version=000000000", "dw_version=000000003", "dw_version=000000004"]
    assert len(list((tmp_path / "t" / "manifest").glob("m=*"))) == 2
    assert buckets.read_table(spark, path).count() == 40


def test_delete_and_lookup_touch_few_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.upsert_buckets(path, spark.createDataFrame([(i, None if i == 9 else "a", 1) for i in range(60)], ROW), "k", "at", 8, splits=2)
    found = buckets.lookup(spark, path, spark.createDataFrame([(5,), (500,)], "k long"), "k")
    assert rows_of(found) == [(5, "a", 1)]
    assert len({f.split("dw_bucket=")[1].split("/")[0] for f in found.inputFiles()}) <= 2
    before = files_under(tmp_path / "t" / "data")
    buckets.delete_from_buckets(spark, path, F.col("k") == 5, "k")
    assert before.items() <= files_under(tmp_path / "t" / "data").items()
    # an unknown condition keeps the row
    buckets.delete_from_buckets(spark, path, F.col("v") == "a", "k")
    assert [r["k"] for r in buckets.read_table(spark, path).collect()] == [9]
    assert buckets.lookup(spark, path, spark.createDataFrame([(5,)], "k long"), "k").count() == 0


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", 1)], ROW)
    buckets.upsert_buckets(path, df, "k", "at", 2)
    tables.write_once(df, f"{path}/manifest/m=000000001")
    with pytest.raises(RuntimeError):
        buckets._commit(spark, path, 1, 2, {0: 0}, 2)


def clustered(n, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, 12))
    return [(i, (centres[i % 30] + 0.4 * rng.standard_normal(12)).tolist(), f"d{i}") for i in range(n)]


def test_index_reaches_the_recall_and_reads_fewer_cells(spark, tmp_path):
    rows = clustered(3000) + [(5000, None, "none"), (5001, [0.0] * 12, "zero")]
    h = spark.createDataFrame(rows, "id long, embedding array<double>, description string")
    path = str(tmp_path / "index")
    probes = vector_index.build_index(h, path, "id", k=5, cells=24)
    asked = h.where("id % 40 = 0").withColumnRenamed("id", "query")
    found = vector_index.search_index(spark, path, asked.where("query < 5000"), "query", "id", k=5)
    got = {(r["query"], r["id"]): r["score"] for r in found.collect()}
    want = {(r["query"], r["id"]): r["score"] for r in similar.nearest(asked.where("query < 5000"), h, "query", "id", "embedding", 5).collect()}
    assert probes < 12
    assert len(set(got) & set(want)) >= 0.95 * len(want)
    assert all(got[p] == want[p] for p in set(got) & set(want))
    # one query reads its cells only
    one = vector_index.search_index(spark, path, asked.where("query = 40"), "query", "id", k=3, probes=2)
    assert one.count() == 3
    assert len(list((tmp_path / "index" / "rows").glob("cell=*"))) == 24
    # with every cell probed the answer is the exact one
    every = vector_index.search_index(spark, path, asked.where("query < 5000"), "query", "id", k=5, probes=24)
    assert {(r["query"], r["id"]) for r in every.collect()} == set(want)


def test_index_of_few_rows(spark, tmp_path):
    h = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    assert vector_index.build_index(h, str(tmp_path / "i"), "id") == 1
    found = vector_index.search_index(spark, str(tmp_path / "i"), h.withColumnRenamed("id", "q"), "q", "id", k=9, exclude_same=True)
    assert sorted((r["q"], r["id"]) for r in found.collect()) == [(1, 2), (2, 1)]
    with pytest.raises(ValueError):
        vector_index.build_index(h.limit(0), str(tmp_path / "j"), "id")


def test_each_text_is_embedded_once(spark, tmp_path):
    path, seen = str(tmp_path / "s"), []

    def counting(df, text, emb):
        seen.append(sorted(r[0] for r in df.select(text).collect()))
        return embedding_store.digest_embedder(df, text, emb, 8)

    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "")], "id int, text string")
    first = {r["id"]: r["embedding"] for r in embedding_store.embed_once(path, df, "text", counting).collect()}
    assert seen == [["", "a b"]] and first[1] == first[2] and first[3] == first[4] == [0.0] * 8
    assert sum(x * x for x in first[1]) == pytest.approx(1.0)
    more = spark.createDataFrame([(5, "a b"), (6, "c")], "id int, text string")
    again = embedding_store.embed_once(path, more, "text", counting)
    assert seen[1] == ["c"] and again.count() == 2 and embedding_store.stored_texts(spark, path) == 3


def test_index_search_shuffles_no_copy_a_cell(spark, tmp_path, monkeypatch):
    h = spark.createDataFrame([(i, v) for i, v, _ in clustered(1500)], "id long, embedding array<double>")
    path = str(tmp_path / "index")
    vector_index.build_index(h, path, "id", k=5, cells=12)
    asked = h.where("id % 10 = 0").withColumnRenamed("id", "query")
    sent, keep = [], similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df: sent.append(keep(df)) or sent[-1])
    every = vector_index.search_index(spark, path, asked, "query", "id", k=5, probes=12, exclude_same=True)
    want = similar.nearest(asked, h, "query", "id", "embedding", 5, exclude_same=True)
    assert sent[0].count() == asked.count()  # a query goes on once, whatever it probes
    rows = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, every.collect())) == rows
    # several blocks of queries and of rows give the same
    monkeypatch.setattr(similar, "BLOCK_BYTES", 40 * 8 * 12)
    blocks = vector_index.search_index(spark, path, asked, "query", "id", k=5, probes=12, exclude_same=True)
    assert sorted(map(tuple, blocks.collect())) == rows


def test_block_join_deals_copies_out_by_their_bytes(spark, monkeypatch):
    h = spark.createDataFrame([(i, v) for i, v, _ in clustered(600)], "id long, embedding array<double>")
    asked = h.where("id % 6 = 0").withColumnRenamed("id", "query")
    want = sorted(map(tuple, similar.nearest(asked, h, "query", "id", "embedding", 3).collect()))
    monkeypatch.setattr(similar, "PARTITION_BYTES", 4096)
    dealt = similar.nearest(asked, h, "query", "id", "embedding", 3, rows_per_block=50)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert any(int(n) > 20 for n in re.findall(r"hashpartitioning\(qb#\d+, hb#\d+, (\d+)\), REPARTITION_BY_NUM", plan))
    assert sorted(map(tuple, dealt.collect())) == want

"""A stored vector index: the history in cells around centroids, one partition a cell.

Centroids are fitted on a bounded sample with Spark ML, every row is stored in
the cell of its nearest centroid, and a query probes the cells of its nearest
centroids. How many that takes is measured once, when the index is built: exact
neighbours of trial vectors must be reached at the wanted recall. Only probed
partitions are read, and within them the search is the exact block join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.operators import similar
from driftwatch.operators.similar import unit_rows

FIT_ROWS = 50_000
MOST_CELLS = 1024
TRIALS = 200
RECALL = 0.97
SEED = 11


def _by_cell(df: DataFrame, emb: str, centroids: np.ndarray, n: int, cell: str, bitmap: bool = False) -> DataFrame:
    """Adds an array of the ``n`` nearest cells, nearest first, or a bitmap of them. ``centroids`` has at most ``MOST_CELLS`` rows."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = unit_rows(batch.column(emb)) @ shared.value.T
                near = np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)
                if bitmap:
                    inside = np.zeros(score.shape, bool)
                    np.put_along_axis(inside, near, True, axis=1)
                    cells = pa.array([x.tobytes() for x in np.packbits(inside, axis=1)], pa.binary())
                else:
                    cells = pa.FixedSizeListArray.from_arrays(pa.array(near.reshape(-1)), n).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, cell])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kind}, `{cell}` {'binary' if bitmap else 'array<int>'}")


def _fit(vectors: DataFrame, emb: str, rows: int, fit_rows: int, cells: int | None) -> np.ndarray:
    drawn = vectors if rows <= fit_rows else vectors.sample(False, fit_rows / rows, SEED)
    cells = cells or max(1, min(MOST_CELLS, int(rows**0.5)))
    ready = drawn.select(array_to_vector(F.col(emb).cast("array<double>")).alias("v"))
    model = KMeans(k=cells, seed=SEED, maxIter=15, distanceMeasure="cosine", featuresCol="v").fit(ready) if cells > 1 else None
    if model is None:
        first = drawn.select(emb).first()
        return np.ones((1, len(first[0]) if first else 1))
    m = np.array(model.clusterCenters())
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def build_index(
    history: DataFrame, path: str, history_id: str, emb: str = "embedding", k: int = 10, recall: float = RECALL,
    fit_rows: int = FIT_ROWS, cells: int | None = None,
) -> int:
    """Writes the index of a history under ``path`` and returns the number of cells a query probes.

    Rows without a vector, or whose vector has no length, are in no cell: their
    cosine with everything is 0. Vectors are taken as they are, so the exact
    search of a cell gives the scores of the exact search of everything.
    """
    spark = history.sparkSession
    length = F.aggregate(emb, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    vectors = history.where(F.col(emb).isNotNull() & (F.sqrt(length) > 1e-9))
    rows = vectors.count()
    if not rows:
        raise ValueError("a history without vectors cannot be indexed")
    centroids = _fit(vectors, emb, rows, fit_rows, cells)
    placed = _by_cell(vectors, emb, centroids, 1, "_cells").withColumn("cell", F.col("_cells")[0]).drop("_cells")
    # rows of a cell are spread by id: a large cell is several files
    placed.repartition("cell", F.pmod(F.xxhash64(history_id), F.lit(1 + rows // 1_000_000))).write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/rows")
    index = spark.read.parquet(f"{path}/rows")
    probes = _needed(index, centroids, history_id, emb, k, recall, min(1.0, TRIALS / rows))
    meta = [(i, c.tolist(), probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(meta, "cell int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")
    return probes


def _needed(index: DataFrame, centroids: np.ndarray, history_id: str, emb: str, k: int, recall: float, share: float) -> int:
    """The fewest cells that hold the share ``recall`` of the exact neighbours of some rows."""
    if len(centroids) == 1:
        return 1
    trials = index.sample(False, share, SEED).limit(2 * TRIALS).select(F.col(history_id).alias("trial"), emb)
    exact = similar.nearest(trials, index, "trial", history_id, emb, k, exclude_same=True)
    ranked = _by_cell(trials, emb, centroids, len(centroids), "_cells").select("trial", "_cells")
    place = exact.join(index.select(history_id, "cell"), history_id).join(ranked, "trial").select(F.array_position("_cells", F.col("cell")).alias("n"))
    needed = sorted(r["n"] for r in place.collect())  # at most 2 * TRIALS * k rows
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) if needed else len(centroids)


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, query_id: str, history_id: str, emb: str = "embedding", k: int = 10,
    probes: int | None = None, exclude_same: bool = False,
) -> DataFrame:
    """(query, history_id, score, rank): the ``k`` best rows found in the probed cells; cells nobody probes are not read."""
    meta = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    centroids, probes = np.array([r["centroid"] for r in meta]), probes or meta[0]["probes"]
    asked = queries.where(F.col(emb).isNotNull()).select(query_id, emb)
    routed = _by_cell(asked, emb, centroids, min(probes, len(centroids)), "_cells")
    wanted = sorted(r[0] for r in routed.select(F.explode("_cells")).distinct().collect())
    rows = spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(wanted))
    # a query goes on once, with a bit for each cell, not once for each of its cells
    marked = _by_cell(asked, emb, centroids, min(probes, len(centroids)), "_cells", bitmap=True)
    return similar.nearest(marked, rows, query_id, history_id, emb, k, exclude_same=exclude_same, cells=("_cells", "cell"))


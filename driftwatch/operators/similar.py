"""Similar incidents: exact k-nearest search by cosine, near-duplicate
collapse, and text search through a pluggable embedder.

The search is a block join. Queries that fit one block (32 MB of vectors, by
counted rows) are sent to all tasks, and the history is read once where it
lies, without a shuffle. More queries are split into blocks by a hash of their
id, and so is the history; every pair of blocks meets in one task as two
matrices. Only the best ``k`` per query, of different keys where near-duplicates
collapse, leave a task, so no task or driver ever
holds an unbounded side and no pair list is produced. A task takes the history
slice by slice, and the copies of the blocks are dealt out to as many partitions
as their bytes need, so its memory does not grow with the tables. In the block join,
equality columns (pre-filters) become part of the block key, so only rows that
agree on them meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.text import duplicate_key
from driftwatch.session import bounded, keys_of, materialize, spread

# Matches returned, default resolution time.
MATCHES, DEFAULT_MINUTES = 3, 30
# Memory of one block of vectors inside a task.
BLOCK_BYTES = 32 * 1024 * 1024
# Memory of the history's vectors that a task holds as a matrix, and of what a partition of the block join sorts.
SLICE_BYTES = 2 * 1024 * 1024
PARTITION_BYTES = 64 * 1024 * 1024
MIN_BLOCK_ROWS = 256
# List of the newest incidents of any type, for types without a history.
ANY_TYPE = "*"


def block_rows(dimension: int) -> int:
    return max(1, BLOCK_BYTES // (8 * max(1, dimension)))


def _blocks(df: DataFrame, row_id: str, mine: str, other: str, n_mine: int, n_other: int) -> DataFrame:
    """Puts each row in one block of its own side and one copy per other block."""
    own = F.pmod(F.xxhash64(F.col(row_id)), F.lit(n_mine)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
    return df.withColumn(mine, own).withColumn(other, copies)


def nearest(
    queries: DataFrame, history: DataFrame, query_id: str, history_id: str, emb: str, k: int, match_on=(),
    exclude_same: bool = False, rows_per_block: int | None = None, distinct: Column | None = None, cells: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows (query_id, history_id, score, rank) of the ``k`` best per query.

    With ``distinct``, a string of the history, only the best row of each of
    its values counts, null being one value. With ``cells``, a query meets the
    rows of its cells only: the first names a bitmap (binary, high bits first)
    of the queries, the second the number of a cell in the history.

    Exact: every query meets every history row that agrees on ``match_on``.
    Scores are cosines rounded to 6 places, ties go to the smaller id. A
    vector of zero length scores 0.
    """
    same = keys_of(match_on)
    bits, cell = ([F.col(c).alias(n)] for c, n in zip(cells, ("_bits", "_cell"))) if cells else ([], [])
    q = queries.filter(F.col(emb).isNotNull()).select(F.col(query_id).alias("q"), F.col(emb).alias("qv"), *same, *bits)
    h = history.filter(F.col(emb).isNotNull()).select(F.col(history_id).alias("h"), F.col(emb).alias("hv"), *same, *cell, _text_key(distinct).alias("_c"))
    q = materialize(q)
    # both sides are as wide, or they have no cosine
    n, widest = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("qv")), F.lit(1))).first()
    rows_per_block = rows_per_block or block_rows(widest)
    types = dict(q.dtypes), dict(h.dtypes)
    schema = f"q {types[0]['q']}, h {types[1]['h']}, score double, c string"
    once = distinct is not None
    asked = Asked(tuple(same), k, exclude_same, once, max(1, SLICE_BYTES // (8 * max(1, widest))))
    n_q = max(1, ceil(n / rows_per_block))
    if n_q == 1:
        found = _scan(q, h, asked, schema)
    else:
        found = _block_join(q, h, asked, schema, n, n_q, rows_per_block, widest)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "h")
    if once:
        first = Window.partitionBy("q", "c").orderBy(F.desc("score"), "h")
        found = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("q").alias(query_id if query_id != history_id else "query_id"), F.col("h").alias(history_id), "score", "rank")
    )


def _text_key(distinct: Column | None) -> Column:
    """The values of ``distinct`` as strings, null apart from all of them."""
    return F.lit(None).cast("string") if distinct is None else F.coalesce(F.concat(F.lit("="), distinct), F.lit(""))


class Asked(NamedTuple):
    """What a search looks for."""

    same: tuple[str, ...]
    k: int
    exclude_same: bool
    once: bool
    rows: int  # of the history, taken at once


class Search:
    """The best rows for a block of queries among those of the history seen so far."""

    def __init__(self, q: pa.Table, asked: Asked):
        self.asked = asked
        self.ids = q["q"].combine_chunks()
        self.names = self.ids.to_pylist()
        self.targets = unit_rows(q["qv"].combine_chunks())
        self.every = np.arange(len(self.ids))
        self.bits = np.frombuffer(b"".join(q["_bits"].to_pylist()), np.uint8).reshape(len(self.ids), -1) if "_bits" in q.column_names else None
        self.agreeing: dict[tuple, list[int]] = {}
        for i, mark in enumerate(zip(*[q[c].to_pylist() for c in asked.same])):
            self.agreeing.setdefault(mark, []).append(i)
        nothing = np.array([], dtype=object)
        self.top = [(nothing, np.array([]), nothing) for _ in self.every]
        self.reach = np.full(len(self.ids), -np.inf)  # score of the k-th best, once there are so many

    def add(self, history: pa.RecordBatch) -> None:
        for at in range(0, history.num_rows, self.asked.rows):
            self._add(history.slice(at, self.asked.rows))

    def _add(self, rows: pa.RecordBatch) -> None:
        rows = rows.take(pc.array_sort_indices(rows.column("h"), null_placement="at_start"))
        names, vectors = _objects(rows.column("h").to_pylist()), unit_rows(rows.column("hv"))
        keys = _objects(rows.column("_c").to_pylist())
        codes = pd.factorize(keys)[0] if self.asked.once else None
        own: dict = {}
        if self.asked.exclude_same:
            for at, name in enumerate(names):
                own.setdefault(name, []).append(at)
        for places, asking in self._meetings(rows):
            part = vectors if places is None else vectors[places]
            for start in range(0, len(asking), 256):
                some = asking[start : start + 256]
                block = self.targets[some] @ part.T
                # rounding moves no score by as much as the margin
                for j in np.flatnonzero(block.max(axis=1) >= self.reach[some] - 1e-6):
                    row = np.round(np.clip(block[j], -1.0, 1.0), 6)
                    self._merge(some[j], row, places, names, keys, codes, own)

    def _merge(self, i: int, row: np.ndarray, places: np.ndarray | None, names, keys, codes, own: dict) -> None:
        mine = own.get(self.names[i])
        if mine:
            row[mine if places is None else np.isin(places, mine)] = -np.inf
        # only scores that reach the k-th best so far compete
        good = np.flatnonzero(row >= self.reach[i])
        at = good if places is None else places[good]
        chosen = _best(row[good], self.asked.k, None if codes is None else codes[at])
        if len(chosen):
            at = at[chosen]
            self.top[i] = _merge(self.top[i], (names[at], row[good[chosen]], keys[at]), self.asked.k, self.asked.once)
            if len(self.top[i][1]) >= self.asked.k:
                self.reach[i] = self.top[i][1][-1]

    def _meetings(self, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
        """(places of rows, null for all; the queries that meet them)"""
        columns = [*self.asked.same, *["_cell"] * (self.bits is not None)]
        if not columns:
            yield None, self.every
            return
        groups: dict[tuple, list[int]] = {}
        for at, mark in enumerate(zip(*[rows.column(c).to_pylist() for c in columns])):
            groups.setdefault(mark, []).append(at)
        for mark, places in groups.items():
            asking = np.array(self.agreeing.get(mark[: len(self.asked.same)], []), np.int64) if self.asked.same else self.every
            if self.bits is not None:
                asking = asking[(self.bits[asking, mark[-1] >> 3] >> (7 - (mark[-1] & 7)) & 1).astype(bool)]
            if len(asking):
                yield np.array(places), asking

    def found(self, kind: pa.DataType) -> pa.RecordBatch:
        """(q, h, score, c); ``kind`` is the type of the history's ids."""
        hits, scores, keys = ([x for t in self.top for x in t[j].tolist()] for j in range(3))
        ids = self.ids.take(pa.array(np.repeat(self.every, [len(t[1]) for t in self.top])))
        return pa.RecordBatch.from_arrays([ids, pa.array(hits, kind), pa.array(scores, pa.float64()), pa.array(keys, pa.string())], ["q", "h", "score", "c"])


def _objects(values: list) -> np.ndarray:
    made = np.empty(len(values), dtype=object)
    made[:] = values
    return made


def _merge(old: tuple, new: tuple, k: int, once: bool) -> tuple:
    """The ``k`` best of two short lists, with ``once`` of different keys; of equal scores the smaller ids."""
    names, scores, keys = (np.concatenate(x) for x in zip(old, new))
    order = sorted(range(len(scores)), key=lambda j: (-scores[j], names[j] is not None, names[j]))
    if once:
        first: dict = {}
        for j in order:
            first.setdefault(keys[j], j)
        order = list(first.values())
    return names[order[:k]], scores[order[:k]], keys[order[:k]]


def _scan(q: DataFrame, h: DataFrame, asked: Asked, schema: str) -> DataFrame:
    """One pass over the history against one block of queries."""
    block = q.sparkSession.sparkContext.broadcast(q.toArrow())  # one block of vectors at most

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            if batch.num_rows and block.value.num_rows:
                search = search or Search(block.value, asked)
                search.add(batch)
        if search:
            yield search.found(batch.schema.field("h").type)

    return spread(h).mapInArrow(best, schema)


def _block_join(
    q: DataFrame, h: DataFrame, asked: Asked, schema: str, rows: int, n_q: int, rows_per_block: int, width: int
) -> DataFrame:
    """Every block of queries against every block of the history."""
    n = h.count()
    n_h = _history_blocks(h, n, n_q, rows_per_block)
    keys = ["qb", "hb", *asked.same]
    # as many partitions as the copies of both sides need
    size = (rows * n_h + n * n_q) * (8 * width + 64)
    parts = max(int(h.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size / PARTITION_BYTES))
    left = _blocks(q, "q", "qb", "hb", n_q, n_h).repartition(parts, *keys)
    right = _blocks(h, "h", "hb", "qb", n_h, n_q).repartition(parts, *keys)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        kind = b.schema.field("h").type
        if not (a.num_rows and b.num_rows):
            a = a.slice(0, 0)
            none = [a["q"], pa.array([], kind), pa.array([], pa.float64()), pa.array([], pa.string())]
            return pa.table(none, ["q", "h", "score", "c"])
        search = Search(a, asked)
        for batch in b.to_batches():
            search.add(batch)
        return pa.Table.from_batches([search.found(kind)])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, schema)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best finite scores; of equal ones the earlier places."""
    if len(scores) > k:
        # rows that tie with the k-th best all compete for the last places
        places = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        places = np.arange(len(scores))
    places = places[np.argsort(-scores[places], kind="stable")[:k]]
    return places[scores[places] > -np.inf]


def _best(scores: np.ndarray, k: int, codes: np.ndarray | None) -> np.ndarray:
    """As :func:`_top`; with ``codes``, only the best place of each code counts."""
    if codes is None:
        return _top(scores, k)
    reach = k
    while True:
        places = _top(scores, reach)
        first = np.unique(codes[places], return_index=True)[1]
        if len(first) >= k or len(places) < reach:
            return places[np.sort(first)[:k]]
        reach *= 4


def _history_blocks(h: DataFrame, rows: int, n_q: int, rows_per_block: int) -> int:
    """Enough blocks for the memory bound, and for all tasks to have work."""
    tasks = int(h.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    busy = min(tasks // n_q, rows // MIN_BLOCK_ROWS)
    return max(1, ceil(rows / rows_per_block), busy)


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of unit length; a row of (nearly) zero length is all zeros."""
    numbers = pc.cast(pc.list_flatten(vectors), pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    m = numbers.reshape(len(vectors), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 1e-9)


def collapse(candidates: DataFrame, query: str, kind: str, description: str, order: list[Column], k: int = MATCHES) -> DataFrame:
    """First row per near-duplicate key in score order, then the first ``k``."""
    marked = candidates.withColumn("_key", duplicate_key(F.col(kind), F.col(description)))
    first = Window.partitionBy(query, "_key").orderBy(*order)
    ranked = Window.partitionBy(query).orderBy(*order)
    return (
        marked.withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .drop("_key", "_n")
    )


def similar(
    queries: DataFrame, history: DataFrame, query_id: str, history_id: str, emb: str, kind: str = "anomaly_type",
    description: str = "description", keep: list[str] | None = None, k: int = MATCHES, match_on=(),
) -> DataFrame:
    """The ``k`` distinct past incidents most similar to each query, however many near-duplicates are nearer."""
    key = duplicate_key(F.col(kind), F.col(description))
    hits = nearest(queries, history, query_id, history_id, emb, k, match_on, distinct=key).drop("rank")
    payload = [c for c in dict.fromkeys([history_id, kind, description, *(keep or [])])]
    joined = hits.join(history.select(*payload), history_id)
    query = query_id if query_id != history_id else "query_id"
    return collapse(joined, query, kind, description, [F.desc("score"), F.col(history_id)], k)


def similar_summary(matches: DataFrame, query: str, kind: str = "anomaly_type", minutes: str = "resolution_time_minutes") -> DataFrame:
    """Per query: best score, its type and its resolution time."""
    top = F.min_by(F.struct("score", kind, minutes), "rank")
    return matches.groupBy(query).agg(top.alias("t"), F.count(F.lit(1)).alias("n_matches")).select(
        query,
        "n_matches",
        F.col("t.score").alias("top_match_score"),
        F.col(f"t.{kind}").alias("pattern_identified"),
        F.coalesce(F.col(f"t.{minutes}"), F.lit(DEFAULT_MINUTES)).alias("estimated_resolution_minutes"),
    )


def recent_same_type(anomalies: DataFrame, history: DataFrame, query_id: str, kind: str, created: str, tie: str, n: int = MATCHES) -> DataFrame:
    """The newest ``n`` past incidents of the same type; if none, any newest.

    Both lists are cut to ``n`` rows before they meet an anomaly, so the joins
    only ever multiply by ``n``.
    """
    newest = Window.partitionBy(kind).orderBy(F.desc(created), F.desc(tie))
    per_type = history.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)
    top = history.orderBy(F.desc(created), F.desc(tie)).limit(n)
    any_rank = Window.partitionBy(F.lit(ANY_TYPE)).orderBy(F.desc(created), F.desc(tie))
    lists = per_type.withColumn("_pick", F.col(kind)).unionByName(
        top.withColumn("rank", F.row_number().over(any_rank)).withColumn("_pick", F.lit(ANY_TYPE))
    )
    lists = bounded(lists)
    known = bounded(per_type.select(F.col(kind).alias("_known")).distinct())
    side = anomalies.select(query_id, F.col(kind).alias("_wanted")).join(known, F.col("_wanted") == F.col("_known"), "left")
    pick = F.when(F.col("_known").isNotNull(), F.col("_wanted")).otherwise(F.lit(ANY_TYPE))
    return side.withColumn("_pick", pick).drop("_wanted", "_known").join(lists, "_pick").drop("_pick")


# --- text ---------------------------------------------------------------------------


def hashing_embedder(df: DataFrame, text: str, emb: str = "embedding", dimension: int = 384) -> DataFrame:
    """Default embedder: hashed word counts of unit length, all in the JVM."""
    words = df.withColumn("_words", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != ""))
    hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimension).transform(words)
    scaled = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(hashed)
    return scaled.withColumn(emb, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def model_embedder(load, emb: str = "embedding"):
    """Embedder from a model: ``load()`` returns ``texts -> vectors``.

    The model is loaded once per Python worker batch stream, and texts reach
    it in Arrow batches.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in model(texts.fillna("").tolist())])

    def apply(df: DataFrame, text: str, emb: str = emb) -> DataFrame:
        return df.withColumn(emb, embed(F.col(text)))

    return apply


def text_similar(queries: DataFrame, history: DataFrame, query_id: str, history_id: str, text: str, k: int, embedder=hashing_embedder) -> DataFrame:
    """Embeds the texts of both sides, then searches."""
    q = embedder(queries.select(query_id, text), text)
    h = embedder(history.select(history_id, text), text)
    return nearest(q, h, query_id, history_id, "embedding", k)

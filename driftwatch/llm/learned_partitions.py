"""Approximate nearest incidents by learned partitions of a neighbour graph.

A bounded sample of the history gives a graph of nearest neighbours, which is
cut into partitions of equal size with few edges between them. A small
classifier learns from a vector which partitions its neighbours lie in. It puts
every row of the history into its most probable partition, and sends a query to
several of them, whose rows are ranked by their exact cosine. How many are
probed is measured: exact neighbours of a set of trial queries, found among all
rows, must be reached at the wanted recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.common import power_of_two, stored

MATCHES = 3
FIT_ROWS = 16_384
ROWS_PER_PARTITION = 256  # of the sample
MOST_PARTITIONS = 256
GRAPH_NEIGHBOURS = 10
TRIALS = 256
RECALL = 0.96
HIDDEN, EPOCHS, BATCH, RATE = 64, 30, 256, 3e-3
# Memory of one block of vectors inside a task, and of one block of scores.
BLOCK_BYTES, SCORES = 24 << 20, 1 << 22
# Scores of matrix products this close are compared again one by one.
SLACK = 1e-9
SEED = 7


class PartitionModel(NamedTuple):
    """The classifier: a hidden layer, then one logit for each partition."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def partitions(self) -> int:
        return len(self.b2)

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def usable(emb: str, dimension: int | None = None):
    """Vectors that take part: no null, nothing but finite components, not all zero, of the given length."""
    c = F.col(emb)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0)
    return fine if dimension is None else fine & (F.size(c) == dimension)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows, scaled by powers of two so that no square overflows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = pc.list_flatten(array).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)
    if not m.size:
        return m
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / _lengths(m)[:, None] if m.size else m


def neighbour_graph(spark, unit: np.ndarray, k: int = GRAPH_NEIGHBOURS) -> np.ndarray:
    """Places of the ``k`` nearest other rows of each row of a bounded sample, found block by block in tasks."""
    n = len(unit)
    k = min(k, n - 1)
    shared = spark.sparkContext.broadcast(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            step = max(1, SCORES // n)
            for at in range(0, len(ids), step):
                some = ids[at : at + step]
                s = u[some] @ u.T
                s[np.arange(len(some)), some] = -np.inf
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(best.astype(np.int32)))], ["id", "near"])

    tasks = max(1, min(n // 256, 4 * spark.sparkContext.defaultParallelism))
    rows = spark.range(0, n, 1, tasks).mapInArrow(run, "id long, near array<int>").collect()
    graph = np.zeros((n, k), np.int64)
    for r in rows:
        graph[r["id"]] = r["near"]
    return graph


def balanced_partition(unit: np.ndarray, graph: np.ndarray, partitions: int, rounds: int = 40) -> np.ndarray:
    """Partition of each node of the graph: equal sizes, few edges cut.

    Starts from halves along principal directions. Then, round by round, nodes
    that have more neighbours elsewhere change places with as many that want
    the other way, those with the largest gains first, so that sizes stay.
    """
    label = np.zeros(len(unit), np.int64)
    rng = np.random.default_rng(SEED)
    for _ in range(partitions.bit_length() - 1):
        halves = 2 * label
        for p in range(int(label.max()) + 1):
            mine = np.flatnonzero(label == p)
            x = unit[mine] - unit[mine].mean(axis=0)
            direction = rng.standard_normal(x.shape[1])
            for _ in range(8):
                direction = x.T @ (x @ direction)
                direction /= np.linalg.norm(direction) or 1.0
            order = mine[np.argsort(x @ direction, kind="stable")]
            halves[order[len(order) // 2 :]] += 1
        label = halves
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.reshape(-1)
    node, other = np.concatenate([a, b]), np.concatenate([b, a])
    best, least_cut = label, np.inf
    for _ in range(rounds):
        cut = (label[node] != label[other]).sum()
        if cut < least_cut:
            best, least_cut = label, cut
        near = np.bincount(node * partitions + label[other], minlength=n * partitions).reshape(n, partitions)
        wanted = near.argmax(axis=1)
        gain = near[np.arange(n), wanted] - near[np.arange(n), label]
        movers = np.flatnonzero((gain > 0) & (rng.random(n) < 0.7))
        if not len(movers):
            break
        way = label[movers] * partitions + wanted[movers]
        order = np.lexsort((-gain[movers], way))
        movers, way = movers[order], way[order]
        counts = np.bincount(way, minlength=partitions**2).reshape(partitions, partitions)
        rank = np.arange(len(way)) - np.searchsorted(way, way)
        swapped = movers[rank < np.minimum(counts, counts.T).reshape(-1)[way]]
        label = label.copy()
        label[swapped] = wanted[swapped]
    return best


def fit_classifier(unit: np.ndarray, graph: np.ndarray, label: np.ndarray, partitions: int) -> PartitionModel:
    """Learns the share of each partition among a node and its neighbours (cross entropy, Adam)."""
    n, d = unit.shape
    rng = np.random.default_rng(SEED)
    goal = np.bincount(
        np.repeat(np.arange(n), graph.shape[1] + 1) * partitions + label[np.column_stack([np.arange(n), graph])].reshape(-1),
        minlength=n * partitions,
    ).reshape(n, partitions) / (graph.shape[1] + 1)
    weights = [
        rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN),
        rng.standard_normal((HIDDEN, partitions)) * np.sqrt(1 / HIDDEN), np.zeros(partitions),
    ]
    # inputs of unit length are small: stretch them to unit variance
    stretch = np.sqrt(d)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            some = order[at : at + BATCH]
            x = unit[some] * stretch
            hidden = np.maximum(x @ weights[0] + weights[1], 0)
            z = hidden @ weights[2] + weights[3]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - goal[some]) / len(some)
            dh = (dz @ weights[2].T) * (hidden > 0)
            step += 1
            for i, g in enumerate((x.T @ dh, dh.sum(axis=0), hidden.T @ dz, dz.sum(axis=0))):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                weights[i] = weights[i] - RATE * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return PartitionModel(weights[0] * stretch, *weights[1:])


def fit_partitions(vectors: DataFrame, rows: int, emb: str, fit_rows: int = FIT_ROWS, partitions: int | None = None) -> tuple[PartitionModel | None, np.ndarray]:
    """(classifier, sample): from at most ``fit_rows`` of the ``rows`` usable vectors; no classifier for one partition."""
    spark = vectors.sparkSession
    drawn = vectors if rows <= fit_rows else vectors.sample(False, fit_rows / rows, SEED)
    unit = _unit(_matrix(drawn.select(emb).limit(fit_rows).toArrow().column(0)))
    if partitions is None:
        partitions = power_of_two(len(unit) / ROWS_PER_PARTITION, 1, MOST_PARTITIONS)
        partitions = partitions if partitions * ROWS_PER_PARTITION <= len(unit) else partitions // 2
    if partitions <= 1:
        return None, unit
    graph = neighbour_graph(spark, unit)
    return fit_classifier(unit, graph, balanced_partition(unit, graph, partitions), partitions), unit


def with_partition(vectors: DataFrame, model: PartitionModel | None, emb: str) -> DataFrame:
    """Adds ``part``: the most probable partition of every row."""
    if model is None:
        return vectors.withColumn("part", F.lit(0))
    shared = vectors.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PartitionModel(*shared.value)
        for batch in batches:
            if batch.num_rows:
                part = m.logits(_unit(_matrix(batch.column(emb)))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], [*batch.schema.names, "part"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kind}, part int")


def needed_probes(index: DataFrame, model: PartitionModel, trials: np.ndarray, emb: str, k: int, recall: float) -> int:
    """The fewest partitions that hold the share ``recall`` of the ``k`` nearest rows of the trial vectors.

    The nearest rows are exact, taken over the whole index. Trial vectors come
    from the history, so each finds itself too; its nearest row is left out.
    """
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(trials)
    most = k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        score, part = np.full((len(t), 0), 0.0), np.zeros((len(t), 0), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, SCORES // len(t)):
                some = batch.slice(at, SCORES // len(t))
                s = np.hstack([score, t @ _unit(_matrix(some.column(0))).T])
                p = np.hstack([part, np.tile(some.column(1).to_numpy(), (len(t), 1))])
                best = np.argsort(-s, axis=1, kind="stable")[:, :most]
                score, part = np.take_along_axis(s, best, 1), np.take_along_axis(p, best, 1)
        if score.size:
            trial = np.repeat(np.arange(len(t)), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(trial), pa.array(score.reshape(-1)), pa.array(part.reshape(-1))], ["trial", "score", "part"])

    found = index.select(emb, "part").mapInArrow(run, "trial long, score double, part int")
    order = Window.partitionBy("trial").orderBy(F.desc("score"), "part")
    rows = found.withColumn("n", F.row_number().over(order)).where((F.col("n") > 1) & (F.col("n") <= most)).collect()
    place = np.argsort(np.argsort(-model.logits(trials), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort([place[r["trial"], r["part"]] + 1 for r in rows])
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else model.partitions


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the ids of both sides are; -1 for null."""
    both = pa.concat_arrays([a, b]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return both[: len(a)], both[len(a) :]


def nearest_in_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(query, _v, id, score): the ``k`` best rows of a block for each of its queries.

    Of equal vectors only those with the k + 1 smallest ids can be among them.
    Scores come from sums in a fixed order, so equal vectors score alike.
    """
    ids = rows.column("id").combine_chunks()
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    m = _matrix(rows.column("v"))
    same = np.unique(m.view(np.dtype((np.void, m.shape[1] * 8))).reshape(-1), return_inverse=True)[1].reshape(-1)
    own, code = _codes(queries.column("query").combine_chunks(), ids)
    order = np.lexsort((rank, same))
    # a repeated row counts once; its ids follow one another
    fresh = np.ones(len(order), bool)
    fresh[1:] = (same[order][1:] != same[order][:-1]) | (code[order][1:] != code[order][:-1]) | (code[order][1:] < 0)
    order = order[fresh]
    group = same[order]
    nth = np.arange(len(order)) - np.searchsorted(group, group)
    order, group = order[nth <= k], group[nth <= k]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(group)))
    distinct = m[order[first]]
    length = _lengths(distinct)
    unit = distinct / length[:, None]
    q = _matrix(queries.column("v"))
    q_length = _lengths(q)
    out = []
    step = max(1, SCORES // len(distinct))
    reach = min(k + 1, len(distinct))
    for at in range(0, len(q), step):
        s = (q[at : at + step] / q_length[at : at + step, None]) @ unit.T
        floor = np.partition(s, -reach, axis=1)[:, -reach]
        a, c = np.nonzero(s >= floor[:, None] - SLACK)
        a += at
        exact = np.concatenate(
            [(q[a[i : i + 65_536]] * distinct[c[i : i + 65_536]]).sum(axis=1) for i in range(0, len(a), 65_536)] or [np.zeros(0)]
        )
        exact = np.clip(exact / (q_length[a] * length[c]), -1.0, 1.0)
        a, exact, row = np.repeat(a, size[c]), np.repeat(exact, size[c]), order[_ranges(first[c], size[c])]
        other = (code[row] != own[a]) | (own[a] < 0)
        a, exact, row = a[other], exact[other], row[other]
        best = np.lexsort((rank[row], -exact, a))
        a, exact, row = a[best], exact[best], row[best]
        top = np.arange(len(a)) - np.searchsorted(a, a) < k
        out.append((a[top], exact[top], row[top]))
    a, exact, row = (np.concatenate(x) for x in zip(*out))
    return pa.table(
        {
            "query": queries.column("query").combine_chunks().take(pa.array(a)),
            "_v": queries.column("_v").combine_chunks().take(pa.array(a)),
            "id": ids.take(pa.array(row)),
            "score": pa.array(exact),
        }
    )


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] ..., in one array."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def learned_neighbours(
    queries: DataFrame, history: DataFrame, query_id: str = "query_id", history_id: str = "incident_id", emb: str = "embedding",
    k: int = MATCHES, recall: float = RECALL, fit_rows: int = FIT_ROWS, partitions: int | None = None,
) -> DataFrame:
    """(query_id, rank, history_id, score, probes): the ``k`` nearest past incidents found for each query, by cosine.

    A row of the history with the query's id is the query itself and left out.
    Vectors that are null, zero, or hold a null or a component that is not
    finite take no part, nor do those of another length than the most frequent
    one (of equally frequent ones the longest), which have no cosine with the
    others. A repeated row (equal id and vector) counts once; queries with one
    id and several vectors get several answers. Null ids of the history come
    last among ties. A query gets all rows if there are at most ``k``, as
    enough partitions for that are always probed; an empty history gives an
    empty result. Extra columns are ignored.

    ``fit_rows`` bounds the sample that the graph and the classifier are made
    from; every row is indexed. A partition of any size is cut into blocks by
    the hash of its ids, and so are its queries, so a hot one never meets in
    one task. ``probes`` tells how many partitions the queries looked into.
    """
    spark = history.sparkSession
    name = query_id if query_id != history_id else "query_id"
    out_schema = f"query {queries.schema[query_id].dataType.simpleString()}, _v long, id {history.schema[history_id].dataType.simpleString()}, score double"
    fine = history.where(usable(emb)).select(F.col(history_id).alias("id"), F.col(emb).alias("v"))
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension, rows = sizes if sizes else (1, 0)
    vectors = fine.where(F.size("v") == dimension)
    asked = queries.where(usable(emb, dimension)).select(
        F.col(query_id).alias("query"), F.col(emb).alias("v"), F.xxhash64(emb).alias("_v")
    ).dropDuplicates(["query", "_v"])
    if not rows:
        return spark.createDataFrame([], out_schema).select(
            F.col("query").alias(name), F.lit(0).cast("int").alias("rank"), F.col("id").alias(history_id), "score", F.lit(0).alias("probes")
        )
    model, sample = fit_partitions(vectors, rows, "v", fit_rows, partitions)
    index = stored(with_partition(vectors, model, "v"))
    trials = sample[np.random.default_rng(SEED).permutation(len(sample))[:TRIALS]]
    probes = 1 if model is None else needed_probes(index, model, trials, "v", k, recall)
    held = dict(index.groupBy("part").count().collect())
    count = np.array([held.get(p, 0) for p in range(model.partitions if model else 1)])
    sent = stored(_routed(asked, model, probes, count, k))
    wanted = dict(sent.groupBy("part").count().collect())
    block = max(1, BLOCK_BYTES // (8 * dimension))
    cuts = [(p, int(-(-c // block)), int(-(-wanted[p] // block))) for p, c in enumerate(count.tolist()) if c and p in wanted]
    if not cuts:
        cuts = [(-1, 1, 1)]
    # of each partition: blocks of rows and blocks of queries; a literal of at most MOST_PARTITIONS entries
    blocks = F.create_map(*[F.lit(x) for p, h, q in cuts for x in (p, h)])
    query_blocks = F.create_map(*[F.lit(x) for p, h, q in cuts for x in (p, q)])
    there = F.col("part").isin([p for p, _, _ in cuts])

    def dealt(df: DataFrame, mine, other, by: str, names: tuple[str, str]) -> DataFrame:
        own = F.pmod(F.xxhash64(by), mine[F.col("part")]).cast("int")
        copies = F.explode(F.sequence(F.lit(0), other[F.col("part")] - 1))
        return df.where(there).withColumn(names[0], own).withColumn(names[1], copies)

    left = dealt(sent, query_blocks, blocks, "_v", ("qb", "hb"))
    right = dealt(index, blocks, query_blocks, "id", ("hb", "qb"))
    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return nearest_in_block(a, b, k)
        none = a.select(["query", "_v"]).slice(0, 0)
        return none.append_column("id", b.column("id").slice(0, 0)).append_column("score", pa.array([], pa.float64()))

    keys = ["part", "hb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, out_schema)
    order = Window.partitionBy("query", "_v").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias(name), "rank", F.col("id").alias(history_id), "score", F.lit(probes).alias("probes")
    )


def _routed(asked: DataFrame, model: PartitionModel | None, probes: int, count: np.ndarray, k: int) -> DataFrame:
    """One row of each query for each partition it probes: the most probable ones, and more until k + 1 rows are reached."""
    if model is None:
        return asked.withColumn("part", F.lit(0))
    shared = asked.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PartitionModel(*shared.value)
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-m.logits(_unit(_matrix(batch.column("v")))), axis=1, kind="stable")
                reached = np.cumsum(count[order], axis=1)
                short = np.hstack([np.zeros((len(order), 1), np.int64), reached[:, :-1]]) <= k
                row, place = np.nonzero((np.arange(m.partitions) < probes)[None, :] | short)
                some = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(order[row, place], pa.int32())], [*batch.schema.names, "part"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(run, f"{kind}, part int")

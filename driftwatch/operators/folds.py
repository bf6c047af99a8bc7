"""Sequential rules per key: re-fire suppression, rate limit, circuit state.

These rules depend on their own earlier decisions, so no window function
expresses them. A fold takes the state of a key and a run of its events in time
order and returns the new state with one decision per event. The same folds
serve the streaming operators. A fold with a ``memory`` (microseconds) decides
like one that starts fresh when so much time has passed since the last event.

In batch, a key may own a third of all rows, so a fold never runs over a whole
key in one task. The rows are range-partitioned by (key, time) into even chunks
and every chunk is folded at the same time, as if its first key started fresh.
Each chunk reports one small row: its first and last key and the state it ends
with. Chunks that began inside a key are folded again from the state the chunk
before them ended with, until no entry state changes. The result is exact; the
rules forget quickly, so two or three rounds are the rule, and the worst case
takes as long as one task folding the key alone. Decisions are made in a last
pass over the stored chunks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.session import estimated_bytes, keys_of, materialize

State = list[int]
Fold = Callable[[State, np.ndarray, np.ndarray], tuple[State, np.ndarray]]

# Intervals and limits of the rules.
REFIRE_SECONDS = 3600
THROTTLE_SECONDS = 300
RATE_LIMIT, RATE_SECONDS = 60, 60
CIRCUIT_FAILURES, CIRCUIT_SECONDS = 3, 60
# Small inputs make few chunks: one per this many estimated bytes.
CHUNK_BYTES = 1024 * 1024


def refire_fold(seconds: int = REFIRE_SECONDS) -> Fold:
    """Keep an event if none was kept in the last ``seconds``.

    State: the time of the last kept event. The fold jumps from kept event to
    kept event by binary search.
    """
    gap = seconds * 1_000_000

    def fold(state: State, ts: np.ndarray, flag: np.ndarray):
        kept = np.zeros(len(ts), dtype=np.int32)
        i = int(np.searchsorted(ts, state[0] + gap, "left")) if state else 0
        while i < len(ts):
            kept[i] = 1
            state = [int(ts[i])]
            i = int(np.searchsorted(ts, state[0] + gap, "left"))
        return state, kept

    fold.memory = gap
    return fold


def rate_limit_fold(limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> Fold:
    """Admit an event if fewer than ``limit`` were admitted in the window.

    State: the admitted times still inside the window, ``limit`` at most.
    """
    window = seconds * 1_000_000

    def fold(state: State, ts: np.ndarray, flag: np.ndarray):
        log = deque(state)
        admitted = np.zeros(len(ts), dtype=np.int32)
        for i, now in enumerate(ts.tolist()):
            while log and now - log[0] > window:
                log.popleft()
            if len(log) < limit:
                log.append(now)
                admitted[i] = 1
        if len(ts):
            while log and int(ts[-1]) - log[0] > window:
                log.popleft()
        return list(log), admitted

    fold.memory = window
    return fold


def circuit_fold(failures: int = CIRCUIT_FAILURES, seconds: int = CIRCUIT_SECONDS) -> Fold:
    """Skip events while the circuit is open; ``flag`` marks failing events.

    State: consecutive failures and the time the circuit opened. The decision
    is 1 for an event that ran and 0 for one that was skipped.
    """
    rest = seconds * 1_000_000

    def fold(state: State, ts: np.ndarray, flag: np.ndarray):
        count, opened = state if state else (0, 0)
        ran = np.zeros(len(ts), dtype=np.int32)
        for i, (now, failed) in enumerate(zip(ts.tolist(), flag.tolist())):
            if count >= failures:
                if now - opened <= rest:
                    continue
                count = 0
            ran[i] = 1
            count = count + 1 if failed else 0
            if count >= failures:
                opened = now
        return ([count, opened] if count else []), ran

    return fold


def fold_events(
    df: DataFrame, key, ts: str, tie: str, fold: Fold, decision: str, flag: str | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Rows (key, ts, tie, decision) of the fold over each key in time order.

    ``tie`` must be unique within equal times of a key.
    """
    keys = keys_of(key)
    spark = df.sparkSession
    order = [*keys, "_t", tie]
    mark = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    rows = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), tie, mark.alias("_f"))
    if chunks is None:
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        chunks = min(most, 1 + estimated_bytes(rows) // CHUNK_BYTES)
    laid = materialize(
        rows.filter(F.col("_t").isNotNull())
        .repartitionByRange(chunks, *order)
        .sortWithinPartitions(*order)
        .withColumn("_chunk", F.spark_partition_id())
    )
    entry = _settle(laid, keys, fold)
    types = dict(laid.dtypes)
    names = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "_t", tie])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run, decisions, _, _ in _runs(batches, keys, fold, entry):
            yield run[[*keys, "_t", tie]].assign(**{decision: decisions})

    decided = laid.mapInPandas(decide, f"{names}, `{decision}` int")
    return decided.select(*keys, F.timestamp_micros("_t").alias(ts), tie, decision)


def _runs(batches, keys, fold, entry):
    """Folds the runs of equal keys in a chunk; yields (rows, decisions, key, state)."""
    current, state = None, []
    for pdf in batches:
        if pdf.empty:
            continue
        new = np.zeros(len(pdf), dtype=bool)
        new[0] = True
        for k in keys:
            column = pdf[k].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.append(starts[1:], len(pdf))):
            run = pdf.iloc[a:b]
            name = tuple(str(run[k].iat[0]) for k in keys)
            if current is None:
                state = list(entry.get(int(run["_chunk"].iat[0]), []))
            elif name != current:
                state = []
            current = name
            state, decisions = fold(state, run["_t"].to_numpy(), run["_f"].to_numpy())
            yield run, decisions, name, state


def _settle(laid: DataFrame, keys: list[str], fold: Fold) -> dict[int, State]:
    """Entry state per chunk, by folding chunks until no entry changes."""
    entry: dict[int, State] = {}
    reports: dict[int, tuple] = {}
    dirty: list[int] | None = None
    while dirty is None or dirty:
        todo = laid if dirty is None else laid.filter(F.col("_chunk").isin(dirty))
        for row in _fold_chunks(todo, keys, fold, entry):
            reports[row["chunk"]] = (row["first"], row["last"], list(row["state"]))
        dirty, before = [], None
        for chunk in sorted(reports):
            first, last, _ = reports[chunk]
            wanted = before[2] if before is not None and before[1] == first else []
            if wanted != entry.get(chunk, []):
                entry[chunk] = wanted
                dirty.append(chunk)
            before = reports[chunk]
    return entry


def _fold_chunks(todo: DataFrame, keys: list[str], fold: Fold, entry: dict[int, State]):
    """One report per non-empty chunk; their number is the chunk count."""

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, first, last, state = None, None, None, []
        for run, _, name, state in _runs(batches, keys, fold, entry):
            if chunk is None:
                chunk, first = int(run["_chunk"].iat[0]), name
            last = name
        if chunk is not None:
            yield pd.DataFrame({"chunk": [chunk], "first": [list(first)], "last": [list(last)], "state": [state]})

    return todo.mapInPandas(report, "chunk int, first array<string>, last array<string>, state array<bigint>").collect()


# --- the rules as batch operators ------------------------------------------------


def suppress_refires(df: DataFrame, key, ts: str, tie: str, seconds: int = REFIRE_SECONDS) -> DataFrame:
    """Events kept by the re-fire rule."""
    return fold_events(df, key, ts, tie, refire_fold(seconds), "kept").filter("kept = 1").drop("kept")


def throttle_checks(df: DataFrame, key, ts: str, tie: str, seconds: int = THROTTLE_SECONDS) -> DataFrame:
    """Adds ``checked``: 1 where a check runs, 0 where it is too soon."""
    return fold_events(df, key, ts, tie, refire_fold(seconds), "checked")


def rate_limit(df: DataFrame, key, ts: str, tie: str, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """Adds ``admitted`` by the sliding log of admitted events."""
    return fold_events(df, key, ts, tie, rate_limit_fold(limit, seconds), "admitted")


def circuit_state(
    df: DataFrame, key, ts: str, tie: str, failed: str, failures: int = CIRCUIT_FAILURES, seconds: int = CIRCUIT_SECONDS
) -> DataFrame:
    """Adds ``ran``: 0 for events skipped because the circuit was open."""
    return fold_events(df, key, ts, tie, circuit_fold(failures, seconds), "ran", failed)

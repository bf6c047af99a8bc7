"""Sequential rules over streams in event time.

The events of a key wait in the state of its bucket until the watermark has passed them. Then
no earlier event can come, so they are put in order, folded once, and given
out; what is decided never changes. A timer at the oldest waiting event wakes
the key. The state of a rule is dropped when the watermark is so far past the
last event that the rule has forgotten it, so keys that fall silent cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftwatch.operators.folds import Fold
from driftwatch.session import keys_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Keys of a stream are held in at most so many parts of the state.
BUCKETS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_state(spark: SparkSession):
    """Start queries with timers inside: they need the RocksDB state store, chosen when a query starts."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()


class _InOrder(StatefulProcessor):
    """Holds the events of a bucket of keys back until the watermark and folds those of each key in order of time.

    Events lie in the state as chunks of a table, and the rules of the keys as one table, so that the
    calls of the state grow with the chunks and not with events or keys.
    """

    def __init__(self, fold: Fold, keys: list[str]):
        self.fold, self.keys = fold, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("waiting", "low bigint, rows binary")
        self.rules = handle.getValueState("rules", "rows binary")
        self.wake = handle.getValueState("wake", "at bigint")

    def _wake_at(self, at: int | None) -> None:
        """The one timer of the bucket; only an earlier one replaces it."""
        if at is None:
            return
        known = self.wake.get()[0] if self.wake.exists() else None
        if known is not None and known <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.wake.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            low = int(pdf["micros"].min())
            self.buffer.appendValue((low, _packed(pdf[[*self.keys, "micros", "tie", "flag"]])))
            first = low if first is None else min(first, low)
        self._wake_at(None if first is None else -(-first // 1000))
        return iter(())

    def _split(self, now: int) -> tuple[pd.DataFrame | None, list[tuple[int, bytes]], set]:
        """The rows that the watermark has passed, the chunks of the others, and the keys of these."""
        ready, kept, keys = [], [], set()
        for low, blob in self.buffer.get():
            rows = _unpacked(bytes(blob))
            due = rows["micros"].to_numpy() <= now
            if due.any():
                ready.append(rows[due])
                rows = rows[~due]
                blob, low = (_packed(rows), int(rows["micros"].min())) if len(rows) else (None, None)
            if blob is not None:
                kept.append((low, bytes(blob)))
                keys.update(rows[self.keys].drop_duplicates().itertuples(index=False, name=None))
        return pd.concat(ready, ignore_index=True) if ready else None, kept, keys

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.wake.clear()
        ready, later, waiting = self._split(now)
        if ready is not None:
            self.buffer.clear()
            for chunk in later:
                self.buffer.appendValue(chunk)
        rules = {}
        if self.rules.exists():
            held = _unpacked(bytes(self.rules.get()[0]))
            names = held[self.keys].itertuples(index=False, name=None)
            rules = {k: ([int(x) for x in s], int(last)) for k, s, last in zip(names, held["s"], held["last"])}
        if ready is not None:
            ready["group"] = ready.groupby(self.keys, sort=False, dropna=False).ngroup()
            ready = ready.sort_values(["group", "micros", "tie"], kind="stable", ignore_index=True)
            times, flags = ready["micros"].to_numpy(np.int64), ready["flag"].to_numpy(bool)
            ends = [*(np.flatnonzero(np.diff(ready["group"].to_numpy())) + 1).tolist(), len(ready)]
            names = ready[self.keys].iloc[[0, *ends[:-1]]].itertuples(index=False, name=None)
            decisions = np.zeros(len(ready), np.int32)
            start = 0
            for name, end in zip(names, ends):
                state, decisions[start:end] = self.fold(rules.get(name, ([], 0))[0], times[start:end], flags[start:end])
                rules[name] = ([int(x) for x in state], int(times[end - 1]))
                start = end
            yield ready[[*self.keys, "micros", "tie"]].assign(decision=decisions)
        memory = getattr(self.fold, "memory", None)
        forgotten = lambda k, last: memory is not None and last + memory < now and k not in waiting
        rules = {k: (s, last) for k, (s, last) in rules.items() if s and not forgotten(k, last)}
        if rules:
            columns = dict(zip(self.keys, map(list, zip(*rules))))
            table = pd.DataFrame({**columns, "s": [s for s, _ in rules.values()], "last": [last for _, last in rules.values()]})
            self.rules.update((_packed(table),))
        else:
            self.rules.clear()
        times = [-(-low // 1000) for low, _ in later]
        if memory is not None:
            # wake once more, to forget
            times += [(last + memory) // 1000 + 1 for k, (_, last) in rules.items() if k not in waiting]
        self._wake_at(min(times, default=None))

    def close(self) -> None:
        pass


def fold_stream(
    df: DataFrame, key, ts: str, tie: str, fold: Fold, decision: str, flag: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Rows (key, ts, tie, decision): a sequential rule as a stream, the same as the batch fold of all events.

    ``df`` must have a watermark on ``ts``. Events may come in any order within
    its delay; later ones, and those without a time, should be routed to the
    dead letters before (:mod:`driftwatch.streaming.routing`), since the state
    drops them. An event is decided when the watermark passes it. Start the
    query inside :func:`timer_state`. Keys are dealt to ``buckets`` by hash, and
    a bucket has its waiting events and rules in the state store; those of one
    bucket are in memory at once, in columns. The events of one key are decided
    by one task, as each depends on the one before. Keys must be of types that
    a cast to a string and back leaves as they are.
    """
    keys = keys_of(key)
    mark = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    # plain names, and texts: a null would turn a number of Python into a float
    inner = [f"key{i}" for i in range(len(keys))]
    rows = df.select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"),
        *[F.col(k).cast("string").alias(i) for k, i in zip(keys, inner)], F.col(ts).alias("at"), F.unix_micros(F.col(ts)).alias("micros"),
        F.col(tie).alias("tie"), mark.alias("flag"),
    )
    types, own = dict(rows.dtypes), dict(df.dtypes)
    out = ", ".join(f"{c} {types[c]}" for c in [*inner, "micros", "tie"])
    decided = rows.groupBy("bucket").transformWithStateInPandas(_InOrder(fold, inner), f"{out}, decision int", "append", "eventTime")
    return decided.select(
        *[F.col(i).cast(own[k]).alias(k) for k, i in zip(keys, inner)],
        F.timestamp_micros("micros").alias(ts), F.col("tie").alias(tie), F.col("decision").alias(decision),
    )

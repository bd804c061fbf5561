"""Rows of a stream in event-time order, whatever order they arrive in.

in_order() keeps a key's rows in state until the watermark has passed them; then a timer hands them, sorted, to a
step function with the key's state.  So a result does not depend on how rows fall into micro-batches, and equals that of the
batch form over all rows that the watermark has passed.  A key that is silent for longer than `idle` is closed and its state
removed, by a timer, or before its next row where that is already waiting.

Each call on Spark's state is a message to the JVM.  With `buckets`, the keys of a hash bucket share their state and timer, and rows
lie in state by the batch they came in, so that messages grow with buckets and micro-batches instead of keys and rows.

Needs the RocksDB state store (use_rocksdb(), or the cluster's setting).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cuebase.functions.scalar import micros

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> str | None:
    """Set the state store that timers need; returns the setting before."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    return before


class InOrder(StatefulProcessor):
    """Buffers rows (key, at, then the given columns) and hands those that the watermark has passed to step, in order."""

    def __init__(self, columns: list[str], output: list[str], step: Callable, close: Callable, idle: int):
        self.columns, self.output, self.step, self.end, self.idle = ["of", "at", *columns], output, step, close, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.state = handle.getValueState("state", "held binary")  # {key: (its state, time of its last row)}
        self.timer = handle.getValueState("timer", "due long")

    def _wake(self, at: int | None) -> None:
        """One timer for each key: for the earliest thing that is due."""
        due = None if at is None else -(-at // 1000)
        now = self.timer.get()[0] if self.timer.exists() else None
        if now == due:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.timer.clear()
        if due is not None:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            new = list(zip(*[pdf[c].tolist() for c in self.columns], strict=True))
            if new:
                self.waiting.appendValue((pickle.dumps(new),))
                least = min(r[1] for r in new)
                first = least if first is None else min(first, least)
        if first is not None and (not self.timer.exists() or -(-first // 1000) < self.timer.get()[0]):
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], []
        for (part,) in self.waiting.get() if self.waiting.exists() else []:
            for r in pickle.loads(part):
                (ready if r[1] <= passed else rest).append(r)
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        out: list[tuple] = []
        for of, own in groupby(sorted(ready), lambda r: r[0]):
            state, last = held.get(of, (None, None))
            for _, at, *row in own:
                if last is not None and at - last > self.idle:
                    out += self.end((of,), state)
                    state = None
                state, found = self.step((of,), state, at, *row)
                out += found
                last = at
            held[of] = state, last
        for of in [k for k, (_, last) in held.items() if passed >= last + self.idle]:
            out += self.end((of,), held.pop(of)[0])
        if held:
            self.state.update((pickle.dumps(held),))
        else:
            self.state.clear()
        if rest:
            self.waiting.put([(pickle.dumps(rest),)])
        else:
            self.waiting.clear()
        self.timer.clear()
        self._wake(min([*(r[1] for r in rest), *(last + self.idle for _, last in held.values())], default=None))
        if out:
            yield pd.DataFrame(out, columns=self.output, dtype=object)

    def close(self) -> None:
        pass


def nothing(key, state) -> list:
    return []


def in_order(rows: DataFrame, key: str, columns: str, output: str, step: Callable, delay: float, idle: float, close: Callable = nothing, buckets: int | None = None) -> DataFrame:
    """Stream rows (key, ts, columns...) to output rows.

    step((key,), state or None, at in microseconds, *columns) gives (state, output rows) and is called in the order of (ts, columns);
    close((key,), state) gives the rows of a key that was silent for `idle` seconds.  delay: seconds that a row may be late.
    buckets: keys are kept together in so many groups by hash (each key by itself, if not given); it must not change between runs of a query.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    timed = rows.where(F.col("ts").isNotNull() & F.col(key).isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{int(delay * 1000)} milliseconds")
    group = F.col(key) if buckets is None else F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    own = timed.select(group, "ts", F.col(key).alias("of"), micros(F.col("ts")).alias("at"), *names)
    processor = InOrder(names, [c.split()[0] for c in output.split(", ")], step, close, int(idle * 1e6))
    return own.groupBy(own.columns[0]).transformWithStateInPandas(processor, output, "append", "eventTime")

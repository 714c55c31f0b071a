"""Keyed streams in order: rows that come late wait in a buffer until the watermark has passed them, and a key's state ends some time after its last row."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Whether an executor's stores share one memory of a fixed size, which each of them has otherwise.
BOUNDED = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"


@dataclass(frozen=True)
class Late:
    """How rows may come: the column of their event time, how much later than the latest one a row may come, and for how long a key without new rows is remembered.
    Event times must not fall along the rows' order."""

    event_time: str
    late: str = "10 minutes"
    keep_ms: int = 3_600_000


#: Groups of keys that a stream's state is kept in.
BUCKETS = 4096


def columns_of(frame: pd.DataFrame, names: list[str]) -> dict[str, list]:
    """Columns as lists of plain values, None for null."""
    return {c: frame[c].astype(object).where(frame[c].notna(), None).tolist() if frame[c].hasnans else frame[c].tolist() for c in names}


def frame_of(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows of a rule as Spark takes them; whole numbers may be null."""
    fields = [f.split() for f in schema.split(", ")]
    out = pd.DataFrame(rows, columns=[f[0] for f in fields], dtype=object)
    kinds = {"long": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean"}
    return out.astype({f[0]: kinds[f[1]] for f in fields if f[1] in kinds})


def _rocks(rows: DataFrame) -> None:
    """States on disk and in a memory of a fixed size: the store that is Spark's default has all states of the last versions, and for a minute those of queries that have ended, in the
    executors' heap. For queries that are started from now on; what the session names stays."""
    conf = rows.sparkSession.conf
    if "RocksDB" not in (conf.get(STORE, "") or ""):
        conf.set(STORE, ROCKS)
    if conf.get(BOUNDED, None) is None:
        conf.set(BOUNDED, "true")


class _Reordered(StatefulProcessor):
    def __init__(self, rule: Callable, names: list[str], waiting: str, state: str, order: str, keep_ms: int, out: str) -> None:
        self.rule, self.names, self.schema, self.state, self.order, self.keep_ms, self.out = rule, names, waiting, state, order, keep_ms, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.held = handle.getValueState("held", self.state)
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        values = new[self.names].astype(object).where(new[self.names].notna(), None)
        self.waiting.appendList([tuple(r) for r in values.itertuples(index=False)])
        latest = int(new["event_ms"].max())
        if self.last.exists():
            latest = max(latest, self.last.get()[0])
        self.last.update((latest,))
        # rows of this batch are due when the watermark has passed them; the state some time later
        for at in {*map(int, new["event_ms"].unique()), latest + self.keep_ms}:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        at = self.names.index("event_ms")
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due, left = [tuple(r) for r in rows if r[at] <= passed], [tuple(r) for r in rows if r[at] > passed]
        if due:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            due.sort(key=lambda r: r[self.names.index(self.order)])
            rows = {c: list(v) for c, v in zip(self.names, zip(*due))}
            made, new = self.rule(tuple(key), rows, tuple(self.held.get()) if self.held.exists() else None)
            self.held.update(new)
            yield frame_of(made, self.out)
        if not left and self.last.exists() and passed >= self.last.get()[0] + self.keep_ms:
            self.held.clear()
            self.last.clear()

    def close(self) -> None:
        pass


def _by_bucket(rows: DataFrame, keys: list[str], order: str, rule: Callable, out: str, mode: str) -> DataFrame:
    names = rows.columns

    def follow(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches), ignore_index=True).sort_values([*keys, order], ignore_index=True)
        held = pickle.loads(zlib.decompress(state.get[0])) if state.exists else {}
        k = new[keys]
        cuts = [0, *(np.flatnonzero((k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).any(axis=1).to_numpy()[1:]) + 1).tolist(), len(new)]
        columns, made = columns_of(new, names), []
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(columns[c][lo] for c in keys)
            some, held[key] = rule(key, {c: v[lo:hi] for c, v in columns.items()}, held.get(key))
            made += some
            if held[key] is None:
                del held[key]
        state.update((zlib.compress(pickle.dumps(held, 5), 1),))
        yield frame_of(made, out)

    _rocks(rows)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    return rows.select("*", bucket).groupBy("_bucket").applyInPandasWithState(follow, out, "held binary", mode, GroupStateTimeout.NoTimeout)


def keyed(rows: DataFrame, keys: list[str], order: str, rule: Callable, out: str, state: str, mode: str = "append", late: Late | None = None) -> DataFrame:
    """A rule(key, rows, state) over the rows of each key: columns as lists in order, and the key's state or None; it returns rows and the new state. Without `late` rows must not
    come in an earlier batch than their predecessors, and state is kept for good. Keys are dealt to BUCKETS groups, whose states are kept together and compressed, so that a batch costs a call
    a bucket and not one a key.

    With it rows wait until the watermark has passed their event time and are handed to the rule in order; what comes later than that Spark drops. State is cleared once the
    watermark is keep_ms past a key's last row. Rows are out in append mode. Both need the RocksDB state store, which is set if none is."""
    if late is None:
        return _by_bucket(rows, keys, order, rule, out, mode)
    _rocks(rows)
    timed = rows.withWatermark(late.event_time, late.late).withColumn("event_ms", F.unix_millis(F.col(late.event_time).cast("timestamp")))
    names = [c for c in timed.columns if c != late.event_time]
    waiting = ", ".join(f"`{c}` {timed.schema[c].dataType.simpleString()}" for c in names)
    return timed.groupBy(*keys).transformWithStateInPandas(_Reordered(rule, names, waiting, state, order, late.keep_ms, out), out, "Append", "eventTime")

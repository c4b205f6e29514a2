"""Stateful operators that work through the rows of a key in event-time order.

Rows wait in state until the watermark has passed them. Arrivals are sorted by time and cut into parts of bounded
size, one entry of a map for each; an index tells when each part begins. A timer reads the index and the parts that
are due, and no others: a backlog is read once on its way out, however often the timer rings while it waits. What is
not due yet of a part goes back in halves, so that a row is written again a logarithm of times at most. Due parts are
merged by time and handed on piece by piece: memory follows the parts that overlap, not what is due.

Keys of applications (a vehicle, say) are many and small, and every access to state is a round trip. They share
``SHARDS`` state keys: ``PerKey`` holds the rows of a shard together and gives each key its own memory.

What comes out depends on event times only, not on the order of arrival.
"""

from __future__ import annotations

import json
import pickle
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOT_MS = 600_000
SHARDS = 256        # state keys that all keys are dealt to
PART = 4_096        # weight of a part: its rows, and one more for each WEIGHT bytes of binary columns
GATHERED = 32_768   # weight of arrivals that are sorted together
PIECE = 16_384      # weight that is handed on at once
WEIGHT = 256
MEMORIES = 50_000   # keys whose memory is held between two pieces
SHARD, KEY = "held_shard", "held_key"  # names of fields in Python
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Stateful operators need this state store; an explicit setting is left alone."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, ROCKSDB)


def _values(column: pd.Series) -> list:
    if column.dtype.kind in "iu":
        missing, values = np.iinfo(column.dtype).min, column.tolist()
        return [None if v == missing else v for v in values] if column.min() == missing else values
    if column.dtype.kind == "b":
        return column.tolist()
    column = column.astype(object)
    return column.where(column.notna(), None).tolist()


def tuples(batch: pd.DataFrame, columns: Sequence[str]) -> list[tuple]:
    """Rows of a batch with None for missing values (whole numbers: what ``_whole`` puts there)."""
    return list(zip(*(_values(batch[c]) for c in columns))) if len(batch) else []


def _whole(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns for pandas: a missing whole number is the least one, so that the others stay whole numbers."""
    least = {T.LongType: -2 ** 63, T.IntegerType: -2 ** 31}
    kinds = {c: type(df.schema[c].dataType) for c in columns}
    return [F.coalesce(c, F.lit(least[kind]).cast(df.schema[c].dataType)).alias(c) if (kind := kinds[c]) in least else F.col(c) for c in columns]


def table_of(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=schema.names)
    for field in schema.fields:
        if isinstance(field.dataType, (T.LongType, T.IntegerType)):
            out[field.name] = out[field.name].astype("Int64")
        elif isinstance(field.dataType, T.DoubleType):
            out[field.name] = out[field.name].astype(float)
    return out


class Held(StatefulProcessor):
    """``columns`` of the input rows are held, the first one is the event time in milliseconds. Rows come to
    ``release(key, rows)`` sorted by their first ``order`` columns, in one or several calls, the rows of one time in
    one; it returns the rows of ``schema``. What waits is cut in halves down to ``slot_ms``; ``binary`` names columns
    whose bytes count."""

    def __init__(self, columns: Sequence[str], schema: T.StructType, order: int = 2, slot_ms: int = SLOT_MS, binary: Sequence[str] = ()):
        self.columns, self.schema, self.order, self.slot_ms = list(columns), schema, order, slot_ms
        self.binary = [self.columns.index(c) for c in binary]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "part long", "rows binary")
        self.index = handle.getValueState("index", "text string")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Further state of the operator."""

    def release(self, key, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def settle(self) -> None:
        """What ``release`` has kept in memory goes to state."""

    def arrange(self, rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda row: row[:self.order])

    def _weight(self, rows: list[tuple]) -> int:
        return len(rows) + sum(len(row[c]) for c in self.binary for row in rows if row[c] is not None) // WEIGHT

    def _index(self) -> dict:
        """``parts``: first event time and number of each part; ``next``: the number of the next one."""
        stored = self.index.get()
        return json.loads(stored[0]) if stored else {"next": 0, "parts": []}

    def _save(self, index: dict) -> None:
        if index["parts"]:
            self.index.update((json.dumps(index),))
            self.handle.registerTimer(int(min(first for first, _ in index["parts"])))
        else:
            self.index.clear()

    def _put(self, index: dict, rows: list[tuple]) -> None:
        """A part of ``rows``, which are sorted by time, or several if they weigh more."""
        if len(rows) > 1 and self._weight(rows) > PART:
            half = min(PART, len(rows) // 2) if not self.binary else len(rows) // 2
            self._put(index, rows[:half])
            while not self.binary and len(rows) - half > PART:
                self._put(index, rows[half:half + PART])
                half += PART
            self._put(index, rows[half:])
            return
        self.slots.updateValue((index["next"],), (pickle.dumps(rows),))
        index["parts"].append([int(rows[0][0]), index["next"]])
        index["next"] += 1

    def _put_back(self, index: dict, rows: list[tuple]) -> None:
        """The later half as one part, and so on with the earlier one: the next timer touches few rows."""
        while len(rows) > 1 and rows[-1][0] - rows[0][0] > self.slot_ms:
            self._put(index, rows[len(rows) // 2:])
            rows = rows[:len(rows) // 2]
        self._put(index, rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        index, arrived, weight = self._index(), [], 0
        for batch in rows:
            new = tuples(batch, self.columns)
            arrived += new
            weight += self._weight(new)
            if weight >= GATHERED:
                self._put(index, sorted(arrived, key=lambda row: row[0]))
                arrived, weight = [], 0
        if arrived:
            self._put(index, sorted(arrived, key=lambda row: row[0]))
        self._save(index)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, index = timerValues.getCurrentWatermarkInMs(), self._index()
        due = sorted(part for part in index["parts"] if part[0] <= passed)
        return self._released(key, passed, index, due) if due else iter([])

    def _released(self, key, passed: int, index: dict, due: list) -> Iterator[pd.DataFrame]:
        index["parts"] = [part for part in index["parts"] if part[0] > passed]
        rows, weight, enough = [], 0, PIECE
        for (_, part), after in zip(due, [*due[1:], None]):
            own = pickle.loads(self.slots.getValue((part,))[0])
            self.slots.removeKey((part,))
            if own[-1][0] > passed:
                cut = bisect_right(own, passed, key=lambda row: row[0])
                self._put_back(index, own[cut:])
                own = own[:cut]
            rows += own
            weight += self._weight(own)
            if after is not None and weight < enough:
                continue
            ready = rows if after is None else [row for row in rows if row[0] < after[0]]
            rows = [] if after is None else [row for row in rows if row[0] >= after[0]]
            weight = self._weight(rows)
            enough = max(PIECE, 2 * weight)
            released = self.release(key, self.arrange(ready)) if ready else []
            if released:
                yield table_of(released, self.schema)
        self.settle()
        self._save(index)

    def close(self) -> None:
        pass


class _One:
    """A value, or a list, of the key that a ``Memory`` is at."""

    def __init__(self, memory: Memory, name: str):
        self.memory, self.name = memory, name

    def get(self):
        return self.memory.values.get(self.name, self.memory.nothing[self.name])

    def update(self, value) -> None:
        self.memory.values[self.name] = value

    put = update

    def clear(self) -> None:
        self.memory.values.pop(self.name, None)


class _Many:
    """A map of the key that a ``Memory`` is at, as entries of one map of the shard."""

    def __init__(self, memory: Memory, state):
        self.memory, self.state = memory, state

    def containsKey(self, at) -> bool:
        return self.state.containsKey((self.memory.key, repr(at)))

    def getValue(self, at):
        return pickle.loads(self.state.getValue((self.memory.key, repr(at)))[0])

    def updateValue(self, at, value) -> None:
        self.state.updateValue((self.memory.key, repr(at)), (pickle.dumps(value),))

    def removeKey(self, at) -> None:
        self.state.removeKey((self.memory.key, repr(at)))


class Memory:
    """Stands in for the handle of an operator that sees one key, while its state lies with that of other keys."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.nothing, self.key, self.values = handle, {}, "", {}

    def getValueState(self, name, *_):
        self.nothing[name] = None
        return _One(self, name)

    def getListState(self, name, *_):
        self.nothing[name] = ()
        return _One(self, name)

    def getMapState(self, name, *_):
        return _Many(self, self.handle.getMapState(name, "key string, at string", "value binary"))


class PerKey(Held):
    """``inner`` for every key of a shard: its state is read when the key has rows that are due, and written when all
    that is due is out."""

    def __init__(self, inner: Held):
        super().__init__([*inner.columns, KEY], inner.schema, inner.order, inner.slot_ms, [inner.columns[c] for c in inner.binary])
        self.inner = inner

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.memories = handle.getMapState("memories", "key string", "memory binary")
        self.memory, self.held, self.stored = Memory(handle), {}, None
        self.inner.open(self.memory)

    def arrange(self, rows: list[tuple]) -> list[tuple]:
        return rows  # the order of rows of different keys does not matter

    def release(self, key, rows: list[tuple]) -> list[tuple]:
        if self.stored is None:
            self.stored = self.memories.exists()
        keys: dict[str, list[tuple]] = {}
        for row in rows:
            keys.setdefault(row[-1], []).append(row[:-1])
        out = []
        for name, own in keys.items():
            if name not in self.held:
                known = self.stored and self.memories.containsKey((name,))
                self.held[name] = known, pickle.loads(self.memories.getValue((name,))[0]) if known else {}
            self.memory.key, self.memory.values = name, self.held[name][1]
            out += self.inner.release(tuple(json.loads(name).values()), self.inner.arrange(own))
        if len(self.held) > MEMORIES:
            self._write()
        return out

    def _write(self) -> None:
        for name, (known, values) in self.held.items():
            if values:
                self.memories.updateValue((name,), (pickle.dumps(values),))
            elif known:
                self.memories.removeKey((name,))
        self.held, self.stored = {}, self.stored or bool(self.held)

    def settle(self) -> None:
        self._write()
        self.stored = None  # the next call is for another shard


def shard_of(keys: Sequence[str | Column], shards: int = SHARDS) -> list[Column]:
    """``SHARD`` and ``KEY``, the key as text."""
    text = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return [F.pmod(F.xxhash64(text), F.lit(shards)).cast("int").alias(SHARD), text.alias(KEY)]


def through(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], processor: StatefulProcessor, delay: str | None,
            initial: DataFrame | None = None, event_time: str = "") -> DataFrame:
    """``rows`` through ``processor`` per ``keys``, which are never null; it reads ``columns``. ``delay`` None: the rows come
    from another operator, which has named their event time ``at``."""
    use_rocksdb(rows.sparkSession)
    own = "at"
    if delay is not None:
        own = "event_time"
        if own not in rows.columns:
            rows = rows.withColumn(own, F.timestamp_millis("generate_ms"))
        rows = rows.withWatermark(own, delay)
    rows = rows.select(*keys, own, *_whole(rows, columns))
    state = None if initial is None else initial.groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(
        processor, processor.schema, "append", "EventTime", initialState=state, eventTimeColumnName=event_time)


def in_event_order(rows: DataFrame, keys: Sequence[str], processor: Held, delay: str | None, event_time: str = "") -> DataFrame:
    """``rows`` with ``generate_ms`` through ``processor`` per ``keys``: whole numbers and texts, which may be null.
    ``delay`` None: the rows come from another operator, which has named their event time ``at``. Rows that bring an
    ``event_time`` of null move no watermark and are never too late."""
    processor = PerKey(processor)
    return through(rows.select("*", *shard_of(keys)), [SHARD], processor.columns, processor, delay, event_time=event_time)

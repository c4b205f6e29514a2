"""Contexts on streams: two inputs combined, sections reassembled, applications zipped.

Each is one or two stateful operators whose rows are those of its batch twin in ``operators.context`` and
``plans.pipelines``.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilstream.streaming.held import KEY, SHARD, Held, in_event_order, shard_of, table_of, through, tuples


def _fields(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LONG, TEXT, DOUBLE, TIME = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType()


class TwoInputs(Held):
    """Every row with the latest value of either side; a value older than ``expire_ms`` is forgotten."""

    def __init__(self, kind: T.DataType, expire_ms: int | None):
        super().__init__(["generate_ms", "event_id", "side", "value"], _fields(
            ("vehicle_id", LONG), ("event_id", LONG), ("generate_ms", LONG), ("side", TEXT), ("left_value", kind), ("right_value", kind)))
        self.kind, self.expire_ms = kind, expire_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        value = _fields(("value", self.kind), ("ms", LONG))
        self.sides = {side: handle.getValueState(side, value) for side in ("left", "right")}

    def release(self, key, rows):
        known = {side: state.get() for side, state in self.sides.items()}
        out = []
        for ms, event_id, side, value in rows:
            if value is not None:
                known[side] = value, ms
            fresh = {s: k for s, k in known.items() if k is not None and (self.expire_ms is None or ms - k[1] <= self.expire_ms)}
            if len(fresh) == 2:
                out.append((key[0], event_id, ms, side, fresh["left"][0], fresh["right"][0]))
        last = rows[-1][0]
        for side, state in self.sides.items():
            now = known[side]
            if now is None or self.expire_ms is not None and last - now[1] > self.expire_ms:
                state.clear()
            else:
                state.update(tuple(now))
        return out


def combine_streams(left: DataFrame, right: DataFrame, delay: str = "10 minutes", expire_ms: int | None = None) -> DataFrame:
    """``asof_context`` of two streams with ``vehicle_id, event_id, generate_ms, value``: each row of either side with the
    latest value of the other, which may be at most ``expire_ms`` old."""
    both = left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))
    rows = both.select("vehicle_id", "generate_ms", "event_id", "side", "value")
    return in_event_order(rows, ["vehicle_id"], TwoInputs(both.schema["value"].dataType, expire_ms), delay)


class Numbered(Held):
    """Rows with their number from 1 per key. ``value`` columns pass through; ``at`` is the event time for what follows."""

    def __init__(self, keys: Sequence[T.StructField], values: Sequence[T.StructField]):
        super().__init__(["generate_ms", "event_id", *(v.name for v in values)], T.StructType([
            *keys, *_fields(("generate_ms", LONG), ("event_id", LONG)).fields, *values, T.StructField("n", LONG), T.StructField("at", TIME)]))

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def release(self, key, rows):
        stored = self.count.get()
        n, out = stored[0] if stored else 0, []
        for row in rows:
            n += 1
            out.append((*key, *row, n, pd.Timestamp(row[0], unit="ms")))
        self.count.update((n,))
        return out


class Complete(StatefulProcessor):
    """Collects one value of every application under a key and a number, and hands them on when all are there; they are
    forgotten then. No order is needed, so nothing waits for the watermark. ``CHUNK`` numbers of a key lie in one entry."""

    CHUNK, GATHERED = 64, 100_000

    def __init__(self, apps: Sequence[str], keys: Sequence[T.StructField], kind: T.DataType):
        self.apps = list(apps)
        self.schema = T.StructType([*keys, *(T.StructField(a, kind) for a in self.apps)])
        self.columns = [KEY, "n", "app", "value"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "chunk string", "numbers binary")

    def handleInputRows(self, key, rows, timerValues):
        arrived: dict[str, dict[int, dict]] = {}
        n = 0
        for batch in rows:
            for chunk, number, app, value in tuples(batch, self.columns):
                arrived.setdefault(chunk, {}).setdefault(number, {})[app] = value
            n += len(batch)
            if n >= self.GATHERED:
                yield from self._completed(arrived)
                arrived, n = {}, 0
        yield from self._completed(arrived)

    def _completed(self, arrived):
        stored, out = self.values.exists(), []
        for chunk, numbers in arrived.items():
            known = stored and self.values.containsKey((chunk,))
            if known:
                for number, found in pickle.loads(self.values.getValue((chunk,))[0]).items():
                    numbers[number] = {**found, **numbers.get(number, {})}
            identity = tuple(json.loads(chunk).values())[:-1]
            done = [number for number, found in numbers.items() if len(found) == len(self.apps)]
            for number in done:
                found = numbers.pop(number)
                out.append((*identity, number, *(found[a] for a in self.apps)))
            if numbers:
                self.values.updateValue((chunk,), (pickle.dumps(numbers),))
            elif known:
                self.values.removeKey((chunk,))
        if out:
            yield table_of(out, self.schema)

    def close(self) -> None:
        pass


def zip_app_streams(rows: DataFrame, apps: Sequence[str], value: Column, delay: str = "10 minutes") -> DataFrame:
    """``zip_apps`` of a stream with ``app, vehicle_id, event_id, generate_ms``: the n-th records of all applications side
    by side. Records are numbered per (app, vehicle) and dealt out again by (vehicle, run of numbers), so that a hot vehicle
    is spread where applications wait for each other."""
    if len(apps) < 2:
        raise ValueError("zip_apps needs at least two applications")
    rows = rows.where(F.col("app").isin(*apps)).withColumn("value", value).select("app", "vehicle_id", "generate_ms", "event_id", "value")
    numbered = in_event_order(rows, ["app", "vehicle_id"], Numbered([rows.schema[c] for c in ("app", "vehicle_id")], [rows.schema["value"]]),
                              delay, event_time="at")
    chunk = F.floor(F.col("n") / Complete.CHUNK).alias("chunk")
    done = Complete(apps, [numbered.schema[k] for k in ("vehicle_id", "n")], rows.schema["value"].dataType)
    return through(numbered.select("*", *shard_of(["vehicle_id", chunk])), [SHARD], done.columns, done, None)


class Reassembled(Held):
    """Queues by ordinal: group g has the (g + 1)-th speed and location and the images behind g * ratio. Images wait for
    their samples, samples until all images of their group came; then the group is removed."""

    SAMPLES = ("speed", "location")

    CHUNK = 64  # groups in one entry

    def __init__(self, ratio: int, values: dict[str, T.StructField]):
        out = [values[s] for s in ("speed", "location", "image")]
        columns = ["generate_ms", "event_id", "section", *(v.name for v in out)]
        super().__init__(columns, T.StructType([*_fields(("app", TEXT), ("vehicle_id", LONG), ("generate_ms", LONG), ("event_id", LONG)).fields,
                                                *out, T.StructField("frame_no", LONG)]), order=3, binary=[v.name for v in out if v.dataType == T.BinaryType()])
        self.ratio, self.names = ratio, {s: columns.index(values[s].name) for s in values}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts")
        self.groups = handle.getMapState("groups")

    def release(self, key, rows):
        """``counts``: how many rows of each section came, and up to which entry groups were begun."""
        counts = self.counts.get() or {**dict.fromkeys(self.names, 0), "begun": 0}
        counts, chunks, stored, out = dict(counts), {}, set(), []
        for row in rows:
            ms, event_id, section = row[:3]
            if section not in self.names:
                continue
            place = counts[section]
            counts[section] = place + 1
            number = place if section != "image" else place // self.ratio
            at = number // self.CHUNK
            if at not in chunks:
                if at < counts["begun"] and self.groups.containsKey((at,)):
                    stored.add(at)
                chunks[at] = self.groups.getValue((at,)) if at in stored else {}
            own = chunks[at].setdefault(number, {"images": [], "seen": 0})
            if section == "image":
                own["images"].append((ms, event_id, row[self.names["image"]], place + 1))
                own["seen"] += 1
            else:
                own[section] = row[self.names[section]]
            if all(s in own for s in self.SAMPLES):
                if all(own[s] is not None for s in self.SAMPLES):
                    out += [(*key, at_ms, of, own["speed"], own["location"], image, n) for at_ms, of, image, n in own["images"]]
                own["images"] = []
                if own["seen"] == self.ratio:
                    del chunks[at][number]
        for at, groups in chunks.items():
            if groups:
                self.groups.updateValue((at,), groups)
                counts["begun"] = max(counts["begun"], at + 1)
            elif at in stored:
                self.groups.removeKey((at,))
        self.counts.update(counts)
        return out


def reassemble_stream(published: DataFrame, delay: str | None = "10 minutes", ratio: int = 10) -> DataFrame:
    """``reassemble_policies`` of a stream of published rows: one row per image with the processed speed and location that
    belong to it. ``delay`` None: ``published`` comes out of another operator that keeps its event time."""
    from veilstream.operators.enforce import processed_column
    values = {s: processed_column(s) for s in ("speed", "location", "image")}
    place = published.select(F.to_json(values["location"]).alias(values["location"])).schema[values["location"]]
    rows = published.withColumn(values["location"], F.to_json(values["location"]))
    keep = ["app", "vehicle_id", "generate_ms", "event_id", "section", *values.values()]
    rows = rows.select(*keep, *([] if delay is not None else ["at"]))
    kinds = {s: place if s == "location" else published.schema[c] for s, c in values.items()}
    done = in_event_order(rows, ["app", "vehicle_id"], Reassembled(ratio, kinds), delay)
    return done.withColumn(values["location"], F.from_json(values["location"], published.schema[values["location"]].dataType))


__all__ = ["combine_streams", "reassemble_stream", "zip_app_streams"]

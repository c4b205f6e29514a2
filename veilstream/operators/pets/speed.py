"""Speed anonymiser: noise inside a corridor around the previous *output*.

The recursion on its own output is not a window function. It runs over sorted Arrow batches; a key
that holds too many rows for one task is cut into time slices that run side by side:

1. every slice starts from a guess and reports the value it ends with;
2. a slice whose predecessor ended with a different value than it assumed is run again.

The loop stops when every assumed start equals the predecessor's end, so the result is the one a
single sequential pass gives. Passes only rerun the slices whose start changed, and no pass has more of a
key in one task than a slice. How many passes it takes depends on the data: a corridor forgets its start
when a gap opens it to the full range or when it reaches the reading itself. Where readings come so densely
that slices are shorter than this memory, starts travel one slice per pass; then choose larger slices.

Without noise no loop is needed. A step of the rate limiter is a rising function of the last output, made of
pieces that keep it or shift it, and so are steps one after the other (``Composed``). Every slice reports the
function from its start to its end, one row per slice is folded in order, and all starts are known after one
pass, however long the memory is. A start that a slice has carried along without meeting a reading is the sum
of its shifts; it may differ from the sequential one by the rounding of that sum.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstream.functions.mathx import beta_shape, row_seed
from veilstream.operators.timeline import SlicePlan, join_null_safe
from veilstream.session import cut_lineage, if_small


START = ("_start_value", "_start_ms")


class Draws(random.Random):
    """Random numbers counted on from a seed: choosing a seed costs nothing, unlike that of the standard generator."""

    _at = 0

    def seeded(self, seed: int) -> Draws:
        self._at = seed & 0xFFFFFFFFFFFFFFFF
        return self

    def random(self) -> float:
        self._at = (self._at + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = ((self._at ^ self._at >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        return ((z ^ z >> 31) >> 11) / 9007199254740992.0


DRAWS = Draws()


@dataclass(frozen=True)
class Corridor:
    """Parameters of the speed anonymiser; ``sampler`` is ``beta`` or ``mode`` (no noise)."""

    low: float
    high: float
    gamma: float
    relax_ms: int
    deviation: float
    sampler: str = "beta"
    initial_last: float = -1.0

    #: What each parameter must satisfy, and how to say so.
    RANGES = (("deviation", lambda c: c.deviation >= 0, "at least 0"), ("relax_ms", lambda c: c.relax_ms > 0, "above 0"),
              ("gamma", lambda c: c.gamma > 1, "above 1"), ("high", lambda c: c.high >= c.low, "at least low"),
              ("sampler", lambda c: c.sampler in ("beta", "mode"), "beta or mode"))

    def __post_init__(self):
        wrong = [f"{name} is {getattr(self, name)!r}, must be {what}" for name, holds, what in self.RANGES if not holds(self)]
        if wrong:
            raise ValueError("; ".join(wrong))

    def step(self, state, value: float, ms: int, seed: int):
        """``(state, output)`` after one record; the state is (last output, its time)."""
        last, last_ms = state
        elapsed = 0 if last_ms is None else ms - last_ms
        if elapsed < 0:
            raise ValueError("records must be in time order")
        if last is None or not self.low <= last <= self.high:
            last = min(max(value, self.low), self.high)
        reach = elapsed / self.relax_ms * self.deviation
        lower, upper = max(self.low, last - reach), min(self.high, last + reach)
        out = upper if lower == upper else self._draw(value, lower, upper, seed)
        return (out, ms), out

    def _draw(self, value: float, lower: float, upper: float, seed: int) -> float:
        centre = min(max(value, lower), upper)
        if self.sampler == "mode":
            return centre
        width = upper - lower
        a, b = beta_shape((centre - lower) / width, self.gamma)
        return lower + width * DRAWS.seeded(int(seed)).betavariate(a, b)

    def make(self):
        return (self.initial_last, None), self.step

    @property
    def composable(self) -> bool:
        return self.sampler == "mode"


class Composed:
    """The end of a run of noiseless corridor steps as a function of the output before it.

    Between ``low`` and ``high`` the function is flat or rises with slope 1. It is kept as its lowest end and the
    intervals of starts where it rises. A step moves the lowest end, and the ends within its reach of the reading become
    one: that takes away the intervals in which they lie, found by the rise that lies before them. Intervals are in
    blocks whose rise is known, so that a step costs the root of their number; often only one end is soon left.
    Starts outside the range (after a reading that is no number) all begin anew and share one more end.
    """

    BLOCK = 256

    def __init__(self, corridor: Corridor, ms: int):
        self.corridor, self.ms, self.outside, self.base = corridor, ms, None, corridor.low
        whole = (corridor.low, corridor.high)
        self.blocks, self.rises = ([[whole]], [whole[1] - whole[0]]) if whole[0] < whole[1] else ([], [])

    def step(self, value: float, ms: int) -> None:
        corridor = self.corridor
        if self.blocks:
            reach = (ms - self.ms) / corridor.relax_ms * corridor.deviation
            aim = min(max(value, corridor.low), corridor.high)
            if reach > 0 and aim == aim:
                self._flatten(max(aim - reach - self.base, 0.0), aim + reach - self.base)
            elif reach > 0:
                self.blocks, self.rises = [], []
        self.base, self.outside = (corridor.step((end, self.ms), value, ms, 0)[1] for end in (self.base, self.outside))
        self.ms = ms

    def _flatten(self, low: float, high: float) -> None:
        """Of the whole rise, what lies between ``low`` and ``high`` goes."""
        before, changed = 0.0, []
        for number, rise in enumerate(self.rises):
            if before >= high:
                break
            if before + rise > low:
                changed.append(number)
                self.blocks[number] = self._without(self.blocks[number], low - before, high - before)
            before += rise
        for number in reversed(changed):
            own = self.blocks[number]
            half = len(own) // 2
            parts = [own[:half], own[half:]] if len(own) > self.BLOCK else [own] if own else []
            self.blocks[number:number + 1] = parts
            self.rises[number:number + 1] = [math.fsum(z - x for x, z in part) for part in parts]

    @staticmethod
    def _without(intervals, low: float, high: float) -> list[tuple[float, float]]:
        out, before = [], 0.0
        for x, z in intervals:
            after = before + (z - x)
            if after <= low or before >= high:
                out.append((x, z))
            else:
                if before < low and x < (cut := min(x + (low - before), z)):
                    out.append((x, cut))
                if after > high and (cut := max(x + (high - before), x)) < z:
                    out.append((cut, z))
            before = after
        return out

    @property
    def points(self) -> list[tuple[float, float]]:
        """``(start, end)`` from ``low`` to ``high``."""
        corridor, end = self.corridor, self.base
        points = [(corridor.low, end)]
        for x, z in (interval for block in self.blocks for interval in block):
            if x > points[-1][0]:
                points.append((x, end))
            end += z - x
            points.append((z, end))
        if points[-1][0] < corridor.high or len(points) == 1:
            points.append((corridor.high, end))
        return points

    def found(self) -> list[tuple[float, float]]:
        return [*self.points, (math.nan, self.outside)]


def composed_end(found, start: float) -> float:
    """The end that belongs to ``start``, from what ``Composed`` found."""
    *points, (_, outside) = found
    if not points or not points[0][0] <= start <= points[-1][0]:
        return outside
    for (x, y), (after, upper) in zip(points, points[1:]):
        if start <= after:
            return upper if start == after else min(y + (start - x), upper)
    return points[-1][1]


def noisy_speed(section: str, params: tuple):
    """``min, max, gamma, relax, deviation`` and an optional seed."""
    from veilstream.operators.pets import StepPet
    return StepPet(Corridor(*params[:5]).make, params[5] if len(params) > 5 else 0)


def limited_speed(section: str, params: tuple):
    """The same corridor without noise: a rate limiter."""
    from veilstream.operators.pets import StepPet
    return StepPet(Corridor(*params[:5], sampler="mode").make)


class Dispatch:
    """``make`` for several step functions: the last of the keys is the label that names one."""

    def __init__(self, makes: dict):
        self.makes = makes

    def of(self, identity):
        return self.makes[identity[-1]]()


    def single(self, identity):
        return self.makes[identity[-1]]


def _made(make, identity):
    return make.of(identity) if isinstance(make, Dispatch) else make()


def _corridor(make):
    """The corridor whose steps ``make`` runs, if they can be composed."""
    owner = getattr(make, "__self__", None)
    return owner if isinstance(owner, Corridor) and owner.composable else None


def _composable(make) -> bool:
    return all(map(_corridor, make.makes.values() if isinstance(make, Dispatch) else [make]))


def run_steps(df: DataFrame, make, value: Column, out: str, plan: SlicePlan,
              keys: Sequence[str] = ("vehicle_id",), seed=0,
              order: Sequence[str] = ("generate_ms", "event_id")) -> DataFrame:
    """Run a step function over each key in time order, adding its output as column ``out``.

    Rows are sorted inside their partition and streamed through Python batch by batch: no key has to
    fit into memory, and many small keys share one batch.
    ``seed`` may be a Column of texts.
    """
    keys = list(keys)
    work = df.withColumns({"_value": value,
                           "_draw": row_seed(seed, F.col("vehicle_id"), F.col("generate_ms"))})
    result = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    if not plan.sliced:
        return _in_time_order(work, keys, order).mapInArrow(
            _outputs(make, keys, df.columns, out, order), result)
    rows = cut_lineage(plan.assign(work))
    cold = _in_time_order(rows.where(~F.col("_hot")), keys, order).mapInArrow(
        _outputs(make, keys, df.columns, out, order), result)
    hot = rows.where("_hot")
    sliced = [*keys, "_slice"]
    starts = (_composed_starts if _composable(make) else _settle_starts)(hot, make, keys, order)
    done = _in_time_order(_started(hot, starts, sliced), sliced, order).mapInArrow(
        _outputs(make, sliced, df.columns, out, order), result)
    return cold.unionByName(done)


def _in_time_order(rows: DataFrame, keys, order) -> DataFrame:
    """All rows of a key in one partition, one key after the other."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _started(hot: DataFrame, starts: DataFrame, sliced) -> DataFrame:
    """Hot rows of the slices in ``starts`` with the state to start from: one row for each slice, counted."""
    return join_null_safe(hot, if_small(starts)[0], sliced)


def _settle_starts(hot: DataFrame, make, keys, order) -> DataFrame:
    """Start state of every slice such that it equals the end state of the slice before."""
    sliced = [*keys, "_slice"]
    slices = Window.partitionBy(*keys).orderBy("_slice")
    spans = hot.groupBy(*keys, "_slice").agg(F.max(order[0]).alias("end_ms"))
    starts = cut_lineage(spans.select(
        *keys, "_slice", F.lag("end_ms").over(slices).alias("_start_ms"),
        F.lit(None).cast("double").alias("_start_value")))
    end_type = T.StructType([*[hot.schema[k] for k in keys], T.StructField("_slice", T.LongType()),
                             T.StructField("end_value", T.DoubleType())])
    todo, ends = starts, None
    while True:  # every pass settles at least the first unsettled slice of each key
        rows = _in_time_order(_started(hot, todo, sliced), sliced, order)
        fresh = rows.mapInArrow(_ends(make, sliced, order), end_type)
        if ends is not None:
            fresh = join_null_safe(ends, todo, sliced, "left_anti").unionByName(fresh)
        ends = cut_lineage(fresh)
        wanted = ends.select(*keys, "_slice", F.lag("end_value").over(slices).alias("_wanted"))
        compared = cut_lineage(join_null_safe(starts, wanted, sliced))
        settled = F.col("_start_value").eqNullSafe(F.col("_wanted"))
        starts = compared.select(*sliced, "_start_ms", F.col("_wanted").alias("_start_value"))
        todo = compared.where(~settled).select(*sliced, "_start_ms",
                                               F.col("_wanted").alias("_start_value"))
        if todo.isEmpty():
            return starts


def _composed_starts(hot: DataFrame, make, keys, order) -> DataFrame:
    """Start state of every slice, from one pass over the rows and one over the slices."""
    sliced = [*keys, "_slice"]
    slices = Window.partitionBy(*keys).orderBy("_slice")
    spans = hot.groupBy(*sliced).agg(F.max(order[0]).alias("_end_ms"))
    spans = cut_lineage(spans.select(*sliced, "_end_ms", F.lag("_end_ms").over(slices).alias(START[1]),
                                     F.lit(None).cast("double").alias(START[0])))
    names = [hot.schema[k] for k in keys] + [T.StructField("_slice", T.LongType())]
    points = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))
    maps = _in_time_order(_started(hot, spans.drop("_end_ms"), sliced), sliced, order).mapInArrow(
        _maps(make, sliced, order), T.StructType([*names, T.StructField("_points", points)]))
    joined = join_null_safe(spans.drop(START[0]), cut_lineage(maps), sliced)
    return cut_lineage(_in_time_order(joined, keys, ["_slice"]).mapInArrow(
        _folded(sliced), T.StructType([*names, T.StructField(START[1], T.LongType()), T.StructField(START[0], T.DoubleType())])))


def _maps(make, sliced, order):
    """Sorted Arrow batches -> every slice with the points of its function; the first slice of a key has one end only."""
    sliced, order = list(sliced), list(order)
    kind = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))

    def run(batches):
        at, types, composed, state = None, None, None, None

        def found():
            return [composed.found() if composed else [(math.nan, state[0])]]

        def table(rows):
            columns = zip(*rows) if rows else [[]] * (len(sliced) + 1)
            arrays = [pa.array([[{"start": x, "end": y} for x, y in p] for p in c] if t is kind else list(c), t)
                      for c, t in zip(columns, [*types, kind])]
            return pa.RecordBatch.from_arrays(arrays, names=[*sliced, "_points"])

        for batch in batches:
            types, done = [batch.schema.field(k).type for k in sliced], []
            for identity, start, value, ms, draw in _steps(batch, sliced, order):
                if identity != at:
                    if at is not None:
                        done.append((*at, *found()))
                    at, (state, step), composed = identity, _made(make, identity[:-1]), None
                    if start[1] is not None:
                        single = make.single(identity[:-1]) if isinstance(make, Dispatch) else make
                        composed = Composed(_corridor(single), start[1])
                if composed:
                    composed.step(value, ms)
                else:
                    state, _ = step(state, value, ms, draw)
            yield table(done)
        if at is not None:
            yield table([(*at, *found())])

    return run


def _folded(sliced):
    """Slices of a key in order -> each with its start: the end of the slice before it."""
    sliced = list(sliced)

    def run(batches):
        key, end = None, None
        for batch in batches:
            starts = []
            for *identity, _, points in zip(*(batch.column(c).to_pylist() for c in [*sliced, "_points"])):
                if identity != key:
                    key, end = identity, None
                starts.append(end)
                end = composed_end([(p["start"], p["end"]) for p in points], math.nan if end is None else end)
            yield batch.select([*sliced, START[1]]).append_column(START[0], pa.array(starts, pa.float64()))

    return run


def _steps(batch: pa.RecordBatch, keys, order):
    """Rows of a batch as Python values: identity, start state, value, time and draw."""
    def values(name):
        return batch.column(name).to_pylist()

    starts = [(None, None)] * batch.num_rows
    if START[1] in batch.schema.names:
        starts = zip(*(values(name) for name in START))
    return zip(zip(*(values(k) for k in keys)), starts, values("_value"), values(order[0]),
               values("_draw"))


def _outputs(make, keys, columns, out, order):
    """Sorted Arrow batches -> the same rows with their output. A row's start columns, if there are
    any, give the state to start its key from."""
    keys, columns, order = list(keys), list(columns), list(order)
    width = len(keys) - (keys[-1] == "_slice")

    def run(batches):
        key = None
        for batch in batches:
            outputs = []
            for identity, start, value, ms, draw in _steps(batch, keys, order):
                if identity != key:
                    key = identity
                    state, step = _made(make, identity[:width])
                    state = state if start[1] is None else start
                state, result = step(state, value, ms, draw)
                outputs.append(result)
            yield batch.select(columns).append_column(out, pa.array(outputs, pa.float64()))

    return run


def _ends(make, sliced, order):
    """Sorted Arrow batches -> every slice with the value it ends with."""
    sliced, order = list(sliced), list(order)

    def run(batches):
        at, ends, types = None, [], None
        for batch in batches:
            types = [batch.schema.field(k).type for k in sliced] + [pa.float64()]
            for identity, start, value, ms, draw in _steps(batch, sliced, order):
                if identity != at:
                    if at is not None:
                        ends.append((*at, state[0]))
                    state, step = _made(make, identity[:-1])
                    state = state if start[1] is None else start
                    at = identity
                state, _ = step(state, value, ms, draw)
            yield _table(ends, types, sliced)
            ends = []
        if at is not None:
            yield _table([(*at, state[0])], types, sliced)

    return run


def _table(rows, types, sliced) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                      names=[*sliced, "end_value"])


def speed_anonymizer(df: DataFrame, corridor: Corridor, plan: SlicePlan,
                     keys: Sequence[str] = ("vehicle_id",), seed=0,
                     out: str = "processed_scalar") -> DataFrame:
    """Anonymise ``scalar`` per key. A null speed is no record: it is left out."""
    return run_steps(df.where(F.col("scalar").isNotNull()), corridor.make, F.col("scalar"), out, plan, keys, seed)


def map_speed(df: DataFrame, corridor: Corridor, plan: SlicePlan, **options) -> DataFrame:
    """The bare number-to-number variant, which starts from 0 instead of the first value."""
    return speed_anonymizer(df, replace(corridor, initial_last=0.0), plan, **options)

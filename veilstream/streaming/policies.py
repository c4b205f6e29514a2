"""Whole policies on a stream: contexts, rules of all sections, decisions and enforcement in one operator.

Readings pass through one stateful operator that holds rows until the watermark has passed them and then works
through them in event-time order: it carries the context of every vehicle forward, tries the rules of every
section, decides about the sections that a new rule affects, and keeps the last values of each section for the
transformations. These run after it as Columns, images included, so rows are the same as those of
``plans.pipelines.run_policies``.

*Policies that change.* New versions come as a stream of their own (``control``) into the same operator. Every
vehicle must meet them, so vehicles are dealt to a fixed number of shards per application: the operator is keyed by
(app, shard), a version is sent once to every shard, and each shard holds the version in force beside the memory of
its vehicles. A version is in force from its time on, wherever it lies between the readings in event time; it may
arrive later than they do, as far as the watermark waits.

*Warm start.* ``state_after(history)`` gives the memory that a run over earlier readings ends with; it fills the
state before the first reading, so a stream goes on as if it had seen the past.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from veilstream.functions.petspec import PetSpec
from veilstream.functions.predicates import function_of
from veilstream.operators.context import fan_out
from veilstream.operators.enforce import processed_column
from veilstream.operators.pets import SECTION_VALUE, StepPet, WindowPet, build_pet
from veilstream.operators.policy import Rule, affected_by, rule_name
from veilstream.schemas import SECTIONS
from veilstream.streaming.held import MEMORIES, SHARDS, Held, through
from veilstream.streaming.in_order import RECENT, draw_of

#: What a frame needs beside its bytes, if its transformation reads it.
FRAME = (("height", T.IntegerType()), ("width", T.IntegerType()), ("n_channels", T.IntegerType()), ("class_map", T.BinaryType()))
READING = [("kind", T.IntegerType()), ("event_id", T.LongType()), ("vehicle_id", T.LongType()), ("section", T.StringType()),
           ("scalar", T.DoubleType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("image", T.BinaryType())]


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def control_rows(versions: Sequence[tuple[int, Sequence[Rule]]]) -> list[tuple[str, int, str]]:
    """``(app, effective_ms, rules)`` rows of policy versions, as ``stream_policies`` takes them for ``control``."""
    out = []
    for effective, rules in versions:
        for app in sorted({r.app for r in rules}):
            out.append((app, effective, json.dumps([[r.section, r.rule_no, r.priority, r.predicate, r.pet] for r in rules if r.app == app])))
    return out


CONTROL = "app string, effective_ms long, rules string"


class Policies(Held):
    """``rules`` are in force from the start; ``windows`` maps (section, label) to how many values the transformation
    reads, ``steps`` maps (section, label) to (step function, seed), ``known`` has the labels that can be applied."""

    def __init__(self, rules: Sequence[Rule], windows: dict, steps: dict, known: dict[str, set], frame: list):
        columns = [("generate_ms", T.LongType()), *READING, *frame, ("rules", T.StringType())]
        released = [("app", T.StringType()), ("vehicle_id", T.LongType()), ("generate_ms", T.LongType()), ("event_id", T.LongType()),
                    *READING[3:], *frame, ("pet_label", T.StringType()), ("since_event_id", T.LongType()),
                    ("stepped", T.DoubleType()), ("recent", T.ArrayType(RECENT)), ("at", T.TimestampType())]
        super().__init__([c for c, _ in columns], _struct(released), order=3, binary=[c for c, kind in columns if kind == T.BinaryType()])
        self.start: dict[str, list[Rule]] = {}
        for rule in rules:
            self.start.setdefault(rule.app, []).append(rule)
        self.windows, self.steps, self.known = windows, steps, known
        self.sizes: dict[str, int] = {}
        for (section, _), size in windows.items():
            self.sizes[section] = max(size, self.sizes.get(section, 1))

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getMapState("memory", "vehicle string", "text string")
        self.version = handle.getValueState("version", "since_ms long, rules string")
        self.memories: dict[str, dict] = {}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for vehicle, text in zip(initialState["vehicle"], initialState["memory"]):
            self.memory.updateValue((vehicle,), (text,))

    @staticmethod
    def _tried(rules: Sequence[Rule]) -> list[tuple]:
        """Rules from the highest priority down, ready to be tried."""
        return [(r.section, r.since_ms, r.until_ms, function_of(json.loads(r.predicate)), r.spec.label, r.affected, rule_name(r))
                for r in sorted(rules, key=lambda r: (r.priority, r.rule_no))]

    def _published(self, app: str, since: int, text: str) -> list[tuple]:
        rules = [Rule(app, section, number, priority, predicate, pet, since) for section, number, priority, predicate, pet in json.loads(text)]
        for rule in rules:
            for section in rule.affected:
                if rule.spec.label not in self.known.get(section, ()):
                    raise ValueError(f"a policy of {app!r} brings {rule.spec.label!r} for {section!r}, which is not among the stream's transformations")
        return self._tried(rules)

    @staticmethod
    def _winners(rules: list[tuple], ms: int, memory: dict) -> dict[str, tuple]:
        """The satisfied rule with the smallest (priority, rule_no) of each section."""
        found: dict[str, tuple] = {}
        scalars, x, y = {"speed": memory.get("speed")}, memory.get("x"), memory.get("y")
        for section, since, until, test, label, affected, name in rules:
            if section not in found and (since is None or ms >= since) and (until is None or ms < until) and test(scalars, x, y):
                found[section] = name, label, affected
        return found

    def release(self, key, rows):
        app = key[0]
        stored = self.version.get()
        since, rules = (stored[0], self._published(app, *stored)) if stored else (None, self._tried(self.start.get(app, [])))
        memories, released = self.memories, []
        for ms, kind, event_id, vehicle_id, section, scalar, x, y, image, *more in rows:
            if kind == 0:
                if since is None or ms >= since:  # an older version that comes late is past
                    since, rules = ms, self._published(app, ms, more[-1])
                    self.version.update((ms, more[-1]))
                continue
            vehicle = "" if vehicle_id is None else str(int(vehicle_id))
            if vehicle not in memories:
                memories[vehicle] = json.loads(self.memory.getValue((vehicle,))[0]) if self.memory.containsKey((vehicle,)) else {}
            memory = memories[vehicle]
            last = memory.get("last")
            if last is not None and (ms, event_id) < (last["generate_ms"], last["event_id"]):
                continue  # late: rows after it are out already
            memory["last"] = {"generate_ms": ms, "event_id": event_id}
            found = self._decide(rules, memory, vehicle_id, ms, event_id, section, scalar, x, y, image)
            if found is not None:
                label, brought, stepped, recent = found
                released.append((app, vehicle_id, ms, event_id, section, scalar, x, y, image, *more[:-1], label, brought, stepped,
                                 recent, pd.Timestamp(ms, unit="ms")))
        if len(memories) > MEMORIES:
            self.settle()
        return released

    def settle(self) -> None:
        for vehicle, memory in self.memories.items():
            self.memory.updateValue((vehicle,), (json.dumps(memory),))
        self.memories = {}

    def _decide(self, rules, memory, vehicle_id, ms, event_id, section, scalar, x, y, image):
        """The PET in force on a reading with what it needs; None if nothing is published."""
        if section == "speed" and scalar is not None:
            memory["speed"] = scalar
        if section == "location" and x is not None and y is not None:
            memory["x"], memory["y"] = x, y
        current, pets = memory.setdefault("current", {}), memory.setdefault("pet", {})
        switched = {}
        for of, (name, label, affected) in self._winners(rules, ms, memory).items():
            if current.get(of) != name:
                current[of] = name
                switched[of] = label, affected
        for target in SECTIONS:
            by = [switched[s][0] for s in sorted(switched, key=lambda s: (s != target, SECTIONS.index(s))) if target in switched[s][1]]
            if by:
                pets[target] = {"pet_label": by[0], "since_event_id": event_id}
        if (scalar if section == "speed" else x if section == "location" else image) is None or (section == "location" and y is None):
            return None  # a row without a value is no record
        held = memory.setdefault("recent", {})
        held[section] = (held.get(section, []) + [{"generate_ms": ms, "scalar": scalar, "x": x, "y": y}])[-self.sizes.get(section, 1):]
        if section not in pets:
            return None
        label, since, stepped = pets[section]["pet_label"], pets[section]["since_event_id"], None
        if (section, label) in self.steps:
            make, seed = self.steps[section, label]
            before, step = make()
            known = memory.setdefault("step", {}).get(section)
            if known is not None and known["since"] == since:
                before = known["value"], known["ms"]
            (value, at), stepped = step(before, scalar, int(ms), draw_of(seed, vehicle_id, ms))
            memory["step"][section] = {"value": value, "ms": at, "since": since}
        read = self.windows.get((section, label))
        return label, since, stepped, [{f: r.get(f) for f in RECENT.names} for r in held[section][-read:]] if read else None


def _shard(shards: int):
    return F.pmod(F.xxhash64("vehicle_id"), F.lit(shards)).cast("int")


def stream_policies(readings: DataFrame, rules: Sequence[Rule] = (), delay: str = "10 minutes", control: DataFrame | None = None,
                    may_apply: Sequence[tuple[str, PetSpec]] = (), apps: Sequence[str] = (), state: DataFrame | None = None,
                    shards: int = SHARDS, keep_time: bool = False) -> DataFrame:
    """All sections of all applications of a stream of ``READINGS``; the columns of ``run_policies``.

    ``control`` is a stream of ``CONTROL`` rows (see ``control_rows``): policy versions, each in force from its
    ``effective_ms`` on for its application. They can bring the PETs of ``rules`` and the (section, PET) pairs of
    ``may_apply``, which are compiled when the stream starts; any other is an error, not raw data. ``apps`` names
    applications that have no rules at the start. ``state`` is what ``pipelines.state_after`` gives of the readings
    before. ``shards`` must stay the same when a stream is started again. ``keep_time`` keeps the event time as
    ``at`` for another stateful operator.
    """
    specs = affected_by(rules)
    for section, spec in may_apply:
        if spec.label not in {s.label for s in specs.get(section, [])}:
            specs.setdefault(section, []).append(spec)
    built = {section: [(s.label, *build_pet(s, section)) for s in own] for section, own in specs.items()}
    windows = {(section, label): p.size for section, pets in built.items() for label, _, p in pets if isinstance(p, WindowPet)}
    steps = {(section, label): (p.make, p.seed) for section, pets in built.items() for label, _, p in pets if isinstance(p, StepPet)}
    known = {section: {label for label, _, _ in pets} for section, pets in built.items()}
    frame = [(c, kind) for c, kind in FRAME if c in readings.columns]
    everyone = sorted({r.app for r in rules} | set(apps))
    rows = fan_out(readings, everyone, name="app").select(
        "app", _shard(shards).alias("shard"), "generate_ms", F.lit(1).alias("kind"), "event_id", "vehicle_id", "section", "scalar",
        F.col("location.x").alias("x"), F.col("location.y").alias("y"), "image", *[F.col(c).cast(kind) for c, kind in frame],
        F.lit(None).cast("string").alias("rules"))
    if control is not None:
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        versions = control.where(F.col("app").isin(*everyone)).select(
            "app", every.alias("shard"), F.col("effective_ms").alias("generate_ms"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("event_id"), "rules")
        rows = rows.unionByName(versions, allowMissingColumns=True)
        # A version may be published after the readings of its time; Spark must not drop it as late.
        rows = rows.withColumn("event_time", F.when(F.col("kind") == 1, F.timestamp_millis("generate_ms")))
    if state is not None:
        vehicle = F.coalesce(F.col("vehicle_id").cast("string"), F.lit(""))
        state = state.select("app", _shard(shards).alias("shard"), vehicle.alias("vehicle"), "memory")
    processor = Policies(rules, windows, steps, known, frame)
    released = through(rows, ["app", "shard"], processor.columns, processor, delay, state, "at" if keep_time else "")
    released = released.withColumn("location", F.when(F.col("x").isNotNull(), F.struct("x", "y")))
    outputs, ready = {}, F
    for section, pets in built.items():
        value = F
        for label, kind, pet in pets:
            here = (F.col("section") == section) & (F.col("pet_label") == label)
            column, is_ready = pet, F.lit(True)
            if kind == "window":
                if pet.of_recent is None:
                    raise ValueError(f"PET {label!r} has no form for streams")
                column, is_ready = pet.of_recent(F.slice("recent", -F.least(F.size("recent"), F.lit(pet.size)), F.lit(pet.size)))
            elif kind == "step":
                column = F.col("stepped")
            value, ready = value.when(here, column), ready.when(here, is_ready)
        outputs[processed_column(section)] = value
    missing = {processed_column(s): F.lit(None).cast({"speed": "double", "location": "struct<x:double,y:double>", "image": "binary"}[s])
               for s in SECTION_VALUE if processed_column(s) not in outputs}
    return (released.where(F.coalesce(ready, F.lit(False))).withColumns({**outputs, **missing})
            .select("app", "vehicle_id", "section", "event_id", "generate_ms", "pet_label", "since_event_id", *outputs, *missing,
                    *(["at"] if keep_time else [])))

"""Streaming policy evaluation and enforcement.

Readings (and, if decisions come from outside, decisions) of one (app, vehicle, section) pass through
one stateful operator that holds rows until the watermark has passed them and then works through them
in event-time order. Arrival order therefore does not matter, a late decision still meets the records
it applies to, and a restart continues from the state store.

Rules are evaluated before the operator and transformations after it, both as Columns in the JVM. The
operator itself only tracks which rule or decision is in force and the last few values, which it hands
on as an array.

A row that comes when later rows of its key have already been released is *late*. Spark may drop it
(``LateRows`` counts those); otherwise the operator marks it, and it is left out of the output or kept
apart (``keep_late=True``, then write with ``partitionBy("is_late")``). It never changes state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle, StreamingQueryListener

from veilstream.operators.enforce import distinct_specs, processed_column
from veilstream.operators.pets import StepPet, WindowPet, build_pet
from veilstream.operators.policy import (Rule, decisions, for_defined_sections, rule_lookup, rules_of,
                                         winning_rule)

from veilstream.streaming.held import Held, in_event_order, use_rocksdb

KEYS = ("app", "vehicle_id", "section")

RECENT = T.StructType([T.StructField("generate_ms", T.LongType()),
                       T.StructField("scalar", T.DoubleType()),
                       T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
HELD = T.StructType([T.StructField("generate_ms", T.LongType()), T.StructField("event_id", T.LongType()),
                     T.StructField("kind", T.IntegerType()), T.StructField("cause", T.StringType()),
                     T.StructField("label", T.StringType()), *RECENT.fields[1:]])
CURRENT = T.StructType([T.StructField("cause", T.StringType()), T.StructField("label", T.StringType()),
                        T.StructField("since_event_id", T.LongType()),
                        T.StructField("step_value", T.DoubleType()),
                        T.StructField("step_ms", T.LongType()),
                        T.StructField("last_ms", T.LongType()), T.StructField("last_id", T.LongType())])
RELEASED = T.StructType([
    T.StructField("app", T.StringType()), T.StructField("vehicle_id", T.LongType()),
    T.StructField("section", T.StringType()), T.StructField("event_id", T.LongType()),
    *RECENT.fields, T.StructField("cause", T.StringType()), T.StructField("pet_label", T.StringType()),
    T.StructField("since_event_id", T.LongType()), T.StructField("is_switch", T.BooleanType()),
    T.StructField("stepped", T.DoubleType()), T.StructField("recent", T.ArrayType(RECENT)),
    T.StructField("is_late", T.BooleanType())])


def draw_of(seed, vehicle_id, ms) -> int:
    """The number that ``mathx.row_seed`` gives for the row."""
    return int(hashlib.md5(f"{seed}|{vehicle_id}|{ms}".encode()).hexdigest()[:15], 16)


class InOrder(Held):
    """Releases rows in event-time order with the cause in force and the last ``size`` values.

    ``steps`` maps PET labels to (step function, seed); step functions need the state between records. ``windows``
    maps PET labels to how many values they read; records under other labels are handed on without.
    A decision without a label changes what is current, but not the PET: it is about other sections.
    """

    def __init__(self, windows: dict[str, int], steps: dict):
        super().__init__(HELD.names, RELEASED, order=3)
        self.size = max(windows.values(), default=1)
        self.windows = windows
        self.steps = steps

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", RECENT)
        self.current = handle.getValueState("current", CURRENT)

    def release(self, key, rows: list[tuple]) -> list[tuple]:
        state = self.current.get() or (None,) * len(CURRENT)
        cause, label, since, step_value, step_ms, last_ms, last_id = state
        recent = [tuple(row) for row in self.recent.get()] if self.size > 1 else []
        released = []
        for ms, event_id, kind, new_cause, new_label, scalar, x, y in rows:
            if last_ms is not None and (ms, event_id) < (last_ms, last_id):
                if kind == 1:
                    released.append((*key, event_id, ms, scalar, x, y, None, None, None, False, None,
                                     [], True))
                continue
            last_ms, last_id = ms, event_id
            switch = new_cause is not None and new_cause != cause
            if switch:
                cause = new_cause
            if switch and new_label is not None:
                label, since, step_value, step_ms = new_label, event_id, None, None
            if kind == 0 or (scalar is None if key[2] == "speed" else x is None or y is None):
                continue  # a row without a value is no record
            if self.size > 1:
                recent = [*recent, (ms, scalar, x, y)][-self.size:]
            stepped = None
            if label in self.steps:
                make, seed = self.steps[label]
                initial, step = make()
                before = initial if step_ms is None else (step_value, step_ms)
                (step_value, step_ms), stepped = step(before, scalar, int(ms), draw_of(seed, key[1], ms))
            if label in self.windows:
                last = recent[-self.windows[label]:] if self.size > 1 else [(ms, scalar, x, y)]
                last = [dict(zip(RECENT.names, r)) for r in last]
            else:
                last = None
            released.append((*key, event_id, ms, scalar, x, y, cause, label, since, switch, stepped, last, False))
        self.current.update((cause, label, since, step_value, step_ms, last_ms, last_id))
        if recent and self.size > 1:
            self.recent.put(recent)
        return released


def _flat(df: DataFrame) -> DataFrame:
    """The operator's input columns; a missing section is null."""
    def field(column: str, path: str):
        return F.col(path) if column in df.columns else F.lit(None).cast("double")
    return df.withColumns({"x": field("location", "location.x"), "y": field("location", "location.y"),
                           "scalar": field("scalar", "scalar")}).select(
        *KEYS, "generate_ms", "event_id", "kind", "cause", "label", "scalar", "x", "y")


def release_in_order(rows: DataFrame, delay: str, windows: dict[str, int], steps: dict) -> DataFrame:
    return in_event_order(_flat(rows), KEYS, InOrder(windows, steps), delay)


def caused_by_rules(readings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Readings with the winning rule as their possible cause of a switch (narrow, in the JVM)."""
    evaluated = winning_rule(for_defined_sections(readings, rules), rules)
    named = evaluated.withColumn("current", F.col("winner"))
    # The label is part of the cause: a new policy may give an old place in the list a new PET.
    cause = F.concat(F.col("winner.index").cast("string"), F.lit("|"), rule_lookup(rules, lambda r: F.lit(r.spec.label)))
    label = rule_lookup(rules, lambda r: F.lit(r.spec.label if r.section in r.affected else None).cast("string"))
    return named.withColumns({"label": label, "cause": cause, "kind": F.lit(1)})


def decide_stream(readings: DataFrame, rules: Sequence[Rule], delay: str = "10 minutes") -> DataFrame:
    """Switching decisions of a stream: the same rows that batch evaluation gives."""
    released = release_in_order(caused_by_rules(readings, rules), delay, {}, {})
    index = F.substring_index("cause", "|", 1).cast("int")
    named = released.where(~F.col("is_late")).withColumn("current", F.struct(index.alias("index")))
    priority = rule_lookup(rules, lambda r: F.lit(r.priority))
    named = named.withColumn("current", F.struct(priority.alias("priority"), F.col("current.index")))
    return decisions(named, rules)


def enforce_stream(readings: DataFrame, rules: Sequence[Rule], section: str,
                   delay: str = "10 minutes", keep_late: bool = False) -> DataFrame:
    """Readings of one section under the PET in force; decides and enforces in one operator, so a
    decision cannot arrive after the record that caused it."""
    mine = [r for r in rules if r.section == section]
    specs = distinct_specs(r.spec for r in mine if section in r.affected)
    return _enforced(caused_by_rules(readings, mine), specs, section, delay, keep_late)


def enforce_decided_stream(readings: DataFrame, decided: DataFrame, specs, section: str,
                           delay: str = "10 minutes", keep_late: bool = False) -> DataFrame:
    """The same under decisions that arrive as a stream of their own. Readings wait until the
    watermark has passed them, so a decision may come later than the records it applies to."""
    rows = readings.withColumns({
        "kind": F.lit(1), "cause": F.lit(None).cast("string"), "label": F.lit(None).cast("string")})
    causes = decided.select(
        "app", "vehicle_id", "section", F.col("generation_ms").alias("generate_ms"),
        F.col("trigger_event_id").alias("event_id"), F.lit(0).alias("kind"),
        F.col("decision_id").alias("cause"), F.col("pet_label").alias("label"))
    both = rows.unionByName(causes, allowMissingColumns=True)
    return _enforced(both, specs, section, delay, keep_late)


def _enforced(rows: DataFrame, specs, section: str, delay: str, keep_late: bool) -> DataFrame:
    built = [(s.label, *build_pet(s, section)) for s in distinct_specs(specs)]
    windows = {label: pet.size for label, _, pet in built if isinstance(pet, WindowPet)}
    steps = {label: (pet.make, pet.seed) for label, _, pet in built if isinstance(pet, StepPet)}
    released = release_in_order(rows, delay, windows, steps)
    released = released.withColumn("location", F.struct("x", "y"))
    value, ready = F, F
    for label, kind, pet in built:
        if kind == "window":
            if pet.of_recent is None:
                raise ValueError(f"PET {label!r} has no form for streams")
            column, is_ready = pet.of_recent(F.slice("recent", -F.least(
                F.size("recent"), F.lit(pet.size)), F.lit(pet.size)))
        elif kind == "step":
            column, is_ready = F.col("stepped"), F.lit(True)
        else:
            column, is_ready = pet, F.lit(True)
        here = F.col("pet_label") == label
        value, ready = value.when(here, column), ready.when(here, is_ready)
    out = processed_column(section)
    wanted = F.coalesce(ready, F.lit(False))
    columns = [*KEYS, "event_id", "generate_ms", "pet_label", "since_event_id", out]
    if keep_late:
        return released.where(wanted | F.col("is_late")).withColumn(out, value).select(*columns, "is_late")
    return released.where(wanted & ~F.col("is_late")).withColumn(out, value).select(*columns)


def dedupe_stream(readings: DataFrame, delay: str = "10 minutes",
                  keys: Sequence[str] = ("app", "vehicle_id", "section", "generate_ms")) -> DataFrame:
    """Drop repeated readings that arrive within the watermark."""
    timed = readings.withColumn("event_time", F.timestamp_millis("generate_ms"))
    return (timed.withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark(list(keys)).drop("event_time"))


def evaluate_with_latest_policy(policy_path: str, out_path: str):
    """A ``foreachBatch`` function for policies that change while the stream runs.

    Every micro-batch reads the policy table anew, evaluates the rules on its rows and writes them with
    their cause to ``out_path``; the stateful operator then reads that table as a stream
    (``enforce_caused_stream``). A repeated batch overwrites its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rules = rules_of(batch.sparkSession.read.parquet(policy_path))
        caused = caused_by_rules(batch, rules).drop("winner", "current", "satisfied")
        caused.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return write


def enforce_caused_stream(caused: DataFrame, specs, section: str, delay: str = "10 minutes",
                          keep_late: bool = False) -> DataFrame:
    """Enforcement of rows that carry their cause already."""
    return _enforced(caused, specs, section, delay, keep_late)


def run_available(df: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process all input there is into Parquet files, then stop."""
    (df.writeStream.format("parquet").option("path", out_path)
     .option("checkpointLocation", checkpoint).outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop because they come behind the watermark, over all their triggers:
    ``spark.streams.addListener(late := LateRows())``, then ``late.rows[query name or id]``."""

    def __init__(self):
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        for name in {str(progress.id), progress.name} - {None}:
            self.rows[name] = self.rows.get(name, 0) + dropped

    def onQueryTerminated(self, event) -> None:
        pass

"""Whole pipelines: from readings and a policy to enforced values.

All applications run in one plan: ``app`` is a column, not a copy of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.operators.context import ORDER, fan_out, union_all
from veilstream.operators.enforce import (KEYS, active_pet, apply_pet, distinct_specs, enforce, enforce_sections,
                                          has_value, processed_column, select_active_variant)
from veilstream.operators.pets import StepPet, WindowPet, build_pet
from veilstream.operators.policy import (Rule, affected_by, context_columns, for_affected_sections, in_order,
                                         pets_in_force, rule_name, rules_in_force)
from veilstream.operators.timeline import SlicePlan, Timeline, by_heat, join_null_safe


def for_apps(readings: DataFrame, apps: Sequence[str]) -> DataFrame:
    """Every application sees every reading."""
    return fan_out(readings, apps, name="app")


def evaluate(readings: DataFrame, rules: Sequence[Rule], plan: SlicePlan) -> DataFrame:
    """The PET in force on readings of one section, by rules of that section alone: rows of the
    applications and sections that the rules decide about get ``pet_label`` and ``since_event_id``."""
    scalars, x, y = context_columns(readings.columns)
    return pets_in_force(for_affected_sections(readings, rules), rules, plan, scalars, x, y, keys=KEYS)


def enforce_speed(readings: DataFrame, rules: Sequence[Rule], plan: SlicePlan,
                  history: DataFrame | None = None) -> DataFrame:
    """Speed readings of the policy's applications, each under the PET in force (the minimum slice)."""
    own = [r for r in rules if r.section == "speed"]
    apps = sorted({r.app for r in own})

    def run(rows: DataFrame, heat: SlicePlan) -> DataFrame:
        active = evaluate(for_apps(rows, apps), own, heat)
        return enforce(active, affected_by(own).get("speed", []), "speed", heat)
    return _after_history(readings, history, lambda rows: by_heat(rows, plan, run))


def _after_history(readings: DataFrame, history: DataFrame | None, run) -> DataFrame:
    """``run`` over history and readings, of which only the readings are published: contexts, rules in
    force and windows are those of a run without interruption."""
    if history is None:
        return run(readings)
    past = history.select([c for c in readings.columns if c in history.columns]).withColumn("_past", F.lit(True))
    both = readings.withColumn("_past", F.lit(False)).unionByName(past, allowMissingColumns=True)
    return run(both).where(~F.col("_past")).drop("_past")


def enforce_decided(readings: DataFrame, decided: DataFrame, specs, section: str,
                    plan: SlicePlan) -> DataFrame:
    """Enforcement under decisions that come as a table of their own."""
    return by_heat(readings, plan, lambda rows, heat: enforce(
        active_pet(rows, decided, heat), specs, section, heat))


def filter_outputs(readings: DataFrame, decided: DataFrame, specs, section: str,
                   plan: SlicePlan) -> DataFrame:
    """The baseline: all PETs run on all records, then each record keeps the variant in force."""
    def run(rows: DataFrame, heat: SlicePlan) -> DataFrame:
        variants = union_all([
            apply_pet(rows, spec, section, heat).withColumnRenamed("pet_label", "variant_label")
            for spec in distinct_specs(specs)])
        return select_active_variant(variants, decided, heat)
    return by_heat(readings, plan, run)


def run_policies(readings: DataFrame, rules: Sequence[Rule], plan: SlicePlan,
                 history: DataFrame | None = None) -> DataFrame:
    """All sections of all applications: context -> evaluation per section -> enforcement.

    ``readings`` is the long table of mixed sections. Every section's rules see the whole context, and a
    rule decides about all sections that its PET affects. A row is published under its own section. The
    result has the processed column of each section; ``reassemble_policies`` zips them back into contexts.
    ``rules`` may be of several policy versions (``policy.versioned``). With ``history``, earlier readings
    that are not published again, the run goes on where that history ends. Plan the slices with
    ``copies`` set to the number of applications.
    """
    apps = sorted({r.app for r in rules})

    def run(rows: DataFrame, heat: SlicePlan) -> DataFrame:
        decided = pets_in_force(for_apps(_context(rows, heat), apps), rules, heat, {"speed": F.col("now_speed")},
                                F.col("now_location.x"), F.col("now_location.y"))
        own = for_affected_sections(decided, rules).drop("now_speed", "now_location")
        return enforce_sections(own, affected_by(rules), heat)
    return _after_history(readings, history, lambda rows: by_heat(rows, plan, run))


def _context(rows: DataFrame, plan: SlicePlan) -> DataFrame:
    """Every section carried forward: ``now_speed`` and ``now_location``."""
    there = F.col("location.x").isNotNull() & F.col("location.y").isNotNull()
    return Timeline(["vehicle_id"], ORDER, plan).last_known(rows, {
        "now_speed": F.when(F.col("section") == "speed", F.col("scalar")),
        "now_location": F.when((F.col("section") == "location") & there, F.col("location"))})


def state_after(history: DataFrame, rules: Sequence[Rule], plan: SlicePlan) -> DataFrame:
    """``(app, vehicle_id, memory)``: what a run that ends with ``history`` knows, one JSON text per application and
    vehicle, its size independent of the length of the history. A stream can go on from it.

    It holds the last speed and place, the rule of every section that held last, the PET in force for every
    section and the record that brought it, the last values that windows need, and the last output where a PET
    feeds on it.
    """
    apps, keys, position = sorted({r.app for r in rules}), ["app", "vehicle_id"], F.struct(*ORDER)
    ordered, affected = in_order(rules), affected_by(rules)
    names = F.array(*[F.lit(rule_name(r)) for r in ordered])
    sections = sorted({r.section for r in rules})
    built = {s: [build_pet(spec, s)[1] for spec in specs] for s, specs in affected.items()}
    sizes = {s: max([p.size for p in pets if isinstance(p, WindowPet)], default=1) for s, pets in built.items()}

    def run(rows: DataFrame, heat: SlicePlan) -> DataFrame:
        return rules_in_force(for_apps(_context(rows, heat), apps), rules, heat, {"speed": F.col("now_speed")}, F.col("now_location.x"), F.col("now_location.y"))
    decided = by_heat(history, plan, run)

    def latest(value, when=None):
        return F.max_by(value, position if when is None else F.when(when, position))
    last = decided.groupBy(*keys).agg(
        latest("now_speed").alias("speed"), latest("now_location.x").alias("x"), latest("now_location.y").alias("y"),
        F.map_filter(F.map_from_arrays(F.array(*[F.lit(s) for s in sections]), F.array(*[
            F.try_element_at(names, latest(f"_win_{s}", F.col(f"_win_{s}").isNotNull()) + 1) for s in sections])),
            lambda _, name: name.isNotNull()).alias("current"),
        F.map_filter(F.map_from_arrays(F.array(*[F.lit(s) for s in affected]), F.array(*[latest(f"_pet_{s}") for s in affected])),
                     lambda _, pet: pet.isNotNull()).alias("pet"),
        F.max(position).alias("last"))
    # The newest values of each section; windows run over records only.
    values = decided.where(has_value(decided.columns))
    newest = Window.partitionBy(*keys, "section").orderBy(*[F.desc(c) for c in ORDER])
    size = reduce(lambda c, s: c.when(F.col("section") == s, sizes[s]), sizes, F).otherwise(1)
    there = [c for c in ("scalar",) if c in values.columns]
    place = [F.col("location.x"), F.col("location.y")] if "location" in values.columns else [F.lit(None).cast("double").alias(c) for c in "xy"]
    kept = (values.select(*keys, "section", *ORDER, *there, *place).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= size))
    recent = kept.groupBy(*keys, "section").agg(F.array_sort(F.collect_list(F.struct(*ORDER, *there, "x", "y"))).alias("values"))
    recent = recent.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("section", "values"))).alias("recent"))
    out = join_null_safe(last, recent, keys, "left")
    steps = {s: [spec.label for spec in specs if isinstance(build_pet(spec, s)[1], StepPet)] for s, specs in affected.items()}
    if any(steps.values()):
        done = run_policies(history, rules, plan)
        outputs = [done.where((F.col("section") == s) & F.col("pet_label").isin(*labels)).select(
            *keys, "section", "since_event_id", *ORDER, F.col(processed_column(s)).alias("value")) for s, labels in steps.items() if labels]
        ended = union_all(outputs).groupBy(*keys, "section").agg(F.max_by(F.struct("value", F.col("generate_ms").alias("ms"), F.col("since_event_id").alias("since")), position).alias("step"))
        ended = ended.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("section", "step"))).alias("step"))
        out = join_null_safe(out, ended, keys, "left")
    return out.select(*keys, F.to_json(F.struct(*[c for c in out.columns if c not in keys])).alias("memory"))


def reassemble_policies(enforced: DataFrame, plan: SlicePlan, ratio: int = 10) -> DataFrame:
    """One context per published image with the processed speed and location that belong to it: the samples of the
    same number as its group of ``ratio`` images. All sections are numbered in one pass and meet per group, so the
    pipeline below is read once and a hot vehicle is spread over its groups."""
    values = {s: processed_column(s) for s in ("speed", "location", "image")}
    rows = Timeline(KEYS, ORDER, plan).number(enforced.select(*KEYS, *ORDER, *values.values()), "frame_no")
    place = F.col("frame_no") - 1
    rows = rows.withColumn("_group", F.when(F.col("section") == "image", F.floor(place / ratio)).otherwise(place))
    group = Window.partitionBy("app", "vehicle_id", "_group")
    rows = rows.withColumns({values[s]: F.first(F.when(F.col("section") == s, F.col(values[s])), ignorenulls=True).over(group)
                             for s in ("speed", "location")})
    whole = F.col(values["speed"]).isNotNull() & F.col(values["location"]).isNotNull()
    return rows.where((F.col("section") == "image") & whole).drop("section", "_group")


__all__ = ["enforce_decided", "enforce_speed", "evaluate", "filter_outputs", "for_apps", "reassemble_policies", "run_policies", "state_after"]

"""Applying the PET that is valid at each record.

Readings have ``app, vehicle_id, section, event_id, generate_ms`` and value columns. ``pet_label``
names the PET in force at the row. Scalar PETs become branches of one CASE, so only the branch taken
is evaluated; windows are built only for labels that occur in the policy.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.functions.petspec import PetSpec
from veilstream.operators.context import ORDER, union_all
from veilstream.operators.pets import SECTION_VALUE, build_pet
from veilstream.operators.pets.speed import Dispatch, run_steps
from veilstream.operators.timeline import SlicePlan, Timeline

KEYS = ("app", "vehicle_id", "section")


def active_pet(readings: DataFrame, decisions: DataFrame, plan: SlicePlan,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``decision_id``, ``pet_label`` and ``since_event_id`` of the latest decision of the
    reading's section; a decision is in force from its trigger record on, that record included.

    An as-of join as one ordered pass over both inputs. When a decision arrives late does not matter:
    only its event time does.
    """
    decided = decisions.select(
        *keys, F.col("generation_ms").alias("generate_ms"),
        F.col("trigger_event_id").alias("event_id"), F.lit(0).alias("_kind"),
        F.struct("decision_id", "pet_label", F.col("trigger_event_id").alias("since_event_id"))
        .alias("_decision"))
    decided = plan.align(decided, readings)
    rows = readings.withColumn("_kind", F.lit(1)).unionByName(decided, allowMissingColumns=True)
    line = Timeline(keys, (*ORDER, "_kind"), plan)
    known = line.last_known(rows, {"_active": F.col("_decision")}).where(F.col("_kind") == 1)
    return known.select(*readings.columns, "_active.*")


def withhold(df: DataFrame, unmatched: str = "withhold") -> DataFrame:
    """Records before any decision are withheld (default) or passed on without a PET label."""
    if unmatched not in ("withhold", "pass"):
        raise ValueError(f"unknown choice {unmatched!r}; known: withhold, pass")
    return df.where(F.col("pet_label").isNotNull()) if unmatched == "withhold" else df


def per_section(decisions: DataFrame, sections: str = "sections") -> DataFrame:
    """One row per affected section of decisions that cover several."""
    return decisions.withColumn("section", F.explode(sections)).drop(sections)


def distinct_specs(specs: Iterable[PetSpec]) -> list[PetSpec]:
    return list({s.label: s for s in specs}.values())


def has_value(columns: Sequence[str]) -> Column:
    """The row has the value of its own section."""
    def there(section: str) -> Column:
        column = SECTION_VALUE[section]
        if column not in columns:
            return F.lit(False)
        return F.col("location.x").isNotNull() & F.col("location.y").isNotNull() if column == "location" else F.col(column).isNotNull()
    return reduce(lambda chain, s: chain.when(F.col("section") == s, there(s)), SECTION_VALUE, F).otherwise(F.lit(True))


def processed_column(section: str) -> str:
    return "processed_" + SECTION_VALUE[section]


def enforce(active: DataFrame, specs: Sequence[PetSpec], section: str, plan: SlicePlan,
            keys: Sequence[str] = KEYS) -> DataFrame:
    """Transform rows of one section by the PET named in ``pet_label``."""
    return enforce_sections(active, {section: specs}, plan, keys)


def enforce_sections(active: DataFrame, specs: Mapping[str, Sequence[PetSpec]], plan: SlicePlan,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Transform the rows of each section by the PET named in ``pet_label``, in one pass.

    Window PETs see the whole history of their section (which is what warming them up from the
    history store gives) and emit nothing while their frame is not full. Rows without a label count
    as history but are withheld. A row without a value is no record: it is neither published nor part
    of any frame. Step PETs start anew at every switch, so they run per (keys, ``since_event_id``).
    """
    built = [(section, s.label, *build_pet(s, section))
             for section, own in specs.items() for s in distinct_specs(own)]
    rows = active = active.where(has_value(active.columns))
    windows = [(i, pet) for i, (_, _, kind, pet) in enumerate(built) if kind == "window"]
    framed: dict[int, tuple[Column, Column]] = {}
    if windows:
        columns = [c for c in dict.fromkeys(c for _, pet in windows for c in pet.columns)
                   if c not in keys]

        def compute(df, ordered, whole):
            for i, pet in windows:
                df, value, ready = pet.compute(df, ordered, whole, f"_{i}_")
                framed[i] = value, ready
            return df

        line = Timeline(keys, ORDER, plan)
        rows = line.last_rows(rows, max(pet.size for _, pet in windows), columns, compute)
    values: dict[str, list] = {section: [] for section in specs}
    ready, steps = F.when(F.lit(False), F.lit(False)), []
    for i, (section, label, kind, pet) in enumerate(built):
        here = (F.col("section") == section) & (F.col("pet_label") == label)
        if kind == "step":
            steps.append((here, section, label, pet))
            continue
        value, is_ready = (pet, F.lit(True)) if kind == "column" else framed[i]
        values[section].append((here, value))
        ready = ready.when(here, is_ready)
    outputs = {processed_column(section): reduce(
        lambda chain, branch: chain.when(*branch), branches, F)
        for section, branches in values.items() if branches}
    parts = []
    if outputs:
        parts.append(rows.where(F.coalesce(ready, F.lit(False))).withColumns(outputs)
                     .select(*active.columns, *outputs))
    for section in dict.fromkeys(s for _, s, _, _ in steps):
        # One pass for all of them: a label holds for a whole (keys, since_event_id).
        own = {label: (here, pet) for here, s, label, pet in steps if s == section}
        seeds = reduce(lambda c, item: c.when(F.col("pet_label") == item[0], F.lit(str(item[1][1].seed))), own.items(), F)
        any_of = reduce(lambda a, b: a | b, [here for here, _ in own.values()])
        parts.append(run_steps(active.where(any_of), Dispatch({label: pet.make for label, (_, pet) in own.items()}), F.col("scalar"),
                               processed_column(section), plan, [*keys, "since_event_id", "pet_label"], seeds))
    return union_all(parts)


def apply_pet(df: DataFrame, spec: PetSpec, section: str, plan: SlicePlan,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """One fixed PET for all rows, labelled; an unknown PET raises before anything is published."""
    rows = df.withColumn("pet_label", F.lit(spec.label))
    if "since_event_id" not in df.columns:
        rows = rows.withColumn("since_event_id", F.lit(0).cast("long"))
    done = enforce(rows, [spec], section, plan, keys)
    return done if "since_event_id" in df.columns else done.drop("since_event_id")


def select_active_variant(variants: DataFrame, decisions: DataFrame, plan: SlicePlan,
                          keys: Sequence[str] = KEYS) -> DataFrame:
    """Output filtering: of all PETs' outputs per record keep the one whose label is in force.

    ``variants`` is the union of ``apply_pet`` outputs with its label as ``variant_label``.
    """
    active = active_pet(variants, decisions, plan, keys)
    return active.where(F.col("variant_label") == F.col("pet_label")).drop("variant_label")

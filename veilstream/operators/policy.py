"""Policy evaluation and switching decisions.

A policy has few rules, all known on the driver, so each rule's predicate becomes one boolean Column.
Evaluating all rules of all applications is a narrow projection; only detecting a *change* of the
winning rule needs an ordered window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.functions.petspec import PetSpec
from veilstream.functions.predicates import compile_predicate
from veilstream.operators.context import ORDER
from veilstream.operators.timeline import SlicePlan, Timeline
from veilstream.schemas import POLICY, SECTIONS

MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    app: str
    section: str
    rule_no: int
    priority: int
    predicate: str
    pet: str
    # A policy version is in force from ``since_ms`` until before ``until_ms``; None is open.
    since_ms: int | None = None
    until_ms: int | None = None

    @property
    def spec(self) -> PetSpec:
        return PetSpec.from_json(self.pet)

    @property
    def affected(self) -> tuple[str, ...]:
        """Sections whose PET this rule decides."""
        return self.spec.outputs or (self.section,)

    def in_force(self) -> Column:
        """Rows of the rule's application in the time of its policy version."""
        here = F.col("app") == self.app
        if self.since_ms is not None:
            here = here & (F.col("generate_ms") >= self.since_ms)
        return here if self.until_ms is None else here & (F.col("generate_ms") < self.until_ms)


def rules_of(policy: DataFrame, most: int = MAX_RULES) -> list[Rule]:
    """Bring a policy table to the driver. A policy is configuration: more than ``most`` rules are an
    error rather than a silent cut."""
    rows = (policy.select("app", "section", "rule_no", "priority", "predicate", "pet")
            .orderBy("app", "section", "rule_no").limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"a policy of more than {most} rules is data, not configuration")
    return [Rule(*row) for row in rows]


def versioned(versions: Sequence[tuple[int, Sequence[Rule]]]) -> list[Rule]:
    """Rules of policies that change: ``(effective_ms, rules)`` per version. A version replaces all
    section policies of the applications that it has rules for, until their next version."""
    begins: dict[str, list[int]] = {}
    for begin, rules in versions:
        for app in {r.app for r in rules}:
            begins.setdefault(app, []).append(begin)

    def until(app: str, begin: int) -> int | None:
        return min((b for b in begins[app] if b > begin), default=None)
    return [replace(r, since_ms=begin, until_ms=until(r.app, begin)) for begin, rules in versions for r in rules]


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.app, r.section, r.rule_no, r.priority, r.predicate, r.pet) for r in rules], POLICY)


def context_columns(context_schema: Sequence[str]) -> tuple[dict[str, Column], Column | None, Column | None]:
    """Scalar and position columns of a context row (structs) or of a flat reading row."""
    if "speed" in context_schema:
        return {"speed": F.col("speed.v")}, F.col("location.x"), F.col("location.y")
    scalars = {"speed": F.col("scalar")} if "scalar" in context_schema else {}
    if "location" in context_schema:
        return scalars, F.col("location.x"), F.col("location.y")
    return scalars, None, None


def match_rules(df: DataFrame, rules: Sequence[Rule], scalars: Mapping[str, Column] | None = None,
                x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Add ``satisfied``: the (priority, rule_no) of every rule of the row's (app, section) that holds."""
    if scalars is None:
        scalars, x, y = context_columns(df.columns)
    entries = []
    for rule in rules:
        scope = rule.in_force() & (F.col("section") == rule.section)
        hit = scope & compile_predicate(rule.predicate, scalars, x, y)
        entries.append(F.when(hit, F.struct(F.lit(rule.priority).alias("priority"),
                                            F.lit(rule.rule_no).alias("rule_no"))))
    return df.withColumn("satisfied", F.array_compact(F.array(*entries)))


def winning_rule(df: DataFrame, rules: Sequence[Rule], scalars: Mapping[str, Column] | None = None,
                 x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Add ``winner``: the satisfied rule with the smallest (priority, rule_no), or null.

    Rules are tried from the highest priority down, so evaluation stops at the first hit. ``index`` is
    the rule's place among all rules, by which its texts are looked up.
    """
    if scalars is None:
        scalars, x, y = context_columns(df.columns)
    index = {rule: i for i, rule in enumerate(in_order(rules))}

    def value(rule: Rule) -> Column:
        return F.struct(F.lit(rule.priority).alias("priority"), F.lit(rule.rule_no).alias("rule_no"),
                        F.lit(index[rule]).alias("index"))
    winner = _first_hit(rules, lambda r: r.in_force() & (F.col("section") == r.section), value, scalars, x, y)
    return df.withColumn("winner", winner.cast("struct<priority:int,rule_no:int,index:int>"))


def _first_hit(rules: Sequence[Rule], scope: Callable[[Rule], Column], value: Callable[[Rule], Column],
               scalars, x, y) -> Column:
    """``value`` of the satisfied rule with the smallest (priority, rule_no). Rules are nested by scope, so
    a row tries those of its own application, section and version only."""
    groups: dict[tuple, list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: (r.priority, r.rule_no)):
        groups.setdefault((rule.app, rule.section, rule.since_ms, rule.until_ms), []).append(rule)
    chosen = F
    for own in groups.values():
        chain = reduce(lambda c, r: c.when(compile_predicate(r.predicate, scalars, x, y), value(r)), own, F)
        chosen = chosen.when(scope(own[0]), chain)
    return F.lit(None) if chosen is F else chosen


def affected_by(rules: Sequence[Rule]) -> dict[str, list[PetSpec]]:
    """The PETs that rules can bring into force, by the section that they transform."""
    specs: dict[str, dict[str, PetSpec]] = {}
    for rule in rules:
        for section in rule.affected:
            specs.setdefault(section, {}).setdefault(rule.spec.label, rule.spec)
    return {section: list(own.values()) for section, own in specs.items()}


def for_affected_sections(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Only rows whose (app, section) some rule can decide about."""
    apps: dict[str, set[str]] = {}
    for rule in rules:
        apps.setdefault(rule.app, set()).update(rule.affected)
    return df.where(_any_scope(apps))


def pets_in_force(df: DataFrame, rules: Sequence[Rule], plan: SlicePlan, scalars: Mapping[str, Column],
                  x: Column | None = None, y: Column | None = None,
                  keys: Sequence[str] = ("app", "vehicle_id")) -> DataFrame:
    """Add ``pet_label`` and ``since_event_id``: the PET in force for the row's own section, and the record
    that brought it.

    The rules of every section see each row. When the winner of a section changes, the new rule decides
    about all its affected sections, from that record on, the record included. If several sections decide
    about one section at the same record, its own rule counts, then ``speed``, ``location`` and ``image``.
    All sections are carried as columns of one row, so rows are not multiplied by sections.
    """
    given, affected = df.columns, affected_by(rules)
    df = rules_in_force(df, rules, plan, scalars, x, y, keys)
    mine = reduce(lambda c, t: c.when(F.col("section") == t, F.col(f"_pet_{t}")), affected, F)
    df = df.withColumn("_pet", mine)
    return df.select(*[F.col(f"`{c}`") for c in given], "_pet.pet_label", "_pet.since_event_id")


def rules_in_force(df: DataFrame, rules: Sequence[Rule], plan: SlicePlan, scalars: Mapping[str, Column],
                   x: Column | None = None, y: Column | None = None,
                   keys: Sequence[str] = ("app", "vehicle_id")) -> DataFrame:
    """Add ``_win_<section>``, the satisfied rule of each section as its place among all (``in_order``), and
    ``_pet_<section>``, the PET in force and the record that brought it."""
    ordered, line = in_order(rules), Timeline(keys, ORDER, plan)
    own = {s: [r for r in rules if r.section == s] for s in sorted({r.section for r in rules})}
    index = {rule: i for i, rule in enumerate(ordered)}

    def looked_up(at: Column, value: Callable[[Rule], Column]) -> Column:
        return F.try_element_at(F.array(*[value(r) for r in ordered]), at + 1)
    df = df.withColumns({f"_win_{s}": _first_hit(mine, Rule.in_force, lambda r: F.lit(index[r]), scalars, x, y).cast("int")
                         for s, mine in own.items()})
    df = line.last_known(df, {f"_was_{s}": F.col(f"_win_{s}") for s in own}, inclusive=False)
    affected, decided = affected_by(rules), {}
    for target in affected:
        choices = []
        for s in sorted(own, key=lambda s: (s != target, SECTIONS.index(s))):
            if any(target in r.affected for r in own[s]):
                win = F.col(f"_win_{s}")
                switch = win.isNotNull() & ~win.eqNullSafe(F.col(f"_was_{s}"))
                touches = looked_up(win, lambda r: F.lit(target in r.affected))
                choices.append(F.when(switch & touches, F.struct(
                    looked_up(win, lambda r: F.lit(r.spec.label)).alias("pet_label"), F.col("event_id").alias("since_event_id"))))
        decided[f"_pet_{target}"] = F.coalesce(*choices)
    return line.last_known(df, decided)


def for_defined_sections(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Only rows whose (app, section) has a policy: a filter on driver-known constants, which reaches
    the scan, in place of a semi join."""
    return df.where(_in_scope(rules))


def for_undefined_sections(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that ``for_defined_sections`` drops, as a report."""
    return df.where(~F.coalesce(_in_scope(rules), F.lit(False)))


def _in_scope(rules: Sequence[Rule]) -> Column:
    sections: dict[str, set[str]] = {}
    for rule in rules:
        sections.setdefault(rule.app, set()).add(rule.section)
    return _any_scope(sections)


def _any_scope(sections: Mapping[str, set[str]]) -> Column:
    scopes = [(F.col("app") == app) & F.col("section").isin(*sorted(own))
              for app, own in sorted(sections.items())]
    return reduce(lambda a, b: a | b, scopes) if scopes else F.lit(False)


def detect_switches(df: DataFrame, plan: SlicePlan,
                    keys: Sequence[str] = ("app", "vehicle_id", "section"),
                    winner: str = "winner") -> DataFrame:
    """Add ``previous`` (winner in force before the row), ``current`` (after it) and ``is_switch``.

    A row on which no rule holds keeps the winner in force. The first winner is a switch.
    """
    line = Timeline(keys, ORDER, plan)
    known = line.last_known(df, {"previous": F.col(winner)}, inclusive=False)
    return known.withColumns({
        "current": F.coalesce(winner, "previous"),
        "is_switch": F.col(winner).isNotNull() & ~F.col(winner).eqNullSafe(F.col("previous")),
    })


def in_order(rules: Sequence[Rule]) -> list[Rule]:
    """Rules in the order that ``index`` refers to."""
    return sorted(rules, key=lambda r: (r.app, r.section, r.rule_no, r.since_ms or 0))


def rule_name(rule: Rule) -> str:
    """What tells a rule from all others, its policy version included."""
    return f"{'' if rule.since_ms is None else rule.since_ms}|{rule.section}|{rule.rule_no}|{rule.priority}"


def rule_lookup(rules: Sequence[Rule], value: Callable[[Rule], Column]) -> Column:
    """A constant per rule, looked up by the ``index`` of the row's ``current`` rule."""
    return F.try_element_at(F.array(*[value(r) for r in in_order(rules)]), F.col("current.index") + 1)


def decision_id() -> Column:
    """Deterministic id of the decision that a record causes."""
    return F.sha2(F.concat_ws("|", "app", F.col("vehicle_id").cast("string"), "section",
                              F.col("event_id").cast("string")), 256)


def decisions(switched: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per switch and affected section.

    The affected sections are the PET's output sections, or the record's own section.
    """
    affected = rule_lookup(rules, lambda r: F.array(*[F.lit(s) for s in r.spec.outputs or (r.section,)]))
    return (switched.where("is_switch")
            .select(decision_id().alias("decision_id"), "app", "vehicle_id",
                    F.explode(affected).alias("affected"),
                    F.col("event_id").alias("trigger_event_id"),
                    F.col("generate_ms").alias("generation_ms"),
                    rule_lookup(rules, lambda r: F.lit(r.pet)).alias("pet"),
                    rule_lookup(rules, lambda r: F.lit(r.spec.label)).alias("pet_label"),
                    F.col("current.priority").alias("priority"))
            .withColumnRenamed("affected", "section"))


def fork_context(df: DataFrame, evaluation_ms: Column | None = None) -> DataFrame:
    """Forward every evaluated record, stamped with its evaluation time."""
    stamp = evaluation_ms if evaluation_ms is not None else F.unix_millis(F.current_timestamp())
    return df.withColumn("evaluation_ms", stamp)


def scope_to_app(df: DataFrame, app: str) -> DataFrame:
    return df.where(F.col("app") == app)


def active_policy(readings: DataFrame, versions: DataFrame, plan: SlicePlan,
                  keys: Sequence[str] = ("app",)) -> DataFrame:
    """The policy version in force at each reading: the latest one published for its application.

    ``versions`` has ``app, effective_ms, event_id, version``. A new version replaces all section
    policies of its application. Applications are few and each holds a large part of the rows, so
    ``plan`` should come from ``plan_slices(readings, key="app")``.
    """
    published = versions.select(
        *keys, F.col("effective_ms").alias("generate_ms"), "event_id",
        F.lit(0).alias("_kind"), F.col("version").alias("_version"))
    published = plan.align(published, readings)
    rows = readings.withColumn("_kind", F.lit(1)).unionByName(published, allowMissingColumns=True)
    line = Timeline(keys, ("generate_ms", "event_id", "_kind"), plan)
    known = line.last_known(rows, {"version": F.col("_version")})
    return known.where(F.col("_kind") == 1).drop("_kind", "_version")


def involved_sections(policy: DataFrame) -> DataFrame:
    """Distinct sections per application."""
    return policy.select("app", "section").distinct()


def policy_json(policy: DataFrame) -> DataFrame:
    """One JSON document per application: its sections, each with its rules by priority."""
    rules = policy.groupBy("app", "section").agg(F.sort_array(F.collect_list(
        F.struct("priority", "rule_no", "predicate", "pet"))).alias("rule"))
    rules = rules.withColumn("rule", F.transform("rule", lambda r: F.struct(
        r["priority"].alias("priority"), r["predicate"].alias("predicate"), r["pet"].alias("pet"))))
    return (rules.groupBy("app")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("section").alias("dataSection"), "rule")))
                 .alias("policy"))
            .select("app", F.to_json(F.struct(F.col("app").alias("appName"), "policy")).alias("json")))

"""Policies of any number of rules: the rules are a table, and readings meet them through indexes.

``operators.policy`` compiles a policy into one CASE, which is right for configuration. Here neither the driver nor
any expression sees the rules. Every rule is turned into *terms*, alternatives that are conjunctions of comparisons
and polygon tests, and each kind of term has its index:

*Intervals.* A term that bounds one scalar covers an interval of its axis. The thresholds of an (app, section) cut
the axis into cells; the winner of every cell comes from the dyadic pieces of the intervals (a term has at most two
at each level, a cell lies in one at each level), so n thresholds cost n log n. Readings then find their cell in one
ordered pass over cells and readings, as an as-of join, with hot scopes cut into slices.

*Polygons.* A term with a polygon that must contain the position is entered in a grid whose cells are as large as
the polygon, so it lies in four cells at most. Readings look into their cell at every size that occurs: an
equi-join, after which all conditions of the term are tested exactly. Only the best term that holds is wanted, so a
reading first meets the best few terms of its cell. Where none of them holds it goes on to more terms of a smaller
cell, and so on for a few rounds; what is left then meets all terms of its cell that it has not met. What a reading
costs depends on how many terms it takes to find one that holds, not on how many hold.

*Outside.* A term that only wants positions outside polygons holds almost everywhere. These terms are numbered by
priority, and the winner is the first number that a position does not break: positions meet the first few numbers,
those that break all of them more. For what is left the grid says which of the others a position breaks.

Terms of other kinds (several scalars without a polygon, comparisons together with outside tests only) have no
index. They are compiled as in ``operators.policy``, at most ``most`` of them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions.predicates import RELATIONS, PredicateError
from veilstream.operators.policy import MAX_RULES, Rule, winning_rule
from veilstream.operators.timeline import Timeline, plan_slices
from veilstream.session import cut_lineage

BOUND = "struct<value:double,side:int>"
TERMS = (f"app string, section string, priority int, rule_no int, kind string, scalar string, low {BOUND}, high {BOUND}, "
         "polygons array<struct<inside:boolean,xs:array<double>,ys:array<double>>>, predicate string")
COLUMNS = ["app", "section", "priority", "rule_no", "kind", "scalar", "low", "high", "polygons", "predicate"]
# A bound lies at a value (side 0) or right behind it (side 1): low is the first place inside, high the first behind.
BOUNDS = {"GREATER": ((1,), None), "GREATER_EQUAL": ((0,), None), "LESS": (None, (0,)), "LESS_EQUAL": (None, (1,)), "EQUAL": ((0,), (1,))}
LOWEST, HIGHEST = (-math.inf, 0), (math.inf, 1)
BEST = (16, 64, 256, 256)   # terms of a cell that a reading meets in each round
FINER = 2                   # halvings of a cell's sides from one round to the next
FIRST = (4, 32, 256)        # terms without a place that a reading meets in each round
SALTS = 64                  # parts of a scope while its readings meet these


def _alternatives(spec: Mapping) -> list[list[tuple]]:
    """Disjunctive normal form: lists of ``("scalar", section, relation, value)`` and ``("place", inside, xs, ys)``."""
    parts: list[list[list[tuple]]] = []
    for leaf in spec.get("scalar") or []:
        relation = str(leaf.get("relation")).upper()
        if "custom" in leaf or relation not in RELATIONS:
            raise PredicateError(f"a rule of a table needs plain comparisons, not {leaf!r}")
        leaves = ["LESS", "GREATER"] if relation == "NOT_EQUAL" else [relation]
        parts.append([[("scalar", leaf["data section"], r, float(leaf["value"]))] for r in leaves])
    for leaf in spec.get("location") or []:
        kind = str(leaf["relation"]).upper()
        if kind not in ("IN", "OUT_OF"):
            raise PredicateError(f"unknown location relation {kind!r}; known: IN, OUT_OF")
        parts.append([[("place", kind == "IN", [float(v) for v in leaf["value"]["x"]], [float(v) for v in leaf["value"]["y"]])]])
    parts += [_alternatives(nested) for nested in spec.get("combined") or []]
    logic = spec.get("logic")
    if not parts:
        raise PredicateError("predicate is empty")
    if logic is None and len(parts) > 1 or logic is not None and (str(logic).upper() not in ("AND", "OR") or len(parts) < 2):
        raise PredicateError(f"logic {logic!r} does not fit {len(parts)} parts")
    if str(logic).upper() == "OR":
        return [term for part in parts for term in part]
    return reduce(lambda done, part: [a + b for a in done for b in part], parts, [[]])


def _terms_of(row) -> Iterator[tuple]:
    for term in _alternatives(json.loads(row.predicate)):
        places = [{"inside": t[1], "xs": t[2], "ys": t[3]} for t in term if t[0] == "place"]
        scalars = sorted({t[1] for t in term if t[0] == "scalar"})
        low, high = LOWEST, HIGHEST
        for _, _, relation, value in (t for t in term if t[0] == "scalar"):
            begin, end = BOUNDS[relation]
            low = max(low, (value, *begin)) if begin else low
            high = min(high, (value, *end)) if end else high
        if len(scalars) == 1 and low >= high:
            continue  # no value lies inside
        inside = any(p["inside"] for p in places)
        kind = ("interval" if not places else "inside" if inside else "outside" if not scalars else "other") if len(scalars) <= 1 else "other"
        leaves = {"scalar": [{"data section": s, "relation": r, "value": v} for t, s, r, v in (t for t in term if t[0] == "scalar")],
                  "location": [{"relation": "IN" if p["inside"] else "OUT_OF", "value": {"x": p["xs"], "y": p["ys"]}} for p in places]}
        if len(term) > 1:
            leaves["logic"] = "AND"
        yield (row.app, row.section, row.priority, row.rule_no, kind, scalars[0] if len(scalars) == 1 else None,
               dict(zip(("value", "side"), low)), dict(zip(("value", "side"), high)), places, json.dumps(leaves) if kind == "other" else None)


def rule_terms(rules: DataFrame) -> DataFrame:
    """``TERMS`` of ``rules(app, section, priority, rule_no, predicate)``; a predicate that cannot be read is an error."""
    def run(batches):
        for batch in batches:
            rows = [term for row in batch.itertuples(index=False) for term in _terms_of(row)]
            yield pd.DataFrame(rows, columns=COLUMNS)
    return rules.select("app", "section", F.col("priority").cast("int"), F.col("rule_no").cast("int"), "predicate").mapInPandas(run, TERMS)


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that both sides are dealt out for. Rules, cells and hits grow with the tables, and what
    Spark would broadcast for a small file is far larger as rows: none of it goes through the driver."""
    return df.hint("merge")


def _scope() -> Column:
    return F.concat("section", F.lit("|"), "app")


def _width() -> Column:
    """Cells of a dyadic piece."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))


def interval_cells(terms: DataFrame) -> DataFrame:
    """``(_scope, _value, _side, winner)``: where each cell of the axis begins and the rule that wins in it."""
    terms = terms.select(_scope().alias("_scope"), "low", "high", F.struct("priority", "rule_no").alias("rule"))
    bounds = terms.select("_scope", F.explode(F.array("low", "high")).alias("b")).distinct()
    bounds = cut_lineage(bounds.select("_scope", F.col("b.value").alias("_value"), F.col("b.side").alias("_side")))
    plan = plan_slices(bounds, "_scope", "_value")
    cells = cut_lineage(Timeline(["_scope"], ["_value", "_side"], plan).number(bounds, "_n").select(
        "_scope", "_value", "_side", (F.col("_n") - 1).alias("_n")))
    levels = max(1, int(cells.agg(F.max("_n")).first()[0] or 1).bit_length())

    def placed(name: str) -> DataFrame:
        return cells.select("_scope", F.struct(F.col("_value").alias("value"), F.col("_side").alias("side")).alias(name), F.col("_n").alias(f"_{name}"))
    ranked = terms.join(_dealt(placed("low")), ["_scope", "low"]).join(_dealt(placed("high")), ["_scope", "high"])
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")
    # No piece is wider than its interval.
    own = F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("_high") - F.col("_low"), F.lit(1)))).cast("int") + 1)).alias("_level")
    ranked = ranked.select("_scope", "rule", "_low", "_high", own)
    size = _width()
    left, right = F.ceil(F.col("_low") / size).cast("long"), F.floor(F.col("_high") / size).cast("long")
    pieces = ranked.withColumns({"_l": left, "_r": right}).where("_l < _r").withColumn("_piece", F.explode(F.array_compact(F.array(
        F.when(F.col("_l") % 2 == 1, F.col("_l")), F.when(F.col("_r") % 2 == 1, F.col("_r") - 1)))))
    best = pieces.groupBy("_scope", "_level", "_piece").agg(F.min("rule").alias("rule"))
    above = cells.select("*", level).withColumn("_piece", F.floor(F.col("_n") / _width()).cast("long"))
    return above.join(_dealt(best), ["_scope", "_level", "_piece"], "left").groupBy("_scope", "_value", "_side").agg(F.min("rule").alias("winner"))


def _by_interval(rows: DataFrame, terms: DataFrame, value: Column) -> DataFrame:
    """Add ``_axis``: the winner among the intervals that hold the value."""
    cells = interval_cells(terms).select("_scope", "_value", "_side", F.lit(0).alias("_kind"), F.col("winner").alias("_cell"))
    # A cell without a winner must be known as such: it ends the one before.
    cells = cells.withColumn("_cell", F.struct(F.col("_cell").alias("of")))
    readings = rows.withColumns({"_scope": _scope(), "_value": value, "_side": F.lit(0), "_kind": F.lit(1)})
    plan = plan_slices(readings, "_scope", "_value")
    both = readings.unionByName(plan.align(cells, readings), allowMissingColumns=True)
    known = Timeline(["_scope"], ["_value", "_side", "_kind"], plan).last_known(both, {"_found": F.col("_cell")})
    return known.where("_kind = 1").withColumn("_axis", F.when(F.col("_value").isNotNull(), F.col("_found.of"))).drop(
        "_scope", "_value", "_side", "_kind", "_cell", "_found")


def _inside(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """The winding test of ``predicates.in_polygon`` on polygons that are data."""
    def crossing(total, i):
        x0, y0 = F.element_at(xs, i + 1), F.element_at(ys, i + 1)
        after = (i + 1) % F.size(xs) + 1
        x1, y1 = F.element_at(xs, after), F.element_at(ys, after)
        within = (y >= F.least(y0, y1)) & (y < F.greatest(y0, y1))
        height = F.when(x0 == x1, x0).otherwise(x0 + (y - y0) * ((x1 - x0) / F.nullif(y1 - y0, F.lit(0.0))))
        left = (x < F.greatest(x0, x1)) & ((x < F.least(x0, x1)) | (x < height))
        left = F.when(x0 == x1, x < x0).otherwise(left)
        return total + F.when((y0 != y1) & within & left, F.when(y1 > y0, 1).otherwise(-1)).otherwise(0)
    box = (x >= F.array_min(xs)) & (x <= F.array_max(xs)) & (y >= F.array_min(ys)) & (y <= F.array_max(ys))
    return box & (F.aggregate(F.sequence(F.lit(0), F.size(xs) - 1), F.lit(0), crossing) != 0)


def _box(xs: Column, ys: Column) -> dict[str, Column]:
    return {"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)}


def _covered(c: str, side: Column) -> tuple[Column, Column]:
    """The first and the last number of the cells along an axis that a polygon lies in; its upper bound is outside."""
    low, high = F.col(f"_{c}0") / side, F.col(f"_{c}1") / side
    first, last = F.floor(low), F.greatest(F.floor(low), F.ceil(high) - 1)
    return first, last


def _gridded(polygons: DataFrame) -> DataFrame:
    """Cells ``(_size, _cx, _cy)`` of ``polygons(xs, ys)``: cells as large as the polygon, so at most four."""
    rows = polygons.withColumns(_box(F.col("xs"), F.col("ys")))
    extent = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(2.0 ** -40))
    rows = rows.withColumn("_size", F.ceil(F.log2(extent)).cast("int"))
    side = F.pow(F.lit(2.0), F.col("_size"))
    for c in "xy":
        rows = rows.withColumn(f"_c{c}", F.explode(F.sequence(*_covered(c, side))))
    return rows


def _side(finer: int) -> Column:
    return F.pow(F.lit(2.0), F.col("_size") - finer)


def _finer(cells: DataFrame, finer: int) -> DataFrame:
    """The parts of the cells, halved once more ``FINER`` times, that their polygons lie in."""
    parts = 1 << FINER
    for c in "xy":
        first, last = _covered(c, _side(finer))
        begin = F.col(f"_c{c}") * parts
        cells = cells.withColumn(f"_c{c}", F.explode(F.sequence(F.greatest(first, begin), F.least(last, begin + parts - 1))))
    return cells


def _within(rows: DataFrame, finer: int = 0) -> DataFrame:
    """Positions with their cell at their size."""
    return rows.withColumns({f"_c{c}": F.floor(F.col(f"_{c}") / _side(finer)) for c in "xy"})


def _at(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Positions with their cell at every size that occurs."""
    return _within(rows.withColumn("_size", F.explode(F.array(*[F.lit(s) for s in sizes]))))


def _sizes(cells: DataFrame) -> list[int]:
    return sorted(r[0] for r in cells.select("_size").distinct().collect()) or [0]  # powers of two between the extents


CELL = ["_scope", "_size", "_cx", "_cy"]


def _met(rows: DataFrame, polygons: DataFrame) -> DataFrame:
    """Positions with the polygons ``(_scope, xs, ys, ...)`` that contain them."""
    cells = cut_lineage(_gridded(polygons))
    met = _at(rows, _sizes(cells)).join(_dealt(cells), CELL)
    return met.where(_inside(F.col("xs"), F.col("ys"), F.col("_x"), F.col("_y")))


def _best_inside(points: DataFrame, terms: DataFrame, ids: Sequence[str], used: Mapping[str, Column]) -> DataFrame:
    """``(ids, _inside)``: the best of ``terms(_scope, rule, scalar, low, high, polygons, xs, ys)`` that holds."""
    cells = cut_lineage(_gridded(terms).where("_x0 < _x1 and _y0 < _y1"))  # the others have no inside
    left, found = _at(points, _sizes(cells)), []
    term = F.struct("rule", "scalar", "low", "high", "polygons", "_x0", "_x1", "_y0", "_y1")

    def holds(t):
        box = (F.col("_x") >= t["_x0"]) & (F.col("_x") < t["_x1"]) & (F.col("_y") >= t["_y0"]) & (F.col("_y") < t["_y1"])
        return box & _holds(used, t)
    for number, most in enumerate(BEST):
        best = cells.withColumn("_nth", F.row_number().over(Window.partitionBy(*CELL).orderBy("rule"))).where(F.col("_nth") <= most + 1)
        best = best.groupBy(*CELL).agg(F.array_sort(F.collect_list(term)).alias("_terms"))
        best = best.select(*CELL, F.slice("_terms", 1, most).alias("_terms"), (F.size("_terms") > most).alias("_more"))
        met = left.join(_dealt(best), CELL).withColumn("_hit", F.try_element_at(F.filter("_terms", holds), F.lit(1))["rule"])
        met = met.withColumn("_upto", F.try_element_at("_terms", F.lit(-1))["rule"]).drop("_terms")
        met = cut_lineage(met.where(F.col("_hit").isNotNull() | F.col("_more")))
        found.append(met.where("_hit is not null").select(*ids, F.col("_hit").alias("_inside")))
        left = met.where("_hit is null")
        # Terms that these have met are done; the others are looked up in smaller cells that still have readings.
        open_ = left.select(*CELL, "_upto").distinct()
        cells = cells.join(_dealt(open_), CELL).where(F.col("rule") > F.col("_upto")).drop("_upto")
        left = left.drop("_hit", "_more", "_upto")
        finer = FINER * (number + 1)
        left = _within(left, finer)
        cells = cut_lineage(_finer(cells, finer).join(_dealt(left.select(*CELL).distinct()), CELL, "left_semi"))
    hits = left.join(_dealt(cells), CELL).where(_inside(F.col("xs"), F.col("ys"), F.col("_x"), F.col("_y"))).where(_holds(used))
    found.append(hits.select(*ids, F.col("rule").alias("_inside")))
    return reduce(DataFrame.unionByName, found).groupBy(*ids).agg(F.min("_inside").alias("_inside"))


def _holds(scalars: Mapping[str, Column], term: Column | None = None) -> Column:
    """All conditions of a term, a struct or the row's own columns, on the row that it met."""
    scalar, low, high, polygons = (F.col(c) if term is None else term[c] for c in ("scalar", "low", "high", "polygons"))
    value = reduce(lambda c, s: c.when(scalar == s, scalars[s]), scalars, F)
    value = F.lit(None).cast("double") if value is F else value
    at = F.struct(value.alias("value"), F.lit(0).alias("side"))
    bounded = scalar.isNull() | (value.isNotNull() & (at >= low) & (at < high))
    placed = F.forall(polygons, lambda p: _inside(p["xs"], p["ys"], F.col("_x"), F.col("_y")) == p["inside"])
    return bounded & placed


def _first_outside(points: DataFrame, terms: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``(ids, _outside)`` of every point: the first of ``terms(_scope, _nth, priority, rule_no, polygons)`` that it does not
    break; of points that share their ids, the first that none of them breaks."""
    same = points.groupBy(*ids, "_scope").agg(*[f(c).alias(f"_{n}{c}") for c in ("_x", "_y") for n, f in (("low", F.min), ("high", F.max))],
                                              F.count(F.lit(1)).alias("_times"))
    one = (F.col("_low_x") == F.col("_high_x")) & (F.col("_low_y") == F.col("_high_y"))
    left = same.select(*ids, "_scope", F.when(one, F.col("_low_x")).alias("_x"), F.when(one, F.col("_low_y")).alias("_y"), "_times",
                       F.lit(0).cast("long").alias("_tested"))
    left, found, tested = left.withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int")), [], 0
    free = lambda t: ~F.exists(t["polygons"], lambda p: _inside(p["xs"], p["ys"], F.col("_x"), F.col("_y")))
    for most in FIRST:
        own = terms.where((F.col("_nth") > tested) & (F.col("_nth") <= tested + most))
        first = own.groupBy("_scope").agg(F.array_sort(F.collect_list(F.struct("_nth", "priority", "rule_no", "polygons"))).alias("_terms"))
        first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = left.join(_dealt(first), ["_scope", "_salt"], "left")
        hit = F.when(F.col("_x").isNotNull(), F.try_element_at(F.filter("_terms", free), F.lit(1)))
        met = met.withColumn("_hit", hit).where(F.col("_hit").isNotNull() | F.col("_x").isNull() | (F.size("_terms") == most)).drop("_terms")
        met = cut_lineage(met.withColumn("_outside", F.struct("_hit.priority", "_hit.rule_no")))
        found.append(met.where("_hit is not null").select(*ids, "_times", "_outside"))
        left, tested = met.where("_hit is null").drop("_hit", "_outside"), tested + most
        left = left.withColumn("_tested", F.when(F.col("_x").isNotNull(), tested).otherwise(0).cast("long"))
    rest = points.join(_dealt(left.select(*ids, "_tested", "_times")), list(ids))
    shapes = terms.select("_scope", "_nth", F.explode("polygons").alias("p")).select("_scope", "_nth", "p.xs", "p.ys")
    broken = _met(rest, shapes).where(F.col("_nth") > F.col("_tested")).groupBy(*ids).agg(F.array_sort(F.collect_set("_nth")).alias("_broken"))
    # The first number that is missing among the broken ones.
    gap = F.filter(F.sequence(F.lit(1), F.size("_broken")), lambda i: F.element_at("_broken", i) != i + F.col("_tested"))
    first = F.when(F.col("_broken").isNull(), 1).otherwise(F.coalesce(F.try_element_at(gap, F.lit(1)), F.size("_broken") + 1))
    last = left.select(*ids, "_scope", "_times", "_tested").join(_dealt(broken), list(ids), "left")
    last = last.withColumn("_nth", F.col("_tested") + first).drop("_broken", "_tested")
    last = last.join(_dealt(terms.select("_scope", "_nth", F.struct("priority", "rule_no").alias("_outside"))), ["_scope", "_nth"])
    found.append(last.select(*ids, "_times", "_outside"))
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select(*ids, "_outside")


def winning_rule_of_table(df: DataFrame, rules: DataFrame, scalars: Mapping[str, Column], x: Column | None = None, y: Column | None = None,
                          row_id: Sequence[str] = ("app", "section", "event_id"), most: int = MAX_RULES) -> DataFrame:
    """``policy.winning_rule`` for ``rules`` that are a table of any length: add ``winner``, the satisfied rule of the
    row's (app, section) with the smallest (priority, rule_no), or null. ``row_id`` tells the rows apart."""
    terms = cut_lineage(rule_terms(rules))
    kinds = {(r.kind, r.scalar): r["count"] for r in terms.groupBy("kind", "scalar").count().collect()}
    unknown = sorted({s for _, s in kinds if s is not None} - set(scalars))
    if unknown:
        raise PredicateError(f"unknown data sections {unknown}; known: {', '.join(scalars)}")
    given, found, out = df.columns, [], df
    for number, (kind, scalar) in enumerate(sorted(k for k in kinds if k[0] == "interval")):
        out = _by_interval(out, terms.where((F.col("kind") == kind) & (F.col("scalar") == scalar)), scalars[scalar])
        out = out.withColumnRenamed("_axis", f"_axis{number}")
        found.append(F.col(f"_axis{number}"))
    placed = {k for k, _ in kinds} & {"inside", "outside"}
    if placed and (x is None or y is None):
        raise PredicateError("the context has no location section")
    ids = list(row_id)
    if placed:
        used = {s: F.col(f"_of_{s}") for s in scalars}
        points = df.where(x.isNotNull() & y.isNotNull()).select(*ids, _scope().alias("_scope"), x.alias("_x"), y.alias("_y"),
                                                               *[c.cast("double").alias(f"_of_{s}") for s, c in scalars.items()])
    if "inside" in placed:
        own = terms.where("kind = 'inside'").withColumn("_first", F.try_element_at(F.filter("polygons", lambda p: p["inside"]), F.lit(1)))
        own = own.select(_scope().alias("_scope"), F.struct("priority", "rule_no").alias("rule"), "scalar", "low", "high", "polygons", "_first.xs", "_first.ys")
        out = out.join(_dealt(_best_inside(points, own, ids, used)), ids, "left")
        found.append(F.col("_inside"))
    if "outside" in placed:
        own = terms.where("kind = 'outside'").select(_scope().alias("_scope"), "priority", "rule_no", "polygons")
        plan = plan_slices(own, "_scope", "priority")
        own = cut_lineage(Timeline(["_scope"], ["priority", "rule_no", "polygons"], plan).number(own, "_nth").drop("_slice", "_hot"))
        out = out.join(_dealt(_first_outside(points, own, ids)), ids, "left")
        found.append(F.col("_outside"))
    if any(k == "other" for k, _ in kinds):
        rows = terms.where("kind = 'other'").select("app", "section", "rule_no", "priority", "predicate").limit(most + 1).collect()
        if len(rows) > most:
            raise PredicateError(f"more than {most} alternatives have no index")
        out = winning_rule(out, [Rule(*row, "{}") for row in rows], scalars, x, y).withColumnRenamed("winner", "_other")
        found.append(F.when(F.col("_other").isNotNull(), F.struct("_other.priority", "_other.rule_no")))
    best = F.array_min(F.array_compact(F.array(*found))) if found else F.lit(None)
    return out.withColumn("winner", best.cast("struct<priority:int,rule_no:int>")).select(*[F.col(f"`{c}`") for c in given], "winner")

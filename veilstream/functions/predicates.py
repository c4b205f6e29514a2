"""Predicate JSON -> Column.

A predicate is compiled once on the driver; what runs on the executors is a native boolean
expression, so filters on it can be pruned, pushed and code-generated by Catalyst.

JSON keys: ``logic`` (AND / OR), ``scalar`` (list of comparisons), ``location`` (list of polygon
tests) and ``combined`` (list of nested predicates).
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "EQUAL": operator.eq,
    "NOT_EQUAL": operator.ne,
    "GREATER": operator.gt,
    "LESS": operator.lt,
    "GREATER_EQUAL": operator.ge,
    "LESS_EQUAL": operator.le,
}

_CUSTOM: dict[str, Callable[[Column], Column]] = {}


class PredicateError(ValueError):
    """A predicate description that cannot be compiled."""


def register_predicate(name: str, builder: Callable[[Column], Column]) -> None:
    """Make a user-written test usable as ``{"custom": name, "data section": ...}``."""
    _CUSTOM[name] = builder


def scalar_predicate(value: Column, relation: str, constant: float) -> Column:
    """Compare a scalar with a constant; the relation name is case-insensitive."""
    compare = RELATIONS.get(str(relation).upper())
    if compare is None:
        raise PredicateError(f"unknown relation {relation!r}; known: {', '.join(RELATIONS)}")
    return compare(value, F.lit(float(constant)))


def in_polygon(x: Column, y: Column, xs, ys) -> Column:
    """Non-zero winding test of a point against a polygon that is closed automatically.

    Each edge adds +1 or -1 when a ray going right from the point crosses it. Lower and left edges
    belong to the polygon, upper and right edges do not. Edges that do not change in ``y`` never
    count, so they are dropped here.
    """
    if len(xs) != len(ys):
        raise PredicateError("polygon x and y must have the same number of points")
    if not xs:
        raise PredicateError("polygon has no points")
    corners = [(float(a), float(b)) for a, b in zip(xs, ys)]
    crossings = [
        _crossing(x, y, start, end)
        for start, end in zip(corners, corners[1:] + corners[:1])
        if start[1] != end[1]
    ]
    if not crossings:
        return F.when(x.isNotNull() & y.isNotNull(), F.lit(False))
    box = (
        (x >= min(c[0] for c in corners)) & (x <= max(c[0] for c in corners))
        & (y >= min(c[1] for c in corners)) & (y <= max(c[1] for c in corners))
    )
    # A missing position gives null, which neither IN nor OUT_OF may turn into a hit.
    return F.when(x.isNotNull() & y.isNotNull(), box & (reduce(operator.add, crossings) != 0))


def _crossing(x: Column, y: Column, start, end) -> Column:
    (x0, y0), (x1, y1) = start, end
    direction = 1 if y1 > y0 else -1
    within = (y >= min(y0, y1)) & (y < max(y0, y1))
    if x0 == x1:
        left_of_edge = x < x0
    else:
        at_height = F.lit(x0) + (y - y0) * F.lit((x1 - x0) / (y1 - y0))
        left_of_edge = (x < max(x0, x1)) & ((x < min(x0, x1)) | (x < at_height))
    return F.when(within & left_of_edge, F.lit(direction)).otherwise(F.lit(0))


def location_predicate(x: Column, y: Column, relation: str, shape: Mapping) -> Column:
    """``IN`` / ``OUT_OF`` a polygon given as ``{"x": [...], "y": [...]}``."""
    kind = str(relation).upper()
    if kind not in ("IN", "OUT_OF"):
        raise PredicateError(f"unknown location relation {relation!r}; known: IN, OUT_OF")
    inside = in_polygon(x, y, shape["x"], shape["y"])
    return inside if kind == "IN" else ~inside


def combine(logic: str | None, parts: list[Column]) -> Column:
    """AND / OR over parts; a part over a missing section (null) counts as false."""
    if not parts:
        raise PredicateError("predicate is empty")
    if logic is None:
        if len(parts) > 1:
            raise PredicateError("more than one predicate needs a logic of AND or OR")
        return F.coalesce(parts[0], F.lit(False))
    kind = str(logic).upper()
    if kind not in ("AND", "OR"):
        raise PredicateError(f"logic must be AND or OR, not {logic!r}")
    if len(parts) < 2:
        raise PredicateError(f"a logic of {kind} needs at least two predicates")
    joined = [F.coalesce(part, F.lit(False)) for part in parts]
    return reduce(operator.and_ if kind == "AND" else operator.or_, joined)


def compile_predicate(description: str | Mapping, scalars: Mapping[str, Column],
                      x: Column | None = None, y: Column | None = None) -> Column:
    """Compile a predicate description against the columns of a context.

    ``scalars`` maps each scalar section to its current value; ``x`` and ``y`` are the current
    position. A section the context does not have is an error here, before any row is read.
    """
    spec = json.loads(description) if isinstance(description, str) else description
    parts = [_scalar_leaf(leaf, scalars) for leaf in spec.get("scalar") or []]
    for leaf in spec.get("location") or []:
        if x is None or y is None:
            raise PredicateError("the context has no location section")
        parts.append(location_predicate(x, y, leaf["relation"], leaf["value"]))
    parts += [compile_predicate(nested, scalars, x, y) for nested in spec.get("combined") or []]
    return combine(spec.get("logic"), parts)


def _scalar_leaf(leaf: Mapping, scalars: Mapping[str, Column]) -> Column:
    section = leaf.get("data section")
    if section not in scalars:
        raise PredicateError(f"unknown data section {section!r}; known: {', '.join(scalars)}")
    if "custom" in leaf:
        if leaf["custom"] not in _CUSTOM:
            raise PredicateError(f"no registered predicate {leaf['custom']!r}")
        return _CUSTOM[leaf["custom"]](scalars[section])
    return scalar_predicate(scalars[section], leaf["relation"], leaf["value"])


def holds(spec: Mapping, scalars: Mapping[str, float | None], x: float | None, y: float | None) -> bool:
    """The same test on Python values, for stateful operators that know the context row by row."""
    parts = [_leaf_holds(leaf, scalars[leaf["data section"]]) for leaf in spec.get("scalar") or []]
    parts += [_place_holds(leaf, x, y) for leaf in spec.get("location") or []]
    parts += [holds(nested, scalars, x, y) for nested in spec.get("combined") or []]
    return all(parts) if str(spec.get("logic", "AND")).upper() == "AND" else any(parts)


def function_of(spec: Mapping):
    """``holds`` of one predicate as a function of ``(scalars, x, y)`` that has read the description already. One that
    cannot be read fails where it meets a row, as there."""
    try:
        return _function_of(spec)
    except Exception:  # noqa: BLE001
        return lambda scalars, x, y: holds(spec, scalars, x, y)


def _function_of(spec: Mapping):
    parts = [_leaf_test(leaf) for leaf in spec.get("scalar") or []]
    parts += [_place_test(leaf) for leaf in spec.get("location") or []]
    parts += [_function_of(nested) for nested in spec.get("combined") or []]
    if len(parts) == 1:
        return parts[0]
    if str(spec.get("logic", "AND")).upper() == "AND":
        return lambda scalars, x, y: all([part(scalars, x, y) for part in parts])
    return lambda scalars, x, y: any([part(scalars, x, y) for part in parts])


def _leaf_test(leaf: Mapping):
    if "custom" in leaf:
        raise PredicateError(f"{leaf['custom']!r} is a test on columns")
    section, relation, bound = leaf["data section"], RELATIONS[str(leaf["relation"]).upper()], float(leaf["value"])

    def test(scalars, x, y):
        value = scalars[section]
        return value is not None and bool(relation(value, bound))
    return test


def _place_test(leaf: Mapping):
    corners = [(float(a), float(b)) for a, b in zip(leaf["value"]["x"], leaf["value"]["y"])]
    wanted = str(leaf["relation"]).upper() == "IN"
    edges = [(x0, y0, (x1 - x0) / (y1 - y0), min(y0, y1), max(y0, y1), min(x0, x1), max(x0, x1), 1 if y1 > y0 else -1)
             for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]) if y0 != y1]

    def test(scalars, x, y):
        if x is None or y is None:
            return False
        turns = 0
        for x0, y0, rise, below, above, left, right, way in edges:
            if below <= y < above and x < right and (x < left or x < (x0 if left == right else x0 + (y - y0) * rise)):
                turns += way
        return (turns != 0) == wanted
    return test


def _leaf_holds(leaf: Mapping, value: float | None) -> bool:
    if "custom" in leaf:
        raise PredicateError(f"{leaf['custom']!r} is a test on columns; whole policies on streams need plain tests")
    return value is not None and bool(RELATIONS[str(leaf["relation"]).upper()](value, float(leaf["value"])))


def _place_holds(leaf: Mapping, x: float | None, y: float | None) -> bool:
    if x is None or y is None:
        return False
    corners = [(float(a), float(b)) for a, b in zip(leaf["value"]["x"], leaf["value"]["y"])]
    turns = 0
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        if min(y0, y1) <= y < max(y0, y1):
            at_height = x0 if x0 == x1 else x0 + (y - y0) * ((x1 - x0) / (y1 - y0))
            turns += (1 if y1 > y0 else -1) if x < max(x0, x1) and (x < min(x0, x1) or x < at_height) else 0
    return (turns != 0) == (str(leaf["relation"]).upper() == "IN")


def problem_of(description: str | Mapping | None, scalars: Sequence[str], located: bool = True,
               custom: Sequence[str] | None = None) -> str | None:
    """What ``compile_predicate`` would reject a description for; None if it compiles. Needs no Spark. ``custom`` names
    the registered tests, by default those of this process."""
    known = _CUSTOM if custom is None else custom
    try:
        spec = json.loads(description) if isinstance(description, str) else description
        if not isinstance(spec, Mapping):
            return "not a JSON object"
        for leaf in spec.get("scalar") or []:
            section = leaf.get("data section")
            if section not in scalars:
                return f"unknown data section {section!r}; known: {', '.join(scalars)}"
            if "custom" in leaf:
                if leaf["custom"] not in known:
                    return f"no registered predicate {leaf['custom']!r}"
                continue
            if str(leaf["relation"]).upper() not in RELATIONS:
                return f"unknown relation {leaf['relation']!r}; known: {', '.join(RELATIONS)}"
            float(leaf["value"])
        for leaf in spec.get("location") or []:
            if not located:
                return "the context has no location section"
            if str(leaf["relation"]).upper() not in ("IN", "OUT_OF"):
                return f"unknown location relation {leaf['relation']!r}; known: IN, OUT_OF"
            xs, ys = leaf["value"]["x"], leaf["value"]["y"]
            if len(xs) != len(ys):
                return "polygon x and y must have the same number of points"
            if not xs:
                return "polygon has no points"
            for v in (*xs, *ys):
                float(v)
        nested = spec.get("combined") or []
        for part in nested:
            found = problem_of(part, scalars, located, custom)
            if found:
                return found
        parts, logic = len(spec.get("scalar") or []) + len(spec.get("location") or []) + len(nested), spec.get("logic")
        if not parts:
            return "predicate is empty"
        if logic is None:
            return "more than one predicate needs a logic of AND or OR" if parts > 1 else None
        if str(logic).upper() not in ("AND", "OR"):
            return f"logic must be AND or OR, not {logic!r}"
        return f"a logic of {str(logic).upper()} needs at least two predicates" if parts < 2 else None
    except json.JSONDecodeError:
        return "not a JSON object"
    except (AttributeError, KeyError, TypeError, ValueError) as e:
        return f"malformed predicate: {type(e).__name__}"


def checked(rules: DataFrame, column: str, scalars: Sequence[str], located: bool = True) -> DataFrame:
    """``rules`` with ``problem``: why the description in ``column`` cannot be compiled, null if it can. For policies
    that are tables; a null description is a problem."""
    custom, known = list(_CUSTOM), list(scalars)

    @F.pandas_udf("string")
    def problem(texts: pd.Series) -> pd.Series:
        return pd.Series([problem_of(t, known, located, custom) for t in texts], dtype=object)

    return rules.withColumn("problem", problem(F.col(column)))

import json
import math

import pytest
from pyspark.sql import functions as F

from veilstream.functions.predicates import (PredicateError, compile_predicate, in_polygon,
                                             location_predicate, problem_of, register_predicate, scalar_predicate)


def scalar(relation, value, section="speed"):
    return {"data section": section, "relation": relation, "value": value}


SQUARE = {"x": [0, 10, 10, 0], "y": [0, 0, 10, 10]}


def columns(spark):
    return {"speed": F.col("v")}, F.col("x"), F.col("y")


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, 5.0, 5.0, 5.0), (2, 50.0, 20.0, 5.0), (3, None, 5.0, 5.0), (4, 50.0, None, None),
            (5, float("nan"), 0.0, 0.0)]
    return spark.createDataFrame(data, "id int, v double, x double, y double")


def hits(rows, column):
    return [r.id for r in rows.where(column).orderBy("id").collect()]


def test_polygon_edges_by_hand(spark):
    points = [(0.0, 0.0, True), (0.0, 5.0, True), (5.0, 0.0, True), (10.0, 5.0, False),
              (5.0, 10.0, False), (10.0, 10.0, False), (5.0, 5.0, True), (-1.0, 5.0, False)]
    df = spark.createDataFrame(points, "x double, y double, expected boolean")
    out = df.select("expected", in_polygon(F.col("x"), F.col("y"), SQUARE["x"], SQUARE["y"]).alias("got"))
    assert all(r.expected == r.got for r in out.collect())


def winding(px, py, xs, ys):
    """Angle sum around the point: a different method for points off the edges."""
    total = 0.0
    for i in range(len(xs)):
        a = math.atan2(ys[i] - py, xs[i] - px)
        b = math.atan2(ys[(i + 1) % len(xs)] - py, xs[(i + 1) % len(xs)] - px)
        total += (b - a + math.pi) % (2 * math.pi) - math.pi
    return round(total / (2 * math.pi)) != 0


@pytest.mark.parametrize("xs,ys", [
    ([0, 80, 80, 40, 0], [0, 0, 80, 20, 80]), ([0, 80, 80, 0], [0, 80, 0, 80]),
    ([0, 60, 60, 10, 10, 40, 40, 0], [0, 0, 60, 60, 20, 20, 80, 80]),
    ([10, 50, 0, 40, 25], [0, 60, 20, 10, 70]), ([0, 0, 90], [0, 90, 45])])
def test_polygon_against_angle_sum(spark, xs, ys):
    grid = [(i * 3.7 + 0.13, j * 3.1 + 0.07) for i in range(-3, 28) for j in range(-3, 30)]
    df = spark.createDataFrame(grid, "x double, y double")
    for r in df.select("x", "y", in_polygon(F.col("x"), F.col("y"), xs, ys).alias("got")).collect():
        assert r.got == winding(r.x, r.y, xs, ys), (r.x, r.y)


def test_relations_are_case_insensitive_and_checked(spark, rows):
    assert hits(rows, scalar_predicate(F.col("v"), "greater_EQUAL", 50)) == [2, 4, 5]  # NaN is largest
    with pytest.raises(PredicateError):
        scalar_predicate(F.col("v"), "ABOUT", 1)
    with pytest.raises(PredicateError):
        location_predicate(F.col("x"), F.col("y"), "NEAR", SQUARE)


def test_missing_sections_are_false(spark, rows):
    outside = {"location": [{"relation": "OUT_OF", "value": SQUARE}]}
    assert hits(rows, compile_predicate(outside, *columns(spark))) == [2]
    either = {"logic": "or", "scalar": [scalar("GREATER", 10)],
              "location": [{"relation": "IN", "value": SQUARE}]}
    assert hits(rows, compile_predicate(json.dumps(either), *columns(spark))) == [1, 2, 3, 4, 5]
    both = {**either, "logic": "AND"}
    assert hits(rows, compile_predicate(both, *columns(spark))) == [5]


@pytest.mark.parametrize("bad", [
    {}, {"scalar": [scalar("LESS", 1), scalar("LESS", 2)]}, {"logic": "AND", "scalar": [scalar("LESS", 1)]},
    {"logic": "XOR", "scalar": [scalar("LESS", 1), scalar("LESS", 2)]},
    {"scalar": [scalar("LESS", 1, "altitude")]}, {"scalar": [scalar("NEARLY", 1)]},
    {"location": [{"relation": "IN", "value": {"x": [0, 1], "y": [0]}}]},
    {"scalar": [{"data section": "speed", "custom": "unheard-of"}]}])
def test_bad_descriptions(spark, bad):
    with pytest.raises(PredicateError):
        compile_predicate(bad, *columns(spark))


def test_location_needs_a_position(spark):
    with pytest.raises(PredicateError):
        compile_predicate({"location": [{"relation": "IN", "value": SQUARE}]}, {"speed": F.col("v")})


def test_registered_predicate(spark, rows):
    register_predicate("even", lambda v: v % 10 == 0)
    custom = {"scalar": [{"data section": "speed", "custom": "even"}]}
    assert hits(rows, compile_predicate(custom, *columns(spark))) == [2, 4]


def test_nested(spark, rows):
    nested = {"logic": "AND", "scalar": [scalar("GREATER", 1)], "combined": [
        {"logic": "OR", "scalar": [scalar("LESS", 10), scalar("EQUAL", 50)]}]}
    assert hits(rows, compile_predicate(nested, *columns(spark))) == [1, 2, 4]


def test_python_twin_agrees(spark):
    """``holds`` on Python values and the compiled Column give the same for every context."""
    import itertools
    import json
    from veilstream.functions.predicates import compile_predicate, holds
    shape = {"x": [0, 8, 8, 4, 0], "y": [0, 0, 8, 2, 8]}
    specs = [{"scalar": [{"data section": "speed", "relation": r, "value": 5}]} for r in ("EQUAL", "not_equal", "LESS", "GREATER_EQUAL")]
    specs += [{"location": [{"relation": r, "value": shape}]} for r in ("IN", "OUT_OF")]
    specs += [{"logic": logic, "scalar": [{"data section": "speed", "relation": "GREATER", "value": 4}],
               "location": [{"relation": "IN", "value": shape}], "combined": [specs[0]]} for logic in ("AND", "or")]
    contexts = list(itertools.product([None, 4.0, 5.0, 6.0], [None, 0.0, 3.0, 4.0, 8.0], [None, 0.0, 2.0, 5.0, 8.0]))
    df = spark.createDataFrame(contexts, "v double, x double, y double")
    rows = df.select("*", *[compile_predicate(json.dumps(s), {"speed": F.col("v")}, F.col("x"), F.col("y")).alias(f"p{i}")
                            for i, s in enumerate(specs)]).collect()
    for r in rows:
        assert [r[f"p{i}"] for i in range(len(specs))] == [holds(s, {"speed": r.v}, r.x, r.y) for s in specs]


def test_boolean_parameters():
    from veilstream.functions.petspec import PetSpec, pet_json
    for value, want in ((True, True), (False, False), ("false", False), ("TRUE", True)):
        assert PetSpec.from_json(pet_json("p", [("Boolean", value)])).params == (want,)
    assert PetSpec.from_json(pet_json("p", [("Boolean", True)])).label == "ptrue"
    with pytest.raises(ValueError):
        PetSpec.from_json(pet_json("p", [("Boolean", "maybe")]))


@pytest.mark.parametrize("text", [
    '{"scalar": [{"data section": "speed", "relation": "LESS", "value": 3}]}', '{}', '{"logic": "AND"}',
    '{"scalar": [{"data section": "fuel", "relation": "LESS", "value": 3}]}',
    '{"scalar": [{"data section": "speed", "relation": "NEAR", "value": 3}]}',
    '{"scalar": [{"data section": "speed", "custom": "nobody"}]}',
    '{"logic": "OR", "scalar": [{"data section": "speed", "relation": "LESS", "value": 3}]}',
    '{"logic": "NOT", "scalar": [{"data section": "speed", "relation": "LESS", "value": 3}, {"data section": "speed", "relation": "LESS", "value": 4}]}',
    '{"location": [{"relation": "NEAR", "value": {"x": [1], "y": [1]}}]}', '{"location": [{"relation": "IN", "value": {"x": [1, 2], "y": [1]}}]}',
    '{"location": [{"relation": "OUT_OF", "value": {"x": [], "y": []}}]}', '{"combined": [{}]}',
    '{"combined": [{"scalar": [{"data section": "speed", "relation": "LESS", "value": 3}]}]}'])
def test_problem_is_what_compiling_rejects(spark, text):
    try:
        compile_predicate(text, {"speed": F.col("v")}, F.col("x"), F.col("y"))
        want = None
    except PredicateError as e:
        want = str(e)
    assert problem_of(text, ["speed"]) == want


def test_problem_of_broken_documents(spark):
    assert [problem_of(t, ["speed"]) for t in (None, "", "[1]", "[", "3")] == ["not a JSON object"] * 5
    assert problem_of('{"scalar": [{"data section": "speed", "relation": "LESS", "value": "fast"}]}', ["speed"]) == "malformed predicate: ValueError"
    assert problem_of('{"scalar": [3]}', ["speed"]) == "malformed predicate: AttributeError"


def test_functions_of_predicates():
    """A description that was read once gives what reading it at every row gives, errors included."""
    import random
    from veilstream.functions.predicates import function_of, holds
    r = random.Random(5)
    leaves = [{"scalar": [{"data section": "speed", "relation": k, "value": v}]} for k in ("equal", "NOT_EQUAL", "LESS", "GREATER_EQUAL") for v in (1, "2.5")]
    leaves += [{"location": [{"relation": k, "value": {"x": [0, 4, 4, 2, 0], "y": [0, 0, 4, 1, 4]}}]} for k in ("IN", "out_of")]
    specs = [*leaves, *({"logic": r.choice(["and", "OR"]), "combined": r.sample(leaves, 2), **r.choice(leaves)} for _ in range(40)), {"combined": []}]
    for spec in specs:
        test = function_of(spec)
        for _ in range(60):
            row = {"speed": r.choice([None, 0.0, 1.0, 2.5, 9.0])}, r.choice([None, 0.0, 1.0, 2.0, 3.5, 4.0, 5.0]), r.choice([0.0, 0.5, 1.0, 3.0, 4.0])
            assert test(*row) == holds(spec, *row)
    for wrong in ({"scalar": [{"data section": "speed", "custom": "even"}]}, {"scalar": [{"data section": "fuel", "relation": "LESS", "value": 1}]},
                  {"scalar": [{"data section": "speed", "relation": "LIKE", "value": 1}]}):
        for test in (function_of(wrong), lambda *row: holds(wrong, *row)):
            with pytest.raises((PredicateError, KeyError)):
                test({"speed": 1.0}, None, None)

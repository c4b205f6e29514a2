"""Rules that are a table must give what the compiled rules give."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilstream.functions.predicates import PredicateError
from veilstream.operators import rule_index
from veilstream.operators.policy import Rule, rule_table, winning_rule
from veilstream.operators.rule_index import interval_cells, rule_terms, winning_rule_of_table

RELATIONS = ("EQUAL", "NOT_EQUAL", "GREATER", "LESS", "GREATER_EQUAL", "LESS_EQUAL")
VALUES = [-1.5, 0.0, 1.0, 2.5, 2.75, 7.0, 50.0]


def scalar(r):
    return {"data section": "speed", "relation": r.choice(RELATIONS), "value": r.choice(VALUES)}


def polygon(r):
    n = r.choice([3, 4, 4, 5])
    return {"x": [r.choice([0, 1, 2, 3, 8, 40]) for _ in range(n)], "y": [r.choice([0, 1, 2, 3, 8, 40]) for _ in range(n)]}


def place(r, kinds=("IN", "OUT_OF")):
    return {"relation": r.choice(kinds), "value": polygon(r)}


def predicate(r, depth=0):
    form = r.randrange(7 if depth < 2 else 5)
    if form == 0:
        return {"scalar": [scalar(r)]}
    if form == 1:
        return {"logic": "AND", "scalar": [scalar(r), scalar(r)]}
    if form == 2:
        return {"location": [place(r)]}
    if form == 3:
        return {"logic": "AND", "scalar": [scalar(r)], "location": [place(r, ("IN",))]}
    if form == 4:
        return {"logic": r.choice(["AND", "OR"]), "location": [place(r), place(r)]}
    if form == 5:
        return {"logic": r.choice(["AND", "OR"]), "combined": [predicate(r, depth + 1), predicate(r, depth + 1)]}
    return {"logic": "OR", "scalar": [scalar(r)], "location": [place(r)]}


def contexts(spark, r, n=150):
    rows = [(i, r.choice(["a", "b", "c"]), r.choice(["speed", "location"]), r.choice([*VALUES, 1.75, None]),
             r.choice([0.0, 0.5, 1.0, 2.0, 5.0, 20.0, None]), r.choice([0.0, 0.5, 1.0, 2.5, 8.0, 33.0])) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, app string, section string, v double, px double, py double")


def won(df):
    return {r.event_id: None if r.winner is None else (r.winner.priority, r.winner.rule_no) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_compiled_rules(spark, seed):
    r = random.Random(seed)
    rules = [Rule(r.choice(["a", "b"]), r.choice(["speed", "location"]), i, r.randrange(4), json.dumps(predicate(r)), "{}") for i in range(45)]
    df, columns = contexts(spark, r), ({"speed": F.col("v")}, F.col("px"), F.col("py"))
    indexed = winning_rule_of_table(df, rule_table(spark, rules), *columns)
    assert indexed.columns == [*df.columns, "winner"]
    assert won(indexed) == won(winning_rule(df, rules, *columns))


def test_cells_are_as_many_as_thresholds(spark):
    """Overlapping intervals: the table of cells grows with the thresholds, each with its winner."""
    r = random.Random(8)
    spans = [sorted(r.sample(range(1000), 2)) for _ in range(300)]
    rules = [Rule("a", "speed", i, r.randrange(50), json.dumps({"logic": "AND", "scalar": [
        {"data section": "speed", "relation": "GREATER_EQUAL", "value": a}, {"data section": "speed", "relation": "LESS", "value": b}]}), "{}") for i, (a, b) in enumerate(spans)]
    cells = interval_cells(rule_terms(rule_table(spark, rules))).collect()
    assert len(cells) == len({x for span in spans for x in span})
    for cell in cells:
        over = [(rule.priority, rule.rule_no) for rule, (a, b) in zip(rules, spans) if a <= cell._value < b]
        assert (None if cell.winner is None else tuple(cell.winner)) == min(over, default=None)


def test_no_row_meets_all_rules(spark):
    """Neither the plan nor the driver holds the rules; no nested loop."""
    rules = spark.range(3000).select(F.lit("a").alias("app"), F.lit("speed").alias("section"), F.col("id").cast("int").alias("priority"),
                                     F.col("id").cast("int").alias("rule_no"),
                                     F.format_string('{"scalar": [{"data section": "speed", "relation": "GREATER", "value": %d}]}', "id").alias("predicate"))
    df = spark.createDataFrame([(i, "a", "speed", float(i)) for i in (0, 1, 2, 2999, 5000)], "event_id long, app string, section string, v double")
    out = winning_rule_of_table(df, rules, {"speed": F.col("v")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and len(plan) < 20_000
    assert won(out) == {0: None, 1: (0, 0), 2: (0, 0), 2999: (0, 0), 5000: (0, 0)}


def test_errors(spark):
    df = spark.createDataFrame([(1, "a", "speed", 1.0)], "event_id long, app string, section string, v double")

    def run(predicate, **options):
        rules = rule_table(spark, [Rule("a", "speed", 1, 1, json.dumps(predicate), "{}")])
        return winning_rule_of_table(df, rules, {"speed": F.col("v")}, **options).collect()
    with pytest.raises(PredicateError):  # no position in the context
        run({"location": [{"relation": "IN", "value": {"x": [0, 1, 1], "y": [0, 0, 1]}}]})
    with pytest.raises(PredicateError):  # an unknown section
        run({"scalar": [{"data section": "height", "relation": "LESS", "value": 1}]})
    for wrong in ({}, {"logic": "XOR", "scalar": [{"data section": "speed", "relation": "LESS", "value": 1}] * 2},
                  {"scalar": [{"data section": "speed", "relation": "LIKE", "value": 1}]}):
        with pytest.raises(Exception, match="PredicateError"):
            run(wrong)


def test_terms_without_an_index_are_bounded(spark):
    both = {"logic": "AND", "scalar": [{"data section": "speed", "relation": "LESS", "value": 9}],
            "location": [{"relation": "OUT_OF", "value": {"x": [0, 1, 1], "y": [0, 0, 1]}}]}
    rules = rule_table(spark, [Rule("a", "speed", i, 1, json.dumps(both), "{}") for i in range(3)])
    df = contexts(spark, random.Random(1), 5)
    with pytest.raises(PredicateError):
        winning_rule_of_table(df, rules, {"speed": F.col("v")}, F.col("px"), F.col("py"), most=2)
    assert rule_index.winning_rule_of_table(df, rules.limit(0), {"speed": F.col("v")}).where("winner is not null").count() == 0


def test_no_join_goes_through_the_driver(spark):
    """Rules and readings may be small files and many rows: no side of a join is broadcast, whatever Spark expects of it."""
    square = '{"x": [0, 9, 9, 0], "y": [0, 0, 9, 9]}'
    texts = ['{"scalar": [{"data section": "speed", "relation": "GREATER", "value": 5}]}',
             '{"location": [{"relation": "IN", "value": %s}]}' % square, '{"location": [{"relation": "OUT_OF", "value": %s}]}' % square]
    rules = spark.createDataFrame([("app1", "speed", i, i, text) for i, text in enumerate(texts)],
                                  "app string, section string, priority int, rule_no int, predicate string")
    rows = spark.createDataFrame([("app1", "speed", i, float(i), float(i), 1.0) for i in range(20)],
                                 "app string, section string, event_id long, scalar double, x double, y double")
    won = winning_rule_of_table(rows, rules, {"speed": F.col("scalar")}, F.col("x"), F.col("y"))
    assert {r.event_id: r.winner.rule_no for r in won.collect()} == {i: 0 if i > 5 else 1 for i in range(20)}
    plan = won._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_rounds_of_terms(spark, seed, monkeypatch):
    """Readings that find nothing among the best terms go on to others, in smaller cells, and in the end to all."""
    monkeypatch.setattr(rule_index, "BEST", (1, 2))
    monkeypatch.setattr(rule_index, "FIRST", (1, 1))
    r = random.Random(100 + seed)

    def texts():
        x, y, w, h = r.randrange(12), r.randrange(12), r.choice([1, 2, 6]), r.choice([1, 3])
        yield {"location": [{"relation": "IN", "value": {"x": [x, x + w, x + w], "y": [y, y, y + h]}}]}
        yield {"location": [{"relation": "OUT_OF", "value": {"x": [x, x + 9, x + 9, x], "y": [0, 0, 20, 20]}}]}
        yield {"logic": "AND", "scalar": [scalar(r)], "location": [place(r, ("IN",))]}
    rules = [Rule(r.choice(["a", "b"]), "location", i, r.randrange(6), json.dumps(text), "{}") for i, text in enumerate(t for _ in range(16) for t in texts())]
    rows = [(i, r.choice(["a", "b", "c"]), "location", r.choice([*VALUES, None]), r.choice([None, *range(14)]) if i % 9 else None, r.random() * 14) for i in range(120)]
    df = spark.createDataFrame([(*a, None if px is None else px + r.choice([0.0, 0.5]), py) for *a, px, py in rows],
                               "event_id long, app string, section string, v double, px double, py double")
    columns = ({"speed": F.col("v")}, F.col("px"), F.col("py"))
    assert won(winning_rule_of_table(df, rule_table(spark, rules), *columns)) == won(winning_rule(df, rules, *columns))


def test_readings_do_not_meet_all_terms_that_hold(spark, monkeypatch):
    """Polygons that overlap everywhere: a reading is tested against the best few of its cell, not against all."""
    box = {"x": [0, 8, 8, 0], "y": [0, 0, 8, 8]}
    rules = [Rule("a", "location", i, i, json.dumps({"location": [{"relation": k, "value": box if k == "IN" else {"x": [50, 58, 58], "y": [0, 0, 8]}}]}), "{}")
             for i, k in enumerate(["IN", "OUT_OF"] * 300)]
    sizes, cut = [], rule_index.cut_lineage
    monkeypatch.setattr(rule_index, "cut_lineage", lambda df: sizes.append(cut(df)) or sizes[-1])
    df = spark.createDataFrame([(i, "a", "location", 0.0, float(i % 8), float(i % 7)) for i in range(200)],
                               "event_id long, app string, section string, v double, px double, py double")
    out = winning_rule_of_table(df, rule_table(spark, rules), {"speed": F.col("v")}, F.col("px"), F.col("py"))
    assert won(out) == dict.fromkeys(range(200), (0, 0))
    met = [d.count() for d in sizes if "_hit" in d.columns]
    assert met[0] == 200 and sum(met) == 400  # one row for each reading and index, found in the first round


def test_readings_that_share_an_id(spark):
    """The first number that none of them breaks, for each of them."""
    square = {"x": [0, 1, 1, 0], "y": [0, 0, 1, 1]}
    far = {"x": [5, 6, 6, 5], "y": [0, 0, 1, 1]}
    rules = [Rule("a", "location", i, i, json.dumps({"location": [{"relation": "OUT_OF", "value": v}]}), "{}") for i, v in enumerate([square, far, square, {"x": [9, 10, 9], "y": [0, 0, 1]}])]
    df = spark.createDataFrame([(1, "a", "location", 0.0, 0.5, 0.5), (1, "a", "location", 0.0, 5.5, 0.5), (2, "a", "location", 0.0, 0.5, 0.5), (2, "a", "location", 0.0, 0.5, 0.5)],
                               "event_id long, app string, section string, v double, px double, py double")
    out = winning_rule_of_table(df, rule_table(spark, rules), {"speed": F.col("v")}, F.col("px"), F.col("py"))
    assert won(out) == {1: (3, 3), 2: (1, 1)}

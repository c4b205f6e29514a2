"""Sliced keys must give what the plain window gives, wherever the cuts are."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veilstream.operators.context import ORDER, dedupe_readings
from veilstream.operators.pets.speed import Corridor, speed_anonymizer
from veilstream.operators.timeline import SlicePlan, Timeline, plan_slices
from veilstream.plans import pipelines
from veilstream.sources.history import warmup_piece, warmup_time, warmup_totals
from workload.fixtures import SPEED_RULES

PLAIN = SlicePlan("vehicle_id", "generate_ms")


def readings(spark, seed, hot_share=0.6, n=400):
    rng = random.Random(seed)
    rows = []
    for event_id in range(n):
        vehicle = 0 if rng.random() < hot_share else rng.randrange(1, 6)
        # bursts, ties and long gaps
        ms = rng.choice([rng.randrange(50), rng.randrange(1000), rng.randrange(10 ** 9)])
        value = None if rng.random() < 0.4 else round(rng.random() * 100, 2)
        rows.append((vehicle, event_id, ms, value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "vehicle_id long, event_id long, generate_ms long, v double")


def rows_of(df, *columns):
    return sorted(df.select("event_id", *columns).collect())


@pytest.mark.parametrize("seed,target", [(1, 15), (2, 60), (3, 150)])
def test_sliced_equals_plain(spark, seed, target):
    df = readings(spark, seed).cache()
    plan = plan_slices(df, target_rows=target)
    assert plan.sliced
    plain, sliced = (Timeline(["vehicle_id"], ORDER, p) for p in (PLAIN, plan))
    for inclusive in (True, False):
        last = {"last": F.col("v")}
        assert (rows_of(plain.last_known(df, last, inclusive), "last")
                == rows_of(sliced.last_known(df, last, inclusive), "last"))
    assert rows_of(plain.number(df, "n"), "n") == rows_of(sliced.number(df, "n"), "n")
    total = {"total": F.when(F.col("v") > 50, 1).otherwise(0)}
    assert rows_of(plain.running_sum(df, total), "total") == rows_of(sliced.running_sum(df, total), "total")

    def frame(rows, ordered, whole):
        held = F.collect_list(F.coalesce("v", F.lit(-1.0))).over(ordered.rowsBetween(-6, 0))
        return rows.withColumn("held", held)

    assert (rows_of(plain.last_rows(df, 7, ["v"], frame), "held")
            == rows_of(sliced.last_rows(df, 7, ["v"], frame), "held"))


def test_frame_wider_than_slices(spark):
    """A frame may reach back over many slices that hold one row each."""
    df = spark.createDataFrame([(0, i, i * 1000) for i in range(40)],
                               "vehicle_id long, event_id long, generate_ms long")
    plan = plan_slices(df, target_rows=2)
    line = Timeline(["vehicle_id"], ORDER, plan)
    out = line.last_rows(df, 10, ["event_id"], lambda rows, w, _: rows.withColumn(
        "first", F.min("event_id").over(w.rowsBetween(-9, 0))))
    assert [r.first for r in out.orderBy("event_id").collect()] == [max(0, i - 9) for i in range(40)]


def test_slices_are_monotone_and_split_the_hot_key(spark):
    df = readings(spark, 5, n=2000)
    plan = plan_slices(df, target_rows=100)
    rows = plan.assign(df).where("vehicle_id = 0").orderBy("generate_ms").collect()
    assert [r._slice for r in rows] == sorted(r._slice for r in rows)
    assert len({r._slice for r in rows}) >= 5
    cold = plan.assign(df).where("not _hot").select("_slice").distinct().collect()
    assert all(r._slice == 0 for r in cold)


def test_no_hot_key_means_no_slices(spark):
    df = readings(spark, 6)
    plan = plan_slices(df, target_rows=10_000)
    assert not plan.sliced
    text = (Timeline(["vehicle_id"], ORDER, plan).last_known(df, {"l": F.col("v")})
            ._jdf.queryExecution().executedPlan().toString())
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_times_outside_the_planned_range(spark):
    df = readings(spark, 7)
    plan = plan_slices(df.where("generate_ms between 10 and 500"), target_rows=20)
    plain, sliced = (Timeline(["vehicle_id"], ORDER, p) for p in (PLAIN, plan))
    assert rows_of(plain.number(df, "n"), "n") == rows_of(sliced.number(df, "n"), "n")


def test_plan_must_fit_the_keys(spark):
    plan = plan_slices(readings(spark, 8), target_rows=20)
    with pytest.raises(ValueError):
        Timeline(["app"], ORDER, plan)
    with pytest.raises(ValueError):
        Timeline(["vehicle_id"], ["event_id"], plan)


def test_dedupe_over_slice_borders(spark):
    df = readings(spark, 9).withColumns({"app": F.lit("a"), "section": F.lit("s")})
    plan = plan_slices(df, target_rows=20)
    assert rows_of(dedupe_readings(df, PLAIN)) == rows_of(dedupe_readings(df, plan))


def test_running_sums_keep_their_type(spark):
    df = readings(spark, 10).withColumn("v", F.round(F.coalesce("v", F.lit(0.0)) * 4) / 4)
    plan = plan_slices(df, target_rows=20)
    for value in (F.col("v"), F.col("event_id"), F.col("event_id").cast("int"), F.col("v").cast("decimal(10,2)")):
        plain, sliced = (Timeline(["vehicle_id"], ORDER, p).running_sum(df, {"total": value}) for p in (PLAIN, plan))
        assert plain.schema["total"].dataType == sliced.schema["total"].dataType
        assert rows_of(plain, "total") == rows_of(sliced, "total")


def test_rows_without_a_key_are_sliced(spark):
    df = readings(spark, 11).withColumn("vehicle_id", F.when(F.col("vehicle_id") > 0, F.col("vehicle_id")))
    plan = plan_slices(df, target_rows=20)
    sizes = plan.assign(df).where("vehicle_id is null").groupBy("_slice").count().collect()
    assert len(sizes) > 5
    plain, sliced = (Timeline(["vehicle_id"], ORDER, p) for p in (PLAIN, plan))
    assert rows_of(plain.number(df, "n"), "n") == rows_of(sliced.number(df, "n"), "n")
    assert (rows_of(plain.last_known(df, {"l": F.col("v")}), "l") == rows_of(sliced.last_known(df, {"l": F.col("v")}), "l"))


@pytest.mark.parametrize("target,most", [(100, 200), (20, 40)])
def test_clumped_times_are_cut_by_their_rows(spark, target, most):
    """64 clumps of 125 rows each, far apart; the second case takes two rounds of quantiles."""
    df = spark.range(8000).select(F.lit(0).cast("long").alias("vehicle_id"), F.col("id").alias("event_id"),
                                  ((F.col("id") % 64) * 10 ** 9 + F.col("id")).alias("generate_ms"))
    plan = plan_slices(df, target_rows=target)
    assert max(r["count"] for r in plan.assign(df).groupBy("_slice").count().collect()) <= most
    out = Timeline(["vehicle_id"], ORDER, plan).number(df, "n")
    assert [r.n for r in out.orderBy("generate_ms").collect()] == list(range(1, 8001))


def test_copies_make_smaller_slices(spark):
    df = readings(spark, 12)
    assert not plan_slices(df, target_rows=300).sliced
    assert plan_slices(df, target_rows=300, copies=10).sliced


def test_assigned_rows_meet_others(spark):
    """A table that has slices already, put together with one that has none."""
    from veilstream.operators.enforce import active_pet
    df = readings(spark, 13).withColumns({"app": F.lit("a"), "section": F.lit("speed")})
    decided = df.where("event_id % 7 = 0").select(
        F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("decision_id"), "app", "vehicle_id", "section",
        F.col("event_id").alias("trigger_event_id"), F.col("generate_ms").alias("generation_ms"),
        F.lit("none").alias("pet_label"))
    plan = plan_slices(df, target_rows=20)
    want = rows_of(active_pet(df, decided, PLAIN), "decision_id")
    assert rows_of(active_pet(df, decided, plan), "decision_id") == want
    assert rows_of(active_pet(plan.assign(df), decided, plan), "decision_id") == want
    both = plan.assign(df).unionByName(df, allowMissingColumns=True)
    with pytest.raises(Exception, match="no slice"):
        Timeline(["vehicle_id"], ORDER, plan).number(both, "n").collect()


def nulls(spark, n=600):
    """Half of the rows have no vehicle."""
    rng = random.Random(11)
    rows = [(None if i % 2 else i % 5, i, rng.randrange(10 ** 7), rng.random() * 90) for i in range(n)]
    return spark.createDataFrame(rows, "vehicle_id long, event_id long, generate_ms long, scalar double").withColumns(
        {"section": F.lit("speed"), "app": F.lit("app1")})


def test_rows_without_a_key_are_a_hot_key(spark):
    """No sliced operator loses them or gives them other values."""
    df = nulls(spark)
    plan = plan_slices(df, target_rows=25)
    assert plan.sliced and plan.cuts.where("vehicle_id is null").count() == 1
    limiter = Corridor(0.0, 120.0, 10.0, 3_600_000, 10.0, sampler="mode")
    shown = F.round("processed_scalar", 9)  # composed starts of the limiter are rounded once more
    for run in (lambda p: speed_anonymizer(df, limiter, p).select("event_id", shown),
                lambda p: speed_anonymizer(df, replace(limiter, sampler="beta"), p).select("event_id", "processed_scalar"),
                lambda p: pipelines.enforce_speed(df, SPEED_RULES, p).select("app", "event_id", "pet_label", shown),
                lambda p: Timeline(["vehicle_id"], ORDER, p).number(df, "n").select("event_id", "n"),
                lambda p: dedupe_readings(df, p, keys=["vehicle_id"]).select("event_id"),
                lambda p: warmup_piece(df.where("event_id % 7 = 0"), df, 4, p).select("trigger_event_id", "event_id", "back"),
                lambda p: warmup_totals(df.where("event_id % 7 = 0"), df, 60, p).select("trigger_event_id", "n", "total")):
        plain, sliced = (sorted(map(str, run(p).collect())) for p in (PLAIN, plan))
        assert plain == sliced and plain


def test_history_of_rows_without_a_vehicle(spark):
    history = nulls(spark, 40)
    triggers = history.where("event_id in (38, 39)")
    for found in (warmup_piece(triggers, history, 3, PLAIN), warmup_time(triggers, history, 100_000)):
        assert {r.trigger_event_id for r in found.collect()} == {38, 39}


def test_large_tables_of_cuts_are_not_broadcast(spark):
    """Rows of a hot key are dealt out before they meet its cuts, with the same slices."""
    df = readings(spark, 3)
    plan = plan_slices(df, target_rows=20)
    table = spark.createDataFrame(plan.cuts.collect(), plan.cuts.schema).hint("merge")  # without the hint to broadcast
    salted = replace(plan, broadcast=False, cuts=table)
    assert plan.broadcast and sorted(plan.assign(df).collect()) == sorted(salted.assign(df).select(plan.assign(df).columns).collect())
    text = salted.assign(df)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in text.split("Exchange hashpartitioning(", 1)[1].split("ENSURE", 1)[0]


def test_nothing_is_written_when_no_key_is_hot(spark, monkeypatch):
    from veilstream.operators import timeline
    monkeypatch.setattr(timeline, "cut_lineage", lambda df: (_ for _ in ()).throw(AssertionError("written")))
    assert not plan_slices(readings(spark, 4), target_rows=10_000).sliced

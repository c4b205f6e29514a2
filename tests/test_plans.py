"""Shapes of physical plans: exchanges, pruning, pushdown, no Python where Columns suffice."""

import re

import pytest
from pyspark.sql import functions as F

from veilstream.operators.pets.dummies import rank_places
from veilstream.operators.policy import for_defined_sections, rule_table, rules_of, winning_rule
from veilstream.operators.timeline import SlicePlan, plan_slices
from veilstream.plans import pipelines
from workload import registered
from workload.fixtures import (LOCATION_RULES, MIXED_RULES, SPEED_RULES, mixed_readings, skewed_readings,
                               speed_readings)

PLAIN = SlicePlan("vehicle_id", "generate_ms")
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "PythonMapInArrow",
          "FlatMapGroupsInPandas", "AttachDistributedSequence")
# Queries whose recursion, random sets or frames need Python.
WITH_PYTHON = {"rejected_descriptions", "rate_limited_speed", "rate_limited_speed_hot_vehicle", "rate_limited_speed_from_zero",
               "noisy_speed", "noisy_speed_properties", "noisy_speed_hot_vehicle", "dummy_locations", "dummy_location_properties",
               "place_count_totals", "updated_place_counts", "interval_probabilities",
               "pixelated_frames", "blurred_frames", "redacted_byte_frames", "enforced_images"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(plan, operator):
    return len(re.findall(rf"(?m)^[ :+\-|*()0-9]*{operator}\b", plan))


def test_speed_enforcement_has_one_exchange(spark, sf_dir):
    plan = plan_of(pipelines.enforce_speed(speed_readings(spark, sf_dir), SPEED_RULES, PLAIN))
    assert count(plan, "Exchange") == 1 and count(plan, "Sort") == 1
    assert not any(p in plan for p in PYTHON) and "Join" not in plan


def test_all_policies_have_one_exchange_and_one_scan(spark, sf_dir):
    plan = plan_of(pipelines.run_policies(mixed_readings(spark, sf_dir), MIXED_RULES, PLAIN))
    assert count(plan, "Exchange") == 1 and count(plan, "FileScan") == 1
    assert not any(p in plan for p in PYTHON)


def test_scan_reads_needed_columns_and_filters(spark, sf_dir, tmp_path):
    path = str(tmp_path / "readings")
    mixed_readings(spark, sf_dir).withColumn("app", F.lit("app1")).write.parquet(path)
    df = spark.read.parquet(path)
    plan = plan_of(winning_rule(for_defined_sections(df, LOCATION_RULES), LOCATION_RULES)
                   .select("event_id", "winner"))
    schema = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert schema == ("section:string,event_id:bigint,location:struct<x:double,y:double>,app:string")
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "EqualTo(app,app1)" in pushed and "EqualTo(section,location)" in pushed


@pytest.mark.parametrize("name", sorted(
    n for n in registered()[0] if n not in WITH_PYTHON and not n.startswith("streamed_")))
def test_no_python_and_no_cartesian_product(spark, sf_dir, name):
    plan = plan_of(registered()[0][name](spark, sf_dir))
    assert not any(p in plan for p in PYTHON), name
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_nothing_is_gathered_into_one_partition(spark, sf_dir):
    """Except the sizes of distinct amounts, as long as they are fewer than one slice holds."""
    for name, query in registered()[0].items():
        if name not in WITH_PYTHON and not name.startswith(("streamed_", "ranked_places")):
            assert "Exchange SinglePartition" not in plan_of(query(spark, sf_dir)), name


def test_many_distinct_amounts_are_sliced(spark):
    """Ranks are the same whether the sizes of distinct amounts are summed in one task or in slices."""
    places = spark.range(500).select(F.col("id").alias("place_id"), (F.col("id") * 7 % 500).alias("amount"))
    for target in (1000, 50):
        rows = rank_places(places, target_rows=target).collect()
        assert all(r["rank"] == r.amount for r in rows) and len(rows) == 500


def test_hot_vehicle_is_spread(spark, sf_dir):
    """With slices, no window of the pipeline has a partition with a third of the rows."""
    df = skewed_readings(spark, sf_dir)
    plan = plan_slices(df, target_rows=20)
    sizes = plan.assign(df).groupBy("vehicle_id", "_slice").count().agg(F.max("count")).collect()[0][0]
    assert sizes <= 60 and df.where("vehicle_id = -1").count() > 300
    text = plan_of(pipelines.enforce_speed(df, SPEED_RULES, plan))
    for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text):
        assert "_slice" in keys or "vehicle_id" in keys


def test_policies_are_bounded(spark):
    with pytest.raises(ValueError):
        rules_of(rule_table(spark, SPEED_RULES), most=3)
    assert len(rules_of(rule_table(spark, SPEED_RULES[:3]), most=3)) == 3


def test_all_policies_with_a_hot_vehicle(spark, sf_dir):
    """Slices must not change what the whole pipeline publishes."""
    df = mixed_readings(spark, sf_dir).withColumn(
        "vehicle_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long"))
        .otherwise(F.col("vehicle_id")))
    plan = plan_slices(df, target_rows=20)
    assert plan.sliced

    def published(with_plan):
        out = pipelines.run_policies(df, MIXED_RULES, with_plan)
        return sorted(map(str, out.select(
            "app", "section", "event_id", "pet_label", F.round("processed_scalar", 6),
            F.round("processed_location.x", 4), F.hex("processed_image")).collect()))

    assert published(plan) == published(PLAIN)


def test_hot_pipelines_read_their_input_once(spark, sf_dir):
    """Hot rows come from the shared folder: the readings are scanned once for the ordinary vehicles."""
    from workload.enforce import _hot_policies
    plan, published = _hot_policies(spark, sf_dir)
    assert plan.sliced
    assert count(plan_of(published), "FileScan") <= 2
    assert count(plan_of(pipelines.reassemble_policies(published, plan)), "FileScan") <= 2

"""Streams must give the batch result in any arrival order, across restarts."""

import time

import pytest
from pyspark.sql import functions as F

from veilstream.functions.petspec import PetSpec, pet_json
from veilstream.operators.context import latest_context
from veilstream.operators.enforce import enforce
from veilstream.operators.policy import Rule, rule_table
from veilstream.operators.timeline import SlicePlan
from veilstream.plans import pipelines
from veilstream.streaming import in_order
from workload.enforce import FORCED
from workload.fixtures import (LOCATION_RULES, SPEED_RULES, _speed_rule, forced_decisions, points,
                               readings_of_app, speed_readings)

PLAIN = SlicePlan("vehicle_id", "generate_ms")
APPS = ["app1", "app2", "app3"]
FAR = 4_000_000_000_000  # a time that moves the watermark past everything


def closing_row(df):
    """One row of a vehicle of its own, far in the future."""
    row = df.limit(1).withColumn("vehicle_id", F.lit(-99).cast("long"))
    time = "generate_ms" if "generate_ms" in df.columns else "generation_ms"
    return row.withColumn(time, F.lit(FAR))


def shuffled(df, path, parts, seed=1):
    """Files that each hold rows from all over the time range."""
    df.orderBy(F.rand(seed)).repartition(parts).write.mode("append").parquet(path)


def as_stream(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def bag(df, *columns):
    return sorted(map(str, df.where("vehicle_id <> -99").select(*columns).collect()))


SPEED_OUT = ("app", "vehicle_id", "event_id", "pet_label", "processed")


def published(df):
    return df.withColumn("processed", F.round("processed_scalar", 6))


def test_any_arrival_order_and_restarts(spark, sf_dir, tmp_path):
    df = speed_readings(spark, sf_dir)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first = df.where("event_id % 2 = 0")

    def run():
        stream = pipelines.for_apps(as_stream(spark, source, df.schema, 2), APPS)
        in_order.run_available(in_order.enforce_stream(stream, SPEED_RULES, "speed", "60 days"),
                               out, checkpoint)

    shuffled(first, source, 3)
    run()
    shuffled(df.join(first, "event_id", "left_anti").select(df.columns), source, 2)
    run()
    closing_row(df).write.mode("append").parquet(source)
    run()
    batch = pipelines.enforce_speed(df, SPEED_RULES, PLAIN)
    assert bag(published(spark.read.parquet(out)), *SPEED_OUT) == bag(published(batch), *SPEED_OUT)


def test_late_decisions(spark, sf_dir, tmp_path):
    """All readings arrive before the first decision."""
    rows, decided = readings_of_app(spark, sf_dir), forced_decisions(spark, sf_dir)
    paths = {n: str(tmp_path / n) for n in ("rows", "decided", "out", "checkpoint")}

    def run():
        stream = in_order.enforce_decided_stream(
            as_stream(spark, paths["rows"], rows.schema, 9),
            as_stream(spark, paths["decided"], decided.schema, 9), FORCED, "speed", "60 days")
        in_order.run_available(stream, paths["out"], paths["checkpoint"])

    shuffled(rows, paths["rows"], 2)
    spark.createDataFrame([], decided.schema).write.parquet(paths["decided"])
    run()
    shuffled(decided, paths["decided"], 2)
    run()
    closing_row(rows).write.mode("append").parquet(paths["rows"])
    closing_row(decided).write.mode("append").parquet(paths["decided"])
    run()
    batch = pipelines.enforce_decided(rows, decided, FORCED, "speed", PLAIN)
    assert bag(published(spark.read.parquet(paths["out"])), *SPEED_OUT) == bag(published(batch), *SPEED_OUT)


def test_locations_and_recursive_noise(spark, sf_dir, tmp_path):
    noise = pet_json("speed_noise", [("Double", 0.0), ("Double", 120.0), ("Double", 10.0),
                                     ("Duration", "PT1H"), ("Double", 10.0)], outputs=["speed"])
    rules = [Rule("app1", "speed", 1, 1, _speed_rule("GREATER", 30), noise),
             Rule("app1", "speed", 2, 2, _speed_rule("LESS_EQUAL", 10), pet_json("none"))]
    for name, df, section, own, value in (
            ("speed", speed_readings(spark, sf_dir), "speed", rules, F.round("processed_scalar", 6)),
            ("location", points(spark, sf_dir), "location", LOCATION_RULES,
             F.round(F.col("processed_location.x"), 4))):
        source, out, checkpoint = (str(tmp_path / (name + n)) for n in ("in", "out", "checkpoint"))
        shuffled(df, source, 1)
        stream = pipelines.for_apps(as_stream(spark, source, df.schema), ["app1"])
        in_order.run_available(in_order.enforce_stream(stream, own, section, "0 seconds"), out, checkpoint)
        active = pipelines.evaluate(pipelines.for_apps(df, ["app1"]), own, PLAIN)
        batch = enforce(active, [r.spec for r in own], section, PLAIN)
        columns = ("vehicle_id", "event_id", "pet_label", "value")
        got = bag(spark.read.parquet(out).withColumn("value", value), *columns)
        assert got == bag(batch.withColumn("value", value), *columns) and got


def test_policy_that_changes_while_the_stream_runs(spark, sf_dir, tmp_path):
    df = readings_of_app(spark, sf_dir)
    source, policy, caused, out = (str(tmp_path / n) for n in ("in", "policy", "caused", "out"))
    old = [Rule("app1", "speed", 1, 1, _speed_rule("GREATER_EQUAL", 0), pet_json("none"))]
    new = [Rule("app1", "speed", 7, 1, _speed_rule("GREATER_EQUAL", 0),
                pet_json("clamp", [("Double", 0.0), ("Double", 20.0)]))]
    half = df.approxQuantile("generate_ms", [0.5], 0.0)[0]

    def evaluate(rows, rules):
        rule_table(spark, rules).write.mode("overwrite").parquet(policy)
        rows.write.mode("append").parquet(source)
        (as_stream(spark, source, df.schema, 100).writeStream
         .foreachBatch(in_order.evaluate_with_latest_policy(policy, caused))
         .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True)
         .start().awaitTermination())

    evaluate(df.where(F.col("generate_ms") <= half), old)
    evaluate(df.where(F.col("generate_ms") > half), new)
    schema = spark.read.parquet(caused + "/batch=0").schema
    stream = spark.readStream.schema(schema).parquet(caused + "/batch=*")
    in_order.run_available(
        in_order.enforce_caused_stream(stream, [r.spec for r in old + new], "speed", "0 seconds"),
        out, str(tmp_path / "c2"))
    got = spark.read.parquet(out)
    assert got.count() == df.count()
    before, after = (got.where(F.col("generate_ms") <= half), got.where(F.col("generate_ms") > half))
    assert [r.pet_label for r in before.select("pet_label").distinct().collect()] == ["none"]
    assert [r.pet_label for r in after.select("pet_label").distinct().collect()] == ["clamp0.020.0"]
    assert after.agg(F.max("processed_scalar")).collect()[0][0] <= 20


def test_dedupe_stream(spark, sf_dir, tmp_path):
    df = readings_of_app(spark, sf_dir)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.union(df).write.parquet(source)
    stream = in_order.dedupe_stream(spark.readStream.schema(df.schema).parquet(source), "60 days")
    in_order.run_available(stream, out, str(tmp_path / "checkpoint"))
    assert spark.read.parquet(out).count() == df.count()


def test_latest_context_on_a_stream(spark, sf_dir, tmp_path):
    from workload.fixtures import mixed_readings
    df = mixed_readings(spark, sf_dir)
    source = str(tmp_path / "in")
    shuffled(df, source, 3)
    query = (latest_context(as_stream(spark, source, df.schema)).writeStream.outputMode("complete")
             .format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    columns = ("vehicle_id", "speed", "location", "image", "update_ms")
    assert bag(spark.table("latest"), *columns) == bag(latest_context(df), *columns)


def test_late_rows_are_kept_apart(spark, tmp_path):
    """The third row comes when the first, which is later, has been released."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    columns = "app string, vehicle_id long, section string, event_id long, generate_ms long, scalar double"
    rules = [Rule("app1", "speed", 1, 1, _speed_rule("GREATER", 0), pet_json("none"))]
    spark.streams.addListener(counter := in_order.LateRows())
    for i, ms in enumerate((10_000_000, 11_000_000, 1_000, 12_000_000, FAR)):
        spark.createDataFrame([("app1", 1, "speed", i, ms, 5.0)], columns).coalesce(1).write.mode(
            "append").parquet(source)
        stream = spark.readStream.schema(columns).parquet(source)
        query = (in_order.enforce_stream(stream, rules, "speed", "1 second", keep_late=True)
                 .writeStream.format("parquet").partitionBy("is_late").option("path", out)
                 .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
        query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    time.sleep(1)  # the counts come to Python after the bus has them
    spark.streams.removeListener(counter)
    late = sum(counter.rows.values())
    got = spark.read.parquet(out)
    assert sorted(r.event_id for r in got.where("is_late = 'false'").collect()) == [0, 1, 3]
    marked = [r.event_id for r in got.where("is_late = 'true'").collect()]
    assert late + len(marked) == 1 and set(marked) <= {2}


def test_pets_without_a_stream_form_are_refused(spark):
    from veilstream.operators.pets import REGISTRY, WindowPet, register_pet
    register_pet("batch_only", "window", lambda section, params: WindowPet(2, ("scalar",), None))
    spec = PetSpec.from_json(pet_json("batch_only"))
    rows = spark.createDataFrame([], "app string, vehicle_id long, section string, event_id long, "
                                 "generate_ms long, kind int, cause string, label string, scalar double")
    with pytest.raises(ValueError):
        in_order.enforce_caused_stream(rows, [spec], "speed")
    del REGISTRY["batch_only"]

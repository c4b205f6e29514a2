import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from veilstream.functions.petspec import pet_json
from veilstream.operators.policy import rules_of
from veilstream.operators.timeline import SlicePlan, plan_slices
from veilstream.sources import history, logs, policy_files, readings, traces
from workload.fixtures import mixed_readings

PLAIN = SlicePlan("vehicle_id", "generate_ms")
BY_SEQ = SlicePlan("vehicle_id", "seq")


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


@pytest.fixture
def policy_dirs(tmp_path):
    predicates, pets = tmp_path / "predicates", tmp_path / "pets"
    for name, value in (("fast.json", 60), ("slow.json", 10)):
        write(predicates, name, json.dumps({"scalar": [
            {"data section": "speed", "relation": "GREATER", "value": value}]}, indent=1))
    write(pets, "none.json", pet_json("none"))
    write(pets, "mean.json", pet_json("average", [("Integer", 5)]))
    return tmp_path


HEADER = "app,section,predicate,pet,priority\n"


def test_policy_from_files(spark, policy_dirs):
    """Rows of one application need not stand together."""
    write(policy_dirs, "policy.csv", HEADER + "a,speed,fast.json,mean.json,1\nb,speed,slow.json,none.json,1\n"
          "a,speed,slow.json,none.json,2\n")
    policy = policy_files.load_policy(spark, str(policy_dirs / "policy.csv"),
                                      str(policy_dirs / "predicates"), str(policy_dirs / "pets"))
    rules = rules_of(policy)
    assert [(r.app, r.rule_no, r.priority, r.spec.label) for r in rules] == [
        ("a", 1, 1, "average5"), ("a", 2, 2, "none"), ("b", 1, 1, "none")]
    assert json.loads(rules[0].predicate)["scalar"][0]["value"] == 60


def test_missing_files_are_named(spark, policy_dirs):
    write(policy_dirs, "policy.csv", HEADER + "a,speed,fast.json,gone.json,1\na,speed,lost.json,none.json,2\n")
    with pytest.raises(FileNotFoundError, match="gone.json, lost.json"):
        policy_files.load_policy(spark, str(policy_dirs / "policy.csv"),
                                 str(policy_dirs / "predicates"), str(policy_dirs / "pets"))


def test_frames_in_a_folder(spark, tmp_path):
    for n in (0, 7, 12):
        (tmp_path / f"{n}.png").write_bytes(bytes([n]))
    (tmp_path / "cover.png").write_bytes(b"x")
    (tmp_path / "3.txt").write_bytes(b"x")
    frames = readings.read_frames(spark, str(tmp_path))
    assert sorted((r.sequence_number, bytes(r.content)) for r in frames.collect()) == [
        (0, b"\0"), (7, b"\x07"), (12, b"\x0c")]
    assert readings.read_frames(spark, str(tmp_path), end=8).count() == 2
    stream = readings.read_frames(spark, str(tmp_path), stream=True)
    query = (stream.writeStream.format("memory").queryName("frames")
             .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.table("frames").count() == 3


def test_topics(spark):
    rows = [("speed", "12.5", 1), ("speed", " 3 ", 2), ("speed", "fast", 3)]
    topic = spark.createDataFrame(rows, "k string, v string, t int").select(
        F.encode("k", "utf-8").alias("key"), F.encode("v", "utf-8").alias("value"),
        F.timestamp_millis(F.col("t")).alias("timestamp"))
    parsed = readings.parse_scalar(topic)
    assert [(r.section, r.scalar, r.generate_ms) for r in parsed.orderBy("generate_ms").collect()] == [
        ("speed", 12.5, 1), ("speed", 3.0, 2), ("speed", None, 3)]
    assert readings.rejects(parsed, "scalar").count() == 1


def test_history_store(spark, sf_dir, tmp_path):
    df = mixed_readings(spark, sf_dir)
    path = str(tmp_path / "history")
    history.write_history(df.where("event_id < 300"), path)
    history.write_history(df.where("event_id >= 300"), path)
    assert history.read_history(spark, path).count() == df.count()
    one = history.read_history(spark, path, "speed")
    assert one.count() == df.where("section = 'speed'").count()
    plan = one.select("scalar")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(section" in plan and "PushedFilters: []" in plan
    with pytest.raises(Exception, match="no history for section"):
        history.history_rows(df.withColumn("section", F.lit("smell"))).collect()


def test_bucketed_history(spark, sf_dir, tmp_path):
    """Appended, named again, and looked up without an exchange of the store; rows without a vehicle are one vehicle."""
    df = mixed_readings(spark, sf_dir).withColumn("vehicle_id", F.when(F.col("event_id") % 3 > 0, F.col("vehicle_id")))
    name, path = f"history_{uuid.uuid4().hex}", str(tmp_path / "bucketed")
    for part in (0, 1, 2):
        history.write_history_table(df.where(F.col("event_id") % 5 % 3 == part), name, path, buckets=4)
    again = name + "_again"
    history.open_history_table(spark, again, path, df, buckets=4)
    want = {}
    for r in df.where("section = 'speed'").collect():
        want.setdefault(r.vehicle_id, []).append((r.generate_ms, r.event_id))
    want = {(v, e, back) for v, rows in want.items() for back, (_, e) in enumerate(sorted(rows, reverse=True)[:6], 1)}
    for table in (name, again):
        store = history.read_history_table(spark, table, "speed")
        ring = history.latest_records(store, 7)
        assert {(r.vehicle_id, r.event_id, r.back) for r in ring.collect()} == want
        plan = ring._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 2 and "Bucketed: true" in plan  # the same exchange in the first and the final plan
        below = plan[plan.index("Exchange"):plan.index("FileScan")]
        assert "_back" in below and "hashpartitioning(vehicle_id#" in below and "slot" not in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)[0]
        day = df.agg(F.max("generate_ms")).first()[0]
        part = history.read_history_table(spark, table, "speed", day - 3_600_000, day)
        assert part.count() == df.where(f"section = 'speed' and generate_ms >= {day - 3_600_000} and generate_ms < {day}").count()
        assert "PartitionFilters: [isnotnull(section" in part._jdf.queryExecution().executedPlan().toString()
    assert history.latest_records(store, 1).count() == 0
    for table in (name, again):
        spark.sql(f"DROP TABLE {table}")


def test_warmup_needs_strictly_earlier_records(spark):
    stored = spark.createDataFrame([(1, i, ms, float(i)) for i, ms in enumerate([10, 20, 20, 30])],
                                   "vehicle_id long, event_id long, generate_ms long, scalar double")
    asked = spark.createDataFrame([(1, 100, 20), (1, 101, 31), (1, 102, 10), (2, 103, 99)],
                                  "vehicle_id long, event_id long, generate_ms long")
    got = history.warmup_piece(asked, stored, 4, PLAIN).collect()
    found = sorted((r.trigger_event_id, r.back, r.event_id) for r in got)
    assert found == [(100, 1, 0), (101, 1, 3), (101, 2, 2), (101, 3, 1)]
    got = history.warmup_time(asked.where("event_id = 101"), stored.withColumn(
        "generate_ms", F.col("generate_ms") * 1000).union(stored.where("event_id = 3")), 1)
    assert [r.event_id for r in got.collect()] == [3]


def test_log_files(spark, tmp_path):
    log = spark.createDataFrame([("speed", "1", "-")], "Type string, Time string, `Eval.` string")
    path = tmp_path / "log"
    for _ in range(2):  # appended: still one header
        logs.write_log(log, str(path))
    files = sorted(p.name for p in (path / "speed").glob("*.csv"))
    assert files[0] == logs.HEADER and sum(logs.HEADER in f for f in files) == 1
    whole = "".join((path / "speed" / f).read_text() for f in files)
    assert whole == "Type,Time,Eval.\nspeed,1,-\nspeed,1,-\n" and not list(path.glob(".staging-*"))
    logs.write_log(log, str(path), "overwrite")
    assert logs.read_log(spark, str(path), log.columns).count() == log.count()


def test_log_of_several_kinds_and_failed_attempts(spark, tmp_path):
    """Rows of an attempt that failed are never seen; every kind has its own header."""
    rows = [("speed", 'a "b", c'), ("image", "1"), ("speed", None), ("image", "2")] * 5
    log = spark.createDataFrame(rows, "Type string, Value string").repartition(3)
    path = tmp_path / "log"
    logs.write_log(log, str(path))
    broken = log.withColumn("Value", F.when(F.col("Value") == "2", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("Value")))
    with pytest.raises(Exception):
        logs.write_log(broken, str(path))
    assert sorted(map(str, logs.read_log(spark, str(path), log.columns).collect())) == sorted(map(str, log.collect()))
    assert {p.name for p in path.iterdir() if not p.name.startswith(".")} == {"speed", "image"}
    assert all((path / k / logs.HEADER).read_text() == "Type,Value\n" for k in ("speed", "image"))


def test_a_repeated_batch_replaces_its_files(tmp_path):
    path = str(tmp_path / "log")
    for batch, values in ((0, "ab"), (1, "cd"), (1, "cd"), (2, "e")):
        writer = logs._StreamWriter(path, ["Type", "Value"], False)
        writer.commit([writer.write([("speed", v)]) for v in values], batch)
    files = sorted((tmp_path / "log" / "speed").glob("*.csv"))
    lines = "".join(f.read_text() for f in files).split()
    assert lines[0] == "Type,Value" and sorted(lines[1:]) == [f"speed,{v}" for v in "abcde"]


def test_log_of_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "Type string, Value string"
    for i in range(3):
        spark.createDataFrame([("speed", str(i)), ("image", str(i))], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        logs.log_stream(stream, path, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = logs.read_log(spark, path, ["Type", "Value"], "speed").collect()
    assert sorted(r.Value for r in got) == ["0", "1", "2"]


def waypoint_rows(spark):
    rows = [(1, 0, 0.0, 0.0, 9), (1, 1, 30.0, 40.0, 5), (1, 2, 30.0, 0.0, 2), (2, 0, 1.0, 1.0, 1)]
    return spark.createDataFrame(rows, "vehicle_id long, seq long, x double, y double, seconds long")


def test_traces_by_hand(spark, tmp_path):
    dense = traces.densify_waypoints(waypoint_rows(spark), BY_SEQ)
    trace = traces.location_trace(dense, BY_SEQ)
    assert [(r.x, r.y) for r in trace.orderBy("time").collect()] == [
        (0, 0), (6, 8), (12, 16), (18, 24), (24, 32), (30, 40), (30, 20), (30, 0)]
    speeds = traces.speed_from_waypoints(waypoint_rows(spark), BY_SEQ).orderBy("seq", "step")
    # 50 m in 5 s are 36 km/h, 40 m in 2 s are 72 km/h
    assert [round(r.v, 6) for r in speeds.collect()] == [0, 7.2, 14.4, 21.6, 28.8, 36, 54, 72]
    traces.write_trace(trace, str(tmp_path / "trace"))
    assert spark.read.option("header", True).csv(str(tmp_path / "trace")).count() == 8


def test_traces_of_a_hot_vehicle(spark, sf_dir):
    from workload.ingest import waypoints
    df = waypoints(spark, sf_dir).withColumn("vehicle_id", F.lit(1).cast("long"))
    plan = plan_slices(df, time="seq", target_rows=50)
    assert plan.sliced
    for make in (traces.densify_waypoints, traces.speed_from_waypoints):
        plain, sliced = make(df, BY_SEQ), make(df, plan)
        assert sorted(plain.collect()) == sorted(sliced.collect())
    dense = traces.densify_waypoints(df, plan)
    assert (sorted(traces.location_trace(dense, BY_SEQ).collect())
            == sorted(traces.location_trace(dense, plan).collect()))


def test_waypoint_files(spark, tmp_path):
    (tmp_path / "w.csv").write_text("vehicle_id,seq,x,y,seconds\n1, 0, 1.5, 2.5 ,3\n")
    assert traces.read_waypoints(spark, str(tmp_path / "w.csv")).collect() == [(1, 0, 1.5, 2.5, 3)]

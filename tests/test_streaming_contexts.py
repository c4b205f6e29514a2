"""Held rows, contexts on streams, policies that change, and warm starts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_streaming import as_stream, bag, closing_row, shuffled
from veilstream.functions.petspec import PetSpec, pet_json
from veilstream.operators.context import asof_context, zip_apps
from veilstream.operators.policy import Rule, versioned
from veilstream.operators.timeline import SlicePlan
from veilstream.plans import pipelines
from veilstream.streaming import in_order
from veilstream.streaming.contexts import TwoInputs, combine_streams, reassemble_stream, zip_app_streams
from veilstream.streaming.held import Held, PerKey
from veilstream.streaming.policies import CONTROL, control_rows, stream_policies
from workload.context import _inputs, zipped_rows
from workload.enforce import MIDDLE_MS, SECOND_POLICY
from workload.fixtures import MIXED_RULES, SPEED_RULES, _speed_rule, mixed_columns, mixed_readings, speed_readings

PLAIN = SlicePlan("vehicle_id", "generate_ms")


class Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Map:
    def __init__(self, counts):
        self.rows, self.counts = {}, counts

    def getValue(self, key):
        self.counts["read"] += 1
        return self.rows[key]

    def containsKey(self, key):
        return key in self.rows

    def updateValue(self, key, value):
        self.counts["written"] += 1
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


class Handle:
    """State in memory that counts how often map entries are touched."""

    def __init__(self):
        self.counts, self.states, self.timers = {"read": 0, "written": 0}, {}, []

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Map(self.counts))

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value())

    def registerTimer(self, ms):
        self.timers.append(ms)


class ManyHandle(Handle):
    """The same for operators that ask whether a map has entries."""

    def getMapState(self, name, *_):
        found = super().getMapState(name)
        found.exists = lambda: bool(found.rows)
        return found


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


class Plain(Held):
    def release(self, key, rows):
        return rows


def held(slot_ms=1000):
    schema = T.StructType([T.StructField("generate_ms", T.LongType()), T.StructField("event_id", T.LongType())])
    processor = Plain(["generate_ms", "event_id"], schema, slot_ms=slot_ms)
    processor.init(Handle())
    return processor


def arrive(processor, rows):
    list(processor.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=processor.columns)]), None))


def released(processor, watermark):
    return [tuple(int(x) for x in row) for out in processor.handleExpiredTimer(("k",), Watermark(watermark), None) for row in out.itertuples(index=False)]


def test_rows_leave_in_order_and_only_when_due():
    r, processor = random.Random(2), held()
    rows, out, passed = [(r.randrange(50_000), i) for i in range(500)], [], 0
    for a in range(0, 500, 50):
        arrive(processor, [row for row in rows[a:a + 50] if row[0] > passed])
        passed = a * 100
        now = released(processor, passed)
        assert now == sorted(now) and all(ms <= passed for ms, _ in now)
        out += now
    out += released(processor, 60_000)
    assert out == sorted(out) and processor.handle.states["index"].get() is None and not processor.handle.states["slots"].rows


def test_a_backlog_is_read_once():
    """While rows wait, timers do not touch them; the number of entries read is that of the slots, not its square."""
    processor, n = held(), 400
    for i in range(n):
        arrive(processor, [(i * 1000 + 5, i)])
        assert released(processor, -1) == []
    assert processor.handle.counts["read"] == 0
    for i in range(n):
        assert released(processor, i * 1000 + 5) == [(i * 1000 + 5, i)]
    assert processor.handle.counts["read"] == n and processor.handle.counts["written"] == n


def test_values_expire():
    processor = TwoInputs(T.DoubleType(), 1000)
    processor.init(Handle())
    rows = [(0, 1, "left", 1.0), (500, 2, "right", 2.0), (1400, 3, "right", 3.0), (1500, 4, "left", 4.0), (9000, 5, "right", 5.0)]
    out = processor.release((7,), rows)
    assert [(o[1], o[4], o[5]) for o in out] == [(2, 1.0, 2.0), (4, 4.0, 3.0)]
    assert processor.handle.states["left"].get() is None and processor.handle.states["right"].get() == (5.0, 9000)


def test_two_inputs_in_any_order(spark, sf_dir, tmp_path):
    sides = _inputs(spark, sf_dir)
    folders = [str(tmp_path / n) for n in ("left", "right")]
    for df, folder in zip(sides, folders):
        shuffled(df, folder, 3)
        closing_row(df).write.mode("append").parquet(folder)
    stream = combine_streams(*[as_stream(spark, folder, df.schema, 2) for df, folder in zip(sides, folders)], "400 days")
    in_order.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    columns = ("event_id", "side", "left_value", "right_value")
    assert bag(spark.read.parquet(str(tmp_path / "out")), *columns) == bag(asof_context(*sides, PLAIN), *columns)


def test_zip_in_any_order(spark, sf_dir, tmp_path):
    df = zipped_rows(spark, sf_dir).select("app", "vehicle_id", "event_id", "generate_ms")
    source = str(tmp_path / "in")
    shuffled(df, source, 4)
    for app in ("app1", "app2"):
        closing_row(df).withColumn("app", F.lit(app)).write.mode("append").parquet(source)
    stream = zip_app_streams(as_stream(spark, source, df.schema, 3), ["app1", "app2"], F.col("event_id"), "400 days")
    in_order.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    columns = ("vehicle_id", "n", "app1", "app2")
    assert bag(spark.read.parquet(str(tmp_path / "out")), *columns) == bag(zip_apps(df, ["app1", "app2"], F.col("event_id"), PLAIN), *columns)
    with pytest.raises(ValueError):
        zip_app_streams(df, ["app1"], F.col("event_id"))


def test_reassembly_of_a_stream_of_published_rows(spark, sf_dir, tmp_path):
    """Published rows from a table of their own, in several batches and after a restart."""
    published = pipelines.run_policies(mixed_readings(spark, sf_dir), MIXED_RULES, PLAIN)
    folders = {n: str(tmp_path / n) for n in ("in", "out", "c")}

    def run():
        in_order.run_available(reassemble_stream(as_stream(spark, folders["in"], published.schema, 2), "400 days"), folders["out"], folders["c"])
    for seed in (1, 2):
        part = published.where(F.col("event_id") % 2 == seed - 1)
        shuffled(part, folders["in"], 2, seed)
        run()
    closing_row(published).write.mode("append").parquet(folders["in"])
    run()
    columns = ("app", "vehicle_id", "event_id", "frame_no", "processed_scalar", "processed_location", "processed_image")
    got, expected = spark.read.parquet(folders["out"]), pipelines.reassemble_policies(published, PLAIN)
    assert bag(got, *columns) == bag(expected, *columns) and got.count() > 0


COLUMNS = ("app", "vehicle_id", "event_id", "pet_label", "since_event_id", "processed")


def outputs(df):
    return bag(df.withColumn("processed", F.round("processed_scalar", 6)), *COLUMNS)


def test_policies_arrive_between_readings_and_late(spark, sf_dir, tmp_path):
    """The second version comes after the readings of its time have arrived, a third after the stream was restarted."""
    first = [r for r in SPEED_RULES if r.app in ("app1", "app2")]
    third = [Rule("app2", "speed", 1, 1, _speed_rule("GREATER", 10), pet_json("none"))]
    later = MIDDLE_MS + 86_400_000
    df = mixed_columns(speed_readings(spark, sf_dir))
    rows, control, out, c = (str(tmp_path / n) for n in ("rows", "control", "out", "c"))
    spark.createDataFrame([], CONTROL).write.parquet(control)

    def run():
        stream = stream_policies(as_stream(spark, rows, df.schema, 3), first, "400 days", as_stream(spark, control, CONTROL, 3),
                                 [("speed", r.spec) for r in SECOND_POLICY + third], shards=4)
        in_order.run_available(stream, out, c)

    def publish(*versions):
        spark.createDataFrame(control_rows(versions), CONTROL).coalesce(1).write.mode("append").parquet(control)
    shuffled(df.where("event_id % 2 = 0"), rows, 3)
    run()
    publish((MIDDLE_MS, SECOND_POLICY))
    shuffled(df.where("event_id % 2 = 1"), rows, 2)
    run()
    publish((later, third))
    run()
    closing_row(df).write.mode("append").parquet(rows)
    run()
    rules = versioned([(0, first), (MIDDLE_MS, SECOND_POLICY), (later, third)])
    expected = pipelines.enforce_speed(df, rules, PLAIN)
    assert outputs(spark.read.parquet(out)) == outputs(expected)


def test_policies_with_unknown_transformations_stop_the_stream(spark, sf_dir, tmp_path):
    df = mixed_columns(speed_readings(spark, sf_dir))
    rows, control = str(tmp_path / "rows"), str(tmp_path / "control")
    shuffled(df, rows, 1)
    spark.createDataFrame(control_rows([(1, SECOND_POLICY)]), CONTROL).write.parquet(control)
    stream = stream_policies(as_stream(spark, rows, df.schema), [], "0 seconds", as_stream(spark, control, CONTROL), apps=["app1"],
                             may_apply=[("speed", PetSpec.from_json(pet_json("none")))])
    with pytest.raises(Exception, match="not among the stream's transformations"):
        in_order.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c"))


def test_warm_start_of_recursive_and_window_transformations(spark, sf_dir, tmp_path):
    """A stream from the summary of the past gives what one run over everything gives, step states included."""
    noise = pet_json("speed_noise", [("Double", 0.0), ("Double", 120.0), ("Double", 10.0), ("Duration", "PT1H"), ("Double", 10.0)], outputs=["speed"])
    rules = [Rule("app1", "speed", 1, 1, _speed_rule("GREATER", 30), noise), *[r for r in SPEED_RULES if r.app == "app2"]]
    df, past = mixed_columns(speed_readings(spark, sf_dir)), F.col("generate_ms") <= MIDDLE_MS
    state = pipelines.state_after(df.where(past), rules, PLAIN)
    assert state.count() <= 2 * df.select("vehicle_id").distinct().count()
    rows = str(tmp_path / "rows")
    shuffled(df.where(~past), rows, 2)
    in_order.run_available(stream_policies(as_stream(spark, rows, df.schema, 9), rules, "0 seconds", state=state, shards=4), str(tmp_path / "out"), str(tmp_path / "c"))
    expected = pipelines.run_policies(df, rules, PLAIN).where(~past)
    assert outputs(spark.read.parquet(str(tmp_path / "out"))) == outputs(expected) and expected.count() > 0


def test_class_maps_in_a_stream(spark, sf_dir, tmp_path):
    """Frames are redacted by their class map, as in a batch."""
    spec = pet_json("class_redaction", [("String", "blackout"), ("Integer", 4)], [], ["image"], ["image"])
    rules = [Rule("app1", "image", 1, 1, _speed_rule("GREATER_EQUAL", 0), spec), *[r for r in SPEED_RULES if r.app == "app1"]]
    image = F.col("section") == "image"
    df = mixed_readings(spark, sf_dir).withColumns({
        "image": F.when(image, F.unhex(F.rpad(F.hex("image"), 24, "5A"))), "height": F.when(image, 2), "width": F.when(image, 2), "n_channels": F.when(image, 3),
        "class_map": F.when(image, F.unhex(F.lit("00010203")))})
    rows = str(tmp_path / "rows")
    shuffled(df, rows, 1)
    in_order.run_available(stream_policies(as_stream(spark, rows, df.schema), rules, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "c"))
    columns = ("section", "event_id", "pet_label", "image")
    got, expected = (d.withColumn("image", F.hex("processed_image")) for d in (spark.read.parquet(str(tmp_path / "out")), pipelines.run_policies(df, rules, PLAIN)))
    assert bag(got, *columns) == bag(expected, *columns) and got.where("section = 'image'").count() > 0


def test_small_keys_share_state():
    """Entries of state follow the rows that wait, not the keys or the time that they spread over."""
    processor = PerKey(TwoInputs(T.DoubleType(), None))
    processor.init(handle := ManyHandle())
    rows = [(i * 60_000, i, "left" if i % 2 else "right", float(i), f'{{"vehicle_id":{i % 300}}}') for i in range(6_000)]
    arrive(processor, rows)
    assert handle.counts["written"] <= 4 and handle.counts["read"] == 0
    out = [row for table in processor.handleExpiredTimer((0,), Watermark(10 ** 12), None) for row in table.itertuples(index=False)]
    assert out == [] and handle.counts["read"] <= 4 and handle.counts["written"] <= 4 + 300  # a vehicle has one side only
    assert len(handle.states["memories"].rows) == 300 and not handle.states["slots"].rows


def test_due_rows_are_handed_on_in_pieces():
    """What is due of a shard is never in memory as a whole, however much it is; the order is that of time."""
    seen, processor, r = [], held(600_000), random.Random(3)
    processor.release = lambda key, rows: seen.append(len(rows)) or rows
    rows = [(i, i) for i in range(200_000)]
    for a in range(0, len(rows), 10_000):
        batch = rows[a:a + 10_000]
        arrive(processor, r.sample(batch, len(batch)))
    assert [ms for ms, _ in released(processor, 10 ** 9)] == [ms for ms, _ in rows] and max(seen) < 40_000


def test_a_part_that_waits_is_not_written_for_every_timer():
    processor, n = held(1), 4_000
    arrive(processor, [(i * 1000, i) for i in range(n)])
    for i in range(0, n, 10):
        assert [x for _, x in released(processor, (i + 9) * 1000)] == list(range(i, i + 10))
    assert processor.handle.counts["written"] < n and processor.handle.states["index"].get() is None


def test_ids_stay_exact_beside_missing_ones(spark, tmp_path):
    """Whole numbers beyond those of doubles, with rows that lack them in the same batch."""
    big = 2 ** 60 + 1
    df = spark.createDataFrame([(v, big + i, 1000 + i, side, 1.0) for i in range(4) for v in (None, big) for side in ("left", "right")],
                               "vehicle_id long, event_id long, generate_ms long, side string, value double")
    folders = [str(tmp_path / n) for n in ("left", "right")]
    for folder in folders:
        df.where(F.col("side") == folder.rsplit("/", 1)[1]).drop("side").coalesce(1).write.parquet(folder)
    stream = combine_streams(*[as_stream(spark, folder, df.drop("side").schema, 9) for folder in folders], "0 seconds")
    in_order.run_available(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    got = {(x.vehicle_id, x.event_id) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(v, big + i) for i in range(4) for v in (None, big)}

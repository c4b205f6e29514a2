"""The same results from streams: bounded inputs, processed with ``availableNow``.

The watermark delay is zero because each check reads its whole table in one trigger. A deployment
bounds its micro-batches (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) and sets the delay to how
far its input is out of order.
"""

import uuid

from pyspark.sql import functions as F

from veilstream.plans.pipelines import enforce_speed, for_apps, state_after
from veilstream.session import shared_dir
from veilstream.streaming import in_order
from veilstream.streaming.contexts import combine_streams, reassemble_stream, zip_app_streams
from veilstream.streaming.policies import CONTROL, control_rows, stream_policies
from workload.context import _inputs, zipped_rows
from workload.enforce import ENFORCED_SQL, FORCED, MIDDLE_MS, POLICIES, SECOND_POLICY, _processed, _published
from workload.fixtures import (MIXED_RULES, ORACLES, SPEED_RULES, forced_decisions, mixed_readings, mixed_columns, plan_for, query, speed_readings,
                               with_views)


class _Streaming:
    """Reads tables as streams; stands in for the session in the fixture views."""

    def __init__(self, spark):
        self.spark = spark
        self.conf = spark.conf
        self.read = self

    def parquet(self, path):
        schema = self.spark.read.parquet(path).schema
        # A pattern, because a stream's plain path must be a folder and a table may be one file.
        return self.spark.readStream.schema(schema).parquet(path.replace(".parquet", ".parque[t]"))


def _finished(spark, df):
    folder = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    in_order.run_available(df, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def _apps(spark, sf_dir):
    return for_apps(speed_readings(_Streaming(spark), sf_dir), ["app1", "app2", "app3"])


@query(with_views("labelled", body="""
SELECT sha256(app || '|' || vehicle_id || '|speed|' || event_id) AS decision_id, app, vehicle_id,
       event_id AS trigger_event_id, pet_label, priority FROM labelled WHERE is_switch"""))
def streamed_decisions(spark, sf_dir):
    decided = in_order.decide_stream(_apps(spark, sf_dir), SPEED_RULES, "0 seconds")
    return _finished(spark, decided).select("decision_id", "app", "vehicle_id", "trigger_event_id",
                                            "pet_label", "priority")


@query(with_views("windowed", body=ENFORCED_SQL))
def streamed_enforcement(spark, sf_dir):
    enforced = in_order.enforce_stream(_apps(spark, sf_dir), SPEED_RULES, "speed", "0 seconds")
    return _finished(spark, enforced).select(
        "app", "vehicle_id", "event_id", "generate_ms", "pet_label",
        F.round("processed_scalar", 6).alias("processed"))


@query(with_views("forced_output", body="SELECT * FROM forced_output"))
def streamed_outside_decisions(spark, sf_dir):
    """Decisions come as a stream of their own."""
    source = _Streaming(spark)
    rows = speed_readings(source, sf_dir).withColumn("app", F.lit("app1"))
    enforced = in_order.enforce_decided_stream(rows, forced_decisions(source, sf_dir), FORCED, "speed",
                                               "0 seconds")
    return _finished(spark, enforced).select(
        "vehicle_id", "event_id", "generate_ms", "pet_label",
        F.round("processed_scalar", 6).alias("processed"))


@query(POLICIES + "SELECT * FROM published")
def streamed_policies(spark, sf_dir):
    """All sections of two applications from one stream, images included."""
    done = stream_policies(mixed_readings(_Streaming(spark), sf_dir), MIXED_RULES, "0 seconds")
    return _finished(spark, done).select(
        "app", "vehicle_id", "section", "event_id", "generate_ms", "pet_label", *_processed())


NULL_SPEEDS = with_views("windowed", body=ENFORCED_SQL).replace(
    "value AS scalar\n  FROM events", "CASE WHEN event_id % 7 <> 0 THEN value END AS scalar\n  FROM events").replace(
    "FROM labelled\n", "FROM labelled WHERE scalar IS NOT NULL\n")


def _with_nulls(rows):
    return rows.withColumn("scalar", F.when(F.col("event_id") % 7 != 0, F.col("scalar")))


@query(NULL_SPEEDS)
def enforced_speed_with_nulls(spark, sf_dir):
    """Every seventh reading lost its value: it is no record."""
    return _published(enforce_speed(_with_nulls(speed_readings(spark, sf_dir)), SPEED_RULES, plan_for(spark, sf_dir)))


@query(NULL_SPEEDS)
def streamed_enforcement_with_nulls(spark, sf_dir):
    enforced = in_order.enforce_stream(_with_nulls(_apps(spark, sf_dir)), SPEED_RULES, "speed", "0 seconds")
    return _published(_finished(spark, enforced))


@query(ORACLES["combined_inputs"])
def streamed_inputs(spark, sf_dir):
    """Two streams combined in one operator."""
    done = combine_streams(*_inputs(_Streaming(spark), sf_dir), "0 seconds")
    return _finished(spark, done).select("event_id", "side", "left_value", "right_value")


@query(ORACLES["zipped_apps"])
def streamed_zip(spark, sf_dir):
    """Two operators in a row: numbered per application, then put together per vehicle and number."""
    done = zip_app_streams(zipped_rows(_Streaming(spark), sf_dir), ["app1", "app2"], F.col("event_id"), "0 seconds")
    return _finished(spark, done).select("vehicle_id", "n", "app1", "app2")


def _controls(spark, versions):
    """Policy versions as a stream: rows of a folder, as a policy service would leave them."""
    folder = f"{shared_dir(spark)}/policies-{uuid.uuid4().hex}"
    rows = spark.createDataFrame(control_rows(versions), CONTROL)
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


@query(ORACLES["enforced_under_versions"])
def streamed_policy_changes(spark, sf_dir):
    """The first policy and its replacement arrive as a stream beside the readings."""
    first = [r for r in SPEED_RULES if r.app == "app1"]
    rows = mixed_columns(speed_readings(_Streaming(spark), sf_dir))
    done = stream_policies(rows, delay="0 seconds", control=_controls(spark, [(0, first), (MIDDLE_MS, SECOND_POLICY)]), apps=["app1"],
                           may_apply=[("speed", r.spec) for r in [*first, *SECOND_POLICY]])
    return _published(_finished(spark, done))


@query(ORACLES["enforced_after_history"])
def streamed_after_history(spark, sf_dir):
    """The first half of the readings is history: its summary is the state that the stream of the second half starts from."""
    late = F.col("generate_ms") > MIDDLE_MS
    state = state_after(mixed_readings(spark, sf_dir).where(~late), MIXED_RULES, plan_for(spark, sf_dir, mixed_readings))
    done = stream_policies(mixed_readings(_Streaming(spark), sf_dir).where(late), MIXED_RULES, "0 seconds", state=state)
    return _finished(spark, done).select("app", "vehicle_id", "section", "event_id", "generate_ms", "pet_label", *_processed())


@query(ORACLES["reassembled_policies"])
def streamed_reassembly(spark, sf_dir):
    """Enforced and put back together in one stream of two stateful operators."""
    published = stream_policies(mixed_readings(_Streaming(spark), sf_dir), MIXED_RULES, "0 seconds", keep_time=True)
    return _finished(spark, reassemble_stream(published, delay=None)).select("app", "vehicle_id", "event_id", "frame_no", *_processed())


FAR_MS = 4_000_000_000_000  # moves the watermark past everything


class _Arrivals:
    """A folder that rows arrive in, and a stream over it that stops and starts again at its checkpoint."""

    def __init__(self, spark, sf_dir, delay):
        self.folder, self.spark, self.delay = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}", spark, delay
        self.all = speed_readings(spark, sf_dir)

    def bring(self, rows, files=1):
        rows.repartition(files, F.xxhash64("event_id")).write.mode("append").parquet(f"{self.folder}/in")

    def close(self):
        """A row of a vehicle of its own, later than all others."""
        self.bring(self.spark.range(1).select(
            F.lit(-99).cast("long").alias("vehicle_id"), F.lit(-99).cast("long").alias("event_id"),
            F.lit(FAR_MS).cast("long").alias("generate_ms"), F.lit("speed").alias("section"), F.lit(0.0).alias("scalar")))

    def run(self):
        rows = self.spark.readStream.schema(self.all.schema).option("maxFilesPerTrigger", 2).parquet(f"{self.folder}/in")
        enforced = in_order.enforce_stream(for_apps(rows, ["app1", "app2", "app3"]), SPEED_RULES, "speed", self.delay)
        in_order.run_available(enforced, f"{self.folder}/rows", f"{self.folder}/checkpoint")

    def published(self):
        return _published(self.spark.read.parquet(f"{self.folder}/rows").where("vehicle_id <> -99 or vehicle_id is null"))


@query(with_views("windowed", body=ENFORCED_SQL))
def streamed_restarts(spark, sf_dir):
    """Rows out of order, several triggers, and a stream that is stopped and started again between them."""
    stream = _Arrivals(spark, sf_dir, "9000 days")
    stream.bring(stream.all.where("event_id % 2 = 0"), 3)
    stream.run()
    stream.bring(stream.all.where("event_id % 2 <> 0 or event_id is null"), 3)
    stream.run()
    stream.close()
    stream.run()
    return stream.published()


@query(with_views("windowed", body=ENFORCED_SQL).replace(
    "value AS scalar\n  FROM events", f"value AS scalar\n  FROM events WHERE epoch_us(ts)//1000 > {MIDDLE_MS}"))
def streamed_late_rows(spark, sf_dir):
    """The first half arrives when the watermark has passed the second half: it is dropped and changes nothing."""
    stream = _Arrivals(spark, sf_dir, "0 seconds")
    late = F.col("generate_ms") <= MIDDLE_MS
    stream.bring(stream.all.where(~late))
    stream.close()
    stream.run()
    stream.bring(stream.all.where(late))
    stream.run()
    return stream.published()

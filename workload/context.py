"""Building, merging, comparing and reassembling contexts."""

from pyspark.sql import functions as F

from veilstream.operators import context as ctx
from veilstream.plans.pipelines import for_apps
from workload.fixtures import (SECTION_SQL, context_of, k_of_props, millis, mixed_readings, plan_for, query,
                               section_of_type, speed_readings, table, with_views)


@query(with_views("mixed_readings", body="""
SELECT event_id, section, generate_ms AS update_ms, coalesce(v, -1) AS v, coalesce(x, -1) AS x,
       coalesce(y, -1) AS y, coalesce(payload, '') AS payload FROM mixed_readings"""))
def lifted_contexts(spark, sf_dir):
    return ctx.to_context(mixed_readings(spark, sf_dir)).select(
        "event_id", "section", "update_ms", F.coalesce("speed.v", F.lit(-1.0)).alias("v"),
        F.coalesce("location.x", F.lit(-1.0)).alias("x"),
        F.coalesce("location.y", F.lit(-1.0)).alias("y"),
        F.coalesce(F.decode("image.data", "utf-8"), F.lit("")).alias("payload"))


@query(with_views("mixed_readings", body="""
SELECT event_id, unnest(['speed', 'location', 'image']) AS label, section FROM mixed_readings"""))
def fanned_out_contexts(spark, sf_dir):
    return ctx.fan_out(ctx.to_context(mixed_readings(spark, sf_dir)), name="label").select(
        "event_id", "label", "section")


@query(with_views("mixed_readings", body="SELECT event_id, v FROM mixed_readings WHERE section = 'speed'"))
def one_section(spark, sf_dir):
    return ctx.filter_section(mixed_readings(spark, sf_dir), "SPEED").select(
        "event_id", F.col("scalar").alias("v"))


@query(with_views("mixed_readings", body="""
SELECT vehicle_id, max(generate_ms) AS update_ms,
       coalesce(arg_max(v, generate_ms) FILTER (section = 'speed'), -1) AS v,
       coalesce(max(generate_ms) FILTER (section = 'speed'), -1) AS v_ms,
       coalesce(arg_max(x, generate_ms) FILTER (section = 'location'), -1) AS x,
       coalesce(arg_max(sequence_number, generate_ms) FILTER (section = 'image'), -1) AS image
FROM mixed_readings GROUP BY vehicle_id"""))
def latest_contexts(spark, sf_dir):
    none = F.lit(-1).cast("long")
    return ctx.latest_context(mixed_readings(spark, sf_dir)).select(
        "vehicle_id", "update_ms", F.coalesce("speed.v", F.lit(-1.0)).alias("v"),
        F.coalesce("speed.generate_ms", none).alias("v_ms"),
        F.coalesce("location.x", F.lit(-1.0)).alias("x"),
        F.coalesce("image.sequence_number", none).alias("image"))


@query(with_views("contexts", body="""
SELECT event_id, source, coalesce(v, -1) AS v, coalesce(x, -1) AS x, coalesce(payload, '') AS payload
FROM contexts"""))
def running_contexts(spark, sf_dir):
    return context_of(spark, sf_dir).select(
        "event_id", F.col("section").alias("source"), F.coalesce("speed.v", F.lit(-1.0)).alias("v"),
        F.coalesce("location.x", F.lit(-1.0)).alias("x"),
        F.coalesce(F.decode("image.data", "utf-8"), F.lit("")).alias("payload"))


@query(with_views("contexts", body="""
SELECT event_id, x, y, l_ms AS generate_ms FROM contexts WHERE l_ms IS NOT NULL"""))
def extracted_section(spark, sf_dir):
    return ctx.extract_section(context_of(spark, sf_dir), "location", ["event_id"])


def _inputs(spark, sf_dir):
    events = table(spark, sf_dir, "events")

    def side(chosen):
        return events.where(chosen).select(
            F.col("user_id").alias("vehicle_id"), "event_id", millis("ts").alias("generate_ms"),
            "value")
    speed = section_of_type() == "speed"
    return side(speed), side(~speed)


@query(f"""
WITH e AS (SELECT *, epoch_us(ts)//1000 AS ms, {SECTION_SQL} AS section FROM events),
     l AS (SELECT * FROM e WHERE section = 'speed'), r AS (SELECT * FROM e WHERE section <> 'speed')
SELECT l.event_id, 'left' AS side, l.value AS left_value, r.value AS right_value
FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.ms >= r.ms
UNION ALL
SELECT r.event_id, 'right', l.value, r.value
FROM r ASOF JOIN l ON r.user_id = l.user_id AND r.ms >= l.ms""")
def combined_inputs(spark, sf_dir):
    left, right = _inputs(spark, sf_dir)
    plan = plan_for(spark, sf_dir, mixed_readings)
    return ctx.asof_context(left, right, plan).select("event_id", "side", "left_value", "right_value")


ZIPPED = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, section ORDER BY ts, event_id) AS n
           FROM (SELECT *, {SECTION_SQL} AS section FROM events))
SELECT i.user_id AS vehicle_id, i.event_id, i.n AS frame_no, s.value AS speed, l.value AS location,
       i.props AS image
FROM n i JOIN n s ON s.user_id = i.user_id AND s.section = 'speed' AND s.n = (i.n - 1) // 10 + 1
         JOIN n l ON l.user_id = i.user_id AND l.section = 'location' AND l.n = (i.n - 1) // 10 + 1
WHERE i.section = 'image'"""


def _sections(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns({
        "vehicle_id": F.col("user_id"), "app": F.lit("app1"), "generate_ms": millis("ts")})

    def part(section, value):
        return events.where(section_of_type() == section).withColumn(section, F.col(value))
    return part("speed", "value"), part("location", "value"), part("image", "props")


@query(ZIPPED)
def reassembled_contexts(spark, sf_dir):
    plan = plan_for(spark, sf_dir, mixed_readings)
    return ctx.reassemble(*_sections(spark, sf_dir), plan).select(
        "vehicle_id", "event_id", "frame_no", "speed", "location", "image")


@query("SELECT event_id, value FROM events")
def without_processed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value").withColumns({
        "processed_scalar": F.col("value") + 1, "processed_location": F.lit(None).cast("double")})
    return ctx.erase_processed(rows)


@query(with_views("contexts", body="""
SELECT event_id, (CASE WHEN v_ms IS NULL THEN 0 ELSE 4 END + CASE WHEN l_ms IS NULL THEN 0 ELSE 2 END
       + CASE WHEN i_ms IS NULL THEN 0 ELSE 1 END)::INT AS bits FROM contexts"""))
def available_sections(spark, sf_dir):
    return context_of(spark, sf_dir).select("event_id", ctx.availability().alias("bits"))


@query(with_views("contexts", body="""
SELECT event_id, i_ms IS NULL AS same FROM contexts WHERE source <> 'image'"""))
def same_origins(spark, sf_dir):
    """Contexts of one application against those of another that sees no images."""
    plan = plan_for(spark, sf_dir, mixed_readings)
    rows = mixed_readings(spark, sf_dir)
    first = ctx.running_context(rows, plan).alias("a")
    second = ctx.running_context(rows.where(F.col("section") != "image"), plan).alias("b")
    return first.join(second, F.col("a.event_id") == F.col("b.event_id")).select(
        "a.event_id", ctx.same_origin("a", "b").alias("same"))


@query("""
SELECT event_id FROM (
  SELECT event_id, ms, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS before
  FROM (SELECT *, epoch_us(ts) // 7200000000 * 7200000 AS ms FROM events))
WHERE ms IS DISTINCT FROM before""")
def deduplicated(spark, sf_dir):
    """Times cut to two hours, so that consecutive readings often share one."""
    rows = speed_readings(spark, sf_dir).withColumns({
        "app": F.lit("app1"),
        "generate_ms": (F.floor(F.col("generate_ms") / 7_200_000) * 7_200_000).cast("long")})
    return ctx.dedupe_readings(rows, plan_for(spark, sf_dir)).select("event_id")


@query("""
SELECT event_id, printf('%.2fkm/h ', value) AS speed,
       CASE WHEN event_type = 'error' THEN '-' ELSE printf('%.2fkm/h ', value) END AS processed,
       printf('[%.2f, %.2f]', value, regexp_extract(props, '([0-9]+)', 1)::DOUBLE) AS location
FROM events""")
def display_texts(spark, sf_dir):
    value = F.col("value")
    done = F.when(F.col("event_type") != "error", value)
    return table(spark, sf_dir, "events").select(
        "event_id", ctx.speed_text(value).alias("speed"), ctx.speed_text(done).alias("processed"),
        ctx.location_text(value, k_of_props()).alias("location"))


@query(with_views("mixed_readings", body="""
SELECT event_id, section FROM mixed_readings WHERE section IN ('image', 'speed')"""))
def union_of_sections(spark, sf_dir):
    rows = mixed_readings(spark, sf_dir)
    return ctx.union_all([ctx.filter_section(rows, s).select("event_id", "section")
                          for s in ("speed", "image")])


@query("""
WITH n AS (
  SELECT user_id AS vehicle_id, event_id, app,
         row_number() OVER (PARTITION BY user_id, app ORDER BY ms, event_id) AS n
  FROM (SELECT *, 'app1' AS app, epoch_us(ts)//1000 AS ms FROM events
        UNION ALL SELECT *, 'app2', epoch_us(ts)//1000 + CASE WHEN event_type = 'error' THEN 604800000 ELSE 0 END FROM events))
SELECT a.vehicle_id, a.n, a.event_id AS app1, b.event_id AS app2
FROM n a JOIN n b ON a.vehicle_id = b.vehicle_id AND a.n = b.n
WHERE a.app = 'app1' AND b.app = 'app2'""")
def zipped_apps(spark, sf_dir):
    """Presented together: the n-th records of an application and of one that gets errors a week late."""
    return ctx.zip_apps(zipped_rows(spark, sf_dir), ["app1", "app2"], F.col("event_id"), plan_for(spark, sf_dir))


def zipped_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns({"vehicle_id": F.col("user_id"), "generate_ms": millis("ts")})
    late = (F.col("app") == "app2") & (F.col("event_type") == "error")
    return for_apps(events, ["app1", "app2"]).withColumn(
        "generate_ms", F.when(late, F.col("generate_ms") + 604_800_000).otherwise(F.col("generate_ms")))

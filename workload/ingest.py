"""Sources, history and log layouts."""

import uuid

from pyspark.sql import functions as F

from veilstream.operators.context import fan_out
from veilstream.operators.timeline import Timeline
from veilstream.session import shared_dir
from veilstream.sources import history, logs, policy_files, readings, traces
from workload.fixtures import (SECTION_SQL, context_of, k_of_props, section_of_type, mixed_readings, plan_for, query, skewed_plan,
                               skewed_readings, speed_readings, table, with_views)


def _topic(spark, sf_dir, value):
    return table(spark, sf_dir, "events").select(
        F.encode(F.lit("speed"), "utf-8").alias("key"), F.encode(value, "utf-8").alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"), "event_id")


def _scalar_topic(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return readings.parse_scalar(_topic(spark, sf_dir, text))


@query("""
SELECT 'speed' AS section, value AS scalar, epoch_us(ts)//1000 AS generate_ms, event_id
FROM events WHERE event_type <> 'error'""")
def parsed_scalars(spark, sf_dir):
    return readings.accepted(_scalar_topic(spark, sf_dir), "scalar")


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def rejected_scalars(spark, sf_dir):
    return readings.rejects(_scalar_topic(spark, sf_dir), "scalar").select("event_id")


@query("""
SELECT event_id, value AS x, regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS y,
       epoch_us(ts)//1000 AS generate_ms
FROM events WHERE event_type <> 'error'""")
def parsed_locations(spark, sf_dir):
    x, y = F.col("value").cast("string"), k_of_props().cast("string")
    text = (F.when(F.col("event_type") == "error", x)
            .when(F.col("event_type") == "view", F.concat_ws(",", x, y, F.lit("extra")))
            .otherwise(F.concat_ws(",", x, y)))
    parsed = readings.parse_location(_topic(spark, sf_dir, text))
    return readings.accepted(parsed, "location").select(
        "event_id", "location.x", "location.y", "generate_ms")


def waypoints(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("vehicle_id"), F.col("event_id").alias("seq"),
        F.col("value").alias("x"), k_of_props().alias("y"),
        (1 + F.col("event_id") % 5).alias("seconds"))


def _waypoint_plan(spark, sf_dir):
    return plan_for(spark, sf_dir, waypoints, time="seq")


WAYPOINTS = """
WITH w AS (
  SELECT user_id AS vehicle_id, event_id AS seq, value AS x,
         regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS y, 1 + event_id % 5 AS seconds FROM events),
seg AS (
  SELECT *, lag(x) OVER p AS px, lag(y) OVER p AS py, lag(seconds) OVER p AS ps,
         lag(x, 2) OVER p AS ppx, lag(y, 2) OVER p AS ppy,
         max(seq) OVER (PARTITION BY vehicle_id) AS end_seq
  FROM w WINDOW p AS (PARTITION BY vehicle_id ORDER BY seq)),
dense AS (
  SELECT *, unnest(range(0, seconds + CASE WHEN seq = end_seq THEN 1 ELSE 0 END)) AS step
  FROM seg WHERE px IS NOT NULL),
located AS (
  SELECT vehicle_id, seq, step, round(px + step * ((x - px) / seconds), 6) AS x,
         round(py + step * ((y - py) / seconds), 6) AS y FROM dense),
moving AS (
  SELECT *, sqrt(pow(px - x, 2) + pow(py - y, 2)) / seconds * 3.6e0 AS end_v,
         coalesce(sqrt(pow(ppx - px, 2) + pow(ppy - py, 2)) / ps * 3.6e0, 0) AS start_v FROM dense)
"""


@query(WAYPOINTS + "SELECT * FROM located")
def dense_waypoints(spark, sf_dir):
    dense = traces.densify_waypoints(waypoints(spark, sf_dir), _waypoint_plan(spark, sf_dir))
    return dense.select("vehicle_id", "seq", "step", F.round("x", 6).alias("x"),
                        F.round("y", 6).alias("y"))


@query(WAYPOINTS + """
SELECT vehicle_id, seq, step, round(start_v + (end_v - start_v) / seconds * step, 5) AS v FROM moving""")
def speeds_of_waypoints(spark, sf_dir):
    speeds = traces.speed_from_waypoints(waypoints(spark, sf_dir), _waypoint_plan(spark, sf_dir))
    return speeds.select("vehicle_id", "seq", "step", F.round("v", 5).alias("v"))


@query(WAYPOINTS + """
SELECT vehicle_id, x, y, row_number() OVER (PARTITION BY vehicle_id ORDER BY seq, step) - 1 AS time
FROM located""")
def exported_locations(spark, sf_dir):
    plan = _waypoint_plan(spark, sf_dir)
    dense = traces.densify_waypoints(waypoints(spark, sf_dir), plan)
    return traces.location_trace(dense, plan).select(
        "vehicle_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "time")


@query(WAYPOINTS + """
SELECT vehicle_id, seq, step,
       round(round(start_v + (end_v - start_v) / seconds * step, 5)::DECIMAL(18, 5), 2)::VARCHAR AS v
FROM moving""")
def exported_speeds(spark, sf_dir):
    speeds = traces.speed_from_waypoints(waypoints(spark, sf_dir), _waypoint_plan(spark, sf_dir))
    return traces.speed_trace(speeds.withColumn("v", F.round("v", 5)))


def _numbered(spark, sf_dir, section, name):
    chosen = section_of_type() == "speed" if section == "speed" else section_of_type() != "speed"
    rows = table(spark, sf_dir, "events").where(chosen).select(
        F.col("user_id").alias("vehicle_id"), "event_id", "value",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("generate_ms"))
    line = Timeline(["vehicle_id"], ["generate_ms", "event_id"], plan_for(spark, sf_dir))
    return line.number(rows, name).withColumn(name, F.col(name) - 1)


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, slow ORDER BY ts, event_id) - 1 AS n
           FROM (SELECT *, {SECTION_SQL} = 'speed' AS slow FROM events))
SELECT f.event_id, f.n AS tick, s.value AS speed
FROM n f JOIN n s ON f.user_id = s.user_id AND s.n = f.n // 10 WHERE NOT f.slow AND s.slow""")
def multi_rate_contexts(spark, sf_dir):
    """Other sections every tick; the speed changes with every tenth."""
    fast = _numbered(spark, sf_dir, "other", "tick").select("vehicle_id", "event_id", "tick")
    slow = _numbered(spark, sf_dir, "speed", "sample").select(
        "vehicle_id", "sample", F.col("value").alias("speed"))
    return traces.multi_rate_context(fast, slow).select("event_id", "tick", "speed")


@query("""
WITH rules AS (
  SELECT DISTINCT 'app-' || c_mktsegment AS app, 'section' || c_nationkey % 3 AS section,
         'p' || c_nationkey || '.json' AS predicate_file, 'r' || n_regionkey || '.json' AS pet_file,
         c_nationkey % 7 AS priority, n_name, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT app, section, (row_number() OVER (PARTITION BY app, section
         ORDER BY priority, predicate_file, pet_file))::INT AS rule_no, priority,
       n_name AS predicate, r_name AS pet FROM rules""")
def loaded_policy(spark, sf_dir):
    """Rules that name files, with the files' text in place of the names."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customers = table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rules = customers.select(
        F.concat(F.lit("app-"), "c_mktsegment").alias("app"),
        F.concat(F.lit("section"), (F.col("c_nationkey") % 3).cast("string")).alias("section"),
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string"), F.lit(".json")).alias("predicate_file"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".json")).alias("pet_file"),
        (F.col("c_nationkey") % 7).alias("priority")).distinct()
    predicates = nation.select(
        F.concat(F.lit("p"), F.col("n_nationkey").cast("string"), F.lit(".json")).alias("name"),
        F.col("n_name").alias("text"))
    pets = region.select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".json")).alias("name"),
        F.col("r_name").alias("text"))
    return policy_files.resolve_rules(rules, predicates, pets).select(
        "app", "section", "rule_no", "priority", "predicate", "pet")


@query(with_views("mixed_readings", body="""
SELECT section, vehicle_id, event_id, generate_ms, coalesce(v, -1) AS scalar, coalesce(x, -1) AS x
FROM mixed_readings"""))
def history_layout(spark, sf_dir):
    return history.history_rows(mixed_readings(spark, sf_dir)).select(
        "section", "vehicle_id", "event_id", "generate_ms",
        F.coalesce("scalar", F.lit(-1.0)).alias("scalar"),
        F.coalesce("location.x", F.lit(-1.0)).alias("x"))


def _error_events(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error").select("event_id")


PIECE_SQL = """
SELECT trigger_event_id, event_id, scalar, back FROM (
  SELECT t.event_id AS trigger_event_id, h.event_id, h.scalar,
         row_number() OVER (PARTITION BY t.event_id ORDER BY h.generate_ms DESC, h.event_id DESC) AS back
  FROM speed_readings t JOIN events e ON e.event_id = t.event_id AND e.event_type = 'error'
       JOIN speed_readings h ON h.vehicle_id = t.vehicle_id AND h.generate_ms < t.generate_ms)
WHERE back <= 4"""


def _piece(spark, sf_dir, rows, plan):
    triggers = rows.join(_error_events(spark, sf_dir), "event_id", "left_semi")
    return history.warmup_piece(triggers, rows.select("vehicle_id", "event_id", "generate_ms", "scalar"),
                                5, plan).select("trigger_event_id", "event_id", "scalar", "back")


@query(with_views("speed_readings", body=PIECE_SQL))
def warmup_records(spark, sf_dir):
    """The four readings before every trigger."""
    return _piece(spark, sf_dir, speed_readings(spark, sf_dir), plan_for(spark, sf_dir))


@query(with_views("speed_readings", body=PIECE_SQL, skewed=True))
def warmup_records_hot_vehicle(spark, sf_dir):
    """The same when one vehicle holds a third of all rows."""
    return _piece(spark, sf_dir, skewed_readings(spark, sf_dir), skewed_plan(spark, sf_dir))


@query(with_views("speed_readings", body="""
SELECT t.event_id AS trigger_event_id, h.event_id
FROM speed_readings t JOIN events e ON e.event_id = t.event_id AND e.event_type = 'error'
     JOIN speed_readings h ON h.vehicle_id = t.vehicle_id
      AND h.generate_ms > t.generate_ms - 86400000 AND h.generate_ms < t.generate_ms"""))
def warmup_period(spark, sf_dir):
    """The readings of the day before every trigger."""
    rows = speed_readings(spark, sf_dir)
    triggers = rows.join(_error_events(spark, sf_dir), "event_id", "left_semi")
    return history.warmup_time(triggers, rows, 86_400).select("trigger_event_id", "event_id")


RING_SQL = """
SELECT vehicle_id, event_id, scalar, back FROM (
  SELECT vehicle_id, event_id, scalar, row_number() OVER (PARTITION BY vehicle_id ORDER BY generate_ms DESC, event_id DESC) AS back
  FROM speed_readings) r
WHERE back <= 9"""


def _ring(spark, rows):
    """The readings as a bucketed store, written in two parts, and the nine newest of every vehicle in it."""
    name = f"history_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    for part in (0, 1):
        history.write_history_table(rows.where(F.pmod("event_id", F.lit(2)) == part), name, path, buckets=8)
    ring = history.latest_records(history.read_history_table(spark, name, "speed"), 10)
    return ring.select("vehicle_id", "event_id", "scalar", "back")


@query(with_views("speed_readings", body=RING_SQL))
def history_ring(spark, sf_dir):
    return _ring(spark, speed_readings(spark, sf_dir))


@query(with_views("speed_readings", body=RING_SQL, skewed=True))
def history_ring_hot_vehicle(spark, sf_dir):
    """The same when one vehicle holds a third of all rows."""
    return _ring(spark, skewed_readings(spark, sf_dir))


TOTALS_SQL = """
SELECT t.event_id AS trigger_event_id, count(h.event_id) AS n,
       round(coalesce(sum(h.scalar), 0), 4) AS total
FROM speed_readings t JOIN events e ON e.event_id = t.event_id AND e.event_type = 'error'
     LEFT JOIN speed_readings h ON h.vehicle_id = t.vehicle_id
      AND h.generate_ms > t.generate_ms - 86400000 AND h.generate_ms < t.generate_ms
GROUP BY t.event_id"""


def _totals(spark, sf_dir, rows, plan):
    triggers = rows.join(_error_events(spark, sf_dir), "event_id", "left_semi")
    return history.warmup_totals(triggers, rows, 86_400, plan).select(
        "trigger_event_id", "n", F.round("total", 4).alias("total"))


@query(with_views("speed_readings", body=TOTALS_SQL))
def warmup_totals(spark, sf_dir):
    """Number and sum of the readings of the day before every trigger, without listing them."""
    return _totals(spark, sf_dir, speed_readings(spark, sf_dir), plan_for(spark, sf_dir))


@query(with_views("speed_readings", body=TOTALS_SQL, skewed=True))
def warmup_totals_hot_vehicle(spark, sf_dir):
    """The same when one vehicle holds a third of all rows."""
    return _totals(spark, sf_dir, skewed_readings(spark, sf_dir), skewed_plan(spark, sf_dir))


@query(with_views("contexts", body="""
SELECT event_id, 'speed' AS section, v_ms AS generate_ms, v::VARCHAR AS original
FROM contexts WHERE v_ms IS NOT NULL
UNION ALL SELECT event_id, 'location', l_ms, x::VARCHAR || ',' || y::VARCHAR FROM contexts
WHERE l_ms IS NOT NULL"""))
def logged_sections(spark, sf_dir):
    """Each labelled context logs its own section's reading."""
    labelled = fan_out(context_of(spark, sf_dir).drop("section"), ["Speed", "LOCATION"])
    return logs.own_section(labelled).select("event_id", "section", "generate_ms", "original")

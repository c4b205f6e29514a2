"""Enforcement of decisions, whole policies, sharding and quorums."""

from pyspark.sql import functions as F

from veilstream.functions.petspec import PetSpec, pet_json
from veilstream.operators import enforce as enf
from veilstream.operators import shards
from veilstream.operators.policy import Rule, versioned
from veilstream.plans import pipelines
from workload.fixtures import (AVERAGE, CLAMP, LOCATION_RULES, MEDIAN, MIXED_RULES, NONE, SKEWED_KEY, SPEED_RULES,
                               _speed_rule, forced_decisions, millis, mixed_readings, plan_for, query, readings_of_app, skewed_plan,
                               skewed_readings, speed_readings, table, with_views)

FORCED = [PetSpec.from_json(p) for p in (NONE, AVERAGE, CLAMP)]

ENFORCED_SQL = """
SELECT app, vehicle_id, event_id, generate_ms, pet_label,
       round(CASE pet_label WHEN 'average5' THEN mean5 WHEN 'median5' THEN median5 WHEN 'none' THEN scalar
             ELSE least(greatest(scalar, 0.0), 100.0) END, 6) AS processed
FROM windowed
WHERE pet_label IS NOT NULL AND (pet_label NOT IN ('average5', 'median5') OR n5 = 5)"""


def _published(df):
    return df.select("app", "vehicle_id", "event_id", "generate_ms", "pet_label",
                     F.round("processed_scalar", 6).alias("processed"))


@query(with_views("windowed", body=ENFORCED_SQL))
def enforced_speed(spark, sf_dir):
    """Readings -> rules -> switches -> the transformation in force, for three applications."""
    return _published(pipelines.enforce_speed(speed_readings(spark, sf_dir), SPEED_RULES,
                                              plan_for(spark, sf_dir)))


@query(with_views("windowed", body=ENFORCED_SQL, skewed=True))
def enforced_speed_hot_vehicle(spark, sf_dir):
    """The same when one vehicle holds a third of all rows."""
    return _published(pipelines.enforce_speed(skewed_readings(spark, sf_dir), SPEED_RULES,
                                              skewed_plan(spark, sf_dir)))


@query(with_views("active", body="""
SELECT event_id, coalesce(decision_id, '') AS decision_id, coalesce(pet_label, '') AS pet_label
FROM active"""))
def active_decisions(spark, sf_dir):
    active = enf.active_pet(readings_of_app(spark, sf_dir), forced_decisions(spark, sf_dir),
                            plan_for(spark, sf_dir))
    return active.select("event_id", F.coalesce("decision_id", F.lit("")).alias("decision_id"),
                         F.coalesce("pet_label", F.lit("")).alias("pet_label"))


@query(with_views("forced_output", body="SELECT * FROM forced_output"))
def switched_enforcement(spark, sf_dir):
    """One transformation at a time, swapped at the trigger record."""
    return _published(pipelines.enforce_decided(
        readings_of_app(spark, sf_dir), forced_decisions(spark, sf_dir), FORCED, "speed",
        plan_for(spark, sf_dir))).drop("app")


@query(with_views("forced_output", body="SELECT * FROM forced_output"))
def filtered_outputs(spark, sf_dir):
    """All transformations on all records, then the one in force: must equal switching."""
    return _published(pipelines.filter_outputs(
        readings_of_app(spark, sf_dir), forced_decisions(spark, sf_dir), FORCED, "speed",
        plan_for(spark, sf_dir))).drop("app")


@query(with_views("active", body="""
SELECT event_id, CASE WHEN pet_label = 'none' THEN 'none' ELSE 'clamp0.0100.0' END AS pet_label,
       CASE WHEN pet_label = 'none' THEN scalar ELSE least(greatest(scalar, 0.0), 100.0) END AS processed
FROM active WHERE pet_label IS NOT NULL"""))
def stateless_enforcement(spark, sf_dir):
    decided = forced_decisions(spark, sf_dir).withColumn(
        "pet_label", F.when(F.col("pet_label") == "none", "none").otherwise("clamp0.0100.0"))
    return _published(pipelines.enforce_decided(
        readings_of_app(spark, sf_dir), decided, [FORCED[0], FORCED[2]], "speed",
        plan_for(spark, sf_dir))).select("event_id", "pet_label", "processed")


@query(with_views("active", body="SELECT event_id FROM active WHERE pet_label IS NULL"))
def withheld_records(spark, sf_dir):
    """Records before the first decision of their vehicle are not published."""
    active = enf.active_pet(readings_of_app(spark, sf_dir), forced_decisions(spark, sf_dir),
                            plan_for(spark, sf_dir))
    published = enf.withhold(active).select("event_id")
    return readings_of_app(spark, sf_dir).select("event_id").join(published, "event_id", "left_anti")


@query(with_views("active", body="""
SELECT event_id, unnest(['speed', 'location']) AS section, pet_label
FROM active WHERE pet_label IS NOT NULL"""))
def decisions_for_several_sections(spark, sf_dir):
    decided = enf.per_section(forced_decisions(spark, sf_dir).withColumn(
        "sections", F.array(F.lit("speed"), F.lit("location"))))
    rows = readings_of_app(spark, sf_dir)
    both = rows.unionByName(rows.withColumn("section", F.lit("location")))
    return enf.withhold(enf.active_pet(both, decided, plan_for(spark, sf_dir))).select(
        "event_id", "section", "pet_label")


# --- whole policies ------------------------------------------------------------------------------

IN_SQUARE = "(x >= 0 AND x < 60 AND y >= 0 AND y < 60)"
POLICIES = with_views("contexts", body="").rstrip() + f""",
scoped AS (
  SELECT *, unnest(['app1', 'app2']) AS app FROM contexts),
labelled AS (
  SELECT *, unnest(['speed', 'location', 'image']) AS section FROM scoped),
ruled AS (
  SELECT *, CASE app || section
    WHEN 'app1speed' THEN CASE WHEN v > 60 THEN 'average5' WHEN v <= 60 THEN 'none' END
    WHEN 'app2speed' THEN CASE WHEN v > 100 THEN 'clamp0.0100.0' WHEN v > 50 THEN 'median5'
                               WHEN v >= 0 THEN 'none' END
    WHEN 'app1location' THEN CASE WHEN {IN_SQUARE} THEN 'geo57.522.00.20.253.0'
                                  WHEN NOT {IN_SQUARE} THEN 'none' END
    WHEN 'app2location' THEN CASE WHEN {IN_SQUARE} THEN 'none' END
    WHEN 'app1image' THEN CASE WHEN v > 60 THEN 'image_redactionblackout' WHEN v <= 60 THEN 'none' END
    WHEN 'app2image' THEN CASE WHEN v > 20 AND {IN_SQUARE} THEN 'image_redactionblackout'
                               WHEN v >= 0 THEN 'none' END END AS hit FROM labelled),
decided AS (
  SELECT *, last_value(hit IGNORE NULLS) OVER (PARTITION BY app, section, vehicle_id
           ORDER BY generate_ms, event_id ROWS UNBOUNDED PRECEDING) AS pet_label FROM ruled),
own AS (SELECT * FROM decided WHERE source = section),
timed AS (
  SELECT *, (generate_ms - min(generate_ms) OVER (PARTITION BY app, section, vehicle_id)) / 1e3 AS t
  FROM own),
framed AS (
  SELECT *, avg(v) OVER w AS mean5, quantile_disc(v, 0.5) OVER w AS median5, count(*) OVER w AS n5,
         avg(x) OVER w + coalesce(regr_slope(x, t) OVER w, 0) * (t - avg(t) OVER w) AS px,
         avg(y) OVER w + coalesce(regr_slope(y, t) OVER w, 0) * (t - avg(t) OVER w) AS py,
         (('0x' || substr(md5('0r|' || vehicle_id || '|' || event_id), 1, 8))::BIGINT + 0.5e0)
           / 4294967296e0 AS u,
         (('0x' || substr(md5('0a|' || vehicle_id || '|' || event_id), 1, 8))::BIGINT + 0.5e0)
           / 4294967296e0 AS a
  FROM timed WINDOW w AS (PARTITION BY app, section, vehicle_id ORDER BY generate_ms, event_id
                          ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
noise AS (
  SELECT *, CASE WHEN e < 7.5e0 THEN 0.2e0 * 0.25e0 WHEN e < 22e0 THEN 0.2e0 ELSE 3e0 * 0.2e0 END
            - e * sign(u - 0.5e0) * ln(1 - 2 * abs(u - 0.5e0)) AS r
  FROM (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS e FROM framed)),
published AS (
  SELECT app, vehicle_id, section, event_id, generate_ms, pet_label,
         CASE WHEN section = 'speed' THEN round(CASE pet_label WHEN 'none' THEN v
           WHEN 'average5' THEN mean5 WHEN 'median5' THEN median5
           ELSE least(greatest(v, 0.0), 100.0) END, 6) ELSE -1 END AS p_speed,
         CASE WHEN section = 'location' THEN round(CASE pet_label WHEN 'none' THEN x
           ELSE x + r * cos(a * 2e0 * pi()) END, 3) + 0e0 ELSE -1 END AS p_x,
         CASE WHEN section = 'image' THEN CASE pet_label WHEN 'none' THEN payload
           ELSE repeat('0', length(payload)) END ELSE '' END AS p_image
  FROM noise WHERE pet_label IS NOT NULL
    AND (pet_label NOT IN ('average5', 'median5', 'geo57.522.00.20.253.0') OR n5 = 5))
"""


def _all_policies(spark, sf_dir):
    return pipelines.run_policies(mixed_readings(spark, sf_dir), MIXED_RULES,
                                  plan_for(spark, sf_dir, mixed_readings))


def _processed():
    image = F.regexp_replace(F.decode("processed_image", "utf-8"), "\\x00", "0")
    return [F.coalesce(F.round("processed_scalar", 6), F.lit(-1.0)).alias("p_speed"),
            F.coalesce(F.round("processed_location.x", 3) + 0.0, F.lit(-1.0)).alias("p_x"),
            F.coalesce(image, F.lit("")).alias("p_image")]


@query(POLICIES + "SELECT * FROM published")
def enforced_policies(spark, sf_dir):
    """All sections of two applications at once."""
    return _all_policies(spark, sf_dir).select(
        "app", "vehicle_id", "section", "event_id", "generate_ms", "pet_label", *_processed())


REASSEMBLED = """,
n AS (SELECT *, row_number() OVER (PARTITION BY app, vehicle_id, section
                                   ORDER BY generate_ms, event_id) AS n FROM published)
SELECT i.app, i.vehicle_id, i.event_id, i.n AS frame_no, s.p_speed, l.p_x, i.p_image
FROM n i JOIN n s ON i.app = s.app AND i.vehicle_id = s.vehicle_id AND s.section = 'speed'
                 AND s.n = (i.n - 1) // 10 + 1
         JOIN n l ON i.app = l.app AND i.vehicle_id = l.vehicle_id AND l.section = 'location'
                 AND l.n = (i.n - 1) // 10 + 1
WHERE i.section = 'image'"""


@query(POLICIES + REASSEMBLED)
def reassembled_policies(spark, sf_dir):
    """The published sections put back together into one context per image."""
    plan = plan_for(spark, sf_dir, mixed_readings)
    whole = pipelines.reassemble_policies(_all_policies(spark, sf_dir), plan)
    return whole.select("app", "vehicle_id", "event_id", "frame_no", *_processed())


MIDDLE_MS = 1_705_300_000_000
SKEWED_POLICIES = POLICIES.replace("user_id AS vehicle_id", SKEWED_KEY)


def skewed_mixed(spark, sf_dir):
    """``mixed_readings`` where one vehicle holds a third of all rows."""
    return mixed_readings(spark, sf_dir).withColumn(
        "vehicle_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("vehicle_id")))


def _hot_policies(spark, sf_dir):
    plan = plan_for(spark, sf_dir, skewed_mixed, share=0.01)
    return plan, pipelines.run_policies(skewed_mixed(spark, sf_dir), MIXED_RULES, plan)


@query(SKEWED_POLICIES + "SELECT * FROM published")
def enforced_policies_hot_vehicle(spark, sf_dir):
    """The same when one vehicle holds a third of all rows."""
    return _hot_policies(spark, sf_dir)[1].select(
        "app", "vehicle_id", "section", "event_id", "generate_ms", "pet_label", *_processed())


@query(SKEWED_POLICIES + REASSEMBLED)
def reassembled_policies_hot_vehicle(spark, sf_dir):
    plan, published = _hot_policies(spark, sf_dir)
    return pipelines.reassemble_policies(published, plan).select("app", "vehicle_id", "event_id", "frame_no", *_processed())


@query(POLICIES + f"SELECT * FROM published WHERE generate_ms > {MIDDLE_MS}")
def enforced_after_history(spark, sf_dir):
    """The first half of the readings is history: the second goes on where it ended."""
    rows, late = mixed_readings(spark, sf_dir), F.col("generate_ms") > MIDDLE_MS
    done = pipelines.run_policies(rows.where(late), MIXED_RULES, plan_for(spark, sf_dir, mixed_readings),
                                  history=rows.where(~late))
    return done.select("app", "vehicle_id", "section", "event_id", "generate_ms", "pet_label", *_processed())


SECOND_POLICY = [Rule("app1", "speed", 1, 1, _speed_rule("GREATER", 90), CLAMP),
                 Rule("app1", "speed", 2, 2, _speed_rule("LESS_EQUAL", 40), MEDIAN)]


@query(with_views("speed_readings", body="").rstrip() + f""",
evaluated AS (
  SELECT *, CASE WHEN generate_ms < {MIDDLE_MS} THEN CASE WHEN scalar > 60 THEN 1 WHEN scalar <= 60 THEN 2 END
            ELSE CASE WHEN scalar > 90 THEN 3 WHEN scalar <= 40 THEN 4 END END AS rule FROM speed_readings),
labelled AS (
  SELECT *, (['average5', 'none', 'clamp0.0100.0', 'median5'])[last_value(rule IGNORE NULLS) OVER (
           PARTITION BY vehicle_id ORDER BY generate_ms, event_id ROWS UNBOUNDED PRECEDING)] AS pet_label FROM evaluated),
windowed AS (
  SELECT 'app1' AS app, *, avg(scalar) OVER w AS mean5, quantile_disc(scalar, 0.5) OVER w AS median5, count(*) OVER w AS n5
  FROM labelled WINDOW w AS (PARTITION BY vehicle_id ORDER BY generate_ms, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
""" + ENFORCED_SQL)
def enforced_under_versions(spark, sf_dir):
    """A second version of the policy replaces the first in the middle of the time."""
    rules = versioned([(0, [r for r in SPEED_RULES if r.app == "app1"]), (MIDDLE_MS, SECOND_POLICY)])
    return _published(pipelines.enforce_speed(speed_readings(spark, sf_dir), rules, plan_for(spark, sf_dir)))


WIDE_NONE = pet_json("none", outputs=["speed", "location"])
WIDE_RULES = [Rule("app1", "speed", 1, 1, _speed_rule("GREATER", 60), WIDE_NONE),
              Rule("app1", "speed", 2, 2, _speed_rule("LESS_EQUAL", 60), AVERAGE),
              *[r for r in LOCATION_RULES if r.app == "app1"],
              Rule("app2", "speed", 1, 1, _speed_rule("GREATER", 30), WIDE_NONE)]


@query(with_views("contexts", body="").rstrip() + f""",
hit AS (
  SELECT *, CASE WHEN app = 'app1' THEN CASE WHEN v > 60 THEN 1 WHEN v <= 60 THEN 2 END WHEN v > 30 THEN 3 END AS s,
         CASE WHEN app = 'app1' THEN CASE WHEN {IN_SQUARE} THEN 1 WHEN NOT {IN_SQUARE} THEN 2 END END AS l
  FROM (SELECT *, unnest(['app1', 'app2']) AS app FROM contexts)),
was AS (
  SELECT *, last_value(s IGNORE NULLS) OVER w AS s0, last_value(l IGNORE NULLS) OVER w AS l0 FROM hit
  WINDOW w AS (PARTITION BY app, vehicle_id ORDER BY generate_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
choice AS (
  SELECT *, CASE WHEN s IS NOT NULL AND s IS DISTINCT FROM s0 THEN CASE s WHEN 2 THEN 'average5' ELSE 'none' END END AS for_speed,
         CASE WHEN l IS NOT NULL AND l IS DISTINCT FROM l0 THEN CASE l WHEN 1 THEN 'geo57.522.00.20.253.0' ELSE 'none' END
              WHEN s IS NOT NULL AND s IS DISTINCT FROM s0 AND s <> 2 THEN 'none' END AS for_location FROM was),
active AS (
  SELECT *, last_value(for_speed IGNORE NULLS) OVER w AS p_speed, last_value(for_location IGNORE NULLS) OVER w AS p_location
  FROM choice WINDOW w AS (PARTITION BY app, vehicle_id ORDER BY generate_ms, event_id ROWS UNBOUNDED PRECEDING)),
own AS (
  SELECT app, vehicle_id, source AS section, event_id, CASE source WHEN 'speed' THEN p_speed ELSE p_location END AS pet_label,
         count(*) OVER (PARTITION BY app, vehicle_id, source ORDER BY generate_ms, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n5
  FROM active WHERE source <> 'image')
SELECT app, vehicle_id, section, event_id, pet_label FROM own WHERE pet_label IS NOT NULL AND (pet_label = 'none' OR n5 = 5)""")
def policies_with_several_outputs(spark, sf_dir):
    """A speed rule whose transformation also decides about locations, with and without location rules."""
    done = pipelines.run_policies(mixed_readings(spark, sf_dir), WIDE_RULES, plan_for(spark, sf_dir, mixed_readings))
    return done.select("app", "vehicle_id", "section", "event_id", "pet_label")


# --- sharding ------------------------------------------------------------------------------------

@query("""
WITH acks AS (SELECT l_orderkey AS decision_id, (l_linenumber - 1) % 4 AS instance,
                     epoch_us(l_shipdate)//1000 AS ack_ms FROM lineitem),
firsts AS (SELECT decision_id, instance, min(ack_ms) AS first_ms, count(*) AS times
           FROM acks GROUP BY ALL)
SELECT decision_id, max(first_ms) AS ready_ms, (sum(times) - count(*))::BIGINT AS duplicates
FROM firsts GROUP BY decision_id HAVING count(*) = 4""")
def acknowledged_decisions(spark, sf_dir):
    """Orders as decisions, line items as acknowledgements of four instances."""
    acks = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("decision_id"),
        ((F.col("l_linenumber") - 1) % 4).alias("instance"), millis("l_shipdate").alias("ack_ms"))
    return shards.quorum(acks, 4)


def sharded(spark, sf_dir):
    """Four shards of different lengths."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7 % 4).alias("shard"))


@query("""
WITH n AS (SELECT event_id, event_id % 7 % 4 AS shard,
                  row_number() OVER (PARTITION BY event_id % 7 % 4 ORDER BY event_id) AS n FROM events),
full_rounds AS (SELECT min(m) AS m FROM (SELECT count(*) AS m FROM n GROUP BY shard))
SELECT event_id, shard, (n - 1) * 4 + shard AS emit_no FROM n JOIN full_rounds ON n <= m""")
def restored_order(spark, sf_dir):
    plan = plan_for(spark, sf_dir, sharded, key="shard", time="event_id", share=0.05)
    return shards.interleave(sharded(spark, sf_dir), "shard", 4, ["event_id"], plan)


@query("""
SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 4 AS shard
FROM events""")
def assigned_shards(spark, sf_dir):
    return shards.round_robin(speed_readings(spark, sf_dir), 4, ["generate_ms", "event_id"],
                              plan_for(spark, sf_dir)).select("event_id", "shard")


@query("""
SELECT event_id, (row_number() OVER (PARTITION BY CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END
                                     ORDER BY ts, event_id) - 1) % 4 AS shard
FROM events""")
def assigned_shards_hot_vehicle(spark, sf_dir):
    """The same when one vehicle holds a third of all rows."""
    return shards.round_robin(skewed_readings(spark, sf_dir), 4, ["generate_ms", "event_id"],
                              skewed_plan(spark, sf_dir)).select("event_id", "shard")

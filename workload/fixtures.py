"""The given tables seen as readings, once for Spark and once as SQL text for the check.

Every view covers its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.functions.petspec import pet_json
from veilstream.operators.context import running_context
from veilstream.operators.policy import Rule
from veilstream.operators.timeline import SlicePlan, plan_slices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return register


SKEWED_KEY = "CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS vehicle_id"


def with_views(*names: str, body: str, recursive: bool = False, skewed: bool = False) -> str:
    """SQL text: the named views as CTEs (with the views they need), then ``body``.

    With ``skewed``, one vehicle holds a third of all rows.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        text, needs = VIEWS[name]
        for need in needs:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][0]})" for name in ordered)
    text = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
    return text.replace("user_id AS vehicle_id", SKEWED_KEY) if skewed else text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def section_of_type():
    """Every event is a reading of one section."""
    return (F.when(F.col("event_type").isin("click", "signup"), "speed")
            .when(F.col("event_type").isin("view", "error"), "location").otherwise("image"))


SECTION_SQL = ("CASE WHEN event_type IN ('click', 'signup') THEN 'speed' "
               "WHEN event_type IN ('view', 'error') THEN 'location' ELSE 'image' END")


def k_of_props():
    return F.regexp_extract("props", r"(\d+)", 1).cast("double")


# --- Spark views ---------------------------------------------------------------------------------

def speed_readings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("vehicle_id"), "event_id", millis("ts").alias("generate_ms"),
        F.lit("speed").alias("section"), F.col("value").alias("scalar"))


def points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("vehicle_id"), "event_id", millis("ts").alias("generate_ms"),
        F.lit("location").alias("section"),
        F.struct(F.col("value").alias("x"), k_of_props().alias("y")).alias("location"))


def mixed_readings(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.withColumn("section", section_of_type())
    return rows.select(
        F.col("user_id").alias("vehicle_id"), "section", "event_id", millis("ts").alias("generate_ms"),
        F.when(F.col("section") == "speed", F.col("value")).alias("scalar"),
        F.when(F.col("section") == "location",
               F.struct(F.col("value").alias("x"), k_of_props().alias("y"))).alias("location"),
        F.when(F.col("section") == "image", F.encode("props", "utf-8")).alias("image"),
        F.when(F.col("section") == "image", F.col("event_id")).alias("sequence_number"))


def mixed_columns(rows: DataFrame) -> DataFrame:
    """Speed readings with the columns of all sections."""
    return rows.withColumns({"location": F.lit(None).cast("struct<x:double,y:double>"), "image": F.lit(None).cast("binary"),
                             "sequence_number": F.lit(None).cast("long")})


def skewed_readings(spark, sf_dir) -> DataFrame:
    """Speed readings where one vehicle holds a third of all rows."""
    return speed_readings(spark, sf_dir).withColumn(
        "vehicle_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long"))
        .otherwise(F.col("vehicle_id")))


def forced_decisions(spark, sf_dir) -> DataFrame:
    """Every ``error`` event decides; which PET depends on its id."""
    label = (F.when(F.col("event_id") % 3 == 0, "none").when(F.col("event_id") % 3 == 1, "average5")
             .otherwise("clamp0.0100.0"))
    return table(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("decision_id"),
        F.lit("app1").alias("app"), F.col("user_id").alias("vehicle_id"),
        F.lit("speed").alias("section"), F.col("event_id").alias("trigger_event_id"),
        millis("ts").alias("generation_ms"), label.alias("pet_label"))


def readings_of_app(spark, sf_dir, app: str = "app1") -> DataFrame:
    return speed_readings(spark, sf_dir).withColumn("app", F.lit(app))


def plan_for(spark, sf_dir, view=None, key="vehicle_id", time="generate_ms", share=None) -> SlicePlan:
    """Slices for a view. With ``share``, a key is hot from that share of all rows on."""
    view = view or speed_readings
    rows = view(spark, sf_dir)
    target = {} if share is None else {"target_rows": max(50, int(rows.count() * share))}
    return plan_slices(rows, key, time, **target)


def context_of(spark, sf_dir) -> DataFrame:
    """``mixed_readings`` with every section carried forward."""
    return running_context(mixed_readings(spark, sf_dir), plan_for(spark, sf_dir, mixed_readings))


def skewed_plan(spark, sf_dir) -> SlicePlan:
    return plan_for(spark, sf_dir, skewed_readings, share=0.01)


# --- policies ------------------------------------------------------------------------------------

NONE = pet_json("none")
AVERAGE = pet_json("average", [("Integer", 5)], [("speed", "PIECE", 5)], ["speed"], ["speed"])
MEDIAN = pet_json("median", [("Integer", 5)], [("speed", "PIECE", 5)], ["speed"], ["speed"])
CLAMP = pet_json("clamp", [("Double", 0.0), ("Double", 100.0)], [], ["speed"], ["speed"])
GEO = pet_json("geo", [("Integer", 5), ("Double", 7.5), ("Double", 22.0), ("Double", 0.2),
                       ("Double", 0.25), ("Double", 3.0)],
               [("location", "PIECE", 5)], ["location"], ["location"])
BLANK = pet_json("image_redaction", [("String", "blackout")], [], ["image"], ["image"])


def _speed_rule(relation: str, value: float) -> str:
    return ('{"scalar": [{"data section": "speed", "relation": "%s", "value": %s}]}'
            % (relation, value))


SQUARE = '{"x": [0, 60, 60, 0], "y": [0, 0, 60, 60]}'


def _area_rule(relation: str) -> str:
    return '{"location": [{"relation": "%s", "value": %s}]}' % (relation, SQUARE)


SPEED_RULES = [
    # exclusive rules
    Rule("app1", "speed", 1, 1, _speed_rule("GREATER", 60), AVERAGE),
    Rule("app1", "speed", 2, 2, _speed_rule("LESS_EQUAL", 60), NONE),
    # overlapping rules
    Rule("app2", "speed", 1, 1, _speed_rule("GREATER", 100), CLAMP),
    Rule("app2", "speed", 2, 2, _speed_rule("GREATER", 50), MEDIAN),
    Rule("app2", "speed", 3, 3, _speed_rule("GREATER_EQUAL", 0), NONE),
    # no rule between 20 and 80
    Rule("app3", "speed", 1, 1, _speed_rule("GREATER", 80), CLAMP),
    Rule("app3", "speed", 2, 1, _speed_rule("LESS", 20), NONE),
]
LOCATION_RULES = [
    Rule("app1", "location", 1, 1, _area_rule("IN"), GEO),
    Rule("app1", "location", 2, 2, _area_rule("OUT_OF"), NONE),
]
MIXED_RULES = [
    *[r for r in SPEED_RULES if r.app in ("app1", "app2")],
    *LOCATION_RULES,
    Rule("app2", "location", 1, 1, _area_rule("IN"), NONE),
    Rule("app1", "image", 1, 1, _speed_rule("GREATER", 60), BLANK),
    Rule("app1", "image", 2, 2, _speed_rule("LESS_EQUAL", 60), NONE),
    Rule("app2", "image", 1, 1, '{"logic": "AND", "scalar": [{"data section": "speed", '
         '"relation": "GREATER", "value": 20}], "location": [{"relation": "IN", "value": %s}]}'
         % SQUARE, BLANK),
    Rule("app2", "image", 2, 2, _speed_rule("GREATER_EQUAL", 0), NONE),
]

# --- SQL views -----------------------------------------------------------------------------------

ORDERED = "ORDER BY generate_ms, event_id"

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "speed_readings": ("""
  SELECT user_id AS vehicle_id, event_id, epoch_us(ts)//1000 AS generate_ms, value AS scalar
  FROM events""", ()),
    "app_readings": ("""
  SELECT unnest(['app1', 'app2']) AS app, * FROM speed_readings""", ("speed_readings",)),
    "versions": ("""
  SELECT CASE WHEN event_id % 2 = 0 THEN 'app1' ELSE 'app2' END AS app, event_id AS version,
         epoch_us(ts)//1000 AS effective_ms
  FROM events WHERE event_type = 'signup'""", ()),
    "points": ("""
  SELECT user_id AS vehicle_id, event_id, epoch_us(ts)//1000 AS generate_ms, value AS x,
         regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS y
  FROM events""", ()),
    "mixed_readings": (f"""
  SELECT user_id AS vehicle_id, event_id, epoch_us(ts)//1000 AS generate_ms, section,
         CASE WHEN section = 'speed' THEN value END AS v,
         CASE WHEN section = 'location' THEN value END AS x,
         CASE WHEN section = 'location' THEN regexp_extract(props, '([0-9]+)', 1)::DOUBLE END AS y,
         CASE WHEN section = 'image' THEN props END AS payload,
         CASE WHEN section = 'image' THEN event_id END AS sequence_number
  FROM (SELECT *, {SECTION_SQL} AS section FROM events)""", ()),
    "contexts": (f"""
  SELECT vehicle_id, event_id, generate_ms, section AS source,
         last_value(v IGNORE NULLS) OVER w AS v,
         last_value(CASE WHEN section = 'speed' THEN generate_ms END IGNORE NULLS) OVER w AS v_ms,
         last_value(x IGNORE NULLS) OVER w AS x, last_value(y IGNORE NULLS) OVER w AS y,
         last_value(CASE WHEN section = 'location' THEN generate_ms END IGNORE NULLS) OVER w AS l_ms,
         last_value(payload IGNORE NULLS) OVER w AS payload,
         last_value(CASE WHEN section = 'image' THEN generate_ms END IGNORE NULLS) OVER w AS i_ms
  FROM mixed_readings
  WINDOW w AS (PARTITION BY vehicle_id {ORDERED} ROWS UNBOUNDED PRECEDING)""", ("mixed_readings",)),
    "evaluated": ("""
  SELECT 'app1' AS app, *, CASE WHEN scalar > 60 THEN 1 WHEN scalar <= 60 THEN 2 END AS rule_no,
         CASE WHEN scalar > 60 THEN 1 WHEN scalar <= 60 THEN 2 END AS priority FROM speed_readings
  UNION ALL
  SELECT 'app2', *, CASE WHEN scalar > 100 THEN 1 WHEN scalar > 50 THEN 2 WHEN scalar >= 0 THEN 3 END,
         CASE WHEN scalar > 100 THEN 1 WHEN scalar > 50 THEN 2 WHEN scalar >= 0 THEN 3 END
  FROM speed_readings
  UNION ALL
  SELECT 'app3', *, CASE WHEN scalar > 80 THEN 1 WHEN scalar < 20 THEN 2 END,
         CASE WHEN scalar > 80 OR scalar < 20 THEN 1 END FROM speed_readings""", ("speed_readings",)),
    "switched": (f"""
  SELECT *, last_value(rule_no IGNORE NULLS) OVER (
           PARTITION BY app, vehicle_id {ORDERED}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_rule
  FROM evaluated""", ("evaluated",)),
    "ruled": ("""
  SELECT *, coalesce(rule_no, previous_rule) AS current_rule,
         rule_no IS NOT NULL AND rule_no IS DISTINCT FROM previous_rule AS is_switch
  FROM switched""", ("switched",)),
    "labelled": ("""
  SELECT *, CASE app || current_rule
           WHEN 'app11' THEN 'average5' WHEN 'app12' THEN 'none'
           WHEN 'app21' THEN 'clamp0.0100.0' WHEN 'app22' THEN 'median5' WHEN 'app23' THEN 'none'
           WHEN 'app31' THEN 'clamp0.0100.0' WHEN 'app32' THEN 'none' END AS pet_label
  FROM ruled""", ("ruled",)),
    "windowed": (f"""
  SELECT *, avg(scalar) OVER w AS mean5, quantile_disc(scalar, 0.5) OVER w AS median5,
         count(*) OVER w AS n5
  FROM labelled
  WINDOW w AS (PARTITION BY app, vehicle_id {ORDERED}
               ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", ("labelled",)),
    "forced_decisions": ("""
  SELECT 'd' || event_id AS decision_id, user_id AS vehicle_id, event_id AS trigger_event_id,
         epoch_us(ts)//1000 AS generation_ms,
         CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'average5' ELSE 'clamp0.0100.0' END
           AS pet_label
  FROM events WHERE event_type = 'error'""", ()),
    "active": (f"""
  SELECT r.*, d.decision_id, d.pet_label,
         avg(r.scalar) OVER w AS mean5, count(*) OVER w AS n5
  FROM speed_readings r ASOF LEFT JOIN forced_decisions d
    ON r.vehicle_id = d.vehicle_id AND r.generate_ms >= d.generation_ms
  WINDOW w AS (PARTITION BY r.vehicle_id ORDER BY r.generate_ms, r.event_id
               ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
               ("speed_readings", "forced_decisions")),
    "forced_output": ("""
  SELECT vehicle_id, event_id, generate_ms, pet_label,
         round(CASE pet_label WHEN 'none' THEN scalar WHEN 'average5' THEN mean5
               ELSE least(greatest(scalar, 0.0), 100.0) END, 6) AS processed
  FROM active WHERE pet_label IS NOT NULL AND (pet_label <> 'average5' OR n5 = 5)""", ("active",)),
}

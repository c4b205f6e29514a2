"""Predicates, policy evaluation, decisions and PET descriptions."""

from pyspark.sql import functions as F

from veilstream.functions import petspec, predicates
from veilstream.operators import policy
from veilstream.operators.context import (is_affected, is_trigger, only_affects, tag_triggers,
                                          trigger_ids)
from veilstream.operators.enforce import per_section
from veilstream.operators.rule_index import winning_rule_of_table
from veilstream.plans.pipelines import for_apps
from workload.fixtures import (LOCATION_RULES, SPEED_RULES, SQUARE, context_of, forced_decisions,
                               millis, mixed_readings, plan_for, points, query, readings_of_app,
                               skewed_plan, skewed_readings, speed_readings, table, with_views)

APPS = ["app1", "app2", "app3"]
CONCAVE = ([0, 80, 80, 40, 0], [0, 0, 80, 20, 80])
CROSSED = ([0, 80, 80, 0], [0, 80, 0, 80])


# --- predicates ----------------------------------------------------------------------------------

@query(with_views("speed_readings", body="""
SELECT event_id, scalar = 25.0 AS equal, scalar <> 25.0 AS not_equal, scalar > 25.0 AS greater,
       scalar < 25.0 AS less, scalar >= 25.0 AS greater_equal, scalar <= 25.0 AS less_equal
FROM speed_readings"""))
def scalar_comparisons(spark, sf_dir):
    value = F.col("scalar")
    return speed_readings(spark, sf_dir).select("event_id", *[
        predicates.scalar_predicate(value, relation, 25.0).alias(relation)
        for relation in ("equal", "not_equal", "greater", "less", "greater_equal", "less_equal")])


@query(with_views("points", body="""
SELECT event_id, x >= 0 AND x < 60 AND y >= 0 AND y < 60 AS inside FROM points"""))
def point_in_square(spark, sf_dir):
    inside = predicates.in_polygon(F.col("location.x"), F.col("location.y"),
                                   [0, 60, 60, 0], [0, 0, 60, 60])
    return points(spark, sf_dir).select("event_id", inside.alias("inside"))


def _winding_sql(xs, ys) -> str:
    terms = []
    for i in range(len(xs)):
        x0, y0, x1, y1 = xs[i], ys[i], xs[(i + 1) % len(xs)], ys[(i + 1) % len(xs)]
        if y0 == y1:
            continue
        terms.append(
            f"CASE WHEN y >= {min(y0, y1)} AND y < {max(y0, y1)} AND "
            f"x < {x0}e0 + (y - {y0}) * ({x1 - x0}e0 / {y1 - y0}e0) "
            f"THEN {1 if y1 > y0 else -1} ELSE 0 END")
    return " + ".join(terms)


@query(with_views("points", body=f"""
SELECT event_id, ({_winding_sql(*CONCAVE)}) <> 0 AS concave, ({_winding_sql(*CROSSED)}) <> 0 AS crossed,
       ({_winding_sql(*CONCAVE)}) = 0 AS outside
FROM points"""))
def point_in_polygons(spark, sf_dir):
    x, y = F.col("location.x"), F.col("location.y")
    outside = predicates.location_predicate(x, y, "out_of", {"x": CONCAVE[0], "y": CONCAVE[1]})
    return points(spark, sf_dir).select(
        "event_id", predicates.in_polygon(x, y, *CONCAVE).alias("concave"),
        predicates.in_polygon(x, y, *CROSSED).alias("crossed"), outside.alias("outside"))


NESTED = ('{"logic": "OR", "scalar": [{"data section": "speed", "relation": "GREATER", "value": 90}], '
          '"combined": [{"logic": "and", "scalar": [{"data section": "speed", "relation": "LESS", '
          '"value": 50}], "location": [{"relation": "IN", "value": %s}]}]}' % SQUARE)


@query(with_views("contexts", body="""
SELECT event_id, coalesce(v > 90, FALSE) OR (coalesce(v < 50, FALSE)
       AND coalesce(x >= 0 AND x < 60 AND y >= 0 AND y < 60, FALSE)) AS hit
FROM contexts"""))
def boolean_composition(spark, sf_dir):
    context = context_of(spark, sf_dir)
    scalars, x, y = policy.context_columns(context.columns)
    return context.select("event_id", predicates.compile_predicate(NESTED, scalars, x, y).alias("hit"))


@query("SELECT event_id, value IS NOT NULL AND floor(value) % 2 = 0 AS hit FROM events")
def user_defined_predicate(spark, sf_dir):
    """A test of the user's own, named in a predicate description."""
    predicates.register_predicate("even", lambda value: F.pmod(F.floor(value), F.lit(2)) == 0)
    rows = speed_readings(spark, sf_dir)
    own = '{"scalar": [{"data section": "speed", "custom": "even"}]}'
    return rows.select("event_id", predicates.compile_predicate(own, {"speed": F.col("scalar")}).alias("hit"))


# One description per event: its type says which part may be wrong, its number what stands there.
DESCRIPTION = """
CASE event_type
  WHEN 'click' THEN '{"scalar": [{"data section": "speed", "relation": "' || CASE WHEN event_id % 2 = 0 THEN 'less' ELSE 'BELOW' END
       || '", "value": ' || event_id || '}]}'
  WHEN 'view' THEN '{' || CASE event_id % 3 WHEN 0 THEN '"logic": "AND", ' WHEN 1 THEN '"logic": "XOR", ' ELSE '' END
       || '"scalar": [{"data section": "speed", "relation": "LESS", "value": 1}, {"data section": "speed", "relation": "GREATER", "value": '
       || event_id || '}]}'
  WHEN 'error' THEN '{"location": [{"relation": "IN", "value": {"x": [0, ' || event_id || '], "y": ['
       || CASE WHEN event_id % 2 = 0 THEN '0, 1' ELSE '0' END || ']}}]}'
  WHEN 'signup' THEN '{"combined": [' || CASE WHEN event_id % 2 = 0 THEN ''
       ELSE '{"scalar": [{"data section": "fuel", "relation": "LESS", "value": 1}]}' END || ']}'
  ELSE CASE WHEN event_id % 2 = 0 THEN props ELSE '[' || event_id END END"""


@query("""
SELECT event_id, CASE event_type
    WHEN 'click' THEN CASE WHEN event_id % 2 <> 0 THEN
      'unknown relation ''BELOW''; known: EQUAL, NOT_EQUAL, GREATER, LESS, GREATER_EQUAL, LESS_EQUAL' END
    WHEN 'view' THEN CASE event_id % 3 WHEN 1 THEN 'logic must be AND or OR, not ''XOR'''
      WHEN 2 THEN 'more than one predicate needs a logic of AND or OR' END
    WHEN 'error' THEN CASE WHEN event_id % 2 <> 0 THEN 'polygon x and y must have the same number of points' END
    WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'predicate is empty' ELSE 'unknown data section ''fuel''; known: speed' END
    ELSE CASE WHEN event_id % 2 = 0 AND props IS NOT NULL THEN 'predicate is empty' ELSE 'not a JSON object' END END AS problem
FROM events""")
def rejected_descriptions(spark, sf_dir):
    """Predicate descriptions of a table, checked where they lie."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(DESCRIPTION).alias("predicate"))
    return predicates.checked(rows, "predicate", ["speed"]).select("event_id", "problem")


# --- evaluation ----------------------------------------------------------------------------------

def _evaluated(spark, sf_dir, view=speed_readings):
    return policy.winning_rule(for_apps(view(spark, sf_dir), APPS), SPEED_RULES)


@query(with_views("speed_readings", body="""
SELECT event_id, 'app2' AS app,
       concat_ws(',', CASE WHEN scalar > 100 THEN '1:1' END, CASE WHEN scalar > 50 THEN '2:2' END,
                 CASE WHEN scalar >= 0 THEN '3:3' END) AS satisfied
FROM speed_readings
UNION ALL
SELECT event_id, 'app3', concat_ws(',', CASE WHEN scalar > 80 THEN '1:1' END,
                                   CASE WHEN scalar < 20 THEN '1:2' END)
FROM speed_readings"""))
def satisfied_rules(spark, sf_dir):
    rules = [r for r in SPEED_RULES if r.app != "app1"]
    matched = policy.match_rules(for_apps(speed_readings(spark, sf_dir), APPS[1:]), rules)
    text = F.transform("satisfied", lambda s: F.concat_ws(":", s["priority"].cast("string"),
                                                          s["rule_no"].cast("string")))
    return matched.select("event_id", "app", F.array_join(text, ",").alias("satisfied"))


@query(with_views("evaluated", body="""
SELECT app, event_id, coalesce(priority, -1) AS priority, coalesce(rule_no, -1) AS rule_no
FROM evaluated"""))
def winning_rules(spark, sf_dir):
    return _evaluated(spark, sf_dir).select(
        "app", "event_id", F.coalesce("winner.priority", F.lit(-1)).alias("priority"),
        F.coalesce("winner.rule_no", F.lit(-1)).alias("rule_no"))


@query(with_views("ruled", body="""
SELECT app, vehicle_id, event_id, coalesce(previous_rule, -1) AS previous_rule,
       coalesce(current_rule, -1) AS current_rule, is_switch FROM ruled"""))
def rule_changes(spark, sf_dir):
    switched = policy.detect_switches(_evaluated(spark, sf_dir), plan_for(spark, sf_dir))
    return switched.select("app", "vehicle_id", "event_id",
                           F.coalesce("previous.rule_no", F.lit(-1)).alias("previous_rule"),
                           F.coalesce("current.rule_no", F.lit(-1)).alias("current_rule"), "is_switch")


@query(with_views("ruled", body="""
SELECT app, vehicle_id, event_id, coalesce(previous_rule, -1) AS previous_rule,
       coalesce(current_rule, -1) AS current_rule, is_switch FROM ruled""", skewed=True))
def rule_changes_hot_vehicle(spark, sf_dir):
    """The same when one vehicle holds a third of all rows: its time axis is sliced."""
    switched = policy.detect_switches(_evaluated(spark, sf_dir, skewed_readings),
                                      skewed_plan(spark, sf_dir))
    return switched.select("app", "vehicle_id", "event_id",
                           F.coalesce("previous.rule_no", F.lit(-1)).alias("previous_rule"),
                           F.coalesce("current.rule_no", F.lit(-1)).alias("current_rule"), "is_switch")


@query(with_views("labelled", body="""
SELECT sha256(app || '|' || vehicle_id || '|speed|' || event_id) AS decision_id, app, vehicle_id,
       'speed' AS section, event_id AS trigger_event_id, generate_ms AS generation_ms, pet_label,
       priority
FROM labelled WHERE is_switch"""))
def decision_records(spark, sf_dir):
    switched = policy.detect_switches(_evaluated(spark, sf_dir), plan_for(spark, sf_dir))
    return policy.decisions(switched, SPEED_RULES).drop("pet")


AFFECTED_SQL = """
SELECT event_id, unnest(CASE WHEN event_id % 4 = 0 THEN [section]
       WHEN event_id % 4 = 1 THEN ['speed'] ELSE ['speed', 'location'] END) AS affected
FROM mixed_readings"""


@query(with_views("mixed_readings", body=AFFECTED_SQL))
def affected_sections(spark, sf_dir):
    """A PET's output sections, or the record's own section when it names none."""
    outputs = (F.when(F.col("event_id") % 4 == 0, F.lit("[]"))
               .when(F.col("event_id") % 4 == 1, F.lit('["speed"]'))
               .otherwise(F.lit('["speed","location"]')))
    pet = F.concat(F.lit('{"name":"p","stateWindow":[],"parameters":[],"inputDataSection":[],'
                         '"outputDataSection":'), outputs, F.lit("}"))
    rows = mixed_readings(spark, sf_dir).withColumn("parsed", petspec.parse_pet(pet))
    return rows.select("event_id", F.explode(
        petspec.affected_sections(F.col("parsed"), F.col("section"))).alias("affected"))


@query(with_views("evaluated", body="""
SELECT event_id, rule_no FROM evaluated WHERE app = 'app2'"""))
def rules_of_one_app(spark, sf_dir):
    """A policy is used only by the evaluation of its own application."""
    rows = policy.scope_to_app(_evaluated(spark, sf_dir), "app2")
    return rows.select("event_id", F.col("winner.rule_no").alias("rule_no"))


def _versions(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    app = F.when(F.col("event_id") % 2 == 0, "app1").otherwise("app2")
    return events.select(app.alias("app"), millis("ts").alias("effective_ms"), "event_id",
                         F.col("event_id").alias("version"))


def app_readings(spark, sf_dir):
    return for_apps(speed_readings(spark, sf_dir), APPS[:2])


@query(with_views("versions", "app_readings", body="""
SELECT r.app, r.event_id, coalesce(v.version, -1) AS version
FROM app_readings r ASOF LEFT JOIN versions v ON r.app = v.app AND r.generate_ms >= v.effective_ms"""))
def policy_in_force(spark, sf_dir):
    """The latest policy version of each application at every reading. Two applications hold all
    rows, so their time axes are sliced."""
    plan = plan_for(spark, sf_dir, app_readings, key="app", share=0.05)
    active = policy.active_policy(app_readings(spark, sf_dir), _versions(spark, sf_dir), plan)
    return active.select("app", "event_id",
                         F.coalesce("version", F.lit(-1).cast("long")).alias("version"))


@query(with_views("mixed_readings", body="""
SELECT section, count(*) AS n FROM mixed_readings WHERE section IN ('speed', 'location')
GROUP BY section"""))
def defined_sections(spark, sf_dir):
    rows = mixed_readings(spark, sf_dir).withColumn("app", F.lit("app1"))
    rules = [r for r in SPEED_RULES + LOCATION_RULES if r.app == "app1"]
    return (policy.for_defined_sections(rows, rules).groupBy("section")
            .agg(F.count(F.lit(1)).alias("n")))


@query(with_views("mixed_readings", body="""
SELECT event_id, section FROM mixed_readings WHERE section = 'image'"""))
def undefined_sections(spark, sf_dir):
    rows = mixed_readings(spark, sf_dir).withColumn("app", F.lit("app1"))
    rules = [r for r in SPEED_RULES + LOCATION_RULES if r.app == "app1"]
    return policy.for_undefined_sections(rows, rules).select("event_id", "section")


@query(with_views("evaluated", body="""
SELECT app, event_id, 'speed' AS section, generate_ms + event_id % 7 AS evaluation_ms
FROM evaluated"""))
def forked_context(spark, sf_dir):
    rows = policy.fork_context(_evaluated(spark, sf_dir),
                               F.col("generate_ms") + F.col("event_id") % 7)
    return rows.select("app", "event_id", "section", "evaluation_ms")


def _policy_rows(spark, sf_dir):
    """Rules as a table: one per user and event type that occurs, priority by the event type."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("app"), F.col("user_id").cast("string")).alias("app"),
        F.col("event_type").alias("section"),
        F.length("event_type").alias("priority")).distinct().withColumns({
            "rule_no": F.lit(1), "predicate": F.lit("{}"),
            "pet": F.concat(F.lit("pet-"), F.col("section"))})


@query("""
SELECT DISTINCT 'app' || user_id AS app, event_type AS section FROM events""")
def involved_sections(spark, sf_dir):
    return policy.involved_sections(_policy_rows(spark, sf_dir))


@query("""
WITH rules AS (SELECT DISTINCT 'app' || user_id AS app, event_type AS section,
                      length(event_type) AS priority FROM events)
SELECT app, '{"appName":"' || app || '","policy":[' || string_agg(
         '{"dataSection":"' || section || '","rule":[{"priority":' || priority ||
         ',"predicate":"{}","pet":"pet-' || section || '"}]}', ',' ORDER BY section) || ']}' AS json
FROM rules GROUP BY app""")
def policy_documents(spark, sf_dir):
    return policy.policy_json(_policy_rows(spark, sf_dir))


# --- PET descriptions ----------------------------------------------------------------------------

def _described(spark, sf_dir):
    """A PET description per event: kind, window size and parameter from its values."""
    size = F.regexp_extract("props", r"(\d+)", 1).cast("int") % 4
    kind = F.when(F.col("event_type") == "view", "time").otherwise("PIECE")
    text = F.concat(F.lit('{"name":"'), F.col("event_type"),
                    F.lit('","stateWindow":[{"dataSection":"speed","type":"'), kind,
                    F.lit('","size":'), size.cast("string"),
                    F.lit('}],"parameters":[{"type":"java.lang.Integer","value":'), size.cast("string"),
                    F.lit('},{"type":"java.lang.String","value":"x'), F.col("user_id").cast("string"),
                    F.lit('"}],"inputDataSection":["speed"],"outputDataSection":[]}'))
    return table(spark, sf_dir, "events").select("event_id",
                                                 petspec.parse_pet(text).alias("parsed"))


DESCRIBED = """
WITH d AS (SELECT event_id, event_type, user_id, regexp_extract(props, '([0-9]+)', 1)::INT % 4 AS size,
                  CASE WHEN event_type = 'view' THEN 'time' ELSE 'PIECE' END AS kind FROM events)
"""


@query(DESCRIBED + """
SELECT event_id, event_type AS name, kind, size, 'x' || user_id AS second_value, 1 AS inputs FROM d""")
def parsed_descriptions(spark, sf_dir):
    p = F.col("parsed")
    return _described(spark, sf_dir).select(
        "event_id", p["name"].alias("name"), p["stateWindow"][0]["type"].alias("kind"),
        p["stateWindow"][0]["size"].alias("size"), p["parameters"][1]["value"].alias("second_value"),
        F.size(p["inputDataSection"]).alias("inputs"))


@query(DESCRIBED + "SELECT event_id, kind = 'time' OR size > 1 AS stateful FROM d")
def stateful_descriptions(spark, sf_dir):
    return _described(spark, sf_dir).select(
        "event_id", petspec.is_stateful(F.col("parsed")).alias("stateful"))


@query(DESCRIBED + "SELECT event_id, event_type || size || 'x' || user_id AS label FROM d")
def description_labels(spark, sf_dir):
    return _described(spark, sf_dir).select(
        "event_id", petspec.pet_label(F.col("parsed")).alias("label"))


# --- triggers ------------------------------------------------------------------------------------

def _tagged(spark, sf_dir):
    """Every ``error`` event is a trigger for speed, and for location too if its id is even."""
    decided = forced_decisions(spark, sf_dir).withColumn("sections", F.when(
        F.col("trigger_event_id") % 2 == 0, F.array(F.lit("speed"), F.lit("location")))
        .otherwise(F.array(F.lit("speed"))))
    return tag_triggers(readings_of_app(spark, sf_dir), per_section(decided))


@query("""
SELECT event_id, event_type = 'error' AS is_trigger, event_type = 'error' AS affects_speed,
       event_type = 'error' AND event_id % 2 = 0 AS affects_location,
       event_type = 'error' AND event_id % 2 = 1 AS only_speed,
       CASE WHEN event_type = 'error' THEN 'd' || event_id ELSE '' END AS ids,
       (CASE WHEN event_type <> 'error' THEN 0 WHEN event_id % 2 = 0 THEN 2 ELSE 1 END)::INT AS n
FROM events""")
def trigger_tags(spark, sf_dir):
    return _tagged(spark, sf_dir).select(
        "event_id", is_trigger().alias("is_trigger"), is_affected("SPEED").alias("affects_speed"),
        is_affected("location").alias("affects_location"),
        only_affects(["speed"]).alias("only_speed"),
        F.array_join(trigger_ids(), ",").alias("ids"), F.size("triggers").alias("n"))


def rules_of_items(spark, sf_dir):
    """Line items as rules about speeds, parts and suppliers as rules about places."""
    items = table(spark, sf_dir, "lineitem")
    line = F.pmod(F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.lit(1_000_003))
    low = (line % 30_011) / 100.0 - 50
    width = (1 + F.col("l_partkey") % 7) / 50.0
    relation = F.element_at(F.array(F.lit("GREATER"), F.lit("GREATER_EQUAL")), F.col("l_linenumber") % 2 + 1)
    speed = F.format_string('{"logic": "AND", "scalar": [{"data section": "speed", "relation": "%s", "value": %s}, '
                            '{"data section": "speed", "relation": "LESS", "value": %s}]}',
                            relation, low.cast("string"), (low + width).cast("string"))
    speeds = items.select(F.concat(F.lit("app"), F.col("l_suppkey") % 3 + 1).alias("app"), F.lit("speed").alias("section"),
                          (F.col("l_partkey") % 500).cast("int").alias("priority"), line.cast("int").alias("rule_no"), speed.alias("predicate"))
    left, bottom = F.col("p_partkey") % 97 - 20.0, F.col("p_partkey") % 89 - 10.0
    square = F.format_string('{"x": [%s, %s, %s, %s], "y": [%s, %s, %s, %s]}', *[c.cast("string") for c in (
        left, left + 9, left + 9, left, bottom, bottom, bottom + 6, bottom + 6)])
    kind = F.when(F.col("p_partkey") % 5 == 0, "OUT_OF").otherwise("IN")
    place = F.format_string('{"location": [{"relation": "%s", "value": %s}]}', kind, square)
    places = table(spark, sf_dir, "part").select(
        F.concat(F.lit("app"), F.col("p_partkey") % 3 + 1).alias("app"), F.lit("location").alias("section"),
        F.when(F.col("p_partkey") % 5 == 0, 400 + F.col("p_partkey") % 9).otherwise(F.col("p_partkey") % 399).cast("int").alias("priority"),
        F.col("p_partkey").cast("int").alias("rule_no"), place.alias("predicate"))
    return speeds.unionByName(places)


@query("""
WITH s AS (SELECT 'app' || (l_suppkey % 3 + 1) AS app, l_partkey % 500 AS priority, (l_orderkey * 8 + l_linenumber) % 1000003 AS rule_no,
                  l_linenumber % 2 = 0 AS open, (1 + l_partkey % 7) / 50.0::DOUBLE AS width FROM lineitem),
r AS (SELECT *, rule_no % 30011 / 100.0::DOUBLE - 50 AS low FROM s),
p AS (SELECT 'app' || (p_partkey % 3 + 1) AS app, p_partkey AS rule_no, p_partkey % 5 = 0 AS outside,
             CASE WHEN p_partkey % 5 = 0 THEN 400 + p_partkey % 9 ELSE p_partkey % 399 END AS priority,
             p_partkey % 97 - 20.0 AS x0, p_partkey % 89 - 10.0 AS y0 FROM part),
e AS (SELECT event_id, value, regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS y, unnest(['app1', 'app2', 'app3']) AS app FROM events),
w AS (SELECT event_id, e.app, min((priority, rule_no)) AS best FROM e JOIN r ON r.app = e.app AND value >= low AND value < low + width
      WHERE NOT open OR value > low GROUP BY ALL),
l AS (SELECT event_id, e.app, min((priority, rule_no)) AS best FROM e JOIN p ON p.app = e.app
       AND (value >= x0 AND value < x0 + 9 AND y >= y0 AND y < y0 + 6) <> outside GROUP BY ALL)
SELECT event_id, app, 'speed' AS section, coalesce(best[1], -1)::INTEGER AS priority, coalesce(best[2], -1)::INTEGER AS rule_no
FROM e LEFT JOIN w USING (event_id, app)
UNION ALL
SELECT event_id, app, 'location', coalesce(best[1], -1)::INTEGER, coalesce(best[2], -1)::INTEGER FROM e LEFT JOIN l USING (event_id, app)""")
def winning_rules_many(spark, sf_dir):
    """As many rules as there are line items and parts: a table, not an expression."""
    rows = for_apps(points(spark, sf_dir).withColumn("scalar", F.col("location.x")), ["app1", "app2", "app3"]).drop("section")
    rows = rows.withColumn("section", F.explode(F.array(F.lit("speed"), F.lit("location"))))
    won = winning_rule_of_table(rows, rules_of_items(spark, sf_dir), {"speed": F.col("scalar")}, F.col("location.x"), F.col("location.y"))
    return won.select("event_id", "app", "section", F.coalesce("winner.priority", F.lit(-1)).alias("priority"),
                      F.coalesce("winner.rule_no", F.lit(-1)).alias("rule_no"))

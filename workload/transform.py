"""Privacy-enhancing transformations and their mathematics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilstream.functions import mathx
from veilstream.functions.petspec import PetSpec, pet_json
from veilstream.operators.enforce import apply_pet
from veilstream.operators.pets import dummies, geo, image, register_pet
from veilstream.operators.pets.speed import Corridor, map_speed, speed_anonymizer
from veilstream.operators.policy import Rule
from veilstream.operators.timeline import Timeline
from veilstream.plans.pipelines import run_policies
from workload.fixtures import (AVERAGE, CLAMP, GEO, MEDIAN, NONE, k_of_props, plan_for, points, query,
                               readings_of_app, skewed_plan, skewed_readings, speed_readings, table,
                               with_views)

FRAME = "PARTITION BY vehicle_id ORDER BY generate_ms, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"


def _fixed(spark, sf_dir, description):
    rows = readings_of_app(spark, sf_dir)
    return apply_pet(rows, PetSpec.from_json(description), "speed", plan_for(spark, sf_dir)).select(
        "event_id", "pet_label", F.round("processed_scalar", 6).alias("processed"))


# --- one fixed transformation --------------------------------------------------------------------

@query(with_views("speed_readings", body="""
SELECT event_id, 'none' AS pet_label, round(scalar, 6) AS processed FROM speed_readings"""))
def identity_speed(spark, sf_dir):
    return _fixed(spark, sf_dir, NONE)


@query(with_views("speed_readings", body=f"""
SELECT event_id, 'average5' AS pet_label, round(m, 6) AS processed FROM (
  SELECT event_id, avg(scalar) OVER w AS m, count(*) OVER w AS n FROM speed_readings
  WINDOW w AS ({FRAME})) WHERE n = 5"""))
def sliding_mean_speed(spark, sf_dir):
    return _fixed(spark, sf_dir, AVERAGE)


MEDIAN_SQL = f"""
SELECT event_id, 'median5' AS pet_label, round(m, 6) AS processed FROM (
  SELECT event_id, quantile_disc(scalar, 0.5) OVER w AS m, count(*) OVER w AS n FROM speed_readings
  WINDOW w AS ({FRAME})) WHERE n = 5"""


@query(with_views("speed_readings", body=MEDIAN_SQL))
def sliding_median_speed(spark, sf_dir):
    return _fixed(spark, sf_dir, MEDIAN)


@query(with_views("speed_readings", body=MEDIAN_SQL, skewed=True))
def sliding_median_hot_vehicle(spark, sf_dir):
    """The same when one vehicle holds a third of all rows."""
    rows = skewed_readings(spark, sf_dir).withColumn("app", F.lit("app1"))
    return apply_pet(rows, PetSpec.from_json(MEDIAN), "speed", skewed_plan(spark, sf_dir)).select(
        "event_id", "pet_label", F.round("processed_scalar", 6).alias("processed"))


@query(with_views("speed_readings", body="""
SELECT event_id, 'clamp0.0100.0' AS pet_label,
       round(least(greatest(scalar, 0.0), 100.0), 6) AS processed FROM speed_readings"""))
def clamped_speed(spark, sf_dir):
    return _fixed(spark, sf_dir, CLAMP)


register_pet("coarse", "column", lambda section, params: F.floor(F.col("scalar") / params[0]) * params[0])


@query(with_views("speed_readings", body="""
SELECT event_id, 'coarse10.0' AS pet_label, floor(scalar / 1e1) * 1e1 AS processed
FROM speed_readings"""))
def user_defined_transformation(spark, sf_dir):
    """A transformation registered by the user of the library."""
    return _fixed(spark, sf_dir, '{"name": "coarse", "stateWindow": [], "parameters": [{"type": '
                                 '"Double", "value": 10.0}], "inputDataSection": ["speed"], '
                                 '"outputDataSection": ["speed"]}')


# --- corridor ------------------------------------------------------------------------------------

CORRIDOR = Corridor(low=0.0, high=120.0, gamma=10.0, relax_ms=3_600_000, deviation=10.0, sampler="mode")


def _corridor_sql(first: str) -> str:
    return f""",
ordered AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY generate_ms, event_id) AS rn
            FROM speed_readings),
chain AS (
  SELECT vehicle_id, event_id, generate_ms, rn, {first} AS v
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.vehicle_id, o.event_id, o.generate_ms, o.rn,
         least(greatest(o.scalar,
                        greatest(0e0, c.v - (o.generate_ms - c.generate_ms) / 3.6e6 * 1e1)),
               least(12e1, c.v + (o.generate_ms - c.generate_ms) / 3.6e6 * 1e1))
  FROM chain c JOIN ordered o ON o.vehicle_id = c.vehicle_id AND o.rn = c.rn + 1)
SELECT event_id, round(v, 6) AS processed FROM chain"""


def chained(first: str, skewed: bool = False) -> str:
    head = with_views("speed_readings", body="", recursive=True, skewed=skewed).rstrip()
    return head + _corridor_sql(first)


CLAMPED_FIRST = "least(greatest(scalar, 0e0), 12e1)"


@query(chained(CLAMPED_FIRST))
def rate_limited_speed(spark, sf_dir):
    done = speed_anonymizer(speed_readings(spark, sf_dir), CORRIDOR, plan_for(spark, sf_dir))
    return done.select("event_id", F.round("processed_scalar", 6).alias("processed"))


@query(chained(CLAMPED_FIRST, skewed=True))
def rate_limited_speed_hot_vehicle(spark, sf_dir):
    """One vehicle holds a third of all rows: its recursion runs in slices side by side."""
    done = speed_anonymizer(skewed_readings(spark, sf_dir), CORRIDOR, skewed_plan(spark, sf_dir))
    return done.select("event_id", F.round("processed_scalar", 6).alias("processed"))


@query(chained("0e0"))
def rate_limited_speed_from_zero(spark, sf_dir):
    done = map_speed(speed_readings(spark, sf_dir), CORRIDOR, plan_for(spark, sf_dir))
    return done.select("event_id", F.round("processed_scalar", 6).alias("processed"))


@query()
def noisy_speed(spark, sf_dir):
    """Beta noise inside the corridor; the draws come from the row's identity."""
    from dataclasses import replace
    done = speed_anonymizer(speed_readings(spark, sf_dir), replace(CORRIDOR, sampler="beta"),
                            plan_for(spark, sf_dir), seed=7)
    return done.select("event_id", F.round("processed_scalar", 6).alias("processed"))


def _inside_corridor(readings, done):
    """Whether each output keeps the limits, and the reach from the output before it."""
    order = Window.partitionBy("vehicle_id").orderBy("generate_ms", "event_id")
    out, last = F.col("processed_scalar"), F.lag("processed_scalar").over(order)
    reach = (F.col("generate_ms") - F.lag("generate_ms").over(order)) / CORRIDOR.relax_ms * CORRIDOR.deviation
    inside = out.between(CORRIDOR.low, CORRIDOR.high) & (last.isNull() | (F.abs(out - last) <= reach + 1e-9))
    return done.select("event_id", inside.alias("inside"))


@query("SELECT event_id, true AS inside FROM events")
def noisy_speed_properties(spark, sf_dir):
    """Every noisy speed lies inside the corridor around the one before it."""
    from dataclasses import replace
    rows = speed_readings(spark, sf_dir)
    return _inside_corridor(rows, speed_anonymizer(rows, replace(CORRIDOR, sampler="beta"), plan_for(spark, sf_dir), seed=7))


@query("SELECT event_id, true AS inside FROM events")
def noisy_speed_hot_vehicle(spark, sf_dir):
    """The same when one vehicle holds a third of all rows and its recursion runs in slices."""
    from dataclasses import replace
    rows = skewed_readings(spark, sf_dir)
    return _inside_corridor(rows, speed_anonymizer(rows, replace(CORRIDOR, sampler="beta"), skewed_plan(spark, sf_dir), seed=7))


# --- geo-obfuscation -----------------------------------------------------------------------------

PREDICTED_SQL = f""",
timed AS (SELECT *, (generate_ms - min(generate_ms) OVER (PARTITION BY vehicle_id)) / 1e3 AS t
          FROM points),
fitted AS (
  SELECT *, avg(x) OVER w + coalesce(regr_slope(x, t) OVER w, 0) * (t - avg(t) OVER w) AS px,
         avg(y) OVER w + coalesce(regr_slope(y, t) OVER w, 0) * (t - avg(t) OVER w) AS py,
         count(*) OVER w AS n
  FROM timed WINDOW w AS ({FRAME})),
measured AS (
  SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS error FROM fitted WHERE n = 5),
levelled AS (
  SELECT *, CASE WHEN error < 7.5e0 THEN 0.2e0 * 0.25e0 WHEN error < 22e0 THEN 0.2e0
                 ELSE 3e0 * 0.2e0 END AS level,
         (('0x' || substr(md5('0r|' || vehicle_id || '|' || event_id), 1, 8))::BIGINT + 0.5e0)
           / 4294967296e0 AS u,
         (('0x' || substr(md5('0a|' || vehicle_id || '|' || event_id), 1, 8))::BIGINT + 0.5e0)
           / 4294967296e0 AS a
  FROM measured)
"""


def geo_sql(body: str, skewed: bool = False) -> str:
    return with_views("points", body="", skewed=skewed).rstrip() + PREDICTED_SQL + body


def _predicted(spark, sf_dir):
    line = Timeline(["vehicle_id"], ["generate_ms", "event_id"], plan_for(spark, sf_dir, points))
    rows = line.last_rows(points(spark, sf_dir), 5, ["location"],
                          lambda df, ordered, whole: geo.predict_positions(df, ordered, whole, 5))
    return rows.where(F.col("n_points") == 5)


@query(geo_sql("SELECT event_id, round(px, 3) + 0e0 AS px, round(py, 3) + 0e0 AS py FROM fitted WHERE n = 5"))
def predicted_positions(spark, sf_dir):
    return _predicted(spark, sf_dir).select(
        "event_id", (F.round("predicted_x", 3) + 0.0).alias("px"),
        (F.round("predicted_y", 3) + 0.0).alias("py"))


@query(geo_sql("SELECT event_id, round(error, 3) AS error, round(level, 6) AS level FROM levelled"))
def privacy_levels(spark, sf_dir):
    error = geo.prediction_error(F.col("predicted_x"), F.col("predicted_y"))
    return _predicted(spark, sf_dir).select(
        "event_id", F.round(error, 3).alias("error"),
        F.round(geo.privacy_level(error, 7.5, 22.0, 0.2, 0.25, 3.0), 6).alias("level"))


OBFUSCATED = """
SELECT event_id, round(x + r * cos(a * 2e0 * pi()), 3) + 0e0 AS x,
       round(y + r * sin(a * 2e0 * pi()), 3) + 0e0 AS y
FROM (SELECT *, level - error * sign(u - 0.5e0) * ln(1 - 2 * abs(u - 0.5e0)) AS r FROM levelled)"""


def _obfuscated(rows, plan):
    done = apply_pet(rows.withColumn("app", F.lit("app1")), PetSpec.from_json(GEO), "location", plan)
    return done.select("event_id", (F.round("processed_location.x", 3) + 0.0).alias("x"),
                       (F.round("processed_location.y", 3) + 0.0).alias("y"))


@query(geo_sql(OBFUSCATED))
def obfuscated_positions(spark, sf_dir):
    return _obfuscated(points(spark, sf_dir), plan_for(spark, sf_dir, points))


def skewed_points(spark, sf_dir):
    return points(spark, sf_dir).withColumn(
        "vehicle_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long"))
        .otherwise(F.col("vehicle_id")))


@query(geo_sql(OBFUSCATED, skewed=True))
def obfuscated_positions_hot_vehicle(spark, sf_dir):
    return _obfuscated(skewed_points(spark, sf_dir),
                       plan_for(spark, sf_dir, skewed_points, share=0.01))


# --- dummy locations -----------------------------------------------------------------------------

def places(spark, sf_dir):
    """Suppliers as places, visited once per line item."""
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("place_id"), F.col("s_suppkey").cast("double").alias("x"),
        F.col("s_acctbal").alias("y"))
    visits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("place_id"))
    return dummies.visit_counts(suppliers, visits)


K, GAMMA = 4, 8.0
PLACES = """
WITH places AS (
  SELECT s_suppkey AS place_id, s_suppkey::DOUBLE AS x, s_acctbal AS y, count(l_suppkey) AS amount
  FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL)
"""


@query(PLACES + """
SELECT place_id, x, y, amount, row_number() OVER (ORDER BY amount, place_id) - 1 AS rank FROM places""")
def ranked_places(spark, sf_dir):
    return dummies.rank_places(places(spark, sf_dir)).select("place_id", "x", "y", "amount", "rank")


@query("""
SELECT o_orderkey AS place_id, o_custkey AS amount,
       row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS rank FROM orders""")
def ranked_places_many(spark, sf_dir):
    """Ranks without a global sort in one task."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place_id"),
                                                 F.col("o_custkey").alias("amount"))
    return dummies.rank_places(rows).select("place_id", "amount", "rank")


def _requests(spark, sf_dir, n: int):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % n).alias("place_id"))


@query()
def dummy_locations(spark, sf_dir):
    """Four places per customer, the real one among them."""
    ranked = dummies.rank_places(places(spark, sf_dir))
    n = table(spark, sf_dir, "supplier").count()
    chosen = dummies.dummy_locations(_requests(spark, sf_dir, n), ranked, k=K, m=12, gamma=GAMMA, seed=3)
    return chosen.select("request_id", "real_place_id", "slot", "rank", "place_id", "x", "y",
                         F.round("entropy", 6).alias("entropy"), "trial")


@query()
def updated_place_counts(spark, sf_dir):
    """Visit counts after the batch of requests."""
    counted = places(spark, sf_dir)
    n = table(spark, sf_dir, "supplier").count()
    chosen = dummies.dummy_locations(_requests(spark, sf_dir, n), dummies.rank_places(counted), k=K,
                                     m=12, gamma=GAMMA, seed=3)
    return dummies.updated_counts(counted, chosen).select("place_id", "amount")


@query("""
SELECT c_custkey AS request_id, 4::BIGINT AS places, true AS distinct_places, true AS holds_real_place,
       true AS entropy_agrees FROM customer""")
def dummy_location_properties(spark, sf_dir):
    """Of every request: how many places, whether they differ, hold the real one, and have the entropy that the
    finite sum of the Beta distribution function gives."""
    n = table(spark, sf_dir, "supplier").count()
    chosen = dummies.dummy_locations(_requests(spark, sf_dir, n), dummies.rank_places(places(spark, sf_dir)), k=K,
                                     m=12, gamma=GAMMA, seed=3)
    sets = chosen.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("places"), (F.countDistinct("place_id") == K).alias("distinct_places"),
        F.max(F.col("place_id") == F.col("real_place_id")).alias("holds_real_place"),
        F.first("entropy").alias("entropy"), F.collect_list("rank").alias("ranks"))
    # every member as the real place: the product of the probabilities of the others as its dummies
    product = F.transform("ranks", lambda me: F.aggregate(
        F.filter("ranks", lambda r: r != me), F.lit(1.0),
        lambda acc, other: acc * _probability(F.when(other > me, other - 1).otherwise(other), me, n)))
    agrees = F.abs(mathx.entropy_of(product) - F.col("entropy")) < 1e-9
    return sets.select("request_id", "places", "distinct_places", "holds_real_place", agrees.alias("entropy_agrees"))


def _probability(interval, rank, places):
    """Native twin of ``interval_probability`` for a whole GAMMA: a finite sum."""
    mode = rank.cast("double") / (places - 1)
    light = mathx.beta_parameters(mode, F.lit(GAMMA))
    p = F.when(mode <= 0.5, light["a"]).otherwise(light["b"])

    def tail(x):
        y, total = 1 - x, F.lit(1.0)
        for j in range(int(GAMMA) - 1, 0, -1):
            total = 1 + (p + (j - 1)) / j * y * total
        return F.pow(x, p) * total

    def cdf(x):
        return F.when(mode <= 0.5, tail(x)).otherwise(1 - tail(1 - x))
    return cdf((interval + 1) / (places - 1)) - cdf(interval / (places - 1))


@query("SELECT (SELECT count(*) FROM lineitem) + 4 * (SELECT count(*) FROM customer) AS visits")
def place_count_totals(spark, sf_dir):
    """Visits after the batch of requests: those before and one for each published place."""
    return updated_place_counts(spark, sf_dir).agg(F.sum("amount").alias("visits"))


def _tail_sql(x: str) -> str:
    """The regularised incomplete beta function of x with second parameter 8 as a finite sum."""
    total = "1e0"
    for j in range(7, 0, -1):
        total = f"(1e0 + (p + {j - 1}) / {j}e0 * (1 - {x}) * {total})"
    return f"pow({x}, p) * {total}"


@query(f"""
WITH e AS (SELECT event_id, event_id % 100 AS i, regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 100 AS mode FROM events),
s AS (SELECT *, 1 + least(mode, 1 - mode) * 7e0 / (1 - least(mode, 1 - mode)) AS p, i / 100e0 AS low, (i + 1) / 100e0 AS high FROM e)
SELECT event_id, round(CASE WHEN mode <= 0.5 THEN {_tail_sql('high')} - {_tail_sql('low')}
       ELSE {_tail_sql('(1 - low)')} - {_tail_sql('(1 - high)')} END, 9) AS probability FROM s""")
def interval_probabilities(spark, sf_dir):
    """Probability that a dummy for the event's place (of 101) falls into the event's interval."""
    probability = dummies.interval_probability(101, GAMMA)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(probability((F.col("event_id") % 100), k_of_props().cast("long")), 9)
        .alias("probability"))


# --- mathematics ---------------------------------------------------------------------------------

@query("""
SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM (
  SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p
  FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def event_type_entropy(spark, sf_dir):
    """Entropy of each user's mix of event types."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))
    return (counts.select("user_id", share.alias("p")).groupBy("user_id")
            .agg(F.round(mathx.entropy(F.col("p")), 6).alias("entropy")))


@query("""
SELECT event_id, round(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END
                       + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END, 6) AS entropy
FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 99 AS p FROM events)""")
def two_way_entropy(spark, sf_dir):
    """Array form, per row."""
    p = k_of_props() / 99
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(mathx.entropy_of(F.array(p, 1 - p)), 6).alias("entropy"))


@query("""
SELECT event_id, least(greatest(value, 10.0), 50.0) AS fitted,
       floor((value - 50) * 10 + 0.5) / 10 AS rounded,
       floor(-value * 1 + 0.5) AS rounded_negative
FROM events""")
def clamped_and_rounded(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", mathx.clamp(value, 10, 50).alias("fitted"),
        mathx.round_half_up(value - 50, 1).alias("rounded"),
        mathx.round_half_up(-value, 0).alias("rounded_negative"))


@query(r"""
SELECT event_id, CASE WHEN t LIKE '0.%' THEN substr(t, 2) ELSE t END || '\%' AS share FROM (
  SELECT event_id, regexp_replace(printf('%.3f', round_even(k / 128e0 * 100, 3)), '\.?0+$', '') AS t
  FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::DOUBLE + 1 AS k FROM events))""")
def percent_texts(spark, sf_dir):
    share = (k_of_props() + 1) / 128
    return table(spark, sf_dir, "events").select("event_id", mathx.percent_text(share, 3).alias("share"))


@query("""
SELECT event_id, round(CASE WHEN m <= 0.5 THEN (10 * m - 2 * m + 1) / (1 - m) ELSE 10 END, 6) AS a,
       round(CASE WHEN m <= 0.5 THEN 10 ELSE (10 * (1 - m) - 2 * (1 - m) + 1) / m END, 6) AS b
FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 99 AS m FROM events)""")
def beta_parameters(spark, sf_dir):
    ab = mathx.beta_parameters(k_of_props() / 99, F.lit(10.0))
    return (table(spark, sf_dir, "events").select("event_id", ab.alias("ab"))
            .select("event_id", F.round("ab.a", 6).alias("a"), F.round("ab.b", 6).alias("b")))


# --- image redaction -----------------------------------------------------------------------------

SIDE = 8


def frames(spark, sf_dir):
    """Embeddings as grey frames of 8 x 8 pixels with a class per pixel."""
    classes = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)),
                          lambda i: ((i * 7 + F.col("label")) % 20).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("pixels"), classes.alias("classes"))


PRIORITY_LIST = "[" + ", ".join(str(p) for p in image.CLASS_PRIORITIES) + "]"
FRAMES = f"""
WITH pixels AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings),
frames AS (
  SELECT vec_id, i, i // 8 AS r, i % 8 AS c, v,
         {PRIORITY_LIST}[(i * 7 + label) % 20 + 1] < 7 AS hide FROM pixels)
"""


def _exploded(df, column):
    return df.select("vec_id", F.posexplode(column).alias("i", "v")).select(
        "vec_id", F.col("i").cast("long").alias("i"), (F.round("v", 5) + 0.0).alias("v"))


@query(FRAMES + "SELECT vec_id, i, round(CASE WHEN hide THEN 0e0 ELSE v END, 5) + 0e0 AS v FROM frames")
def blacked_out_frames(spark, sf_dir):
    out = frames(spark, sf_dir).withColumn("out", image.blackout(F.col("pixels"), F.col("classes")))
    return _exploded(out, "out")


def _redacted(spark, sf_dir, mode):
    redact = image.redact_pixels(mode, SIDE, SIDE, grid=(4, 4), box=(3, 3))
    return _exploded(frames(spark, sf_dir).withColumn("out", redact("pixels", "classes")), "out")


@query(FRAMES + """
SELECT vec_id, i, round(CASE WHEN hide THEN
         avg(v) OVER (PARTITION BY vec_id, r // 2, c // 2) ELSE v END, 5) + 0e0 AS v FROM frames""")
def pixelated_frames(spark, sf_dir):
    return _redacted(spark, sf_dir, "pixelate")


@query(FRAMES + """,
by_row AS (SELECT *, avg(v) OVER (PARTITION BY vec_id, c ORDER BY r
                                  ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM frames)
SELECT vec_id, i, round(CASE WHEN hide THEN avg(m) OVER (
         PARTITION BY vec_id, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
       ELSE v END, 5) + 0e0 AS v FROM by_row""")
def blurred_frames(spark, sf_dir):
    return _redacted(spark, sf_dir, "blur")


@query(FRAMES.replace("unnest(embedding)::DOUBLE", "floor(128 + 100 * unnest(embedding)::DOUBLE)") + """
SELECT vec_id, sum(CASE WHEN hide THEN 0 ELSE v END)::BIGINT AS total FROM (
  SELECT vec_id, hide, least(greatest(v, 0), 255) AS v FROM frames) GROUP BY vec_id""")
def redacted_byte_frames(spark, sf_dir):
    """Decoded byte frames, as the image source gives them."""
    level = lambda v: F.least(F.greatest(F.floor(v * 100 + 128), F.lit(0)), F.lit(255))
    text = F.array_join(F.transform("pixels", lambda v: F.lpad(F.hex(level(v)), 2, "0")), "")
    rows = frames(spark, sf_dir).select(
        "vec_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"),
        F.lit(1).alias("n_channels"), F.unhex(text).alias("data"),
        F.lit(SIDE).alias("class_height"), F.lit(SIDE).alias("class_width"), "classes")
    done = image.redact_frames(rows, "blackout")
    digits = F.hex("processed_data")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), F.lit(0).cast("long"),
                        lambda acc, i: acc + F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10)
                        .cast("long"))
    return done.select("vec_id", total.alias("total"))


def framed_readings(spark, sf_dir):
    """Embeddings as byte frames with a class map, taken by the vehicle of their label; each vehicle has a speed first."""
    level = lambda v: F.least(F.greatest(F.floor(v * 100 + 128), F.lit(0)), F.lit(255))

    def packed(column, value):
        return F.unhex(F.array_join(F.transform(column, lambda v: F.lpad(F.hex(value(v).cast("long")), 2, "0")), ""))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("vehicle_id"))
    images = frames(spark, sf_dir).join(vectors, "vec_id").select(
        "vehicle_id", F.lit("image").alias("section"), F.col("vec_id").alias("event_id"), F.col("vec_id").alias("generate_ms"),
        packed("pixels", level).alias("image"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(1).alias("n_channels"),
        packed("classes", lambda v: v).alias("class_map"))
    speeds = vectors.groupBy("vehicle_id").agg(F.min("vec_id").alias("event_id")).select(
        "vehicle_id", F.lit("speed").alias("section"), "event_id", (F.col("event_id") - 1).alias("generate_ms"), F.lit(50.0).alias("scalar"))
    return images.unionByName(speeds, allowMissingColumns=True).withColumn("location", F.lit(None).cast("struct<x:double,y:double>"))


ANY_SPEED = '{"scalar": [{"data section": "speed", "relation": "GREATER", "value": 0}]}'
IMAGE_RULES = [Rule(mode, "image", 1, 1, ANY_SPEED, pet_json("class_redaction", [("String", mode), ("Integer", size)]))
               for mode, size in (("blackout", 1), ("pixelate", 4), ("blur", 2))]


@query(FRAMES.replace("unnest(embedding)::DOUBLE", "least(greatest(floor(128 + 100 * unnest(embedding)::DOUBLE), 0), 255)") + """,
layers AS (
  SELECT vec_id, i, v, hide, avg(v) OVER (PARTITION BY vec_id, r // 2, c // 2) AS cell,
         avg(v) OVER (PARTITION BY vec_id, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS line, r, c FROM frames),
boxes AS (SELECT *, avg(line) OVER (PARTITION BY vec_id, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS box FROM layers)
SELECT mode AS app, vec_id AS event_id, sum(CASE WHEN NOT hide THEN v WHEN mode = 'blackout' THEN 0
         WHEN mode = 'pixelate' THEN round_even(cell, 0) ELSE round_even(box, 0) END)::BIGINT AS total
FROM (SELECT *, unnest(['blackout', 'pixelate', 'blur']) AS mode FROM boxes) GROUP BY ALL""")
def enforced_images(spark, sf_dir):
    """Three applications, each with one way of redacting frames by their classes, from a policy."""
    plan = plan_for(spark, sf_dir, framed_readings)
    done = run_policies(framed_readings(spark, sf_dir), IMAGE_RULES, plan)
    digits = F.hex("processed_image")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), F.lit(0).cast("long"),
                        lambda acc, i: acc + F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    return done.select("app", "event_id", total.alias("total"))

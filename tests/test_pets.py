import math
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilstream.functions import mathx
from veilstream.functions.petspec import PetSpec, duration_ms, pet_json
from veilstream.operators.pets import REGISTRY, build_pet, dummies, image, speed
from veilstream.operators.pets.speed import Composed, Corridor, composed_end, speed_anonymizer
from veilstream.operators.timeline import SlicePlan, plan_slices
from workload.fixtures import skewed_readings, speed_readings

PLAIN = SlicePlan("vehicle_id", "generate_ms")
CORRIDOR = Corridor(0.0, 120.0, 10.0, 3_600_000, 10.0)


# --- descriptions --------------------------------------------------------------------------------

def test_description_on_the_driver():
    text = pet_json("p", [("java.lang.Integer", 5), ("java.lang.Double", 2.5),
                          ("java.time.Duration", "PT1M30S"), ("String", "a")],
                    [("speed", "time", 10), ("speed", "PIECE", 1)], ["speed"], [])
    spec = PetSpec.from_json(text)
    assert spec.params == (5, 2.5, 90_000, "a")
    assert spec.label == "p52.5PT1M30Sa"
    assert spec.stateful and not spec.windows[1].stateful
    assert duration_ms("12.5") == 12_500 and duration_ms("P1DT1S") == 86_401_000


@pytest.mark.parametrize("text", [
    '{"name": "p"}', pet_json("p", [("Widget", 1)]), pet_json("p", windows=[("speed", "LAPS", 1)]),
    pet_json("p", [("Duration", "soon")])])
def test_bad_descriptions(text):
    with pytest.raises(ValueError):
        PetSpec.from_json(text)


def test_unknown_pets_fail(spark):
    with pytest.raises(ValueError):
        build_pet(PetSpec.from_json(pet_json("invisible")), "speed")
    with pytest.raises(ValueError):
        build_pet(PetSpec.from_json(pet_json("average", [("Integer", 5)])), "image")
    assert {"none", "average", "median", "geo", "speed_noise"} <= set(REGISTRY)


# --- corridor ------------------------------------------------------------------------------------

def test_corridor_checks():
    for bad in (dict(low=5.0, high=1.0), dict(gamma=1.0), dict(relax_ms=0), dict(deviation=-1.0),
                dict(sampler="dice")):
        with pytest.raises(ValueError):
            replace(CORRIDOR, **bad)
    with pytest.raises(ValueError):
        CORRIDOR.step((5.0, 100), 5.0, 99, 0)


def test_noise_stays_in_the_corridor(spark, sf_dir):
    done = speed_anonymizer(speed_readings(spark, sf_dir), CORRIDOR, PLAIN, seed=1)
    by_vehicle = {}
    for r in done.orderBy("vehicle_id", "generate_ms", "event_id").collect():
        assert 0 <= r.processed_scalar <= 120
        if r.vehicle_id in by_vehicle:
            last, ms = by_vehicle[r.vehicle_id]
            reach = (r.generate_ms - ms) / 3_600_000 * 10
            assert abs(r.processed_scalar - last) <= reach + 1e-9
        else:
            assert r.processed_scalar == min(max(r.scalar, 0), 120)
        by_vehicle[r.vehicle_id] = r.processed_scalar, r.generate_ms


def values(df):
    return {r.event_id: r.processed_scalar for r in df.collect()}


@pytest.mark.parametrize("sampler", ["mode", "beta"])
@pytest.mark.parametrize("deviation", [0.0, 0.05, 10.0])
def test_slices_give_the_sequential_result(spark, sf_dir, sampler, deviation):
    """Also with a corridor so narrow that a slice's end depends on its start."""
    corridor = replace(CORRIDOR, sampler=sampler, deviation=deviation)
    df = skewed_readings(spark, sf_dir)
    plan = plan_slices(df, target_rows=50)
    assert plan.sliced
    sliced, plain = (values(speed_anonymizer(df, corridor, p, seed=2)) for p in (plan, PLAIN))
    # Without noise starts are composed: a start carried through whole slices is a sum of shifts, rounded once more.
    assert sliced == (plain if sampler == "beta" else pytest.approx(plain, abs=1e-11, rel=0))


@pytest.mark.parametrize("seed", range(12))
def test_composed_steps_are_the_steps_one_after_the_other(seed):
    """From any start, with readings outside the range, repeated times, wide gaps and readings that are no number."""
    rng = random.Random(seed)
    corridor = Corridor(5.0, 5.0 if seed == 0 else 120.0, 10.0, 10_000, rng.choice([0.0, 0.3, 4.0, 90.0]), sampler="mode")
    rows, ms = [], 1_000
    for _ in range(rng.choice([1, 5, 60, 400])):
        ms += rng.choice([0, 100, 1_000, 1_000, 3_000, 20_000 if seed % 3 else 1_000])
        rows.append((rng.choice([rng.uniform(-20, 150), 0.0, 130.0, float("nan") if seed % 4 == 1 else 60.0]), ms))
    composed = Composed(corridor, 1_000)
    for value, ms in rows:
        composed.step(value, ms)
    starts = [5.0, corridor.high, float("nan"), *(rng.uniform(5.0, corridor.high) for _ in range(200))]
    for start in [*starts, *(x for x, _ in composed.points)]:
        state = (start, 1_000)
        for value, ms in rows:
            state, out = corridor.step(state, value, ms, 0)
        assert composed_end(composed.found(), start) == pytest.approx(out, abs=1e-9, nan_ok=True)


def test_a_step_does_not_go_through_all_bends():
    """Reaches far smaller than the range: thousands of bends, and two steps of the corridor for each reading."""
    steps, rng = [], random.Random(1)

    class Counted(Corridor):
        def step(self, *args):
            steps.append(1)
            return super().step(*args)
    rows = [(rng.expovariate(1 / 30), 1_000 + 100 * i) for i in range(3_000)]
    corridor = Counted(0.0, 120.0, 10.0, 3_600_000, 10.0, sampler="mode")
    composed = Composed(corridor, 1_000)
    for value, ms in rows:
        composed.step(value, ms)
    assert len(steps) == 2 * len(rows) and len(composed.points) > 1_000
    for start in [rng.uniform(0.0, 120.0) for _ in range(20)]:
        state = (start, 1_000)
        for value, ms in rows:
            state, out = corridor.step(state, value, ms, 0)
        assert composed_end(composed.found(), start) == pytest.approx(out, abs=1e-9)


def test_dense_readings_need_one_pass(spark, monkeypatch):
    """One reading a second and slices far shorter than the memory of the corridor: no loop over slices."""
    rng = random.Random(5)
    rows = [(1 if i % 2 else None, i, i * 500, 120.0 * (i // 700 % 2) if i % 40 else float("nan") if i % 800 == 0 else rng.random() * 120)
            for i in range(4_000)]
    df = spark.createDataFrame(rows, "vehicle_id long, event_id long, generate_ms long, scalar double")
    corridor = Corridor(0.0, 120.0, 10.0, 10_000, 0.5, sampler="mode")
    plan = plan_slices(df, target_rows=50)
    monkeypatch.setattr(speed, "_settle_starts", None)
    sliced, plain = (values(speed_anonymizer(df, corridor, p)) for p in (plan, PLAIN))
    assert len(sliced) == 4_000 and sliced == pytest.approx(plain, abs=1e-9, rel=0, nan_ok=True)


def test_noise_does_not_depend_on_partitioning(spark, sf_dir):
    df = speed_readings(spark, sf_dir)
    first = values(speed_anonymizer(df.repartition(7), CORRIDOR, PLAIN, seed=3))
    assert first == values(speed_anonymizer(df.coalesce(1), CORRIDOR, PLAIN, seed=3))
    assert first != values(speed_anonymizer(df, CORRIDOR, PLAIN, seed=4))


def test_noise_follows_its_distribution():
    """Mean of the draws against the mean of the Beta distribution with that mode."""
    step = replace(CORRIDOR, deviation=60.0).step
    draws = [step((60.0, 0), 30.0, 3_600_000, seed)[1] for seed in range(4000)]
    a, b = dummies.beta_shape(0.25, 10.0)
    assert abs(np.mean(draws) / 120 - a / (a + b)) < 0.01


# --- dummy locations -----------------------------------------------------------------------------

def test_beta_cdf_known_values():
    x = np.linspace(0, 1, 201)
    assert np.allclose(dummies.beta_cdf(x, 1.0, 10.0), 1 - (1 - x) ** 10, atol=1e-13)
    assert np.allclose(dummies.beta_cdf(x, 3, 4), sum(
        math.comb(6, j) * x ** j * (1 - x) ** (6 - j) for j in range(3, 7)), atol=1e-13)
    mode = np.linspace(0, 1, 41)
    a, b = dummies.beta_shape(mode, 10.0)
    inner = (mode > 0) & (mode < 1)
    assert np.allclose(((a - 1) / (a + b - 2))[inner], mode[inner])


def test_interval_probabilities_sum_to_one():
    for rank in (0, 17, 50, 99, 100):
        p = dummies._interval_probability(np.arange(100), np.full(100, rank), 101, 10.0)
        assert abs(p.sum() - 1) < 1e-12 and (p >= 0).all()


def entropy_by_hand(ranks, places, gamma):
    probabilities = []
    for real in ranks:
        p = 1.0
        for other in ranks:
            if other != real:
                interval = other - 1 if other > real else other
                p *= float(dummies._interval_probability([interval], [real], places, gamma)[0])
        probabilities.append(p)
    return -sum(p * math.log2(p) for p in probabilities if p > 0)


def test_set_entropy_by_hand():
    sets = np.array([[[40, 3, 60], [40, 41, 39]], [[0, 99, 50], [99, 98, 1]]])
    got = dummies.set_entropy(sets, 100, 10.0)
    for i in range(2):
        for j in range(2):
            assert math.isclose(got[i, j], entropy_by_hand(sets[i, j], 100, 10.0), rel_tol=1e-9)


def place_table(spark, n):
    return spark.createDataFrame([(i, float(i), float(i), (i * 7) % 13) for i in range(n)],
                                 "place_id long, x double, y double, amount long")


@pytest.mark.parametrize("n,k", [(100, 3), (5, 5), (2, 2), (40, 10)])
def test_dummies(spark, n, k):
    ranked = dummies.rank_places(place_table(spark, n))
    requests = spark.createDataFrame([(i, i % n) for i in range(60)], "request_id long, place_id long")
    out = dummies.dummy_locations(requests, ranked, k, 15, 10.0, seed=1).collect()
    sets = {}
    for r in out:
        sets.setdefault(r.request_id, []).append(r)
    assert len(sets) == 60
    for request, rows in sets.items():
        assert len(rows) == k and len({r.place_id for r in rows}) == k
        assert request % n in {r.place_id for r in rows}
        ranks = [r["rank"] for r in sorted(rows, key=lambda r: r.slot)]
        assert math.isclose(rows[0].entropy, entropy_by_hand(ranks, n, 10.0), rel_tol=1e-9, abs_tol=1e-12)


def test_more_candidate_sets_do_not_lower_entropy(spark):
    ranked = dummies.rank_places(place_table(spark, 100))
    requests = spark.createDataFrame([(i, i) for i in range(50)], "request_id long, place_id long")

    def best(m):
        rows = dummies.dummy_locations(requests, ranked, 3, m, 10.0, seed=5).collect()
        return {r.request_id: r.entropy for r in rows}

    few, many = best(1), best(15)
    assert all(many[i] >= few[i] - 1e-12 for i in few) and sum(many.values()) > sum(few.values())


def test_k_is_validated(spark):
    ranked = dummies.rank_places(place_table(spark, 5))
    requests = spark.createDataFrame([(1, 1)], "request_id long, place_id long")
    for k in (1, 6):
        with pytest.raises(ValueError):
            dummies.dummy_locations(requests, ranked, k, 3, 10.0)


def test_ranks_with_many_equal_amounts(spark):
    rng = random.Random(4)
    places = [(i, rng.choice([0, 0, 0, 5, 9])) for i in range(300)]
    df = spark.createDataFrame(places, "place_id long, amount long")
    plan = plan_slices(df, key="amount", time="place_id", target_rows=20)
    assert plan.sliced
    ranked = dummies.rank_places(df, plan, target_rows=2)
    got = {r.place_id: r["rank"] for r in ranked.collect()}
    want = {p: i for i, (p, _) in enumerate(sorted(places, key=lambda t: (t[1], t[0])))}
    assert got == want


def test_successive_sampling_has_no_repeats():
    rng = np.random.default_rng(0)
    drawn = dummies._draw_rest(rng, 1.5, 10.0, [0, 1], 20, 20)
    assert sorted(drawn) == list(range(20))
    # of 10**12 intervals nearly all mass is near the front, yet the draw ends
    assert len(set(dummies._draw_rest(rng, 1.5, 1e6, [0, 1], 40, 10 ** 12))) == 40


def test_successive_sampling_keeps_the_probabilities():
    """The second draw after a first: like rejecting repeats."""
    rng, wanted = np.random.default_rng(1), np.zeros(6)
    p = np.diff(dummies.beta_cdf(np.arange(7) / 6, 2.0, 3.0))
    for _ in range(4000):
        wanted[dummies._draw_rest(rng, 2.0, 3.0, [1], 2, 6)[1]] += 1
    p[1] = 0
    assert np.allclose(wanted / 4000, p / p.sum(), atol=0.03)


# --- images --------------------------------------------------------------------------------------

def redacted_by_hand(pixels, classes, mode, grid, box):
    h, w = len(pixels), len(pixels[0])
    out = [[0.0] * w for _ in range(h)]
    for r in range(h):
        for c in range(w):
            cls = classes[r * len(classes) // h][c * len(classes[0]) // w]
            if image.CLASS_PRIORITIES[cls] >= image.THRESHOLD:
                out[r][c] = pixels[r][c]
            elif mode == "pixelate":
                gh, gw = min(grid[0], h), min(grid[1], w)
                cell = [pixels[i][j] for i in range(h) for j in range(w)
                        if i * gh // h == r * gh // h and j * gw // w == c * gw // w]
                out[r][c] = sum(cell) / len(cell)
            elif mode == "blur":
                near = [pixels[i][j]
                        for i in range(max(0, r - box[0] // 2), min(h, r + box[0] - box[0] // 2))
                        for j in range(max(0, c - box[1] // 2), min(w, c + box[1] - box[1] // 2))]
                out[r][c] = sum(near) / len(near)
    return out


@pytest.mark.parametrize("mode", image.MODES)
@pytest.mark.parametrize("shape,map_shape,grid,box", [
    ((9, 7), (9, 7), (4, 3), (3, 4)), ((6, 10), (3, 5), (50, 50), (50, 50)), ((1, 1), (1, 1), (2, 2), (1, 1))])
def test_redaction_by_hand(mode, shape, map_shape, grid, box):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, shape).astype(float)
    classes = rng.integers(0, 20, map_shape)
    got = image.redact_array(pixels[:, :, None], classes, mode, image.CLASS_PRIORITIES,
                             image.THRESHOLD, grid, box)[:, :, 0]
    assert np.allclose(got, redacted_by_hand(pixels.tolist(), classes.tolist(), mode, grid, box))


def test_byte_frames(spark):
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (4, 5, 3), dtype=np.uint8)
    classes = rng.integers(0, 20, (4, 5))
    df = spark.createDataFrame([(4, 5, 3, bytearray(pixels.tobytes()), 4, 5, classes.ravel().tolist())],
                               "height int, width int, n_channels int, data binary, class_height int, "
                               "class_width int, classes array<int>")
    for mode in image.MODES:
        row = image.redact_frames(df, mode, grid=(2, 2), box=(3, 3)).collect()[0]
        want = image.redact_array(pixels.astype(float), classes, mode, image.CLASS_PRIORITIES,
                                  image.THRESHOLD, (2, 2), (3, 3))
        assert bytes(row.processed_data) == np.rint(want).astype(np.uint8).tobytes()
    with pytest.raises(ValueError):
        image.redact_frames(df, "smudge")


# --- mathematics ---------------------------------------------------------------------------------

def test_math_by_hand(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.125,), (0.0,), (1.0,), (None,)], "v double")
    v = F.col("v")
    rows = df.select(mathx.round_half_up(v, 0).alias("r"), mathx.clamp(v, 0, 2).alias("c"),
                     mathx.percent_text(v, 3).alias("p"), mathx.percent_text(v, 0).alias("p0")).collect()
    assert [r.r for r in rows] == [-2.0, 3.0, 0.0, 0.0, 1.0, None]
    assert [r.c for r in rows] == [0.0, 2.0, 0.125, 0.0, 1.0, None]
    assert [r.p for r in rows] == ["-250\\%", "250\\%", "12.5\\%", "0\\%", "100\\%", None]
    assert [r.p0 for r in rows] == ["-250.\\%", "250.\\%", "12.\\%", "0.\\%", "100.\\%", None]


def test_uniforms_are_uniform(spark):
    u = spark.range(20_000).select(mathx.uniform(5, F.col("id")).alias("u"))
    low, high, mean = u.agg(F.min("u"), F.max("u"), F.avg("u")).collect()[0]
    assert 0 < low < 0.001 and 0.999 < high < 1 and abs(mean - 0.5) < 0.01


def test_memory_of_candidate_sets_does_not_follow_the_batch(spark):
    """A whole Arrow batch of requests over many places, and the same sets as in small batches."""
    import tracemalloc
    rng, choose = random.Random(4), dummies.best_set(60_000, 4, 12, 8.0).func
    real, seed = (pd.Series([rng.randrange(n) for _ in range(6_000)]) for n in (60_000, 2 ** 59))
    tracemalloc.start()
    whole = choose(real, seed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    part = choose(real[100:140].reset_index(drop=True), seed[100:140].reset_index(drop=True))
    assert [list(x) for x in part["ranks"]] == [list(x) for x in whole["ranks"][100:140]]
    assert part["entropy"].tolist() == whole["entropy"][100:140].tolist()


def test_streamed_point_is_computed_once(spark):
    """The fits of a point on a stream stand once in its expression, however often its error is used."""
    import math

    from veilstream.operators.pets.geo import adaptive_geo, displaced, prediction_error, privacy_level
    pet = adaptive_geo("location", (3, 7.5, 22.0, 0.2, 0.25, 3.0, 4))
    tracks = [[(0, 1.0, 2.0), (1500, 4.0, 2.5), (4000, 5.0, 9.0)], [(7, 3.0, 1.0), (7, 30.0, 2.0)], [(9, 5.0, 5.0)]]
    rows = [(1, i, t, {"x": t[-1][1], "y": t[-1][2]}) for i, t in enumerate(tracks)]
    df = spark.createDataFrame(rows, "vehicle_id long, event_id long, recent array<struct<generate_ms:long,x:double,y:double>>, location struct<x:double,y:double>")
    value, ready = pet.of_recent(F.col("recent"))
    found = {r.event_id: (r.value.x, r.value.y, r.ready) for r in df.select("event_id", value.alias("value"), ready.alias("ready")).collect()}
    text = df.select(value.alias("value"))._jdf.queryExecution().analyzed().toString()
    assert text.count("aggregate(") == 8

    def fit(track, c):
        t = [(r[0] - track[0][0]) / 1000 for r in track]
        mean_t, mean_v = sum(t) / len(t), sum(r[c] for r in track) / len(t)
        spread = sum((a - mean_t) ** 2 for a in t)
        return mean_v + (sum((a - mean_t) * (r[c] - mean_v) for a, r in zip(t, track)) / spread if spread else 0) * (t[-1] - mean_t)
    fits = spark.createDataFrame([(i, fit(t, 1), fit(t, 2)) for i, t in enumerate(tracks)], "event_id long, px double, py double")
    error = prediction_error(F.col("px"), F.col("py"))
    moved = displaced(privacy_level(error, 7.5, 22.0, 0.2, 0.25, 3.0), error, 4, F.col("vehicle_id"), F.col("event_id"))
    for r in df.join(fits, "event_id").select("event_id", moved.alias("m")).collect():
        assert math.isclose(found[r.event_id][0], r.m.x, abs_tol=1e-9) and math.isclose(found[r.event_id][1], r.m.y, abs_tol=1e-9)
        assert found[r.event_id][2] == (len(tracks[r.event_id]) == 3)

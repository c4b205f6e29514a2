"""k-anonymous dummy locations.

Places are ranked by visit count. For a request at a real place, ``m`` candidate sets of ``k - 1``
other places are drawn around the real place's rank; the set under which an observer is least certain
which place is real (highest entropy) is published.

Requests are independent of each other given the ranks, so they run in parallel; the visit counts are
updated between batches (``updated_counts``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions.mathx import beta_shape, row_seed
from veilstream.operators.timeline import TARGET_ROWS, SlicePlan, Timeline, join_null_safe, plan_slices
from veilstream.session import cut_lineage

SCORED = 100_000  # doubles of one temporary when candidate sets are compared: these lie in a core's cache


def rank_places(places: DataFrame, plan: SlicePlan | None = None,
                target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add ``rank`` (from 0) by (``amount``, ``place_id``).

    A global row number would run in one task. Instead places are numbered within their amount
    (sliced by ``place_id`` if many share one amount) and offset by the number of places with a lower
    amount. Distinct amounts are dealt to ranges, numbered inside each, and moved on by the ranges before:
    no key is constant, and what meets in one task is one row for each range.
    """
    if plan is None:
        plan = plan_slices(places, key="amount", time="place_id", target_rows=target_rows)
    numbered = Timeline(["amount"], ["place_id"], plan).number(places, "_n")
    offsets = _running_below(places.groupBy("amount").agg(F.count(F.lit(1)).alias("_places")))
    return (join_null_safe(numbered, offsets, ["amount"])
            .withColumn("rank", F.col("_below") + F.col("_n") - 1).drop("_below", "_n"))


def _running_below(sizes: DataFrame) -> DataFrame:
    """``(amount, _below)``: the number of places with a smaller amount; a null amount is the smallest."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(sizes.repartitionByRange(parts, "amount").withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(F.asc_nulls_first("amount")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_places").alias("_total"))
    # One row for each range: which ranges lie before is an array lookup, not a window over everything.
    every = totals.agg(F.map_from_entries(F.collect_list(F.struct("_range", "_total"))).alias("_totals")).first()[0] or {}
    before, upto = {}, 0
    for number in sorted(every):
        before[number], upto = upto, upto + every[number]
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    return ranged.select("amount", (F.element_at(starts, F.col("_range")).cast("long") + F.coalesce(F.sum("_places").over(inside), F.lit(0))).alias("_below"))


def visit_counts(places: DataFrame, visits: DataFrame) -> DataFrame:
    """Places with ``amount``, the number of their visits (0 if none)."""
    counts = visits.groupBy("place_id").agg(F.count(F.lit(1)).alias("amount"))
    return (places.join(counts, "place_id", "left")
            .withColumn("amount", F.coalesce("amount", F.lit(0).cast("long"))))


def updated_counts(places: DataFrame, published: DataFrame) -> DataFrame:
    """Visit counts after a batch: every published place counts once per request."""
    gained = published.groupBy("place_id").agg(F.count(F.lit(1)).alias("_gained"))
    return (places.join(gained, "place_id", "left")
            .withColumn("amount", F.col("amount") + F.coalesce("_gained", F.lit(0)))
            .drop("_gained"))


def _log_gamma(v: np.ndarray) -> np.ndarray:
    """Log-gamma, computed once per distinct value (shapes repeat per place)."""
    distinct, back = np.unique(v, return_inverse=True)
    values = np.fromiter((math.lgamma(x) for x in distinct), dtype=float, count=len(distinct))
    return values[back].reshape(v.shape)


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, element by element."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    return _beta_cdf(x, a, b, _log_scale(a, b))


def _log_scale(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)


def _beta_cdf(x, a, b, log_scale) -> np.ndarray:
    shape = x.shape
    x, a, b, log_scale = x.ravel(), a.ravel(), b.ravel(), log_scale.ravel()
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    z = np.where(flip, 1 - x, x)
    inner = (z > 0) & (z < 1)
    safe = np.where(inner, z, 0.5)
    front = np.exp(log_scale + p * np.log(safe) + q * np.log1p(-safe)) / p
    low = np.where(inner, front * _fraction(safe, p, q), np.where(z <= 0, 0.0, 1.0))
    return np.where(flip, 1 - low, low).reshape(shape)


def _fraction(z: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The continued fraction; elements that have converged leave the iteration."""
    def away_from_zero(v):
        return np.where(np.abs(v) < 1e-300, 1e-300, v)

    result = np.empty_like(z)
    at = np.arange(len(z))
    c = np.ones_like(z)
    d = 1 / away_from_zero(1 - (p + q) * z / (p + 1))
    total = d.copy()
    for j in range(1, 500):
        for term in (j * (q - j) * z / ((p + 2 * j - 1) * (p + 2 * j)),
                     -(p + j) * (p + q + j) * z / ((p + 2 * j) * (p + 2 * j + 1))):
            d = 1 / away_from_zero(1 + term * d)
            c = away_from_zero(1 + term / c)
            change = d * c
            total = total * change
        done = np.abs(change - 1) < 4e-16
        if done.any() or j == 499:
            result[at] = total
            keep = ~done
            if not keep.any():
                break
            at, z, p, q, c, d, total = (v[keep] for v in (at, z, p, q, c, d, total))
    return result


def interval_probability(places: int, gamma: float):
    """Column function ``(interval, real_rank) -> probability`` that a dummy for a real place of that
    rank falls into the interval (of ``places - 1`` equal ones)."""
    @F.pandas_udf("double")
    def probability(interval: pd.Series, real_rank: pd.Series) -> pd.Series:
        return pd.Series(_interval_probability(interval.to_numpy(), real_rank.to_numpy(),
                                               places, gamma))
    return probability


def _interval_probability(interval, real_rank, places: int, gamma: float) -> np.ndarray:
    width = places - 1
    interval, real_rank = np.broadcast_arrays(np.asarray(interval), np.asarray(real_rank, dtype=float))
    # What depends on the real place only is computed once for each.
    distinct, back = np.unique(real_rank, return_inverse=True)
    a, b = beta_shape(distinct / width, gamma)
    a, b, log_scale = (v[back.reshape(real_rank.shape)] for v in (a, b, _log_scale(a, b)))
    return _beta_cdf((interval + 1) / width, a, b, log_scale) - _beta_cdf(interval / width, a, b, log_scale)


def set_entropy(sets: np.ndarray, places: int, gamma: float) -> np.ndarray:
    """Entropy of each candidate set (last axis: ranks): for each member, the probability of the
    others as its dummies."""
    k = sets.shape[-1]
    me, them = np.nonzero(~np.eye(k, dtype=bool))
    real, other = sets[..., me], sets[..., them]
    interval = np.where(other > real, other - 1, other)
    p = _interval_probability(interval, real, places, gamma)
    p = p.reshape(*sets.shape[:-1], k, k - 1).prod(axis=-1)
    logs = np.log2(np.where(p > 0, p, 1.0))
    return -(np.where(p > 0, p, 0.0) * logs).sum(axis=-1)


def _draw_sets(seeds, a, b, trials: int, wanted: int, intervals: int) -> np.ndarray:
    """Distinct intervals in the order in which they come up: (request, trial, ``wanted``).

    A request draws a few values more than it needs at once; the rare set with too many repeats goes
    on drawing by itself.
    """
    width = 2 * wanted + 2
    generators = [np.random.default_rng(seed) for seed in seeds]
    drawn = np.stack([g.beta(a[i], b[i], size=(trials, width)) for i, g in enumerate(generators)])
    drawn = np.minimum((drawn * intervals).astype(np.int64), intervals - 1)
    repeats = np.zeros(drawn.shape, dtype=bool)
    for j in range(1, width):
        repeats[..., j] = (drawn[..., :j] == drawn[..., j:j + 1]).any(axis=-1)
    first = np.argsort(repeats, axis=-1, kind="stable")[..., :wanted]
    sets = np.take_along_axis(drawn, first, axis=-1)
    for row, trial in np.argwhere((~repeats).sum(axis=-1) < wanted):
        seen = list(dict.fromkeys(drawn[row, trial].tolist()))
        sets[row, trial] = _draw_rest(generators[row], a[row], b[row], seen, wanted, intervals)
    return sets


def _draw_rest(rng, a: float, b: float, known: list[int], wanted: int, intervals: int) -> list[int]:
    """Draw from the intervals not seen yet until there are ``wanted``, which is what rejecting repeats amounts to:
    a point of the remaining probability is found by halving, so the work does not grow with the intervals."""
    seen = list(known)
    while len(seen) < wanted:
        taken = np.sort(np.array(seen, dtype=np.int64))
        mass = beta_cdf((taken + 1) / intervals, a, b) - beta_cdf(taken / intervals, a, b)
        # what lies before each seen interval, without the seen ones
        before = beta_cdf(taken / intervals, a, b) - (np.cumsum(mass) - mass)
        left = max(1.0 - mass.sum(), 0.0)
        point = rng.uniform() * left
        k = int(np.searchsorted(before, point, side="right"))
        low, high = (0 if k == 0 else int(taken[k - 1]) + 1), (intervals if k == len(taken) else int(taken[k]))
        aim, top = point + float(mass[:k].sum()), high
        while low < high - 1:
            middle = (low + high) // 2
            low, high = (middle, high) if float(beta_cdf(middle / intervals, a, b)) <= aim else (low, middle)
        free = low if low < top and low not in seen else next(
            i for d in range(intervals) for i in (low - d, low + d) if 0 <= i < intervals and i not in seen)  # no mass is left here
        seen.append(free)
    return seen


def best_set(places: int, k: int, m: int, gamma: float):
    """Column function ``(real_rank, seed) -> struct(ranks, entropy, trial)``."""
    width = places - 1

    @F.pandas_udf("ranks array<long>, entropy double, trial int")
    def choose(real_rank: pd.Series, seed: pd.Series) -> pd.DataFrame:
        real, seeds = real_rank.to_numpy(dtype=np.int64), seed.tolist()
        a, b = beta_shape(real / width, gamma)
        if not len(real):
            return pd.DataFrame({"ranks": [], "entropy": [], "trial": []})
        step, parts = max(1, SCORED // (m * k * k)), []
        for i in range(0, len(real), step):
            own = real[i:i + step]
            drawn = _draw_sets(seeds[i:i + step], a[i:i + step], b[i:i + step], m, k - 1, width)
            others = np.where(drawn >= own[:, None, None], drawn + 1, drawn)
            sets = np.concatenate([np.broadcast_to(own[:, None, None], (len(own), m, 1)), others], axis=2)
            score = set_entropy(sets, places, gamma)
            best, pick = score.argmax(axis=1), np.arange(len(own))
            parts.append(pd.DataFrame({"ranks": list(sets[pick, best]), "entropy": score[pick, best],
                                       "trial": best.astype("int32")}))
        return pd.concat(parts)

    return choose


def dummy_locations(requests: DataFrame, ranked: DataFrame, k: int, m: int, gamma: float,
                    seed=0, tasks: int | None = None) -> DataFrame:
    """``k`` published places per request, the real one among them.

    ``requests`` has ``request_id, place_id``; ``ranked`` comes from ``rank_places``. The candidate
    sets of a request are drawn and compared inside one Arrow batch, so only the chosen ranks move.
    A request is a few bytes but much work, so requests are spread over ``tasks`` (by default as many
    as shuffles have partitions) whatever their bytes. The ranks are needed three times; they are
    written once, so that visits are not counted again.
    """
    ranked = cut_lineage(ranked)
    places = ranked.count()
    if not 2 <= k <= places:
        raise ValueError(f"k must be between 2 and the number of places ({places}), not {k}")
    if m < 1:
        raise ValueError("at least one candidate set is needed")
    tasks = tasks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = (requests.join(ranked.select("place_id", "rank"), "place_id")
              .repartition(tasks, "request_id").withColumn("chosen", best_set(places, k, m, gamma)(
                  F.col("rank"), row_seed(seed, F.col("request_id")))))
    spread = chosen.select("request_id", F.col("place_id").alias("real_place_id"),
                           F.col("chosen.entropy").alias("entropy"),
                           F.col("chosen.trial").alias("trial"),
                           F.posexplode("chosen.ranks").alias("slot", "rank"))
    return spread.join(ranked, "rank")

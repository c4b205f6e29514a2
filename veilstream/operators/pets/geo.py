"""Adaptive geo-obfuscation.

A point that its recent movement predicts badly gives away more, so it gets a different noise level.
All steps are Columns over the frame of the last ``size`` points; the random numbers come from the
row's identity, so they do not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.functions.mathx import laplace_from_uniform, uniform


def predict_positions(rows, ordered, whole, size: int, prefix: str = ""):
    """Add ``predicted_x``, ``predicted_y`` (straight-line fits evaluated now) and ``n_points``.

    Times enter the fit as seconds from the first row of the partition: the fit itself does not depend
    on the origin, but raw epoch times would lose digits.
    """
    frame = ordered.rowsBetween(-(size - 1), 0)
    rows = rows.withColumn(f"{prefix}origin", F.min("generate_ms").over(whole))
    rows = rows.withColumns({
        f"{prefix}t": (F.col("generate_ms") - F.col(f"{prefix}origin")) / 1000.0,
        f"{prefix}x": F.col("location.x"), f"{prefix}y": F.col("location.y")})

    def fitted(value: str) -> Column:
        t = F.col(f"{prefix}t")
        slope = F.coalesce(F.regr_slope(value, t).over(frame), F.lit(0.0))
        return F.avg(value).over(frame) + slope * (t - F.avg(t).over(frame))

    return (rows.withColumns({f"{prefix}predicted_x": fitted(f"{prefix}x"),
                              f"{prefix}predicted_y": fitted(f"{prefix}y"),
                              f"{prefix}n_points": F.count(F.lit(1)).over(frame)})
            .drop(*[f"{prefix}{c}" for c in ("origin", "t", "x", "y")]))


def bound(value: Column, use) -> Column:
    """``use(value)`` where the value is computed once: inside a lambda or a branch Spark computes an expression again
    wherever it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fit_of_recent(recent: Column, value: str) -> Column:
    """The same straight-line fit over an array of the last rows, evaluated at the last one."""
    n, start = F.size(recent), recent[0]["generate_ms"]

    def total(term) -> Column:
        return F.aggregate(recent, F.lit(0.0), lambda acc, r: acc + term(r))

    def seconds(r: Column, start: Column = start) -> Column:
        return (r["generate_ms"] - start) / 1000.0

    def fitted(m: Column) -> Column:
        away = lambda r: seconds(r, m["start"]) - m["t"]
        spread = total(lambda r: away(r) * away(r))
        joint = total(lambda r: away(r) * (r[value] - m["v"]))
        slope = F.coalesce(F.try_divide(joint, spread), F.lit(0.0))
        return m["v"] + slope * away(F.element_at(recent, -1))

    means = F.struct((total(seconds) / n).alias("t"), (total(lambda r: r[value]) / n).alias("v"), start.alias("start"))
    return bound(means, fitted)


def prediction_error(px: Column, py: Column) -> Column:
    dx, dy = F.col("location.x") - px, F.col("location.y") - py
    return F.sqrt(dx * dx + dy * dy)


def privacy_level(error: Column, t1: float, t2: float, epsilon: float, alpha: float,
                  beta: float) -> Column:
    """Small errors scale ``epsilon`` by ``alpha``, large ones by ``beta``."""
    return (F.when(error < t1, F.lit(alpha * epsilon))
            .when(error < t2, F.lit(epsilon))
            .otherwise(F.lit(beta * epsilon)))


def turn(level: Column, error: Column, seed, *identity: Column) -> Column:
    """A Laplace radius (location ``level``, scale ``error``) and a uniform angle."""
    radius = laplace_from_uniform(uniform(f"{seed}r", *identity), level, error)
    angle = uniform(f"{seed}a", *identity) * F.lit(2 * math.pi)
    return F.struct(radius.alias("radius"), angle.alias("angle"))


def turned(by: Column) -> Column:
    """The point moved by a radius at an angle."""
    return F.struct((F.col("location.x") + by["radius"] * F.cos(by["angle"])).alias("x"),
                    (F.col("location.y") + by["radius"] * F.sin(by["angle"])).alias("y"))


def displaced(level: Column, error: Column, seed, *identity: Column) -> Column:
    return turned(turn(level, error, seed, *identity))


def adaptive_geo(section: str, params: tuple):
    """``size, threshold1, threshold2, epsilon, alpha, beta`` and an optional seed."""
    from veilstream.operators.pets import WindowPet
    size, t1, t2, epsilon, alpha, beta = params[:6]
    seed = params[6] if len(params) > 6 else 0

    def moved(px: Column, py: Column) -> Column:
        error = prediction_error(px, py)
        level = privacy_level(error, t1, t2, epsilon, alpha, beta)
        return displaced(level, error, seed, F.col("vehicle_id"), F.col("event_id"))

    def compute(rows, ordered, whole, prefix):
        rows = predict_positions(rows, ordered, whole, size, prefix)
        value = moved(F.col(f"{prefix}predicted_x"), F.col(f"{prefix}predicted_y"))
        return rows, value, F.col(f"{prefix}n_points") == size

    def of_recent(recent):
        identity = F.col("vehicle_id"), F.col("event_id")
        value = bound(recent, lambda last: bound(
            F.struct(*[fit_of_recent(last, c).alias(c) for c in "xy"]), lambda at: bound(
                prediction_error(at["x"], at["y"]), lambda error: bound(
                    turn(privacy_level(error, t1, t2, epsilon, alpha, beta), error, seed, *identity), turned))))
        return value, F.size(recent) == size

    return WindowPet(size, ("location", "vehicle_id"), compute, of_recent)

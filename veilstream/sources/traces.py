"""Traces from waypoints: one row per second between waypoints, speeds derived from distances.

Waypoints have ``vehicle_id, seq, x, y, seconds``; ``seconds`` is the duration of the segment that
*ends* in the row. ``seq`` must rise per vehicle. Slice plans are made with ``time="seq"``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.operators.timeline import SlicePlan, Timeline

METRES_PER_SECOND_TO_KMH = 3.6


def _segments(waypoints: DataFrame, plan: SlicePlan) -> DataFrame:
    """Each waypoint with the one before it (``px, py, ps``: position and segment seconds) and the
    one before that. Segments are named by the waypoint that ends them."""
    line = Timeline(["vehicle_id"], ["seq"], plan)
    return line.last_rows(waypoints, 3, ["x", "y", "seconds"], lambda rows, w, _: rows.withColumns({
        "px": F.lag("x").over(w), "py": F.lag("y").over(w), "ps": F.lag("seconds").over(w),
        "ppx": F.lag("x", 2).over(w), "ppy": F.lag("y", 2).over(w),
    })).where(F.col("px").isNotNull())


def _seconds_of(segments: DataFrame, values: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per second of each segment, values going evenly from start to end, and a closing row
    per vehicle with the values at the end of its last segment (found by a combining aggregate)."""
    def between(start: Column, end: Column) -> Column:
        rise = F.try_divide(end - start, F.col("seconds")) * F.col("step")
        return F.when(F.col("step") == 0, start).otherwise(start + rise)

    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("seconds") - 1, F.lit(0)))
    dense = segments.withColumn("step", F.explode(steps)).select(
        "vehicle_id", "seq", "step", *[between(*v).alias(name) for name, v in values.items()])
    closing = F.struct("seq", F.col("seconds").cast("long").alias("step"),
                       *[end.alias(name) for name, (_, end) in values.items()])
    ends = segments.groupBy("vehicle_id").agg(F.max_by(closing, "seq").alias("_end"))
    return dense.unionByName(ends.select("vehicle_id", "_end.*"))


def densify_waypoints(waypoints: DataFrame, plan: SlicePlan) -> DataFrame:
    """One point per second: each segment from its first point on, and the last waypoint at the end.

    ``seq`` is the number of the waypoint that ends the segment, ``step`` the second within it; the
    closing point has step = ``seconds``.
    """
    return _seconds_of(_segments(waypoints, plan), {
        "x": (F.col("px"), F.col("x")), "y": (F.col("py"), F.col("y"))})


def speed_from_waypoints(waypoints: DataFrame, plan: SlicePlan) -> DataFrame:
    """Speed in km/h per second.

    A segment's speed is its distance over its duration and holds at its end; the trace starts at 0
    and changes evenly within a segment. The last segment's speed closes the trace.
    """
    def kmh(x0, y0, x1, y1, seconds) -> Column:
        metres = F.sqrt(F.pow(F.col(x0) - F.col(x1), 2) + F.pow(F.col(y0) - F.col(y1), 2))
        return F.try_divide(metres, F.col(seconds)) * METRES_PER_SECOND_TO_KMH

    segments = _segments(waypoints, plan).withColumns({
        "end_v": kmh("px", "py", "x", "y", "seconds"),
        "start_v": F.coalesce(kmh("ppx", "ppy", "px", "py", "ps"), F.lit(0.0))})
    return _seconds_of(segments, {"v": (F.col("start_v"), F.col("end_v"))})


def multi_rate_context(fast: DataFrame, slow: DataFrame, ratio: int = 10,
                       keys=("vehicle_id",)) -> DataFrame:
    """One context per fast tick; slow samples change every ``ratio``-th tick and hold in between.

    ``fast`` has ``tick`` (from 0), ``slow`` has ``sample`` (from 0). An equi-join on the sample
    number, so nothing has to be carried forward.
    """
    sample = F.floor(F.col("tick") / ratio).cast("long")
    return fast.withColumn("sample", sample).join(slow, [*keys, "sample"])


def location_trace(dense: DataFrame, plan: SlicePlan) -> DataFrame:
    """Export layout ``x, y, time``: time counts the rows of a vehicle from 0."""
    line = Timeline(["vehicle_id"], ["seq", "step"], plan)
    return (line.number(dense, "time").withColumn("time", F.col("time") - 1)
            .select("vehicle_id", "x", "y", "time"))


def speed_trace(dense: DataFrame) -> DataFrame:
    """Export layout ``v`` with two decimals, with the ordering columns in front."""
    return dense.select("vehicle_id", "seq", "step", F.format_string("%.2f", "v").alias("v"))


def read_waypoints(spark, path: str) -> DataFrame:
    """Waypoint files (header; ``vehicle_id, seq, x, y, seconds``)."""
    schema = "vehicle_id long, seq long, x double, y double, seconds int"
    return (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True).schema(schema).csv(path))


def write_trace(trace: DataFrame, path: str, order: str = "time") -> None:
    """Write a trace as CSV with a header: each vehicle in one run of rows of one file or of files that follow each
    other, in order. The number of files goes with the amount of data, not with the number of vehicles."""
    order = [c for c in (order, "seq", "step") if c in trace.columns]
    (trace.repartitionByRange("vehicle_id", *order).sortWithinPartitions("vehicle_id", *order)
     .write.mode("errorifexists").option("header", True).csv(path))

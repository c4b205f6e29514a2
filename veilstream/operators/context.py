"""Building, merging, comparing and reassembling contexts.

A *context* row holds the latest speed, location and image of a vehicle as nullable structs that each
carry their own ``generate_ms``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.operators.timeline import SlicePlan, Timeline
from veilstream.schemas import SECTIONS

ORDER = ("generate_ms", "event_id")


def section_structs() -> dict[str, Column]:
    """Each section of a long reading row as a struct, null for rows of other sections."""
    speed = F.struct(F.col("scalar").alias("v"), F.col("generate_ms"))
    location = F.struct(F.col("location.x").alias("x"), F.col("location.y").alias("y"),
                        F.col("generate_ms"))
    image = F.struct(F.col("image").alias("data"), F.col("sequence_number"), F.col("generate_ms"))
    return {
        "speed": F.when(F.col("section") == "speed", speed),
        "location": F.when(F.col("section") == "location", location),
        "image": F.when(F.col("section") == "image", image),
    }


def to_context(readings: DataFrame) -> DataFrame:
    """Lift each reading to a context that holds only its own section."""
    structs = section_structs()
    return readings.select("vehicle_id", "event_id", "section",
                           F.col("generate_ms").alias("update_ms"),
                           *[structs[s].alias(s) for s in SECTIONS])


def fan_out(context: DataFrame, sections: Sequence[str] = SECTIONS,
            name: str = "section") -> DataFrame:
    """Copy each context once per section, labelled."""
    return context.withColumn(name, F.explode(F.array(*[F.lit(s) for s in sections])))


def filter_section(df: DataFrame, section: str) -> DataFrame:
    """Rows of one section; case does not matter."""
    return df.where(F.lower("section") == section.lower())


def latest_context(readings: DataFrame) -> DataFrame:
    """Newest value of each section per vehicle; among equal times the first ``event_id`` stays.

    ``max_by`` combines before the shuffle, so a hot vehicle sends one row per input task.
    """
    structs = section_structs()
    position = F.struct(F.col("generate_ms"), -F.col("event_id"))
    return readings.groupBy("vehicle_id").agg(
        *[F.max_by(structs[s], F.when(F.col("section") == s, position)).alias(s)
          for s in SECTIONS],
        F.max("generate_ms").alias("update_ms"))


def running_context(readings: DataFrame, plan: SlicePlan) -> DataFrame:
    """The context as of each reading: every section carried forward from its last reading."""
    line = Timeline(["vehicle_id"], ORDER, plan)
    return line.last_known(readings, section_structs())


def extract_section(context: DataFrame, section: str, keep: Sequence[str] = ()) -> DataFrame:
    """The fields of one section as columns; rows without it are dropped."""
    if section not in SECTIONS:
        raise ValueError(f"unknown section {section!r}; known: {', '.join(SECTIONS)}")
    return context.where(F.col(section).isNotNull()).select(*keep, f"{section}.*")


def asof_context(left: DataFrame, right: DataFrame, plan: SlicePlan) -> DataFrame:
    """Combine two inputs: every row of either side with the latest value of the other.

    Both sides have ``vehicle_id, event_id, generate_ms, value``. Rows without a value on the other
    side yet are not emitted.
    """
    both = left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))
    line = Timeline(["vehicle_id"], ORDER, plan)
    known = line.last_known(both, {
        "left_value": F.when(F.col("side") == "left", F.col("value")),
        "right_value": F.when(F.col("side") == "right", F.col("value")),
    })
    return known.where(F.col("left_value").isNotNull() & F.col("right_value").isNotNull()).drop("value")


def dedupe_readings(df: DataFrame, plan: SlicePlan,
                    keys: Sequence[str] = ("app", "vehicle_id", "section"),
                    time: str = "generate_ms", order: Sequence[str] = ORDER) -> DataFrame:
    """Drop a row whose generate time equals that of the row before it in the same section."""
    line = Timeline(keys, order, plan)
    marked = line.last_rows(df, 2, [time], lambda rows, w, _: rows.withColumn(
        "_before", F.lag(time).over(w)))
    return marked.where(~F.col(time).eqNullSafe(F.col("_before"))).drop("_before")


def reassemble(speed: DataFrame, location: DataFrame, image: DataFrame, plan: SlicePlan,
               ratio: int = 10, keys: Sequence[str] = ("app", "vehicle_id"),
               columns: tuple[str, str, str] = ("speed", "location", "image")) -> DataFrame:
    """Zip sections by arrival order: ``ratio`` images share one speed and one location sample.

    Each input has the keys, ``generate_ms``, ``event_id`` and its value column. After numbering, the
    joins run on (keys, group number), which spreads a hot vehicle over all tasks.
    """
    line = Timeline(keys, ORDER, plan)
    on = [*keys, "group_no"]

    def numbered(df: DataFrame, column: str, per_group: int) -> DataFrame:
        out = line.number(df.select(*keys, *ORDER, column), "n")
        group = F.floor((F.col("n") - 1) / per_group).cast("long")
        return out.withColumn("group_no", group)

    frames = numbered(image, columns[2], ratio)
    samples = [numbered(df, column, 1).select(*on, column)
               for df, column in zip((speed, location), columns)]
    joined = reduce(lambda a, b: a.join(b, on), samples, frames)
    return joined.withColumnRenamed("n", "frame_no").drop("group_no")


def erase_processed(df: DataFrame) -> DataFrame:
    """Only raw values and times: drops every ``processed_*`` column."""
    return df.drop(*[c for c in df.columns if c.startswith("processed_")])


def availability(speed="speed", location="location", image="image") -> Column:
    """Bit 2 speed, bit 1 location, bit 0 image."""
    bits = [(speed, 4), (location, 2), (image, 1)]
    return reduce(lambda a, b: a + b, [
        F.when(F.col(name).isNotNull(), F.lit(bit)).otherwise(F.lit(0)) for name, bit in bits])


def same_origin(left: str, right: str) -> Column:
    """True if both contexts hold the same sections with the same generate times.

    ``left`` and ``right`` are the DataFrame aliases of the two contexts.
    """
    return reduce(lambda a, b: a & b, [
        F.col(f"{left}.{s}.generate_ms").eqNullSafe(F.col(f"{right}.{s}.generate_ms"))
        for s in SECTIONS])


def tag_triggers(context: DataFrame, decisions: DataFrame,
                 on: Sequence[str] = ("app", "vehicle_id", "event_id")) -> DataFrame:
    """Attach the (section, decision id) pairs that a record triggered.

    Decisions have one row per affected section. A record has at most a few, so the lists stay short.
    """
    pairs = (decisions.withColumnRenamed("trigger_event_id", "event_id")
             .groupBy(*on)
             .agg(F.array_sort(F.collect_list(F.struct("section", "decision_id"))).alias("triggers")))
    empty = F.array().cast("array<struct<section:string,decision_id:string>>")
    return (context.join(pairs, list(on), "left")
            .withColumn("triggers", F.coalesce("triggers", empty)))


def is_trigger(triggers="triggers") -> Column:
    return F.size(triggers) > 0


def is_affected(section: str, triggers="triggers") -> Column:
    """Any trigger for the section; case does not matter."""
    return F.exists(triggers, lambda t: F.lower(t["section"]) == section.lower())


def only_affects(sections: Sequence[str], triggers="triggers") -> Column:
    """There are triggers, and all of them are for one of the given sections."""
    return (F.size(triggers) > 0) & F.forall(triggers, lambda t: t["section"].isin(*sections))


def trigger_ids(triggers="triggers") -> Column:
    return F.array_distinct(F.transform(triggers, lambda t: t["decision_id"]))


def speed_text(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2fkm/h ", value)).otherwise(F.lit("-"))


def location_text(x: Column, y: Column) -> Column:
    return (F.when(x.isNotNull() & y.isNotNull(), F.format_string("[%.2f, %.2f]", x, y))
            .otherwise(F.lit("-")))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of section streams or application streams, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def zip_apps(df: DataFrame, apps: Sequence[str], value: Column, plan: SlicePlan) -> DataFrame:
    """The n-th record of every application side by side, only while all of them have one."""
    line = Timeline(["app", "vehicle_id"], ORDER, plan)
    numbered = line.number(df, "n").withColumn("_value", value)
    wide = (numbered.groupBy("vehicle_id", "n").pivot("app", list(apps))
            .agg(F.first("_value", ignorenulls=True).alias("value"),
                 F.count(F.lit(1)).alias("present")))
    if len(apps) == 1:
        raise ValueError("zip_apps needs at least two applications")
    complete = reduce(lambda a, b: a & b, [F.col(f"{a}_present") > 0 for a in apps])
    return wide.where(complete).select("vehicle_id", "n", *[F.col(f"{a}_value").alias(a) for a in apps])

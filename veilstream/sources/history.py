"""The history of raw readings and the look-ups that warm up a stateful PET from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.operators.timeline import SlicePlan, Timeline, join_null_safe
from veilstream.schemas import SECTIONS

SLOTS = 16
BUCKETED = ("vehicle_id", "slot")


def history_rows(readings: DataFrame) -> DataFrame:
    """Layout of the store: raw values and generate time only, one partition per section."""
    section = F.lower("section")
    known = F.when(section.isin(*SECTIONS), section).otherwise(
        F.raise_error(F.concat(F.lit("no history for section "), F.col("section"))))
    return readings.select(known.alias("section"), "vehicle_id", "event_id", "generate_ms",
                           *[c for c in ("scalar", "location", "image") if c in readings.columns])


def _day(ms) -> Column:
    return F.floor(ms / 86_400_000).cast("int")


def write_history(readings: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the store; also usable as the body of ``foreachBatch``.

    The store is partitioned by section and day (days since 1970), so a look-up for one section and a period
    reads only its files. A day's rows are dealt by vehicle, which keeps the files few.
    """
    rows = history_rows(readings).withColumn("day", _day(F.col("generate_ms")))
    (rows.repartition("section", "day", F.pmod(F.xxhash64("vehicle_id"), F.lit(8))).sortWithinPartitions("section", "day", "vehicle_id", "generate_ms")
     .write.mode(mode).partitionBy("section", "day").parquet(path))


def read_history(spark, path: str, section: str | None = None, since_ms: int | None = None,
                 until_ms: int | None = None) -> DataFrame:
    """The store, or its part of one section and a period (``since_ms`` included, ``until_ms`` not)."""
    return _part(spark.read.parquet(path), section, since_ms, until_ms)


def _part(history: DataFrame, section, since_ms, until_ms) -> DataFrame:
    if section is not None:
        history = history.where(F.col("section") == section)
    if since_ms is not None:
        history = history.where((F.col("day") >= _day(F.lit(since_ms))) & (F.col("generate_ms") >= since_ms))
    if until_ms is not None:
        history = history.where((F.col("day") <= _day(F.lit(until_ms))) & (F.col("generate_ms") < until_ms))
    return history.drop("day")


def write_history_table(readings: DataFrame, name: str, path: str | None = None, buckets: int = 64) -> None:
    """Append to the bucketed store ``name`` (created with its files in ``path``, if that is given).

    Rows are bucketed by (vehicle_id, slot) and sorted by time inside; partitions are those of ``write_history``. A slot
    is a hash of the time, one of ``SLOTS``: a vehicle of any size, and rows without a vehicle, lie in so many buckets.
    """
    slot = F.pmod(F.xxhash64("generate_ms"), F.lit(SLOTS)).cast("int")
    rows = history_rows(readings).withColumns({"slot": slot, "day": _day(F.col("generate_ms"))})
    # Rows come to their buckets first: a bucket gets one file a write, section and day, not one of every task.
    writer = (rows.repartition(buckets, *BUCKETED).write.format("parquet").mode("append").partitionBy("section", "day")
              .bucketBy(buckets, *BUCKETED).sortBy("generate_ms"))
    (writer.option("path", path) if path else writer).saveAsTable(name)


def open_history_table(spark, name: str, path: str, like: DataFrame, buckets: int = 64) -> None:
    """Name the bucketed store in ``path`` again, in a catalog that does not know it; ``like`` has the columns of its readings."""
    rows = history_rows(like).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows if f.name != "section")
    spark.sql(f"CREATE TABLE {name} ({columns}, slot int, section string, day int) USING parquet PARTITIONED BY (section, day) "
              f"CLUSTERED BY ({', '.join(BUCKETED)}) SORTED BY (generate_ms) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")


def read_history_table(spark, name: str, section: str | None = None, since_ms: int | None = None,
                       until_ms: int | None = None) -> DataFrame:
    """The bucketed store, or its part of one section and a period, with ``slot``."""
    return _part(spark.table(name), section, since_ms, until_ms)


def latest_records(history: DataFrame, size: int) -> DataFrame:
    """The ring of every vehicle: its ``size - 1`` newest records, with ``back`` (1 = newest).

    ``history`` comes from ``read_history_table``. The newest of every slot are found inside the buckets, without a shuffle
    of the store; only these, at most ``SLOTS * (size - 1)`` of a vehicle, move to be put together.
    """
    newest = [F.desc("generate_ms"), F.desc("event_id")]
    inside = F.row_number().over(Window.partitionBy(*BUCKETED).orderBy(*newest))
    kept = history.withColumn("_back", inside).where(F.col("_back") < size).drop("_back", "slot")
    back = F.row_number().over(Window.partitionBy("vehicle_id").orderBy(*newest))
    return kept.withColumn("back", back).where(F.col("back") < size)


def warmup_piece(triggers: DataFrame, history: DataFrame, size: int, plan: SlicePlan) -> DataFrame:
    """The ``size - 1`` newest records strictly before each trigger (all, if there are fewer).

    Instead of a range join, every record gets its number in the vehicle's history and every trigger
    the count of earlier records; the look-up is then an equi-join on (vehicle, number).
    Adds ``back`` (1 = newest).
    """
    keep = size - 1
    asked = triggers.select("vehicle_id", "generate_ms", F.col("event_id").alias("trigger_event_id"),
                            F.lit(0).alias("_kind"))
    # Only vehicles with a trigger are looked at.
    stored = (join_null_safe(history, asked.select("vehicle_id").distinct(), ["vehicle_id"], "left_semi")
              .withColumn("_kind", F.lit(1)))
    # A trigger comes before records of the same time: only strictly earlier ones count.
    line = Timeline(["vehicle_id"], ["generate_ms", "_kind", "event_id"], plan)
    rows = line.running_sum(stored.unionByName(asked, allowMissingColumns=True),
                            {"_number": F.col("_kind")})
    wanted = (rows.where((F.col("_kind") == 0) & (F.col("_number") > 0) & F.lit(keep > 0))
              .select("vehicle_id", "trigger_event_id", F.col("_number").alias("_earlier"),
                      F.explode(F.sequence(F.greatest(F.lit(1), F.col("_number") - (keep - 1)),
                                           F.col("_number"))).alias("_number")))
    found = rows.where(F.col("_kind") == 1).drop("_kind", "trigger_event_id")
    return (join_null_safe(wanted, found, ["vehicle_id", "_number"])
            .withColumn("back", F.col("_earlier") - F.col("_number") + 1)
            .drop("_earlier", "_number"))


def warmup_time(triggers: DataFrame, history: DataFrame, seconds: int) -> DataFrame:
    """Records with ``t - seconds < generate_ms < t`` for each trigger time ``t``.

    Both sides are put into buckets of a quarter of the period, so a trigger meets five buckets only and
    the join is an equi-join on (vehicle, bucket) that pairs few records from outside the period.
    """
    span = seconds * 1000
    bucket = F.floor(F.col("generate_ms") / (span / 4)).cast("long")
    asked = triggers.select("vehicle_id", F.col("event_id").alias("trigger_event_id"),
                            F.col("generate_ms").alias("trigger_ms"),
                            F.explode(F.sequence(bucket - 4, bucket)).alias("_bucket"))
    stored = history.withColumn("_bucket", bucket)
    inside = ((F.col("generate_ms") > F.col("trigger_ms") - span)
              & (F.col("generate_ms") < F.col("trigger_ms")))
    return join_null_safe(stored, asked, ["vehicle_id", "_bucket"]).where(inside).drop("_bucket")


def warmup_totals(triggers: DataFrame, history: DataFrame, seconds: int, plan: SlicePlan,
                  decimals: int = 6) -> DataFrame:
    """``n`` and ``total`` of ``scalar`` over the same period before each trigger, without listing its
    records: the difference of two running totals, so the work does not grow with the period.

    Totals are kept in whole units of the last decimal, which makes them exact.
    """
    span, unit = seconds * 1000, 10 ** decimals
    asked = triggers.select("vehicle_id", F.col("event_id").alias("trigger_event_id"),
                            F.explode(F.array(
                                # everything up to the lower bound, that bound included, is outside
                                F.struct(F.lit(-1).alias("_sign"), F.lit(2).alias("_kind"),
                                         (F.col("generate_ms") - span).alias("generate_ms")),
                                # everything strictly before the trigger counts
                                F.struct(F.lit(1).alias("_sign"), F.lit(0).alias("_kind"),
                                         F.col("generate_ms")))).alias("_edge"))
    edges = asked.select("vehicle_id", "trigger_event_id", "_edge.*")
    stored = history.select("vehicle_id", "event_id", "generate_ms", F.lit(1).alias("_kind"),
                            F.round(F.col("scalar") * unit).cast("long").alias("_units"))
    line = Timeline(["vehicle_id"], ["generate_ms", "_kind", "event_id"], plan)
    rows = line.running_sum(stored.unionByName(edges, allowMissingColumns=True), {
        "_n": F.when(F.col("_kind") == 1, 1).otherwise(0),
        "_total": F.coalesce("_units", F.lit(0))})
    return (rows.where(F.col("_kind") != 1).groupBy("vehicle_id", "trigger_event_id")
            .agg(F.sum(F.col("_sign") * F.col("_n")).alias("n"),
                 (F.sum(F.col("_sign") * F.col("_total")) / unit).alias("total")))

"""Sharding, order restoration and acknowledgement quorums as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstream.operators.timeline import SlicePlan, Timeline


def quorum(acks: DataFrame, instances: int) -> DataFrame:
    """Decisions that all ``instances`` have acknowledged, with the time of completion.

    ``acks`` has ``decision_id, instance`` (from 0) and ``ack_ms``. A decision is ready when its last
    instance acknowledges for the first time. Repeats count as duplicates. Everything is combined
    before the shuffle.
    """
    firsts = acks.groupBy("decision_id", "instance").agg(
        F.min("ack_ms").alias("first_ms"), F.count(F.lit(1)).alias("times"))
    counts = [F.max("first_ms").alias("ready_ms"),
              (F.sum("times") - F.count(F.lit(1))).alias("duplicates")]
    full = F.count("instance") == instances  # one row for each of them
    grouped = firsts.groupBy("decision_id").agg(*counts, full.alias("_full"))
    return grouped.where("_full").drop("_full")


def interleave(df: DataFrame, shard: str, shards: int, order: Sequence[str], plan: SlicePlan,
               name: str = "emit_no") -> DataFrame:
    """Restore order round-robin: the n-th rows of all shards in turn, while every shard has one.

    Adds the emission number. Completeness is checked per ordinal, which spreads over all tasks.
    """
    numbered = Timeline([shard], order, plan).number(df, "_n")
    round_size = F.count(F.lit(1)).over(Window.partitionBy("_n"))
    return (numbered.withColumn("_have", round_size).where(F.col("_have") == shards)
            .withColumn(name, (F.col("_n") - 1) * shards + F.col(shard)).drop("_n", "_have"))


def round_robin(df: DataFrame, shards: int, order: Sequence[str], plan: SlicePlan,
                keys: Sequence[str] = ("vehicle_id",), name: str = "shard") -> DataFrame:
    """Assign rows to shards 0..n-1 in turn, per keys. To balance load only, ``repartition`` does it
    without numbering."""
    numbered = Timeline(keys, order, plan).number(df, "_n")
    return numbered.withColumn(name, (F.col("_n") - 1) % shards).drop("_n")

"""Latency metrics of records and switches. Inside the engine a missing interval is null; only the
log layouts render it as ``-``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "-"


def record_latencies(traces: DataFrame) -> DataFrame:
    """Evaluation, transmission, processing and presentation latency, and end to end."""
    c = F.col
    return traces.withColumns({
        "evaluation_latency": c("evaluation_ms") - c("generate_ms"),
        "transmission_latency": c("process_begin_ms") - c("evaluation_ms"),
        "processing_latency": c("process_end_ms") - c("process_begin_ms"),
        "presentation_latency": c("presentation_ms") - c("process_end_ms"),
        "e2e_latency": end_to_end(),
    })


def end_to_end() -> Column:
    """Until presentation, or until the end of processing for records never presented."""
    return F.coalesce("presentation_ms", "process_end_ms") - F.col("generate_ms")


def switch_latencies(switches: DataFrame) -> DataFrame:
    """Network, instantiation, synchronisation and switching time, and the total by mode."""
    c = F.col
    parts = switches.withColumns({
        "network": c("inst_begin_ms") - c("generation_ms"),
        "instantiation": c("inst_end_ms") - c("inst_begin_ms"),
        "synchronisation": c("sync_end_ms") - c("inst_end_ms"),
        "switching": c("switch_end_ms") - c("switch_begin_ms"),
    })
    return parts.withColumn("total", total_switch_time())


def total_switch_time() -> Column:
    """BENCHMARK: until the switch ends. CENTRALIZED: sum of the parts. DISTRIBUTED: until all
    instances are in step. Any other mode is an error."""
    c = F.col
    unknown = F.raise_error(F.concat(F.lit("no total is defined for switches of mode "),
                                     F.coalesce("mode", F.lit("null")))).cast("long")
    return (F.when(c("mode") == "BENCHMARK", c("switch_end_ms") - c("generation_ms"))
            .when(c("mode") == "CENTRALIZED", c("network") + c("instantiation") + c("switching"))
            .when(c("mode") == "DISTRIBUTED", c("sync_end_ms") - c("generation_ms"))
            .otherwise(unknown))


def shown(value: Column) -> Column:
    """Text of a value, ``-`` if missing."""
    return F.coalesce(value.cast("string"), F.lit(MISSING))


# Column titles of the three logs.
RECORD_LOG = ("Type", "Time", "Orig.", "Ret", "Eval.", "Trans.", "Proc.", "Pres.", "E2E")
SWITCH_LOG = ("Type", "Section", "ID", "Issue", "Net.", "Inst.", "Sync.", "Switch", "Total", "From")
MEMORY_LOG = ("Time", "Max", "Total", "Used")


def record_log(measured: DataFrame) -> DataFrame:
    """Nine columns per record; images show their sequence number and no result."""
    image = F.col("section") == "image"
    values = [
        F.col("section"), F.col("generate_ms").cast("string"),
        F.when(image, F.col("sequence_number").cast("string")).otherwise(F.col("original")),
        F.when(image, F.lit(MISSING)).otherwise(F.col("processed")),
        *[shown(F.col(c)) for c in ("evaluation_latency", "transmission_latency",
                                    "processing_latency", "presentation_latency", "e2e_latency")],
    ]
    return measured.select(*[v.alias(t) for v, t in zip(values, RECORD_LOG)])


def switch_log(measured: DataFrame, source: str) -> DataFrame:
    """Ten columns per switch and section; the id is cut at its first dash."""
    values = [
        F.lit("switch"), F.col("section"), F.substring_index("decision_id", "-", 1),
        shown(F.col("generation_ms")),
        *[shown(F.col(c)) for c in ("network", "instantiation", "synchronisation", "switching",
                                    "total")],
        F.lit(source),
    ]
    return (measured.withColumn("section", F.explode("sections"))
            .select(*[v.alias(t) for v, t in zip(values, SWITCH_LOG)]))


def memory_log(samples: DataFrame) -> DataFrame:
    """Four columns per memory sample (``time_ms, max_bytes, total_bytes, used_bytes``)."""
    return samples.select(*[F.col(c).alias(t) for c, t in zip(
        ("time_ms", "max_bytes", "total_bytes", "used_bytes"), MEMORY_LOG)])

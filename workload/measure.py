"""Latency metrics and log layouts."""

import uuid

from pyspark.sql import functions as F

from veilstream.operators import metrics
from veilstream.session import shared_dir
from veilstream.sources.logs import read_log, write_log
from workload.fixtures import ORACLES, millis, query, table


def traces(spark, sf_dir):
    """Events as traces: each stage takes some milliseconds, some stages are missing."""
    e = F.col("event_id")
    ms = millis("ts")
    present = e % 11 != 0
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "image").otherwise("speed").alias("section"),
        ms.alias("generate_ms"), F.when(present, ms + e % 7).alias("evaluation_ms"),
        F.when(present, ms + e % 7 + e % 5).alias("process_begin_ms"),
        (ms + e % 7 + e % 5 + e % 13).alias("process_end_ms"),
        F.when(e % 4 != 0, ms + e % 7 + e % 5 + e % 13 + e % 3).alias("presentation_ms"),
        e.alias("sequence_number"), F.col("value").cast("string").alias("original"),
        F.concat(F.lit("p"), e.cast("string")).alias("processed"))


TRACES = """
WITH t AS (
  SELECT event_id, CASE WHEN event_type = 'view' THEN 'image' ELSE 'speed' END AS section,
         epoch_us(ts)//1000 AS ms, value::VARCHAR AS original, event_id % 11 <> 0 AS evaluated,
         event_id % 4 <> 0 AS presented, event_id % 7 AS a, event_id % 5 AS b, event_id % 13 AS c,
         event_id % 3 AS d FROM events)
"""


@query(TRACES + """
SELECT event_id, coalesce(CASE WHEN evaluated THEN a END, -1) AS evaluation,
       coalesce(CASE WHEN evaluated THEN b END, -1) AS transmission,
       coalesce(CASE WHEN evaluated THEN c END, -1) AS processing,
       coalesce(CASE WHEN presented THEN d END, -1) AS presentation,
       a + b + c + CASE WHEN presented THEN d ELSE 0 END AS e2e FROM t""")
def record_latencies(spark, sf_dir):
    none = F.lit(-1).cast("long")
    measured = metrics.record_latencies(traces(spark, sf_dir))
    return measured.select("event_id", *[
        F.coalesce(f"{name}_latency", none).alias(name)
        for name in ("evaluation", "transmission", "processing", "presentation")],
        F.col("e2e_latency").alias("e2e"))


@query(TRACES + """
SELECT section AS "Type", ms::VARCHAR AS "Time",
       CASE WHEN section = 'image' THEN event_id::VARCHAR ELSE original END AS "Orig.",
       CASE WHEN section = 'image' THEN '-' ELSE 'p' || event_id END AS "Ret",
       CASE WHEN evaluated THEN a::VARCHAR ELSE '-' END AS "Eval.",
       CASE WHEN evaluated THEN b::VARCHAR ELSE '-' END AS "Trans.",
       CASE WHEN evaluated THEN c::VARCHAR ELSE '-' END AS "Proc.",
       CASE WHEN presented THEN d::VARCHAR ELSE '-' END AS "Pres.",
       (a + b + c + CASE WHEN presented THEN d ELSE 0 END)::VARCHAR AS "E2E" FROM t""")
def record_log_rows(spark, sf_dir):
    return metrics.record_log(metrics.record_latencies(traces(spark, sf_dir)))


@query(ORACLES["record_log_rows"])
def logged_records(spark, sf_dir):
    """Written by the log sink in two appended parts and read back."""
    path, rows = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", traces(spark, sf_dir)
    for part in (0, 1):
        write_log(metrics.record_log(metrics.record_latencies(rows.where(F.col("event_id") % 2 == part))), path)
    return read_log(spark, path, list(metrics.RECORD_LOG))


def switches(spark, sf_dir):
    """Orders as switches: the mode and the stage times come from their key."""
    k = F.col("o_orderkey")
    ms = millis("o_orderdate")
    mode = (F.when(k % 3 == 0, "BENCHMARK").when(k % 3 == 1, "CENTRALIZED").otherwise("DISTRIBUTED"))
    return table(spark, sf_dir, "orders").select(
        F.concat(k.cast("string"), F.lit("-x-y")).alias("decision_id"),
        F.array(F.lit("speed"), F.lit("location")).alias("sections"), mode.alias("mode"),
        ms.alias("generation_ms"), (ms + k % 5).alias("inst_begin_ms"),
        (ms + k % 5 + k % 7).alias("inst_end_ms"), (ms + 20).alias("switch_begin_ms"),
        (ms + 20 + k % 11).alias("switch_end_ms"),
        F.when(k % 5 != 0, ms + k % 5 + k % 7 + k % 13).alias("sync_end_ms"))


SWITCHES = """
WITH s AS (
  SELECT o_orderkey AS k, epoch_us(o_orderdate)//1000 AS ms, o_orderkey % 5 AS network,
         o_orderkey % 7 AS inst, o_orderkey % 11 AS switching,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 13 END AS sync FROM orders),
m AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 20 + switching WHEN 1 THEN network + inst + switching
                       ELSE network + inst + sync END AS total FROM s)
"""


@query(SWITCHES + """
SELECT k || '-x-y' AS decision_id, network, inst AS instantiation, coalesce(sync, -1) AS synchronisation,
       switching, coalesce(total, -1) AS total FROM m""")
def switch_latencies(spark, sf_dir):
    none = F.lit(-1).cast("long")
    return metrics.switch_latencies(switches(spark, sf_dir)).select(
        "decision_id", "network", "instantiation",
        F.coalesce("synchronisation", none).alias("synchronisation"), "switching",
        F.coalesce("total", none).alias("total"))


@query(SWITCHES + """
SELECT 'switch' AS "Type", unnest(['speed', 'location']) AS "Section", k::VARCHAR AS "ID",
       ms::VARCHAR AS "Issue", network::VARCHAR AS "Net.", inst::VARCHAR AS "Inst.",
       coalesce(sync::VARCHAR, '-') AS "Sync.", switching::VARCHAR AS "Switch",
       coalesce(total::VARCHAR, '-') AS "Total", 'feedback' AS "From" FROM m""")
def switch_log_rows(spark, sf_dir):
    return metrics.switch_log(metrics.switch_latencies(switches(spark, sf_dir)), "feedback")


@query("""
SELECT epoch_us(l_shipdate)//1000 AS "Time", l_orderkey * 100 AS "Max", l_orderkey * 50 AS "Total",
       l_orderkey * 10 + l_linenumber AS "Used" FROM lineitem""")
def memory_log_rows(spark, sf_dir):
    k = F.col("l_orderkey")
    return metrics.memory_log(table(spark, sf_dir, "lineitem").select(
        millis("l_shipdate").alias("time_ms"), (k * 100).alias("max_bytes"),
        (k * 50).alias("total_bytes"), (k * 10 + F.col("l_linenumber")).alias("used_bytes")))

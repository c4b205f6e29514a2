"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import urllib.parse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build_session(name: str = "veilstream", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE with skew-join handling, Arrow."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Lets small inputs use all cores; inputs of a cluster's size are far above it.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all machines must share. There is no default on a
    cluster; a session on one machine (``local[...]``) that names none uses ``checkpoints`` inside its warehouse."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not named:
            warehouse = urllib.parse.urlparse(spark.conf.get("spark.sql.warehouse.dir")).path
            named = os.path.join(warehouse, "checkpoints")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Write the rows to the shared folder and continue from there (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def if_small(df, weight=None, most: int = 200_000):
    """``df``, to be broadcast if its counted rows, or the sum of ``weight`` over them, are at most ``most``; and whether
    it is. For tables that are written already: Spark does not know the size of those."""
    counted = df.agg(F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return (F.broadcast(df), True) if counted <= most else (df, False)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors of a session that does not have it installed there."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="veilstream-code-")
    spark.sparkContext.addPyFile(shutil.make_archive(
        os.path.join(folder, "veilstream"), "zip", os.path.dirname(root), os.path.basename(root)))

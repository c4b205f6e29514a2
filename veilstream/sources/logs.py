"""Measurement log sinks.

A log is a folder with a folder for each kind of row (its first column), in which ``0-header.csv`` has the titles
and every other file has rows only. So a kind has one header however many tasks wrote to it and however often it was
appended to, and the files of a kind one after the other are one CSV file. Tasks write their rows to a staging
folder and report file names; the commit moves files and writes missing headers, so rows of a failed or repeated
attempt are never seen, and no row passes through the driver. A micro-batch that is written again replaces its files.
"""

from __future__ import annotations

import csv
import io
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from veilstream.operators.context import SECTIONS

FORMAT, HEADER = "veilstream_log", "0-header.csv"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)
    return fs.LocalFileSystem(), path


def _line(values) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(["" if v is None else v for v in values])
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    """``(kind, staged file)`` of a task."""

    files: list


class _Rows:
    """Staged files of tasks, and their commit."""

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite, self.run = path, columns, overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        system, root = _place(self.path)
        context, open_ = TaskContext.get(), {}
        name = f"{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}.csv"
        for row in rows:
            kind = str(row[0])
            if kind not in open_:
                folder = f"{root}/.staging-{self.run}/{kind}"
                system.create_dir(folder, recursive=True)
                open_[kind] = f"{folder}/{name}", system.open_output_stream(f"{folder}/{name}")
            open_[kind][1].write(_line(row).encode())
        for _, stream in open_.values():
            stream.close()
        return Written([(kind, file) for kind, (file, _) in open_.items()])

    def _commit(self, messages, prefix: str) -> None:
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        old = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and "/.staging-" not in f.path]
        for path in old:
            if self.overwrite or prefix.startswith("batch") and path.rsplit("/", 1)[1].startswith(prefix):
                system.delete_file(path)
        for kind, file in files:
            system.create_dir(f"{root}/{kind}", recursive=True)
            header = f"{root}/{kind}/{HEADER}"
            if system.get_file_info(header).type == fs.FileType.NotFound:
                with system.open_output_stream(header) as out:
                    out.write(_line(self.columns).encode())
            system.move(file, f"{root}/{kind}/{prefix}-{file.rsplit('/', 1)[1]}")
        self._forget()

    def _forget(self) -> None:
        system, root = _place(self.path)
        staging = f"{root}/.staging-{self.run}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class _Writer(_Rows, DataSourceWriter):
    def commit(self, messages) -> None:
        self._commit(messages, f"rows-{self.run}")

    def abort(self, messages) -> None:
        self._forget()


class _StreamWriter(_Rows, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        self._commit(messages, f"batch{batchId:012d}")

    def abort(self, messages, batchId: int) -> None:
        self._forget()


class LogSource(DataSource):
    """``format("veilstream_log")`` for writing log layouts, in batch and stream."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options["path"], schema.names, False)


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Append a log layout to the log at ``path``, or write it anew with ``overwrite``."""
    log.sparkSession.dataSource.register(LogSource)
    log.write.format(FORMAT).mode(mode).option("path", path).save()


def log_stream(log: DataFrame, path: str, checkpoint: str):
    """The same for a stream; start the returned writer."""
    log.sparkSession.dataSource.register(LogSource)
    return (log.writeStream.format(FORMAT).option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append"))


def read_log(spark, path: str, columns: list[str], kind: str = "*") -> DataFrame:
    """The rows of a log, or of one kind, as text columns."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("escape", '"').csv(f"{path}/{kind}/[rb]*.csv")
    return rows


def own_section(context: DataFrame) -> DataFrame:
    """The reading that a labelled context row is about: its own section's value and time."""
    label = F.lower("section")
    values = {"speed": F.col("speed.v").cast("string"),
              "location": F.concat_ws(",", F.col("location.x").cast("string"),
                                      F.col("location.y").cast("string")),
              "image": F.col("image.sequence_number").cast("string")}
    value, time = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("long"))
    for section in SECTIONS:
        value = value.when(label == section, values[section])
        time = time.when(label == section, F.col(f"{section}.generate_ms"))
    return (context.select("vehicle_id", "event_id", label.alias("section"),
                           time.alias("generate_ms"), value.alias("original"))
            .where(F.col("generate_ms").isNotNull()))

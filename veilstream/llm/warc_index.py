"""WARC archives of pages and their capture index by external merge.

``write_archives`` writes one WARC 1.1 record per page with Spark's text writer, so the files go to any store
Spark writes to and failed tasks leave nothing behind. Of pages with equal payloads of at least
``least`` bytes the one with the largest page_id keeps its payload, the others become revisit records that
name it. Equality is the SHA-1 of the payload: one row per digest is aggregated and joined back, a plain join
that adaptive execution splits where one payload is very common.

``capture_histories`` reads archives back. Each file gives one run of index entries, sorted in the task by URL
key (host from the top domain down, then path), time and page. Runs are cut at range bounds; the parts of a
range meet in one task and are merged by a tree of losers into one ordered run. Ranges follow each other, so
the whole index is in order: all captures of a URL together, oldest first. The bounds come from a bounded
sample of keys (``SAMPLE``); they only balance the ranges. They are cut by the whole key, so a URL with very
many captures spreads over several ranges.

Defined cases: null html is an empty payload; a null or unparsable URL is its own key; line ends in a URL are
percent-encoded in the archive. A null page_id is written as null and sorts first; in a group of equal
payloads it is a revisit unless all ids are null. Equal rows give equal records. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import math
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BYTES, RECORDS_PER_FILE, RANGE_ROWS, SAMPLE = 1000, 20_000, 8_000, 10_000
EPOCH = 1_704_067_200    # capture time of page 0 where pages have no captured_at: 2024-01-01T00:00:00Z
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ENTRY = pa.schema([("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                   ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
HISTORY = ("url_key string, captured_at string, page_id long, url string, record_type string, payload_bytes long, "
           "payload_digest string, refers_to long, archive string, offset long, range int, place long")


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """One column ``record`` with the text of each record up to its closing empty lines."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html"))
    kept = (rows.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("d"))
            .agg(F.max("page_id").alias("response"), F.lit(True).alias("grouped")))
    rows = rows.join(kept, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least), "left")
    revisit = F.col("grouped").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    time = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    crlf = "\r\n"
    about = F.when(revisit, F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
        F.col("response").cast("string"), F.lit(">\r\n"))).otherwise("")
    body = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(crlf + "WARC-Record-ID: <urn:page:"),
        name, F.lit(">\r\nWARC-Date: "), time, F.lit(crlf + "WARC-Target-URI: "), url, F.lit(crlf + "WARC-Payload-Digest: sha1:"),
        F.col("digest"), F.lit(crlf + "X-Payload-Length: "), F.col("bytes").cast("string"), F.lit(crlf), about,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("body").cast("string"),
        F.lit(crlf + crlf), F.col("body"))
    return rows.withColumn("body", body).select(record.alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, per_file: int = RECORDS_PER_FILE) -> None:
    (records(pages, least).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def read_records(stream):
    """``(offset, headers, block)`` of every record of an opened archive."""
    offset = 0
    while line := stream.readline():
        begin, headers = offset, {}
        offset += len(line)
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {begin}: {line[:40]!r}")
        while (line := stream.readline()) not in (b"\r\n", b""):
            offset += len(line)
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[key.lower()] = value
        block = stream.read(int(headers["content-length"]))
        end = stream.read(4)
        if end != b"\r\n\r\n" or len(block) != int(headers["content-length"]):
            raise ValueError(f"the record at byte {begin} is cut off")
        offset += 2 + len(block) + 4
        yield begin, headers, block


def url_key(url: str) -> str:
    """``com,example,www)/path?query`` in lower case; what is no URL stays as it is."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    return (",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")"
            + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number in ("", "null") else int(number)


def sort_key(entry) -> tuple:
    """Order of the index: URL key, time, page (null first), then place in the archives."""
    return (entry["url_key"], entry["captured_at"], entry["page_id"] is not None, entry["page_id"] or 0, entry["archive"], entry["offset"])


def entry_of(archive: str, offset: int, headers: dict, block: bytes) -> dict:
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = headers["warc-type"] == "revisit"
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{archive}: the record at byte {offset} does not match its digest")
    return {"url_key": url_key(headers["warc-target-uri"]), "captured_at": headers["warc-date"], "page_id": _page(headers["warc-record-id"]),
            "url": headers["warc-target-uri"], "record_type": headers["warc-type"],
            "payload_bytes": int(headers["x-payload-length"]) if revisit else len(payload), "payload_digest": digest,
            "refers_to": _page(headers["warc-refers-to"]) if revisit else None, "archive": archive, "offset": offset}


class LoserTree:
    """Merges sorted iterators: every inner node holds the loser of its match, the winner goes up."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _next(self, i):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            won = self.winner
            yield self.heads[won][2]
            self.heads[won] = self._next(won)
            node = (won + self.k) // 2
            while node:
                if self._beats(self.losers[node], won):
                    self.losers[node], won = won, self.losers[node]
                node //= 2
            self.winner = won


def _bounds(pages: DataFrame) -> list[tuple]:
    total = pages.count()
    ranges, every = math.ceil(total / RANGE_ROWS), max(1, total // SAMPLE)
    name = F.xxhash64("url", "page_id")
    sample = pages.where(F.pmod(name, F.lit(every)) == 0).select(
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("page_id").cast("long").alias("page_id"))
    time = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = sample.distinct().orderBy(F.xxhash64("url", "page_id")).limit(2 * SAMPLE).select("url", "page_id", time.alias("time")).collect()
    keys = sorted((url_key(r.url), r.time) for r in rows)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def capture_histories(spark: SparkSession, path: str, bounds: list[tuple] = ()) -> DataFrame:
    """Index of the archives under ``path``: ``HISTORY`` columns, ordered by ``range`` and ``place``."""
    bounds = list(bounds)

    def runs(batches):
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"]):
                archive = name.rsplit("/", 1)[-1]
                with gzip.open(io.BytesIO(content)) if name.endswith(".gz") else io.BytesIO(content) as stream:
                    run = sorted((entry_of(archive, *r) for r in read_records(stream)), key=sort_key)
                parts: dict[int, list] = {}
                for entry in run:
                    parts.setdefault(bisect.bisect_right(bounds, (entry["url_key"], entry["captured_at"])), []).append(entry)
                for part, entries in parts.items():
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, ENTRY) as writer:
                        writer.write(pa.RecordBatch.from_pylist(entries, ENTRY))
                    yield pd.DataFrame({"range": [part], "run": [sink.getvalue().to_pybytes()]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        sorted_runs = [pa.ipc.open_stream(run).read_all().to_pylist() for run in rows["run"]]
        out = pa.Table.from_pylist(list(LoserTree(sorted_runs, sort_key)), ENTRY).to_pandas(types_mapper=pd.ArrowDtype)
        out["range"], out["place"] = rows["range"].iloc[0], range(len(out))
        return out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return (files.mapInPandas(runs, "range int, run binary").groupBy("range").applyInPandas(merge, HISTORY))


def archive_and_index(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives of ``pages(page_id, url, html)`` to a new folder ``path`` and reads their index back."""
    write_archives(pages, path, least)
    return capture_histories(pages.sparkSession, path, _bounds(pages))

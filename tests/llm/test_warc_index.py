import hashlib
import io
import random
import uuid

import pytest

from veilstream.llm.warc_index import LoserTree, _bounds, archive_and_index, capture_histories, read_records, url_key, write_archives
from veilstream.session import shared_dir

BIG = "<p>" + "payload " * 200 + "</p>"
PAGES = [(1, "http://www.example.com/b?x=1", BIG), (2, "http://example.com/a", BIG), (9, "http://www.example.com/b?x=1", BIG), (4, "http://www.example.com/b?x=1", "small"),
         (5, "http://x.example.org", "small"), (6, None, None), (7, "no url at all", ""), (8, "http://[bad", "é" * 600), (10, "http://e.com/\r\nWARC/1.1", "a\r\n\r\nWARC/1.1\r\n\r\nb"),
         (11, "http://e.com/1", BIG + "é"), (12, "http://e.com/1", BIG + "é"), (12, "http://e.com/1", BIG + "é"), (13, "http://e.com/2", "\r\n\r\n\n")]
SCHEMA = "page_id long, url string, html string"


def brute(pages, least=1000):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        group = [p for p, _, h in pages if (h or "").encode() == data]
        revisit = len(data) >= least and i != max(group)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(group) if revisit else None))
    return sorted(out, key=str)


def folder(spark):
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def test_round_trip(spark, clashing):
    pages = clashing(spark.createDataFrame(PAGES, SCHEMA).repartition(3))
    found = archive_and_index(pages, folder(spark))
    rows = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == brute(PAGES)


def test_histories_are_in_order(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(4)
    path = folder(spark)
    write_archives(pages, path, per_file=7)
    keys = sorted(url_key(r.url) for r in pages.select("url").collect())
    bounds = [(keys[len(keys) // 3], ""), (keys[2 * len(keys) // 3], "2024")]
    rows = capture_histories(spark, path, bounds).orderBy("range", "place").collect()
    assert len({r.range for r in rows}) == 3 and len({r.archive for r in rows}) > 4
    order = [(r.url_key, r.captured_at, r.page_id) for r in rows]
    assert order == sorted(order) and len(order) == pages.count()
    assert _bounds(pages) == []  # a small table is one range


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randrange(30) for _ in range(r.randrange(0, 12))) for _ in range(k)]
    assert list(LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_cut_off_archives_are_refused():
    record = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert len(list(read_records(io.BytesIO(record * 2)))) == 2
    for broken in (record[:-3], record[:-6], b"x" + record):
        with pytest.raises((ValueError, KeyError)):
            list(read_records(io.BytesIO(broken)))


def test_empty_table(spark):
    assert archive_and_index(spark.createDataFrame([], SCHEMA), folder(spark)).collect() == []

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from veilstream.llm import suffix_dedup
from veilstream.llm.suffix_dedup import common_prefixes, drop_repeated_strings, refined


def brute(rows, width):
    data, times = [(i, (t or "").encode()) for i, t in rows], {}
    for _, d in data:
        for s in range(len(d) - width + 1):
            times[d[s:s + width]] = times.get(d[s:s + width], 0) + 1
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - width + 1):
            if times[d[s:s + width]] > 1:
                gone[s:s + width] = b"\1" * width
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.drop("kept").collect()), key=str)


@pytest.mark.parametrize("width,gram,heavy", [(400, 200, 20_000), (60, 20, 20_000), (60, 8, 2), (16, 16, 1)])
def test_equals_brute_force(make_docs, clashing, corpus, width, gram, heavy):
    texts = [t if t is None else t[:20_000] for t in corpus]
    got = drop_repeated_strings(clashing(make_docs(texts)), width, gram, heavy, shard=2_000)
    assert found(got) == brute(list(enumerate(texts)), width)


@pytest.mark.parametrize("seed", range(3))
def test_few_letters(make_docs, seed):
    """Strings that repeat at all distances, also overlapping themselves, and touching passages."""
    r = random.Random(seed)
    texts = ["".join(r.choice("abé" if i % 2 else "ab") for _ in range(r.randrange(0, 300))) for i in range(20)]
    texts += ["ab" * 100, "b" * 90, "b" * 20, texts[0] + texts[1], texts[1] + "x" + texts[0]]
    assert found(drop_repeated_strings(make_docs(texts), 20, 8)) == brute(list(enumerate(texts)), 20)


def test_repeated_rows_and_ids(spark):
    """Every row is a document: equal rows repeat each other, other texts under one id do not suffer."""
    r = random.Random(1)
    a, b = prose(r, 120), prose(r, 120)
    rows = [(7, a), (7, b), (None, b + "."), (None, prose(r, 90)), (3, a), (3, a), (4, "short"), (4, "short")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert found(drop_repeated_strings(df)) == brute(rows, 400)


def test_one_anchor_in_many_documents(make_docs, monkeypatch):
    """A shared passage in ever other surroundings is spread over shards; its strings still meet."""
    r = random.Random(9)
    passage = prose(r, 40)
    texts = [prose(r, 8) + passage + prose(r, 8) for _ in range(60)] + [f"{i} {passage}" for i in range(20)]
    monkeypatch.setattr(suffix_dedup, "MERGED", 50)
    sizes = []
    pack = suffix_dedup._pack
    monkeypatch.setattr(suffix_dedup, "_pack", lambda shards, *rest: sizes.append(shards) or pack(shards, *rest))
    got = found(drop_repeated_strings(make_docs(texts), 200, 100, heavy=5, shard=3_000))
    assert got == brute(list(enumerate(texts)), 200) and sizes[0] > 4


def test_passages_of_over_fifty_words(make_docs):
    """Bytes decide, not words: of repeated passages of over 50 words those of 400 bytes go, and `n_removed` says so."""
    r = random.Random(12)
    short, long = " ".join(["wordy"] + [r.choice("abcdefgh") + r.choice("xyz") * 4 for _ in range(55)]), prose(r, 80)
    assert len(short.split()) > 50 and len(short.encode()) < 380 and 400 <= len(long.encode())
    around = lambda passage: f"{prose(r, 90)} <{passage}> {prose(r, 90)}"
    texts = [around(short), around(short), around(long), around(long), around(prose(r, 70)), around(prose(r, 70))]
    got = found(drop_repeated_strings(make_docs(texts)))
    assert got == brute(list(enumerate(texts)), 400)
    assert [x[2] >= len(long.encode()) for x in got] == [False, False, True, True, False, False]
    assert [x[2] == 0 for x in got] == [True, True, False, False, True, True]


def test_places_of_a_frequent_anchor_stay_apart(spark, monkeypatch):
    """No task gets all places of one anchor; rare ones are found by a shuffle, those that start once are left out."""
    monkeypatch.setattr(suffix_dedup, "OFTEN", 50)
    anchors = spark.range(0, 7_000, 1, 8).selectExpr("unhex(hex(id)) key", "case when id % 4 = 0 then -1 else id % 4000 end hash", "id place")
    counts = anchors.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = suffix_dedup._marked(anchors, counts, 7_000)
    times = dict(map(tuple, counts.collect()))
    assert times[-1] == 1_750 and 3_001 not in times
    expected = [(r.place, times[r.hash]) for r in anchors.orderBy("place").collect() if r.hash in times]
    assert sorted(map(tuple, marked.select("place", "n").collect())) == expected
    tasks = [r["count"] for r in marked.where("n > 2").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 8 and max(tasks) < 250


def test_long_text_in_parts(make_docs, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    shared = prose(r, 60)
    texts = [prose(r, 300) + shared + prose(r, 300), shared + prose(r, 20), prose(r, 500)]
    assert found(drop_repeated_strings(make_docs(texts), 100, 50)) == brute(list(enumerate(texts)), 100)


def test_kept_bytes(make_docs):
    shared = "0123456789" * 3
    rows = drop_repeated_strings(make_docs([f"début{shared}fin", f"x{shared}y", "z"]), 30, 10).orderBy("doc_id").collect()
    assert [bytes(r.kept).decode() for r in rows] == ["débutfin", "xy", "z"] and [r.n_spans for r in rows] == [1, 1, 0]


def test_suffix_array_and_common_prefixes():
    r = random.Random(6)
    for depth in (1, 8, 9, 40, 400):
        data = "".join(r.choice("ab") for _ in range(500)).encode() + b"ab" * 60
        order, rank = refined(np.frombuffer(data, np.uint8), depth)
        head = [data[i:i + depth] for i in order]
        assert head == sorted(head)
        assert all((rank[order[k]] == rank[order[k - 1]]) == (head[k] == head[k - 1]) for k in range(1, len(head)))
        at = np.sort(order[1:])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = order[place[at] - 1]
        expected = [next((k for k in range(depth) if data[i + k:i + k + 1] != data[j + k:j + k + 1] or i + k >= len(data) or j + k >= len(data)), depth)
                    for i, j in zip(at.tolist(), before.tolist())]
        got = common_prefixes(np.frombuffer(data, np.uint8), at, before, depth)
        ends = np.minimum(len(data) - at, len(data) - before)
        assert np.minimum(got, ends).tolist() == np.minimum(expected, ends).tolist()


def test_widths_are_checked(make_docs):
    with pytest.raises(ValueError):
        drop_repeated_strings(make_docs(["x"]), 10, 20)


def test_empty_table(make_docs):
    empty = drop_repeated_strings(make_docs([]).where(F.lit(False)))
    assert empty.collect() == []

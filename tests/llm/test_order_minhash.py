import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from veilstream.llm.order_minhash import edited_fingerprints, fingerprint, fingerprints, likeness, occurrence_numbered


def brute_edits(texts):
    order = sorted(range(len(texts)), reverse=True)
    out = {}
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        out[i] = (len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest())
    return out


def test_edited_texts(make_docs, clashing, corpus):
    rows = edited_fingerprints(clashing(make_docs(corpus, parts=4))).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == brute_edits(corpus)
    by_id = {r.doc_id: r for r in rows}
    order = sorted(by_id, reverse=True)
    for k, i in enumerate(order):
        after = by_id[order[(k + 1) % len(order)]]
        same = sum(by_id[i].fingerprint[p:p + 16] == after.fingerprint[p:p + 16] for p in range(0, 256, 16)) / 16
        assert by_id[i].near_next == same and 0 <= by_id[i].near_edited <= 1
        assert len(by_id[i].fingerprint) == 256
    by_text = {}
    for i, t in enumerate(corpus):
        assert by_text.setdefault(t or "", by_id[i].fingerprint) == by_id[i].fingerprint


def test_occurrences(spark):
    df = spark.createDataFrame([("a b a b a b c",), ("",), ("a",), ("x y",)], "t string")
    rows = [r.k for r in df.select(occurrence_numbered(F.col("t")).alias("k")).collect()]
    assert [len(r) for r in rows] == [6, 0, 1, 1]
    assert len({x["v"] for x in rows[0]}) == 6 and sorted(x["i"] for x in rows[0]) == list(range(6))


def test_order_counts(spark):
    """Of two texts with the same k-mers the one that keeps their order is nearer."""
    r = random.Random(1)
    text = prose(r, 300).split()
    slightly = text[:150] + ["new"] + text[150:]
    parts = [text[i:i + 10] for i in range(0, 300, 10)]
    r.shuffle(parts)
    shuffled = [w for p in parts for w in p]
    df = spark.createDataFrame([(" ".join(text), " ".join(slightly), " ".join(shuffled), prose(r, 300))], "a string, b string, c string, d string")
    row = df.select(*(likeness(fingerprint(F.col("a")), fingerprint(F.col(c))).alias(c) for c in "abcd")).first()
    assert row.a == 1 and row.b >= 0.75 and row.c < row.b and row.d < 0.2


def test_no_python(make_docs):
    df = edited_fingerprints(make_docs(["a b", "c d"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("texts", [[], [None], ["", ""], ["alone here"]])
def test_tiny_tables(make_docs, texts):
    rows = edited_fingerprints(make_docs(texts)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == brute_edits(texts)
    assert len(fingerprints(make_docs(texts)).collect()) == len(texts)


def test_equal_and_null_ids(spark):
    df = spark.createDataFrame([(5, "b b"), (5, "a a"), (None, "n n"), (1, "c c")], "doc_id long, text string")
    found = sorted((r.edited_sha256 for r in edited_fingerprints(df).collect()))
    after = ["a ", "b ", "c ", "n "]  # a a, b b (id 5 by text), c c (1), n n (null), and round again
    texts = {"a a": "b b", "b b": "c c", "c c": "n n", "n n": "a a"}
    assert len(after) == 4 and found == sorted(hashlib.sha256((t[:2] + n[:1]).encode()).hexdigest() for t, n in texts.items())

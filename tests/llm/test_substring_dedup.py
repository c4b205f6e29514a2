import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from veilstream.llm import substring_dedup
from veilstream.llm.substring_dedup import drop_repeated_passages, heavy_cells
from veilstream.llm.words import SPACE, Words

PACKED = "bucket int, doc binary, row binary, start binary, windows binary, size long, text binary"


def brute(rows, window=20):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        seen, gone = set(), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if first[key] < i or key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_equals_brute_force(make_docs, clashing, corpus):
    found = drop_repeated_passages(clashing(make_docs(corpus))).drop("kept")
    assert sorted(map(tuple, found.collect())) == brute(list(enumerate(corpus)))


@pytest.mark.parametrize("seed", range(3))
def test_few_words(make_docs, seed):
    """Texts of very few different words repeat at all distances, also inside a document."""
    r = random.Random(seed)
    texts = [" ".join(r.choice("ab") for _ in range(r.randrange(0, 400))) for _ in range(12)] + [prose(r, 90)] * 3
    found = drop_repeated_passages(make_docs(texts), buckets=5).drop("kept")
    assert sorted(map(tuple, found.collect())) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("seed", range(2))
def test_rows_that_share_an_id(spark, make_docs, seed):
    """Every row is a document: it loses nothing for what another row of its id has, and nothing in its place."""
    text, other = (" ".join(f"{c}{i}" for i in range(50)) for c in "wx")
    rows = [(1, text), (7, text), (7, other[:200]), (7, other), (7, text + " " + text), (3, other[:90] + " " + text), (7, text), (9, other + " x " + other)]
    r = random.Random(seed)
    rows += [(i % 4, " ".join(r.choice("ab") for _ in range(r.randrange(0, 90)))) for i in range(12)]
    r.shuffle(rows)
    found = drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), heavy=[100, 1_000_000][seed]).drop("kept")
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_empty_table(make_docs):
    assert drop_repeated_passages(make_docs([])).collect() == []


def _footers(n):
    """One sequence in ever different surroundings, and some texts twice."""
    r = random.Random(8)
    texts = [prose(r, 25) + f" v{i} all rights reserved w{i} " + prose(r, 25) for i in range(n)]
    return texts + texts[:3] + ["same " * 400, "same " * 90]


@pytest.mark.parametrize("heavy", [1, 150])
def test_heavy_minimisers_equal_brute_force(make_docs, corpus, heavy):
    texts = corpus + _footers(60)
    found = drop_repeated_passages(make_docs(texts), buckets=7, heavy=heavy).drop("kept")
    assert sorted(map(tuple, found.collect())) == brute(list(enumerate(texts)))


def test_no_bucket_holds_a_heavy_minimiser(make_docs):
    """Different windows around one sequence of the smallest hash are spread over the buckets."""
    data = np.frombuffer(" ".join(f"q{i}" for i in range(9000)).encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), SPACE, False)
    hot = int(words.grams(3)[0][:8998].argmin())
    middle = f"q{hot} q{hot + 1} q{hot + 2}"
    texts = [" ".join(f"a{i}-{j}" for j in range(17)) + f" {middle} " + " ".join(f"b{i}-{j}" for j in range(17)) for i in range(300)]
    rows = make_docs(texts).select("doc_id", "text", F.xxhash64("text").alias("row"))
    cells, heavy, windows = heavy_cells(rows, 20, 3, 1000)
    assert len(heavy) and windows == 300 * 18

    def largest(cut):
        packed = rows.mapInArrow(substring_dedup._pack(16, 20, 3, cells, cut), PACKED)
        sizes = [sum(np.frombuffer(r.windows, np.int64).sum() for r in packed.where(F.col("bucket") == b).collect()) for b in range(16)]
        assert sum(sizes) == windows
        return max(sizes)
    assert largest(heavy[:0]) > windows / 2 and largest(heavy) < windows / 8


def test_buckets_grow_with_windows(make_docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", 50)
    seen, pack = [], substring_dedup._pack
    monkeypatch.setattr(substring_dedup, "_pack", lambda buckets, *rest: seen.append(buckets) or pack(buckets, *rest))
    drop_repeated_passages(make_docs([" ".join(f"w{j}" for j in range(5019))]))
    assert seen == [max(100, 4 * int(make_docs([]).sparkSession.conf.get("spark.sql.shuffle.partitions")))]

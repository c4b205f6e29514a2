import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilstream.llm.quality_trees import NAMES, Trees, _bound, drop_low_quality, grow, held_out, quality_scores, statistics_of, train


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) >= 0.97


def test_held_out_labels_are_not_learned_from(spark, make_docs, corpus):
    docs = make_docs(corpus)
    held = [i for i in range(len(corpus)) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = [(i, i % 2) for i in range(len(corpus))]
    swapped = [(i, 1 - q if i in held else q) for i, q in labels]
    a, b = (train(docs, spark.createDataFrame(x, "doc_id long, quality int"), rounds=5) for x in (labels, swapped))
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.cut, b.cut)


@pytest.mark.parametrize("wanted", [0, 1, 7, 60, 199, 200, 500])
@pytest.mark.parametrize("hashes", ["all", "close", "equal"])
def test_bound_of_the_sample(spark, wanted, hashes):
    r = np.random.default_rng(wanted)
    h = {"all": r.integers(-2 ** 63, 2 ** 63 - 1, 200), "close": -5 + r.integers(0, 2 ** 20, 200), "equal": np.full(200, 2 ** 63 - 1)}[hashes]
    bound = _bound(spark.createDataFrame([(int(v),) for v in h], "h long"), wanted)
    under = 200 if bound is None else int((h <= bound).sum())
    assert (bound is None) == (wanted >= 200) and under >= min(wanted, 200)
    assert hashes == "equal" or under <= max(2 * wanted, 1)


def test_the_sample_is_that_of_the_smallest_hashes(spark, make_docs, corpus):
    docs, labels = make_docs(corpus), spark.createDataFrame([(i % 40, i % 2) for i in range(80)], "doc_id long, quality int")
    some, known = train(docs, labels, sample=9, rounds=4), labels.where(~held_out()).join(docs.select("doc_id"), "doc_id")
    first = [r.doc_id for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(9).collect()]
    inside = train(docs, labels.where(F.col("doc_id").isin(first)), sample=9, rounds=4)
    assert np.array_equal(some.cut, inside.cut) and np.array_equal(some.leaf, inside.leaf)


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = grow(x[:400], y[:400], rounds=60)
    assert np.mean((trees.score(x[400:]) >= 0.5) == y[400:]) > 0.9
    one = Trees(0.0, np.array([[1, 0, 0]]), np.array([[0.0, 1.0, np.inf]]), np.array([[1.0, 2.0, 3.0, 4.0]]))
    assert np.allclose(np.log(one.score(np.array([[2.0, -1.0], [0.0, -1.0], [9.0, 5.0]])) ** -1 - 1), [-2, -1, -3])


def test_statistics(corpus):
    x = statistics_of(pa.array(corpus))
    assert x.shape == (len(corpus), len(NAMES)) and np.isfinite(x).all()
    alone = np.concatenate([statistics_of(pa.array([t], pa.string())) for t in corpus])
    assert np.allclose(x, alone)  # a document's statistics do not depend on its neighbours
    at = {n: i for i, n in enumerate(NAMES)}
    text = statistics_of(pa.array(["one two two three.\nAB one\nAB one\n"]))[0]
    assert np.isclose(text[at["words"]], np.log1p(8)) and np.isclose(text[at["distinct"]], 4 / 8)
    assert np.isclose(text[at["repeated_lines"]], 1 / 3) and np.isclose(text[at["capital_words"]], 2 / 8)


@pytest.mark.parametrize("labels", [[], [(0, 1), (2, 1)], [(0, None), (1, 0)], [(3, 0), (3, 1), (4, 1), (99, 0)]])
def test_few_labels(spark, make_docs, clashing, corpus, labels):
    docs, known = clashing(make_docs(corpus)), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality_scores(docs, known).collect()
    assert len(rows) == len(corpus) and all(0 < r.score < 1 for r in rows)
    kept = drop_low_quality(docs, known)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.predicted)


def test_empty_table(spark, make_docs):
    assert quality_scores(make_docs([]), spark.createDataFrame([], "doc_id long, quality int")).collect() == []

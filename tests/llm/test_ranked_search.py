import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import SCHEMA, prose
from veilstream.llm import ranked_search as rs
from veilstream.llm.ranked_search import Vocabulary, ranked_search
from veilstream.llm.words import SYMBOL, Words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, top=10):
    bags = [(i, terms(t)) for i, t in rows]
    n_docs, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    wanted = {}
    for name, text in items:
        if text is not None:
            wanted.setdefault(name, set()).update(terms(text))
    out = []
    for name, own in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in bags) + 1))) for t in own}
        found = []
        for doc, w in bags:
            if w:
                m = 10 + 90 * len(w) * n_docs // total
                score = sum(weight[t] * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in own)
                if score > 0:
                    found.append((-score, doc is None, doc or 0, doc))
        out += [(name, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "Alphaa betab, gammac"), (2, "épsilond"), (3, ""), (4, None), (5, "not-there"), (None, "kappae"), (None, "la one"), (1, "zeta"),
         (7, "same same"), (8, "ONE two four words"), (9, " ".join(f"w{i}" for i in range(400)))]


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("chars", [10, 1_000_000])
def test_equals_brute_force(spark, make_docs, clashing, corpus, chars):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = found(ranked_search(clashing(make_docs(corpus)), clashing(items), block_chars=chars))
    assert got == brute(list(enumerate(corpus)), ITEMS)


@pytest.mark.parametrize("seed", range(2))
def test_classes_of_many_members(spark, make_docs, monkeypatch, seed):
    """Equal bags of other words, of other order and of other texts of the same length; ids missing or shared."""
    r = random.Random(seed)
    texts = [f"x{i} beta alpha" for i in range(40)] + [f"alpha y{i} beta" for i in range(40)] + [prose(r, 30) for _ in range(40)] + ["beta beta alpha"] * 25
    rows = [(None if i % 9 == 0 else i // 2, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    items = [(1, "alpha"), (2, "alpha beta"), (3, "betaa Alphab la")]
    monkeypatch.setattr(rs, "CLASSES", 3)
    monkeypatch.setattr(rs, "FLUSH", 500)
    got = found(ranked_search(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(items, "item_id int, text string")))
    assert got == brute([row[:2] for row in rows], items)


def test_a_class_is_scored_once(make_docs):
    """Documents that differ only in words outside the items are one row, with their ten smallest ids."""
    vocabulary = Vocabulary({1: ["alpha beta"]})
    batch = pa.RecordBatch.from_arrays([pa.array(range(30, 0, -1)), pa.array([f"alpha z{i}" for i in range(30)])], ["doc_id", "text"])
    rows = [r for b in rs._vectors(vocabulary, 30, 60, 10)(iter([batch])) for r in b.to_pylist()]
    assert len(rows) == 1 and np.frombuffer(rows[0]["ids"], np.int64).tolist() == list(range(1, 11))


def test_clash_of_hashes_makes_no_class(monkeypatch):
    """Vectors of one hash are told apart, words of one hash by their bytes."""
    vocabulary = Vocabulary({1: ["alpha"], 2: ["beta"]})
    weights = np.array([1000, 1000])
    kinds = [np.array([t], np.uint16).tobytes() for t in (0, 1)]
    batch = pa.RecordBatch.from_pylist([{"hash": 5, "m": 100, "terms": k, "freqs": b"\x01", "ids": np.array([i]).tobytes(), "nameless": 0}
                                        for i, k in enumerate(kinds)], rs.VECTORS)
    rows = [r for b in rs._best(vocabulary, weights, 10, pa.int64())(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["item"], r["doc_id"]) for r in rows) == sorted((int(vocabulary.terms.index(t)), i) for i in (0, 1) for t in vocabulary.terms if t[0] == i)
    data = np.frombuffer(b"alpha betas", np.uint8)
    words = Words(data, np.array([0, len(data)]), SYMBOL, True)
    words.h[1] = vocabulary.h[vocabulary.terms[1][0]]
    assert vocabulary.find(words)[0].tolist() == [0]


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(ranked_search(make_docs([]), items)) == []
    assert found(ranked_search(make_docs([None, "", " - "]), items)) == []
    assert found(ranked_search(make_docs(["alpha"]), items.limit(0))) == []

import re
from collections import Counter

import pytest

from veilstream.llm.mixing import mix_report, mixed


def targets(sizes, weights=(5, 2, 1), most=3):
    """By the wording: share by weight, stop at the limit, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed.update({s: most * sizes[s] for s in above})


def test_targets_and_words_taken(make_docs, clashing, corpus):
    docs = clashing(make_docs(corpus))
    rows = mix_report(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(corpus)}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == size and len(rows) == len(corpus)
    by_source = Counter()
    for i, n in size.items():
        by_source[source[i]] += n
    want = targets(by_source)
    taken = Counter()
    for r in rows:
        assert r.source_size == by_source[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= max([size[i] for i in size if source[i] == s]) / 2 + 1e-6
    again = mix_report(docs.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_shards_get_their_share_of_blocks(make_docs):
    docs = make_docs([f"word{i} " * 3 for i in range(600)])
    rows = mixed(docs, shards=4).collect()
    report = {r.doc_id: r.taken for r in mix_report(docs, shards=4).collect()}
    assert Counter(r.doc_id for r in rows) == Counter({i: t // 3 for i, t in report.items() if t})
    assert len({(r.doc_id, r["__drawn"]["pass"]) for r in rows}) == len(rows)
    blocks = Counter(r["__drawn"]["shard"] for r in rows)
    assert set(blocks) == {0, 1, 2, 3} and max(blocks.values()) < 2 * min(blocks.values())


def test_odd_tables(spark, make_docs):
    assert mix_report(make_docs([])).collect() == [] and mixed(make_docs([])).collect() == []
    assert [(r["size"], r.taken) for r in mix_report(make_docs([None, "", " "])).collect()] == [(0, 0)] * 3
    twice = make_docs(["a b c"] * 5).withColumn("doc_id", __import__("pyspark").sql.functions.lit(1).cast("long"))
    assert sum(r.taken for r in mix_report(twice).collect()) == pytest.approx(15, abs=3)

import re

import pytest

from veilstream.llm import ngram_join
from veilstream.llm.components import components
from veilstream.llm.ngram_join import drop_near_duplicates, ngram_jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        low[find(a)] = min(low.get(find(a), i), i)
    return sorted((i, len(s), low[find(a)]) for a, (i, s) in enumerate(sets))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1)] + [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(101, 130)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 7, 8: 7, 7: 7, **{i: 20 for i in range(20, 61)}, **{i: 100 for i in range(100, 130)}}


def test_equals_brute_force(make_docs, clashing, corpus):
    found = ngram_jaccard_join(clashing(make_docs(corpus)), parts=3)
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == brute(list(enumerate(corpus)))


def test_links_across_components(make_docs):
    """A chain of texts in which only neighbours link, and a group that its smallest set does not reach."""
    words = [f"w{i}" for i in range(140)]
    chain = [" ".join(words[6 * i:6 * i + 60]) for i in range(12)]
    ring = [" ".join(f"x{j}" if j != 9 * i + 2 else f"y{i}" for j in range(100)) for i in range(10)]
    twice = [" ".join(f"x{j}" if j not in (9 * i + 2, 9 * i + 7, 9 * i + 4) else f"z{i}-{j}" for j in range(100)) for i in range(10)]
    texts = chain + twice + ring
    found = ngram_jaccard_join(make_docs(texts), parts=3)
    assert sorted(map(tuple, found.collect())) == brute(list(enumerate(texts)))


def test_large_group_of_copies(make_docs):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words)] * 300 + [" ".join([*words[:i], "new", *words[i + 1:]]) for i in range(150)] + ["alone " * 9]
    found = ngram_jaccard_join(make_docs(texts, parts=7))
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, 0) for i in range(450)} | {(450, 450)}


@pytest.mark.parametrize("texts", [[], [None], ["", " "], ["a b c d e f"]])
def test_tiny_tables(make_docs, texts):
    found = ngram_jaccard_join(make_docs(texts))
    assert sorted(map(tuple, found.collect())) == brute(list(enumerate(texts)))


def test_keeps_one_of_each_group(spark, make_docs, clashing, corpus):
    docs = clashing(make_docs(corpus))
    docs = docs.union(docs.where("doc_id in (0, 3, 5)"))  # repeated rows
    kept = drop_near_duplicates(docs, parts=3)
    assert kept.columns == docs.columns
    want = sorted(i for i, n, c in brute(list(enumerate(corpus))) if i == c or not n)
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert all(r.text == corpus[r.doc_id] and r.size == 7 for r in kept.collect())


def test_candidates_in_chunks(spark, monkeypatch):
    """Candidates are dealt to chunks, and only sets that a candidate names are cut into segments."""
    monkeypatch.setattr(ngram_join, "CHUNK", 12)
    monkeypatch.setattr(ngram_join, "COUNTED", 400)
    names, cut = [], ngram_join.cut_lineage
    monkeypatch.setattr(ngram_join, "cut_lineage", lambda df: names.append(cut(df)) or names[-1])
    sets = spark.createDataFrame([(i, [j for j in range(100) if j % 40 != i] if i < 40 else [1000 + i]) for i in range(400)], "cls long, h array<long>")

    def packed(*v):
        return bytearray(b"".join(x.to_bytes(8, "little") for x in v))
    pairs = spark.createDataFrame([(y, len([j for j in range(100) if j % 40 != y]), 0, packed(y + 1, y + 2), packed(
        *(len([j for j in range(100) if j % 40 != y + d]) for d in (1, 2))), packed(y + 1, y + 2)) for y in range(30)],
        "y long, n long, part int, cs binary, ns binary, tags binary")
    found = {(r.a, r.b) for r in ngram_join._counted(sets, pairs, 75).collect()}
    assert found == {(y, y + d) for y in range(30) for d in (1, 2)}
    named = {}
    for r in names[0].collect():
        named.setdefault(r.chunk, set()).add(r.cls)
    assert len(named) > 3 and set().union(*named.values()) == set(range(32)) and max(map(len, named.values())) < 32
    assert {r.chunk: r.fragments for r in names[1].collect()} == {
        c: 1 + sum(len([j for j in range(100) if j % 40 != i]) for i in own) // 400 for c, own in named.items()}


def test_chunks_equal_brute_force(make_docs, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    monkeypatch.setattr(ngram_join, "COUNTED", 100)
    monkeypatch.setattr(ngram_join, "ROW", 2)
    found = ngram_join.ngram_jaccard_join(make_docs(corpus), parts=3)
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == brute(list(enumerate(corpus)))


def test_fragments_follow_the_shingles(make_docs, corpus, monkeypatch):
    """What a task holds does not grow with the table, however few shuffle partitions the session has."""
    made, cut = [], ngram_join._segments
    monkeypatch.setattr(ngram_join, "FRAGMENT", 50)
    monkeypatch.setattr(ngram_join, "HELD", 3)
    monkeypatch.setattr(ngram_join, "_segments", lambda *a: made.append(cut(*a)) or made[-1])
    found = ngram_join.ngram_jaccard_join(make_docs(corpus))
    want = brute(list(enumerate(corpus)))
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == want
    fragments = {r.fragment for r in made[0].select("fragment").collect()}
    assert len(fragments) > sum(n for _, n, _ in want) // 100 > 4


def test_sums_follow_the_fragments(spark, monkeypatch):
    """A chunk of many fragments is summed in as many groups, and sets are cut a bounded number at a time."""
    monkeypatch.setattr(ngram_join, "COUNTED", 20)
    monkeypatch.setattr(ngram_join, "SUMS", 1)
    sets = [(i, [j for j in range(100) if j % 20 != i]) for i in range(12)]

    def packed(*v):
        return bytearray(b"".join(x.to_bytes(8, "little") for x in v))
    pairs = spark.createDataFrame([(y, 95, 0, packed(y + 1, y + 2), packed(95, 95), packed(y + 1, y + 2)) for y in range(10)],
                                  "y long, n long, part int, cs binary, ns binary, tags binary")
    found = ngram_join._counted(spark.createDataFrame(sets, "cls long, h array<long>"), pairs, 75)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "greatest(1, fragments" in plan
    assert {(r.a, r.b) for r in found.collect()} == {(y, y + d) for y in range(10) for d in (1, 2)}

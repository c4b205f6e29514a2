import hashlib
import re

import pytest

from veilstream.llm.decontaminate import contamination, drop_contaminated

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(texts, items):
    strings = {}
    for name, text in items:
        w = words(text)
        if w:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                strings.setdefault(tuple(w[i:i + n]), set()).add("" if name is None else str(name))
    out = []
    for i, text in enumerate(texts):
        w, hit, names = words(text), set(), set()
        for n in {len(s) for s in strings}:
            for a in range(len(w) - n + 1):
                if (found := strings.get(tuple(w[a:a + n]))):
                    hit |= set(range(a, a + n))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def bench(spark, corpus):
    items = [(i, t) for i, t in enumerate([*corpus[:4], corpus[-7][:200], "one", "four WORDS, are/here", "", None, "   ", "same same same same", "épsilonb", corpus[2]])]
    items += [(None, "beta"), (3, "kappaz"), (10, corpus[5])]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_chars", [4_000_000, 300])
def test_equals_brute_force(make_docs, clashing, corpus, bench, block_chars):
    found = contamination(clashing(make_docs(corpus)), bench[1], block_chars=block_chars)
    assert sorted(map(tuple, found.collect())) == brute(corpus, bench[0])


def test_filter_keeps_clean_rows_whole(make_docs, clashing, corpus, bench):
    docs = clashing(make_docs(corpus))
    kept = drop_contaminated(docs, bench[1], block_chars=500)
    assert kept.columns == docs.columns
    clean = {r[0] for r in brute(corpus, bench[0]) if not r[5]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean)


def test_empty_tables(spark, make_docs, bench):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(make_docs([]), bench[1]).collect() == []
    assert [r.contaminated for r in contamination(make_docs(["a b", None]), none).collect()] == [False, False]

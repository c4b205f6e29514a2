import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA
from veilstream.llm import spelling
from veilstream.llm.spelling import crc32_from, near_pairs, neighbours, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, divisor=199):
    counts = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % divisor == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute(rows, divisor=199):
    counts, form, out = brute_words(rows, divisor), {}, {}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts.get(form.get(w)))
    return sorted((w, *x) for w, x in out.items())


def variants(r, n):
    """Texts of few stems with changed, missing and further letters, most of them rare."""
    stems = ["receive", "Éclairé", "beginning", "ÿÀ×÷ßæþ", "commit", "abcdefghijklmnopqrst", "aaaaaa", "internationally"]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(r.randrange(0, 40)):
            word = r.choice(stems)
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(word))
                word = r.choice([word[:at] + r.choice("xé") + word[at:], word[:at] + word[at + 1:], word[:at] + r.choice("xé") + word[at + 1:]])
            words.append(word)
        texts.append(r.choice([" ", "1", "-", "Ā", "\n", "…"]).join(words))
    return texts


@pytest.mark.parametrize("seed,crowded", [(0, 20_000), (1, 3), (2, 1)])
def test_equals_brute_force(spark, clashing, seed, crowded):
    r = random.Random(seed)
    texts = variants(r, 120) + [None, "", "kurz", "commit " * 400, "aaaaaaa " * 50 + "aaaaaaaa " * 9, "Q" * 3000 + " " + ("q" * 2999 + " ") * 6 + ("Q" * 3000 + " ") * 40]
    rows = [(None if i % 11 == 0 else i // 2, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = spelling_variants(clashing(spark.createDataFrame(rows, SCHEMA).repartition(3)), divisor=7, crowded=crowded)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute([row[:2] for row in rows], 7)


def test_chain_of_forms(spark):
    """A rare word whose form has a form itself, over several steps."""
    words = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "abcdefghi": 625, "abcdefghij": 3125}
    texts = [" ".join([w] * n) for w, n in words.items()]
    rows = {r.word: r for r in spelling_variants(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), divisor=1 << 31).collect()}
    assert {r.root for r in rows.values()} == {"abcdefghij"} and rows["abcdef"].form == "abcdefg" and rows["abcdefghij"].form is None


def test_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 20)
    texts = variants(random.Random(5), 60)
    got = spelling_variants(spark.createDataFrame(enumerate(texts), "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(list(enumerate(texts)))


def test_checksums():
    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(3000))
    start = np.array([r.randrange(2900) for _ in range(200)])
    length = np.array([r.randrange(0, 100) for _ in range(200)])
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in range(200)], np.uint32)
    got = crc32_from(heads, np.frombuffer(data, np.uint8), start, length)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + data[s:s + n]) for i, (s, n) in enumerate(zip(start.tolist(), length.tolist()))]


def test_scan_of_random_lists():
    r = random.Random(1)
    for _ in range(100):
        groups = [sorted({"".join(r.choice("abé") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 25))}) for _ in range(r.randrange(1, 5))]
        texts, group = [w for g in groups for w in g], np.array([i for i, g in enumerate(groups) for _ in g])
        i, j = near_pairs(spelling._matrix(texts, 7), np.array([len(t) for t in texts]), group)
        expected = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if group[a] == group[b] and one_edit(texts[a], texts[b])]
        assert sorted(zip(i.tolist(), j.tolist())) == expected


def test_lists_are_dealt_again(spark):
    """One half that all words share: no list of the second dealing holds a third of them."""
    r = random.Random(2)
    words = sorted({"shared" + "".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(600)})
    df = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    lists = spelling._dealt_again(spelling._lists(df), 100).groupBy("side", "size", "head").count()
    assert lists.agg({"count": "max"}).first()[0] < len(words) / 3
    got = {row.word: row.n_near for row in neighbours(df, 100).collect()}
    assert got == {w: k for w in words if (k := sum(one_edit(w, v) for v in words))}


def test_empty_table(make_docs):
    assert spelling_variants(make_docs([])).collect() == []

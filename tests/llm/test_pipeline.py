"""Every stage of the pipeline on the documents that the stage before kept."""
import random
from collections import Counter

import corpus_pipeline as pipeline
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_spans import brute_pii


def fixture(spark, folder):
    r = random.Random(8)
    item = prose(r, 40)
    good = [prose(r, r.randrange(60, 120)) for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in prose(r, r.randrange(40, 90)).split()) for _ in range(30)]
    copies = [t.replace("a ", "b ", 1) for t in good[:8]] + good[8:12]
    leaked = [prose(r, 60) + " " + item for _ in range(4)]
    private = [prose(r, 50) + f" mail me at user{i}@mail.example.org or +49 30 12345{i:02d} now" for i in range(6)]
    texts = good + junk + copies + leaked + private + ["", None]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if 60 <= i < 90 else 1, 0) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_stages(spark, tmp_path):
    texts = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        kept[name] = sorted(r.doc_id for r in rows)
        if name != "mix":
            assert docs.columns == columns
        if name == "quality":
            assert set(kept[name]) >= set(range(60)) | set(range(90, 112)) and not set(kept[name]) & set(range(60, 90))
        if name == "near_duplicates":
            assert kept[name] == sorted(i for i, n, c in near([(r.doc_id, r.text) for r in before]) if i == c or not n)
            assert not set(kept[name]) & set(range(90, 102))
        if name == "decontamination":
            found = contaminated([r.text for r in before], [(1, spark.read.parquet(f"{tmp_path}/benchmark.parquet").first().text)])
            assert kept[name] == sorted(before[f[0]].doc_id for f in found if not f[5]) and not set(kept[name]) & set(range(102, 106))
        if name == "personal_data":
            assert kept[name] == kept["decontamination"]
            for r in rows:
                assert not brute_pii(r.text or "") and (r.text == texts[r.doc_id] or brute_pii(texts[r.doc_id]))
                assert r.n_chars is None or r.n_chars == len(r.text)
        if name == "mix":
            size = {r.doc_id: len((r.text or "").split()) for r in before}
            by_source, taken = Counter(), Counter()
            for r in before:
                by_source[r.source] += size[r.doc_id]
            for r in rows:
                taken[r.source] += size[r.doc_id]
            assert max(Counter(kept[name]).values()) <= 3
            for s, want in targets(by_source).items():
                assert abs(taken[s] - want) <= max(size.values()) / 2 + 1e-6


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir)
    assert rows.count() > 100 and rows.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]

"""The pipeline as a whole, stage by stage against brute force."""

import random

import corpus_pipeline

from .conftest import table, words
from .test_operators import repeated, toxic_docs


def test_run(spark, corpus, tmp_path):
    rng = random.Random(20)
    marked = [(1000 + i, t, y) for i, t, y, _ in toxic_docs(rng, 400)]
    rows = corpus + [(i, t) for i, t, _ in marked]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in marked], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = dict(rows)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r.text for r in docs.collect()} if name != "packing" else docs.collect())
    toxic, exact, near, cut, bins = kept
    bad = {i for i, _, y in marked if y}
    assert len(bad & set(toxic)) <= 2 and len(set(texts) - bad - set(toxic)) <= 3
    assert sorted(exact.values()) == sorted(set(toxic.values()))
    assert set(near) <= set(exact) and set(cut) == set(near)
    assert not repeated(list(cut.items()), 50)
    assert sum(r.words for r in bins) == sum(len(t.split()) for t in cut.values())
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.chunk, r.words) for r in last) == sorted((r.doc_id, r.chunk, r.words) for r in bins)


def test_a_passage_of_many_stays_once(spark):
    rng = random.Random(21)
    passage = words(rng, 100)
    rows = [(k, " ".join(words(rng, 40) + passage + words(rng, 40))) for k in range(60)]
    left = corpus_pipeline.remove_passages(spark, table(spark, rows), "").collect()
    assert len(left) == 60 and [r.doc_id for r in left if " ".join(passage[:50]) in r.text] == [0]
    assert not repeated([(r.doc_id, r.text) for r in left], 50)

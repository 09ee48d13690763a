"""Every operator and every stage over odd rows, over no rows, and with extra columns whose names clash with inner ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, compact_windows, exact_dedup, media, ngram_join, packing, quality, sharding, suffix_dedup, toxicity

from .conftest import SCHEMA, table

MODEL = toxicity.train([f"fine day number {k} again" for k in range(40)] + [f"you scum {k} here" for k in range(20)], np.array([0] * 40 + [1] * 20))
WEIGHTS = quality.train(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
OPERATORS = {
    "bpe": bpe.encode_checked, "suffix": suffix_dedup.repeated_passages, "quality": lambda d: quality.posteriors(d, WEIGHTS), "ngram": ngram_join.similar_documents, "ngram_drop": ngram_join.drop_similar, "exact": exact_dedup.duplicate_groups, "exact_drop": exact_dedup.drop_copies,
    "sharding": sharding.assign_shards, "packing": packing.pack_documents, "toxic": lambda d: toxicity.offending_sentences(d, MODEL), "toxic_drop": lambda d: toxicity.drop_toxic(d, MODEL), "windows": compact_windows.near_duplicate_passages, "windows_cut": compact_windows.cut_passages,
}
CLASHING = ("content", "row", "h", "place", "text_", "gram", "view", "size", "component", "bin", "slot", "shard", "k", "name", "_content", "_id", "_group", "spans", "evidence", "host", "path", "score", "toxic", "owner", "key", "_tessella_hash", "_h", "_label", "_worded")


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, odd_rows, name):
    docs = table(spark, odd_rows)
    rows = OPERATORS[name](docs).collect()
    again = OPERATORS[name](clash(docs))
    assert len(again.collect()) == len(rows)
    if name.endswith(("drop", "cut")):
        assert set(again.columns) == {*docs.columns, *CLASHING}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_defined_results(spark, odd_rows):
    docs = table(spark, odd_rows)
    coded = bpe.encode_checked(docs).collect()
    assert len(coded) == len(odd_rows) and all(r.round_trip is (None if r.n_tokens is None else True) for r in coded)
    assert {(r.doc_id, r.keeper_id, r.n_copies) for r in exact_dedup.duplicate_groups(docs).collect()} == {(5, 5, 4), (6, 5, 4), (None, 5, 4)}
    left = sorted((str(r.doc_id), (r.text or "")[:9]) for r in exact_dedup.drop_copies(docs).collect())
    assert len(left) == len(odd_rows) - 3 and left.count(("5", "t0 t1 t2 ")) == 1
    kept = ngram_join.drop_similar(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "None", "None", "2", "3", "4", "5", "7", "8", "9"])
    similar = sorted((str(r.doc_id), r.class_id, r.n_links, r.n_copies) for r in ngram_join.similar_documents(docs).collect())
    assert similar == [("10", 5, 1, 1), ("5", 5, 1, 4), ("5", 5, 1, 4), ("6", 5, 1, 4), ("None", 5, 1, 4)]
    spans = {(r.doc_id, r.start_word, r.n_words) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert {(5, 0, 70), (6, 0, 70), (None, 0, 70), (10, 0, 70), (8, 0, 300)} <= spans
    cut = {r.doc_id: r for r in compact_windows.cut_passages(docs.where("doc_id in (5, 6, 10)")).collect()}
    assert cut[10].text == "more" and cut[10].n_chars == 4 and cut[6].text == "" and cut[5].text.startswith("t0 ")
    bins = packing.pack_documents(docs).collect()
    assert sum(r.words for r in bins) == sum(len(t.split()) for _, t in odd_rows if t)
    assert len(sharding.assign_shards(docs).collect()) == len(odd_rows)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, odd_rows, tmp_path, k, empty):
    rows = [(i, None if t is None else t[:20_000]) for i, t in odd_rows]
    docs = spark.createDataFrame([], SCHEMA) if empty else table(spark, rows)
    spark.createDataFrame([(4, 1, 0), (9, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    assert len(got) == 0 if empty else len(got) > 0
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_media_edges(spark):
    good = media.encode(media.picture(np.arange(5.0)))
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(good[: len(good) // 2])), (5, bytearray(b"\xff\xd8\xff\xd9")), (1, bytearray(good))], "id long, media binary")
    got = {r.id: r for r in media.decode_media(clash(df).withColumn("rgb", F.lit(1))).collect()}
    assert len(got[1].rgb) == 16 * 16 * 3 and got[1].error is None and got[2].error is None and got[2].rgb is None
    assert got[3].error and got[5].error and media.decode_media(df).count() == 6
    assert media.decode_media(spark.createDataFrame([], "id long, media binary")).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, float("nan")]), (2, []), (3, None)], "vec_id long, embedding array<float>")
    assert [r.media is None for r in media.render(vectors).orderBy("id").collect()] == [False, False, True]


def test_fits_over_odd_rows(spark, odd_rows):
    docs = table(spark, odd_rows)
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 1), (9, 0, 1), (None, 1, 1), (5, None, None), (5, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    for d, y in ((docs, labels), (clash(docs), labels.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in labels.columns])), (docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.where("toxic = 1"))):
        assert toxicity.drop_toxic(docs, toxicity.fit(d, y)).count() <= len(odd_rows)
        assert len(quality.fit(d, y)) == 2 * len(quality.FEATURES) + 1
    assert toxicity.fit(docs, labels.limit(0)).bias == -20


def test_shards_written(spark, odd_rows, tmp_path):
    docs = clash(table(spark, odd_rows)).withColumn("_shard", F.lit(1)).withColumn("_slot", F.lit(2))
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(odd_rows) and {*back.columns} == {*docs.columns, "__shard"}
    placed = {(r.doc_id, r.shard) for r in sharding.assign_shards(docs).collect()}
    assert {(r.doc_id, r["__shard"]) for r in back.collect()} == placed
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"))


def test_coding_odd_rows(spark, odd_rows):
    docs = table(spark, odd_rows)
    coded = bpe.encode(clash(docs))
    back = bpe.decode(coded)
    assert coded.count() == back.count() == len(odd_rows)
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA))).collect() == []


def test_damaged_media():
    good = media.encode(media.picture(np.arange(64.0)))
    whole = media.decode(good)
    rng = np.random.default_rng(3)
    wrong = 0
    for k in range(len(good) - 1):
        with pytest.raises(media.MediaError):
            media.decode(good[:k])
    for _ in range(300):
        bad = bytearray(good)
        for at in rng.integers(2, len(bad), 3):
            bad[at] = rng.integers(0, 256)
        try:
            wrong += media.decode(bytes(bad)).shape != whole.shape
        except media.MediaError:
            wrong += 1
    assert wrong


def test_all_values_show():
    v = np.linspace(-1, 1, 64)
    other = v.copy()
    other[-1] = 0.2
    assert (media.picture(v) != media.picture(other)).any()


def test_words_lose_all_punctuation():
    import pyarrow as pa

    from tessella.llm.textkit import pieces

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["scum", "!" * 40 + "SCUM" + "?" * 30, "!!!", "x"])})
    (p,) = pieces(iter([batch]))
    (h,), _, _ = toxicity.sentence_words(p, (0,))
    assert h[0] == h[1] != h[3] and len(h) == 4


def test_no_weight_is_lost():
    hashes = np.array([5, 5 + (1 << 18), 5 + (2 << 18), 6], np.uint64)
    model = toxicity.Model(hashes, np.array([1.0, 2.0, 3.0, 4.0]), 0.0, 0.5)
    assert model.score([np.append(hashes, np.uint64(7))]).tolist() == [1, 2, 3, 4, 0]


def test_ids_beyond_floats(spark):
    ids = [2**53 + k for k in range(6)]
    rows = sorted((r.doc_id, r.slot) for r in packing.pack_documents(table(spark, [(i, "a b c") for i in ids]).repartition(3), capacity=9).collect())
    assert [i for i, _ in rows] == ids

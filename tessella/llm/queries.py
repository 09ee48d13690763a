"""The operators applied to the whole of their tables, and SQL for the results of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, compact_windows, exact_dedup, media, ngram_join, packing, quality, sharding, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_checked(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of media: each row of embeddings is rendered as a progressive JPEG, which is then decoded."""
    return media.decode_media(media.render(_table(spark, sf_dir, "embeddings")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's posteriors; keep says which are kept."""
    docs = _table(spark, sf_dir, "documents")
    weights = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.posteriors(docs, weights)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offending sentences of the documents that are rejected."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.offending_sentences(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_duplicate_passages(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_suffix_dedup, op3_media, op4_quality, op5_ngram_jaccard, op6_exact_dedup, op7_sharding, op8_packing, op9_toxicity, op10_compact_windows)}

_WORDS = r"list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r ]+'), lambda w: w <> '')"

_OP2 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i - 1 AS start, array_to_string(w[i:i + 49], ' ') AS p
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
twice AS (SELECT doc_id, start FROM (SELECT doc_id, start, count(*) OVER (PARTITION BY p) AS k FROM windows) WHERE k > 1),
marked AS (SELECT doc_id, start, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 50 THEN 0 ELSE 1 END AS new FROM twice),
islands AS (SELECT doc_id, start, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM marked)
SELECT doc_id, CAST(min(start) AS INTEGER) AS start_word, CAST(max(start) + 50 - min(start) AS INTEGER) AS n_words
FROM islands GROUP BY doc_id, island"""

_OP5 = f"""
WITH RECURSIVE names AS (SELECT text, min(doc_id) AS doc FROM documents WHERE text IS NOT NULL GROUP BY text),
words AS (SELECT doc, {_WORDS} AS w FROM names),
grams AS (SELECT DISTINCT doc, array_to_string(w[i:i + 4], ' ') AS g
          FROM (SELECT doc, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc, count(*) AS n FROM grams GROUP BY doc),
shared AS (SELECT a.doc AS doc_a, b.doc AS doc_b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc < b.doc GROUP BY 1, 2),
links AS (SELECT doc_a, doc_b FROM shared JOIN sizes x ON x.doc = doc_a JOIN sizes y ON y.doc = doc_b
          WHERE o / CAST(x.n + y.n - o AS DOUBLE) >= 0.4 - 1e-9),
ends AS (SELECT doc_a AS a, doc_b AS b FROM links UNION ALL SELECT doc_b, doc_a FROM links),
reach AS (SELECT doc AS a, doc AS b FROM sizes UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a),
classes AS (SELECT a AS doc, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a AS doc, count(*) AS n_links FROM ends GROUP BY a),
copies AS (SELECT text, count(*) AS n_copies FROM documents GROUP BY text)
SELECT d.doc_id, k.class_id, CAST(coalesce(c.n_links, 0) AS INTEGER) AS n_links, CAST(p.n_copies AS INTEGER) AS n_copies
FROM documents d JOIN names n ON d.text = n.text JOIN classes k ON k.doc = n.doc JOIN copies p ON p.text = d.text
LEFT JOIN counts c ON c.doc = n.doc WHERE p.n_copies > 1 OR c.n_links > 0"""

_OP6 = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper_id, count(*) OVER (PARTITION BY text) AS n_copies
FROM documents WHERE text IS NOT NULL
QUALIFY count(*) OVER (PARTITION BY text) > 1"""

_SHARDS, _SLOTS = sharding.SHARDS, sharding.SLOTS
_HASH = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
_OP7 = f"""
WITH RECURSIVE shards AS (
  SELECT s, {_HASH.format("'offset:shard-' || lpad(CAST(s AS VARCHAR), 4, '0')")} % {_SLOTS} AS o,
         {_HASH.format("'skip:shard-' || lpad(CAST(s AS VARCHAR), 4, '0')")} % {_SLOTS - 1} + 1 AS k
  FROM range({_SHARDS}) t(s)),
orders AS (SELECT list([(o + j * k) % {_SLOTS} FOR j IN range({_SLOTS})] ORDER BY s) AS p FROM shards),
fill AS (
  SELECT 0 AS turn, [-1 FOR x IN range({_SLOTS})] AS t
  UNION ALL
  SELECT turn + 1, list_transform(t, lambda v, i: CASE WHEN i - 1 = free THEN turn % {_SHARDS} ELSE v END)
  FROM (SELECT turn, t, list_filter(p[turn % {_SHARDS} + 1], lambda x: t[x + 1] < 0)[1] AS free FROM fill, orders WHERE turn < {_SLOTS})),
lookup AS (SELECT t FROM fill WHERE turn = {_SLOTS}),
placed AS (SELECT doc_id, CAST({_HASH.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % {_SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(t[slot + 1] AS INTEGER) AS shard FROM placed, lookup"""

ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": _OP2, "op5_ngram_jaccard": _OP5, "op6_exact_dedup": _OP6, "op7_sharding": _OP7}

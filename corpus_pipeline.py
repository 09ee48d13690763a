"""A corpus pipeline of five of the operators: documents in, packed training sequences out.

Each stage works on all rows that the one before kept; run() writes every stage's rows as Parquet to the session's shared
folder and reads them again, so that a lost executor costs a stage no more than its own tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import compact_windows, exact_dedup, ngram_join, packing, toxicity
from tessella.llm.runtime import local_folder


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model finds toxic go. Null and empty texts stay, null ids and repeated rows are rows like others, no labels or no rows make
    a model that rejects nothing; extra columns are kept, whatever their names; long texts are scored whole.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that of the least id (nulls last); ties and repeated rows leave one. Null texts all stay, the empty text is a
    text like others; no rows give none; extra columns are kept; texts are compared whole, byte by byte.
    """
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, that of the least id (nulls last). Null texts and texts without words all stay; of
    repeated rows one stays; no rows give none; extra columns are kept; long texts are taken whole.
    """
    return ngram_join.drop_similar(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A near-duplicate passage stays in the document of least id only; every row stays, with less text. Null, empty and short texts are
    unchanged, null ids come last, a repeated row keeps its text; no rows give none; extra columns are kept; long texts are taken whole.
    """
    return compact_windows.cut_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole chunks. Null texts are left out, empty ones take no room, null ids stay null, repeated rows are separate items; no rows give no
    bins; extra columns are left out; a text longer than a bin is cut into chunks, all of which are packed.
    """
    return packing.pack_documents(docs)


STAGES = [("toxicity", remove_toxic), ("exact_dedup", remove_copies), ("ngram_jaccard", remove_near_copies), ("substring_dedup", remove_passages), ("packing", pack)]

#: Neither a trained model nor best-fit packing can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of the table documents."""
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or local_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

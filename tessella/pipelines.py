"""The engine's entry points: what each tool of a translation workflow does, as one plan over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import sinks, sources, srx
from .functions import text as T
from .operators import analysis, transforms


def convert(spark: SparkSession, path: str, src_lang: str, format: str | None = None, rules: srx.Rules | None = srx.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(parts, segments) of the documents under a path. rules None leaves paragraphs whole; else segments are split by them."""
    parts = sources.read(spark, path, format)
    segments = sources.segments_of(parts).withColumn("src_lang", F.lit(src_lang))
    if rules:
        segments = srx.resegment(segments.withColumn("matches", F.array().cast("array<string>")), rules)
    return parts, segments


def merge(parts: DataFrame, segments: DataFrame, unapproved: bool = False, policy: str | None = None) -> DataFrame:
    """(doc_id, file_no, text): documents with their translations, each by its format's policy and encoding. Segments of one unit come back
    together first.
    """
    by = ["doc_id", "file_no", "unit_id"]
    if "seg_no" in segments.columns:
        state = F.when(F.coalesce("approved", F.lit(False)), F.lit("final")).otherwise(F.col("state"))
        segments = transforms.to_version_1(segments.withColumn("state", state), by)
    if unapproved:
        segments = segments.withColumn("approved", F.coalesce("approved", F.lit(False)) | F.col("target").isNotNull())
    return sources.merge_text(parts, segments, policy)


def analyse(segments: DataFrame, lang: str) -> dict[str, DataFrame]:
    """Reports of segments (original, pos, source, target, approved, translate, matches): segments, words, status and chart."""
    qualities = F.transform(F.coalesce("matches", F.array()), lambda m: m["quality"])
    kind = F.when(F.coalesce("approved", F.lit(False)) & (F.col("state_qualifier") == "leveraged-inherited"), "ice").otherwise(T.match_class(qualities))
    rows = segments.where(F.length("source") > 0).withColumns({"type": kind, "translated": F.coalesce(F.length("target") > 0, F.lit(False)), "quality": F.coalesce(T.best_quality(qualities), F.lit(0.0)), "approved": F.coalesce("approved", F.lit(False))})
    rows = analysis.counted(rows, "source", lang, F.coalesce("translate", F.lit(True)))
    key = ["source", "words", "untranslatable", "approved", "translated", "chars", "spaces"]
    done = analysis.classify_repetitions(rows, key)
    return {"segments": analysis.segment_report(done), "words": analysis.word_report(done), "status": analysis.status_report(done), "chart": analysis.chart_buckets(done, "original", "pos")}


def export_tmx(segments: DataFrame, src_lang: str, tgt_lang: str) -> DataFrame:
    """(doc_id, text): a translation memory of each document's approved segments."""
    wide = segments.withColumns({"source_lang": F.lit(src_lang), "target_lang": F.lit(tgt_lang)})
    if "preserve_space" not in wide.columns:
        wide = wide.withColumn("preserve_space", F.lit(False))
    approved = wide.where(F.coalesce("approved", F.lit(False)) & (F.length("source") > 0) & F.col("target").isNotNull())
    tuid = F.concat_ws("-", T.java_hash(F.col("original")).cast("string"), F.coalesce("file_no", F.lit(0)).cast("string"), T.java_hash(F.col("unit_id")).cast("string"))
    shown = lambda c: F.when(F.col("preserve_space"), F.col(c)).otherwise(F.trim(F.col(c)))
    units = approved.select("doc_id", tuid.alias("tuid"), "source_lang", "target_lang", shown("source").alias("seg_src"), shown("target").alias("seg_tgt"), T.tmx_date(F.current_timestamp()).alias("created"))
    return sinks.tmx(units, ["doc_id"], src_lang)


def fix_references(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (file, href) with hrefs that begin with a GUID pointing at the file (path) whose name begins with it, before a `=`."""
    guid = lambda c: F.regexp_extract(F.regexp_extract(c, r"([^/\\]*)$", 1), r"^(GUID-[0-9A-Fa-f-]+)", 1)
    known = files.select(guid(F.col("path")).alias("_g"), F.col("path").alias("_p")).where("_g <> ''").groupBy("_g").agg(F.min("_p").alias("_p"))
    rest = F.regexp_extract("href", "(#.*)$", 1)
    return links.join(known, guid(F.regexp_replace("href", "#.*$", "")) == F.col("_g"), "left").select("file", F.when(F.col("_p").isNotNull(), F.concat("_p", rest)).otherwise(F.col("href")).alias("href"))

"""Row transforms of segments; source and target are strings or token arrays alike unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

EMPTY_STATES = ("new", "needs-translation")


def has_text(column: str) -> Column:
    return F.coalesce(F.length(F.col(column)) > 0, F.lit(False))


def approve_all(segments: DataFrame, any_target: bool = False) -> DataFrame:
    """Approves translatable segments with a target that isn't empty; any_target: all that have one, as merging does."""
    when = F.col("target").isNotNull() if any_target else F.col("translate") & has_text("target")
    return segments.withColumns({"approved": F.when(when, True).otherwise(F.col("approved")), "state": F.when(when, F.lit("final")).otherwise(F.col("state"))})


def copy_sources(segments: DataFrame) -> DataFrame:
    """Sources as targets where there is none (an empty one is one); their state is translated."""
    when = F.col("translate") & F.col("target").isNull()
    return segments.withColumns({"state": F.when(when, F.lit("translated")).otherwise(F.col("state")), "target": F.when(when, F.col("source")).otherwise(F.col("target"))})


def pseudo_translate(segments: DataFrame) -> DataFrame:
    """Sources with accented vowels as targets where there is none or an empty one, but where approved, final or not to translate."""
    when = F.col("translate") & ~F.coalesce("approved", F.lit(False)) & (F.coalesce("state", F.lit("")) != "final") & ~has_text("target")
    return segments.withColumns({"state": F.when(when, F.lit("translated")).otherwise(F.col("state")), "target": F.when(when, T.pseudo(F.col("source"))).otherwise(F.col("target"))})


def remove_targets(segments: DataFrame) -> DataFrame:
    none = F.lit(None).cast(segments.schema["target"].dataType)
    return segments.withColumns({"state": F.when(F.col("state").isNotNull(), F.lit("initial")), "target": none, "approved": F.lit(None).cast("boolean")})


def remove_matches(segments: DataFrame) -> DataFrame:
    return segments.withColumn("matches", F.array().cast(segments.schema["matches"].dataType))


def replicate_notes(segments: DataFrame, everywhere: bool = False) -> DataFrame:
    """Notes on the first segment of each unit only, or on all."""
    return segments.withColumn("notes", F.when(F.lit(everywhere) | (F.col("seg_no") == 0), F.col("notes")))


def to_version_2(units: DataFrame) -> DataFrame:
    """State and sub-state of the second version from approval, target and lock."""
    state = F.when(F.coalesce("approved", F.lit(False)), "final").when(has_text("target"), "translated").otherwise("initial")
    return units.withColumns({"state": state, "sub_state": F.when(F.coalesce(F.col("ts"), F.lit("")) == "locked", F.lit("locked:yes"))})


def to_version_1(segments: DataFrame, by: list[str]) -> DataFrame:
    """Units of the first version: texts of each unit's segments end to end, approved if any is final.

    An ignorable piece without a target counts with its source; a unit with no segment's target has none.
    """
    piece = F.coalesce(F.col("target"), F.when(F.col("is_ignorable"), F.col("source")))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seg_no").alias("n"), c.alias("x")))), lambda s: F.coalesce(s["x"], F.lit(""))), "")
    translated = F.bool_or(F.col("target").isNotNull() & ~F.col("is_ignorable"))
    grouped = segments.groupBy(*by).agg(ordered(F.col("source")).alias("source"), ordered(piece).alias("_target"), translated.alias("_has"), F.bool_or(F.coalesce(F.col("state") == "final", F.lit(False))).alias("approved"))
    return grouped.withColumn("target", F.when(F.col("_has"), F.col("_target"))).drop("_has", "_target")


def join_split_groups(units: DataFrame, group: list[str]) -> DataFrame:
    """Units that were split into a group as one again: texts end to end, approved if all are."""
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("n"), F.col(c).alias("x")))), lambda s: F.coalesce(s["x"], F.lit(""))), "")
    return units.groupBy(*group).agg(ordered("source").alias("source"), ordered("target").alias("target"), F.bool_and(F.coalesce("approved", F.lit(False))).alias("approved"))


def number_units(segments: DataFrame, by: list[str], order: list[str], name: str = "unit_no") -> DataFrame:
    return segments.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def tmx_units(segments: DataFrame, file_no: Column, now: Column | None = None) -> DataFrame:
    """(tuid, source_lang, target_lang, seg_src, seg_tgt, created) of approved segments with both texts; trimmed unless space is kept."""
    approved = segments.where(F.coalesce("approved", F.lit(False)) & has_text("source") & F.col("target").isNotNull())
    tuid = F.concat_ws("-", T.java_hash(F.col("original")).cast("string"), file_no.cast("string"), T.java_hash(F.col("unit_id")).cast("string"))
    shown = lambda c: F.when(F.col("preserve_space"), F.col(c)).otherwise(F.trim(F.col(c)))
    return approved.select(tuid.alias("tuid"), "source_lang", "target_lang", shown("source").alias("seg_src"), shown("target").alias("seg_tgt"), T.tmx_date(now if now is not None else F.current_timestamp()).alias("created"))

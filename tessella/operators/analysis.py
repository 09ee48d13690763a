"""Repetition, word, status and match statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

REPORT = ("new", "ice", "exact", "rep-int", "rep-ext", "95", "85", "75", "50")


def spread_scan(scan: DataFrame, *columns: str) -> DataFrame:
    """A scan of few splits (a file of one row group, say) spread over the cluster's cores; one of many is left as it is.

    Only for plain scans: of those the number of partitions is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *columns)


def document_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line of each document: the columns of docs but text, pos (from 0) and segment."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("pos", "segment")).where(F.trim("segment") != "")


def classify_repetitions(segments: DataFrame, key: list[str], kind: str = "type", file: str = "original", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """segments with `kind` of later equals of a new segment set: rep-int in the same file, rep-ext in a later one.

    Files are in order of their names regardless of case, segments in `order`. Only those whose kind is new can be
    repeated; every later equal is marked by the first, and again by the first of its own file that is still new, so
    that it depends on the first alone. The first of each key is found by a grouped minimum, which combines before the
    shuffle, so a segment that is repeated millions of times is no hot partition.
    """
    place = F.struct(F.lower(file).alias("l"), F.col(file).alias("f"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    first = segments.where(F.col(kind) == "new").groupBy(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(key)]).agg(F.min(place).alias("_first"))
    same = [segments[c].eqNullSafe(first[f"_k{n}"]) for n, c in enumerate(key)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = segments.join(first, condition, "left")
    again = F.col("_first").isNotNull() & (place > F.col("_first"))
    new_kind = F.when(again & (F.col(file) == F.col("_first.f")), "rep-int").when(again, "rep-ext").otherwise(F.col(kind))
    return joined.withColumn(kind, new_kind).drop("_first", *[f"_k{n}" for n in range(len(key))])


def segment_report(classified: DataFrame, file: str = "original", kind: str = "type", total: str | None = "SUM") -> DataFrame:
    """Segments per file by class, and a total line; matches are exact to 50. `n_total` counts all, ice too."""
    return _with_total(classified, file, _segment_aggs(kind), total)


def _segment_aggs(kind: str) -> list[Column]:
    count = lambda *kinds: F.count_if(F.col(kind).isin(*kinds))
    return [count("new").alias("n_new"), count("ice").alias("n_ice"), count(*T.CLASSES).alias("n_matches"), count("rep-int").alias("n_rep_int"), count("rep-ext").alias("n_rep_ext"), F.count(F.lit(1)).alias("n_total")]


def word_report(classified: DataFrame, file: str = "original", kind: str = "type", words: str = "words", untranslatable: str = "untranslatable", total: str | None = "SUM") -> DataFrame:
    """Words per file by class; repeated are internal and external together."""
    return _with_total(classified, file, _word_aggs(kind, words, untranslatable), total)


def _word_aggs(kind: str, words: str, untranslatable: str) -> list[Column]:
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col(kind).isin(*kinds), F.col(words)).otherwise(0)), F.lit(0))
    names = {"w_new": ("new",), "w_ice": ("ice",), "w_exact": ("exact",), "w_repeated": ("rep-int", "rep-ext"), "w_95": ("95",), "w_85": ("85",), "w_75": ("75",), "w_50": ("50",)}
    return [of(*kinds).alias(name) for name, kinds in names.items()] + [F.sum(untranslatable).alias("w_untranslatable"), F.sum(F.col(words) + F.col(untranslatable)).alias("w_total")]


def repetition_report(classified: DataFrame, file: str = "original", kind: str = "type", words: str = "words", untranslatable: str = "untranslatable", total: str | None = "SUM") -> DataFrame:
    """segment_report and word_report in one pass."""
    return _with_total(classified, file, _segment_aggs(kind) + _word_aggs(kind, words, untranslatable), total)


def status_report(segments: DataFrame, file: str = "original", total: str | None = "SUM") -> DataFrame:
    """Translated and approved segments, words and characters per file, of columns translated, approved, words, untranslatable,
    chars, spaces, protected_chars and protected_spaces."""
    yes = lambda c: F.col(c) == F.lit(True)
    part = lambda flag, value: [F.sum(F.when(yes(flag), value).otherwise(0)), F.sum(F.when(~yes(flag), value).otherwise(0))]
    aggs: list[Column] = []
    for unit, value in (("segments", F.lit(1)), ("words", F.col("words")), ("chars", F.col("chars") - F.col("spaces"))):
        for flag in ("translated", "approved"):
            on, off = part(flag, value)
            aggs += [on.alias(f"{unit}_{flag}"), off.alias(f"{unit}_not_{flag}")]
    aggs += [F.sum("untranslatable").alias("words_untranslatable"), F.sum(F.col("protected_chars") - F.col("protected_spaces")).alias("chars_untranslatable")]
    return _with_total(segments, file, aggs, total)


def _with_total(rows: DataFrame, file: str, aggs: list[Column], total: str | None) -> DataFrame:
    if total is None:
        return rows.groupBy(file).agg(*aggs)
    grouped = rows.rollup(file).agg(F.grouping(file).alias("_all"), *aggs)
    return grouped.withColumn(file, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(file))).drop("_all")


def counted(segments: DataFrame, text: str, lang: Column | str, translate: Column | None = None) -> DataFrame:
    """segments with words, untranslatable, chars, spaces, protected_chars and protected_spaces of a text column."""
    n = T.word_count(F.col(text), lang)
    free = F.lit(True) if translate is None else translate
    zero = F.lit(0)
    length, spaces = T.utf16_length(F.col(text)), T.space_count(F.col(text))
    return segments.withColumns({"words": F.when(free, n).otherwise(zero), "untranslatable": F.when(free, zero).otherwise(n), "chars": length, "spaces": spaces, "protected_chars": zero, "protected_spaces": zero})


def whole_analysis(segments: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of words by class over all translatable segments (columns translate, type, words, approved, translated).

    Every later equal of a new segment counts as repeated, whatever its file.
    """
    rows = segments.where("translate")
    first = rows.where("type = 'new'").groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    joined = rows.join(first, key, "left")
    kind = F.when(F.struct(*order) > F.col("_first"), "repeated").otherwise(F.col("type"))
    of = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("words"))), F.lit(0))
    names = {"new": "w_new", "exact": "w_exact", "repeated": "w_repeated", "95": "w_95", "85": "w_85", "75": "w_75", "50": "w_50", "ice": "w_ice"}
    flag = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("words"))), F.lit(0))
    return joined.agg(*[of(k).alias(v) for k, v in names.items()], F.coalesce(F.sum("words"), F.lit(0)).alias("w_all"), flag("approved").alias("w_approved"), flag("translated").alias("w_translated"))


def chart_buckets(segments: DataFrame, file: str, pos: str, bars: int = 200) -> DataFrame:
    """(file, bucket, quality, translated, approved) for bar charts: at most about `bars` buckets a file.

    Each bucket averages quality; translated and approved are 100 where more than half (in whole numbers) of its rows are.
    """
    by_file = W.partitionBy(file)
    numbered = segments.select(file, "quality", "translated", "approved", (F.row_number().over(by_file.orderBy(pos)) - 1).alias("k"), F.count(F.lit(1)).over(by_file).alias("n"))
    size = F.when(F.col("n") <= bars, F.lit(1)).otherwise(F.ceil(F.col("n") / bars)).cast("int")
    grouped = numbered.groupBy(file, F.floor(F.col("k") / size).cast("int").alias("bucket"))
    full = lambda c: F.when(F.sum(F.col(c).cast("int")) > F.floor(F.count(F.lit(1)) / 2), 100).otherwise(F.when((F.count(F.lit(1)) == 1) & (F.sum(F.col(c).cast("int")) == 1), 100).otherwise(0))
    return grouped.agg(F.avg("quality").alias("quality"), full("translated").alias("translated"), full("approved").alias("approved"))

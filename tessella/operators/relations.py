"""Operators over two or more tables of segments: leverage, joining, comparison, merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

POLICIES = ("approved", "strict", "always", "keep_original")


def with_context(segments: DataFrame, text: str, file: str = "original", pos: str = "pos") -> DataFrame:
    """Adds prev_text and next_text, those of the neighbours in the file; null at its ends."""
    order = W.partitionBy(file).orderBy(pos)
    return segments.select("*", F.lag(text).over(order).alias("prev_text"), F.lead(text).over(order).alias("next_text"))


def in_context_matches(old: DataFrame, new: DataFrame, text: str = "source", file: str = "original", pos: str = "pos", tags: str | None = None) -> DataFrame:
    """new with the targets of approved old segments of the same file, text and neighbours.

    Matched rows become approved, their state_qualifier leveraged-inherited. Where a new segment is first or last of its
    file, that side's neighbour of the old one isn't looked at; where it has a neighbour, so must the old one. Of several, the last
    in the old file wins. Approved and untranslatable new segments are left alone. tags: a column of
    tokens; candidates with other markup don't match. Segments with both neighbours join on file, text and neighbours, with one old
    segment for each such context, so a line that occurs everywhere meets no other context's; the first and last of a file join on file and text.
    """
    a = with_context(new, text, file, pos)
    b = with_context(old, text, file, pos).where(F.coalesce("approved", F.lit(False)) & F.col("target").isNotNull())
    b = b.select(F.col(file).alias("_file"), F.col(text).alias("_text"), F.col("prev_text").alias("_prev"), F.col("next_text").alias("_next"), F.col(pos).alias("_pos"), F.col("target").alias("_target"), *([F.col(tags).alias("_tags")] if tags else []))
    open_ = F.col("translate") & ~F.coalesce("approved", F.lit(False))
    last = F.max_by("_target", "_pos").alias("_target"), F.max("_pos").alias("_pos")
    b = b.groupBy("_file", "_text", "_prev", "_next", *(["_tags"] if tags else [])).agg(*last)
    same = (F.col(file) == F.col("_file")) & (F.col(text) == F.col("_text"))
    inside = F.col("prev_text").isNotNull() & F.col("next_text").isNotNull()
    side = lambda mine, theirs: F.col(mine).isNull() | F.coalesce(F.col(mine) == F.col(theirs), F.lit(False))
    a = a.where(open_)
    hits = a.where(inside).join(b, same & (F.col("prev_text") == F.col("_prev")) & (F.col("next_text") == F.col("_next")))
    hits = hits.unionByName(a.where(~inside).join(b, same & side("prev_text", "_prev") & side("next_text", "_next")))
    if tags:
        hits = hits.where(T.tag_penalty(F.col(tags), F.col("_tags"), 1) == 0)
    best = hits.groupBy(F.col(file).alias("_f"), F.col(pos).alias("_p")).agg(F.max_by("_target", "_pos").alias("_best"))
    joined = new.join(best, (new[file] == F.col("_f")) & (new[pos] == F.col("_p")), "left")
    hit = F.col("_best").isNotNull()
    return joined.withColumns({"target": F.coalesce("_best", "target"), "approved": F.when(hit, True).otherwise(F.col("approved")), "state_qualifier": F.when(hit, F.lit("leveraged-inherited")).otherwise(F.col("state_qualifier"))}).drop("_best", "_f", "_p")


_BRANCH = "[/\\\\:]"


def tree_root(paths: Column) -> Column:
    """Longest common folder of an array of paths; the part where they branch, or the last of a single path, isn't in it."""
    split = F.transform(paths, lambda p: F.split(p, _BRANCH))
    return _common(F.array_min(split), F.array_max(split))


def tree_root_of(path: Column) -> Column:
    """The same as an aggregate over rows: of the split paths only the least and the greatest are held."""
    split = F.split(path, _BRANCH)
    return _common(F.min(split), F.max(split))


def _common(least: Column, most: Column) -> Column:
    n = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(least), F.size(most))), lambda i: F.slice(least, 1, i) == F.slice(most, 1, i)))
    kept = F.when(n == F.size(least), n - 1).otherwise(n)
    return F.when(kept > 0, F.array_join(F.slice(least, 1, kept), "/")).otherwise("")


def join_files(tables: list[DataFrame], root: bool = True) -> DataFrame:
    """Union of segment tables as one document: files renumbered in order of their first place, originals relative to their common root.

    All must have one version and one pair of languages.
    """
    both = reduce(lambda x, y: x.unionByName(y), [t.withColumn("_n", F.lit(k)) for k, t in enumerate(tables)])
    pairs = both.select("version", "src_lang", "tgt_lang").distinct().limit(2).collect()
    if len(pairs) > 1:
        raise ValueError("files of different versions or languages can't be joined")
    files = both.select("_n", "file_no", "original").distinct()
    # numbered within each table; the tables' offsets are as few rows as there are tables
    offsets = files.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).select("_n", (F.sum("_c").over(W.orderBy("_n")) - F.col("_c")).alias("_off"))
    ranked = files.select("*", (F.row_number().over(W.partitionBy("_n").orderBy("file_no")) - 1).alias("_k"))
    numbers = ranked.join(offsets, "_n").withColumn("_new", (F.col("_k") + F.col("_off")).cast("int")).drop("_k", "_off")
    if root:
        top = files.agg(tree_root_of(F.col("original")).alias("_root"))
        numbers = numbers.crossJoin(F.broadcast(top))  # one row
        numbers = numbers.withColumn("_rel", F.when(F.col("_root") != "", F.expr("substr(original, length(_root) + 2)")).otherwise(F.col("original")))
    else:
        numbers = numbers.withColumn("_rel", F.col("original"))
    out = both.join(numbers.drop("original"), ["_n", "file_no"])
    return out.withColumns({"file_no": F.col("_new"), "original": F.col("_rel")}).drop("_n", "_new", "_rel", "_root")


def split_by_original(segments: DataFrame, path: str) -> None:
    segments.write.partitionBy("original").parquet(path)


def compare(a: DataFrame, b: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, kind) of positions that differ: only_a, only_b, or changed, columns compared with nulls equal."""
    x = a.select(*by, F.struct(*columns).alias("_a"))
    y = b.select(*by, F.struct(*columns).alias("_b"))
    both = x.join(y, by, "full_outer")
    kind = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*by, kind.alias("kind")).where("kind is not null")


def chosen_text(policy: str = "approved", source: str = "source", target: str = "target", approved: str = "approved", original: str = "skeleton_target") -> Column:
    """What a place of a segment is filled with (columns source, target, approved; keep_original: also skeleton_target).

    approved: the target of approved segments, else the source. strict: the same, and approved without a target is an
    error. always: any target, else the source. keep_original: targets of approved segments, else what the skeleton had.
    """
    yes = F.coalesce(F.col(approved), F.lit(False))
    has = yes & F.col(target).isNotNull()
    if policy == "approved":
        return F.when(has, F.col(target)).otherwise(F.col(source))
    if policy == "strict":
        return F.when(yes & F.col(target).isNull(), F.raise_error(F.lit("approved segment without target"))).when(yes, F.col(target)).otherwise(F.col(source))
    if policy == "always":
        return F.coalesce(F.col(target), F.col(source))
    if policy == "keep_original":
        return F.when(has, F.col(target)).otherwise(F.col(original))
    raise ValueError(f"no such policy: {policy}")


def merge_documents(parts: DataFrame, segments: DataFrame, policy: str | Column = "approved", by: tuple[str, ...] = ("doc_id",), encode: Callable[[Column], Column] | None = None) -> DataFrame:
    """(by, text): documents rebuilt from parts (part_no, kind literal or ref, literal, ref_id) and segments (unit_id).

    A part without its segment is an error, as are two segments of one place. One shuffle joins, another gathers each document's parts
    in order. policy: one for all, or a column over parts' columns and the segment's, which are named _source, _target, _approved.
    encode: what is done to the chosen text, over the same columns.
    """
    ready = isinstance(policy, str)
    said = [chosen_text(policy).alias("_text")] if ready else [F.col(c).alias(f"_{c}") for c in ("source", "target", "approved")]
    filled = segments.select(*by, F.col("unit_id").alias("ref_id"), *said, F.lit(True).alias("_found"))
    joined = parts.join(filled, [*by, "ref_id"], "left")
    missing = (F.col("kind") == "ref") & F.col("_found").isNull()
    if not ready:
        joined = joined.withColumn("_text", F.when(F.col("_found"), policy))
    if encode:
        joined = joined.withColumn("_text", encode(F.col("_text")))
    text = F.when(missing, F.raise_error(F.concat(F.lit("segment missing: "), F.coalesce("ref_id", F.lit("null"))))).when(F.col("kind") == "ref", F.col("_text")).otherwise(F.col("literal"))
    piece = F.struct(F.col("part_no").alias("n"), F.coalesce(text, F.lit("")).alias("x"))
    gathered = joined.groupBy(*by).agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    twice = F.size(F.array_distinct("_p.n")) < F.size("_p")
    whole = F.when(twice, F.raise_error(F.lit("two segments of one place"))).otherwise(F.array_join("_p.x", ""))
    return gathered.select(*by, whole.alias("text"))


def match_tags(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """target tags (by, pos, text) with the id of the source tag (by, pos, id, text) of the same text: the first with the first, and so on.

    Target tags beyond the source's get null.
    """
    nth = lambda df: df.withColumn("_n", F.row_number().over(W.partitionBy(*by, "text").orderBy("pos")))
    s = nth(source).select(*by, "text", "_n", "id")
    return nth(target).join(s, [*by, "text", "_n"], "left").select(*by, "pos", "text", "id")


def copy_protected(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """target marks (by, mid, text, protected) with protected ones' text taken from the source mark of the same mid."""
    s = source.select(*by, "mid", F.col("text").alias("_t"))
    return target.join(s, [*by, "mid"], "left").select(*by, "mid", F.when(F.col("protected") & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.col("text")).alias("text"), "protected")

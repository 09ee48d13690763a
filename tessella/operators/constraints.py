"""Integrity rules as queries: each gives the violating rows (rule, place, reason); the first by place is a file's verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

VERSIONS = ("1.0", "1.1", "1.2", "2.0", "2.1", "2.2")
#: Attributes of the elements of version 1.2, by its public specification; names with a colon besides xml: ones are extensions and free.
ATTRIBUTES = {
    "xliff": "version xml:lang", "file": "original source-language datatype tool tool-id date xml:space target-language product-name product-version build-num category", "header": "", "body": "", "skl": "", "internal-file": "form crc", "external-file": "href uid crc", "glossary": "", "reference": "",
    "phase-group": "", "phase": "phase-name process-name company-name tool tool-id date job-id contact-name contact-email contact-phone", "tool": "tool-id tool-name tool-version tool-company", "note": "xml:lang from priority annotates",
    "count-group": "name", "count": "count-type phase-name unit", "context-group": "crc name purpose", "context": "context-type match-mandatory crc", "prop-group": "name", "prop": "prop-type xml:lang",
    "group": "id datatype xml:space restype resname extradata help-id menu menu-option menu-name coord font css-style style exstyle extype translate reformat maxbytes minbytes size-unit maxheight minheight maxwidth minwidth charclass merged-trans ts",
    "trans-unit": "id approved translate reformat xml:space datatype phase-name restype resname extradata help-id menu menu-option menu-name coord font css-style style exstyle extype maxbytes minbytes size-unit maxheight minheight maxwidth minwidth charclass ts",
    "source": "xml:lang ts", "seg-source": "xml:lang ts", "target": "state state-qualifier phase-name xml:lang resname coord font css-style style exstyle equiv-trans ts restype",
    "alt-trans": "mid match-quality tool tool-id crc xml:lang datatype xml:space restype resname extradata help-id menu menu-option menu-name coord font css-style style exstyle extype origin phase-name alttranstype ts",
    "bin-unit": "id mime-type approved translate reformat restype resname phase-name ts", "bin-source": "ts", "bin-target": "mime-type state state-qualifier phase-name restype resname ts",
    "g": "id ctype clone xid equiv-text ts", "x": "id ctype clone xid equiv-text ts", "bx": "id rid ctype clone xid equiv-text ts", "ex": "id rid xid equiv-text ts", "bpt": "id rid ctype crc xid equiv-text ts", "ept": "id rid crc xid equiv-text ts",
    "it": "id pos rid ctype crc xid equiv-text ts", "ph": "id ctype crc assoc xid equiv-text ts", "sub": "datatype ctype xid", "mrk": "mtype mid comment ts",
}
STATES = ("initial", "translated", "reviewed", "final")


def _rows(df: DataFrame, rule: str, place: Column, reason: Column | str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), place.cast("string").alias("place"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def unique(df: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """Values that occur more than once."""
    twice = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).groupBy(*columns).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    return _rows(twice, rule, F.concat_ws("/", *columns), "not unique")


def refers(df: DataFrame, column: str, to: DataFrame, target: str, rule: str, within: list[str] | None = None) -> DataFrame:
    """Values of column that target lacks (within equal values of other columns, if given)."""
    within = within or []
    known = to.select(*within, F.col(target).alias(column)).distinct()
    lost = df.where(F.col(column).isNotNull()).join(known, [*within, column], "left_anti")
    return _rows(lost.select(*within, column).distinct(), rule, F.concat_ws("/", *within, column), "refers to nothing")


def check(df: DataFrame, wrong: Column, place: str, rule: str, reason: str) -> DataFrame:
    return _rows(df.where(F.coalesce(wrong, F.lit(False))), rule, F.col(place), reason)


def attribute_rule(attributes: DataFrame) -> DataFrame:
    """Attributes (doc_id, element, attribute) that their element doesn't have; unknown elements and extensions are free."""
    known = F.create_map(*[x for e, a in ATTRIBUTES.items() for x in (F.lit(e), F.array(*[F.lit(n) for n in a.split()]).cast("array<string>"))])
    allowed = known[F.col("element")]
    free = F.col("attribute").contains(":") & ~F.col("attribute").startswith("xml:") | F.col("attribute").startswith("xmlns")
    return _rows(attributes.where(~free & allowed.isNotNull() & ~F.array_contains(allowed, F.col("attribute"))), "attribute", F.concat_ws("/", "doc_id", "element", "attribute"), "no such attribute")


def version_1_parts(units: DataFrame, tags: DataFrame, groups: DataFrame, phases: DataFrame, tools: DataFrame, alternatives: DataFrame) -> dict[str, DataFrame]:
    """More rules for the first version: of groups (doc_id, group_id), phases (doc_id, phase), tools (doc_id, tool_id),
    alternatives (doc_id, unit_id, mid, tool_id) and segment markers (tags of kind mrk, side seg-source or target)."""
    marks = tags.where("kind = 'mrk' and mid is not null")
    at = ["doc_id", "unit_id"]
    own = marks.where("side = 'seg-source'")
    return {
        "group_unique": unique(groups, ["doc_id", "group_id"], "group_unique"),
        "phase_unique": unique(phases, ["doc_id", "phase"], "phase_unique"),
        "phase": refers(units, "phase", phases, "phase", "phase", ["doc_id"]),
        "tool_unique": unique(tools, ["doc_id", "tool_id"], "tool_unique"),
        "tool": refers(alternatives, "tool_id", tools, "tool_id", "tool", ["doc_id"]),
        "alternative": refers(alternatives, "mid", own, "mid", "alternative", at),
        "mark_unique": unique(own, [*at, "mid"], "mark_unique"),
        "mark": refers(marks.where("side = 'target'"), "mid", own, "mid", "mark", at),
    }


def module_rules(modules: dict[str, DataFrame], within: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Ids of modules (matches, glossary entries, metadata groups, notes) are unique in their unit (doc_id, unit_id, id)."""
    return {name: unique(df, [*(within or {}).get(name, ["doc_id", "unit_id"]), "id"], f"{name}_unique") for name, df in modules.items()}


def version_1_rules(files: DataFrame, units: DataFrame, tags: DataFrame) -> dict[str, DataFrame]:
    """Rules for the first version.

    files: doc_id, version, date, source_lang, target_lang; units: doc_id, unit_id, group_id, phase, xid, source_xml_lang,
    target_xml_lang; tags: doc_id, unit_id, side (source, target), kind (bx ex bpt ept it ...), id, rid, pos, mid.
    """
    wide = units.join(files.select("doc_id", "source_lang", "target_lang"), "doc_id")
    differs = lambda a, b: F.col(a).isNotNull() & (F.lower(a) != F.lower(b))
    key = F.coalesce("rid", "id")
    pair = lambda k: tags.where(F.col("kind") == k).select("doc_id", "unit_id", "side", key.alias("k")).where("k is not null").distinct()

    def unpaired(opener: str, closer: str, rule: str) -> DataFrame:
        a, b = pair(opener), pair(closer)
        on = ["doc_id", "unit_id", "side", "k"]
        lost = a.join(b, on, "left_anti").unionByName(b.join(a, on, "left_anti"))
        return _rows(lost, rule, F.concat_ws("/", *on), f"{opener} and {closer} not paired")

    balance = tags.where("kind = 'it'").groupBy("doc_id").agg(F.sum(F.when(F.col("pos") == "open", 1).when(F.col("pos") == "close", -1).otherwise(0)).alias("n")).where("n <> 0")
    return {
        "version": check(files, ~F.col("version").isin(*VERSIONS) | F.col("version").isNull(), "doc_id", "version", "unknown version"),
        "date": check(files, F.col("date").isNotNull() & ~T.is_date(F.col("date")), "doc_id", "date", "bad date"),
        "source_language": check(files, ~T.is_language(F.col("source_lang")), "doc_id", "source_language", "bad language"),
        "target_language": check(files, F.col("target_lang").isNotNull() & ~T.is_language(F.col("target_lang")), "doc_id", "target_language", "bad language"),
        "source_agrees": check(wide, differs("source_xml_lang", "source_lang"), "unit_id", "source_agrees", "language differs from the file's"),
        "target_agrees": check(wide, differs("target_xml_lang", "target_lang"), "unit_id", "target_agrees", "language differs from the file's"),
        "unit_unique": unique(units, ["doc_id", "unit_id"], "unit_unique"),
        "xid": refers(units, "xid", units, "unit_id", "xid", ["doc_id"]),
        "tag_id": check(tags, F.col("kind").isin("bx", "ex", "bpt", "ept") & key.isNull(), "unit_id", "tag_id", "needs rid or id"),
        "bx_ex": unpaired("bx", "ex", "bx_ex"),
        "bpt_ept": unpaired("bpt", "ept", "bpt_ept"),
        "it_once": unique(tags.where("kind = 'it'"), ["doc_id", "unit_id", "side", "id", "pos"], "it_once"),
        "it_balance": _rows(balance, "it_balance", F.col("doc_id"), "open and close differ in number"),
    }


def version_2_rules(files: DataFrame, segments: DataFrame, tags: DataFrame, data: DataFrame) -> dict[str, DataFrame]:
    """Rules for the second version.

    files: doc_id, file_id, src_lang, trg_lang, skeleton_href, skeleton_text; segments: doc_id, unit_id, segment_id, state,
    sub_state, source, target, source_lang, target_lang, target_order; tags: doc_id, unit_id, side, kind (ph pc sc ec mrk sm em),
    id, start_ref, isolated, copy_of, data_ref, can_delete, type, sub_type; data: doc_id, unit_id, id.
    """
    placed = F.concat_ws("/", "doc_id", "unit_id", "segment_id")
    seg = segments.withColumn("_place", placed)
    wide = seg.join(files.select("doc_id", "src_lang", "trg_lang"), "doc_id")
    tag = tags.withColumn("_place", F.concat_ws("/", "doc_id", "unit_id", "id"))
    on = ["doc_id", "unit_id"]
    codes = tags.where(F.col("kind").isin("ph", "pc", "sc", "ec"))
    starts, ends = tags.where("kind = 'sc' and not coalesce(isolated, false)"), tags.where("kind = 'ec' and not coalesce(isolated, false)")
    open_ = starts.join(ends.select(*on, "side", F.col("start_ref").alias("id")), [*on, "side", "id"], "left_anti")
    orders = seg.where("target_order is not null")
    n = orders.groupBy(*on).agg(F.max("target_order").alias("_m")).join(seg.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), on)
    fixed = tags.where("side = 'source' and can_delete = 'no'").select(*on, "id").join(tags.where("side = 'target'").select(*on, "id"), [*on, "id"], "left_anti")
    src, tgt = (tags.where(F.col("side") == s).select(*on, "id", *[F.col(c).alias(f"{c}_{s[0]}") for c in ("kind", "copy_of", "data_ref", "can_delete", "type")]) for s in ("source", "target"))
    both = src.join(tgt, [*on, "id"])
    agree = both.where(~reduce(lambda a, b: a & b, [F.col(f"{c}_s").eqNullSafe(F.col(f"{c}_t")) for c in ("kind", "copy_of", "data_ref", "can_delete", "type")]))
    final = seg.where("state = 'final'").select(*on).distinct()
    return {
        "languages": check(files, ~T.is_language(F.col("src_lang")) | (F.col("trg_lang").isNotNull() & ~T.is_language(F.col("trg_lang"))), "doc_id", "languages", "bad language"),
        "file_unique": unique(files, ["doc_id", "file_id"], "file_unique"),
        "skeleton": check(files, F.col("skeleton_href").isNotNull() & F.col("skeleton_text").isNotNull(), "doc_id", "skeleton", "both reference and content"),
        "segment_unique": unique(segments, [*on, "segment_id"], "segment_unique"),
        "state": check(seg, F.col("state").isNotNull() & ~F.col("state").isin(*STATES), "_place", "state", "unknown state"),
        "state_target": check(seg, F.col("state").isNotNull() & (F.col("state") != "initial") & F.col("target").isNull(), "_place", "state_target", "state needs a target"),
        "sub_state": check(seg, F.col("sub_state").isNotNull() & (F.col("state").isNull() | ~F.col("sub_state").rlike("^[^:]+:.+$")), "_place", "sub_state", "sub-state needs a state and a prefix"),
        "target_language": check(wide, F.col("target").isNotNull() & F.col("trg_lang").isNull(), "_place", "target_language", "a target needs the target language"),
        "content_language": check(wide, (F.lower("source_lang") != F.lower("src_lang")) | (F.lower("target_lang") != F.lower("trg_lang")), "_place", "content_language", "language differs"),
        "order_unique": unique(orders, [*on, "target_order"], "order_unique"),
        "order_range": _rows(n.where("_m > _n"), "order_range", F.concat_ws("/", *on), "order beyond the segments"),
        "data_unique": unique(data, [*on, "id"], "data_unique"),
        "tag_unique": unique(codes.where("side = 'source' and id is not null"), [*on, "id"], "tag_unique"),
        "copy_or_data": check(tag, F.col("copy_of").isNotNull() & F.col("data_ref").isNotNull(), "_place", "copy_or_data", "both copyOf and dataRef"),
        "data_ref": refers(tags, "data_ref", data, "id", "data_ref", on),
        "type": check(tag, F.col("kind").isin("ph", "pc", "sc", "ec") & F.col("type").isNotNull() & ~F.col("type").isin("fmt", "ui", "quote", "link", "image", "other"), "_place", "type", "unknown type"),
        "sub_type": check(tag, F.col("sub_type").isNotNull() & (F.col("type").isNull() | ~F.col("sub_type").rlike("^[^:]+:.+$")), "_place", "sub_type", "sub-type needs a type and a prefix"),
        "isolated": check(tag, (F.col("kind") == "ec") & F.coalesce("isolated", F.lit(False)) & F.col("id").isNull(), "_place", "isolated", "isolated ec needs an id"),
        "start_ref": refers(ends, "start_ref", tags.where("kind = 'sc'"), "id", "start_ref", on),
        "em_ref": refers(tags.where("kind = 'em'"), "start_ref", tags.where("kind = 'sm'"), "id", "em_ref", on),
        "closed": _rows(open_, "closed", F.concat_ws("/", *on, "side", "id"), "sc without ec"),
        "kept": _rows(fixed.join(final, on, "left_semi"), "kept", F.concat_ws("/", *on, "id"), "tag that can't be deleted isn't in the target"),
        "agreement": _rows(agree.join(final, on, "left_semi"), "agreement", F.concat_ws("/", *on, "id"), "source and target tags differ"),
    }


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rules.values())


def verdict(rules: dict[str, DataFrame]) -> DataFrame:
    """One row: valid, and the first reason by place and rule."""
    first = F.min(F.struct("place", "rule", "reason"))
    return violations(rules).agg((F.count(F.lit(1)) == 0).alias("valid"), first["reason"].alias("reason"))

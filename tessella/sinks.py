"""Writers: bilingual files, translation memories and reports as text columns, made by expressions, a row for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def escape(text: Column) -> Column:
    """Text as XML content; null as nothing."""
    t = F.coalesce(text, F.lit(""))
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(raw), F.lit(coded))
    return t


def _attribute(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), escape(value), F.lit('"'))).otherwise("")


def _element(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), escape(value), F.lit(f"</{name}>"))).otherwise("")


def _gathered(rows: DataFrame, by: list[str], order: list[str], text: Column, head: Column, tail: str) -> DataFrame:
    """(by, text): each group's texts in order, between head and tail."""
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], text.alias("x"))))
    return rows.groupBy(*by).agg(F.concat(F.first(head), F.array_join(F.transform(items, lambda s: s["x"]), ""), F.lit(tail)).alias("text"))


def xliff_1(segments: DataFrame, src_lang: str, tgt_lang: str | None = None) -> DataFrame:
    """(doc_id, text): files of version 1.2 from doc_id, original, pos, unit_id, source, target, approved and translate."""
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("no")
    unit = F.concat(F.lit("<trans-unit"), _attribute("id", F.col("unit_id")), _attribute("approved", yes(F.col("approved"))), _attribute("translate", yes(F.col("translate"))), F.lit(' xml:space="preserve">'), _element("source", F.col("source")), _element("target", F.col("target")), F.lit("</trans-unit>\n"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2">\n<file'), _attribute("original", F.col("original")), F.lit(f' source-language="{src_lang}"' + (f' target-language="{tgt_lang}"' if tgt_lang else "") + ' datatype="plaintext">\n<body>\n'))
    return _gathered(segments, ["doc_id"], ["pos"], unit, head, "</body>\n</file>\n</xliff>\n")


def xliff_2(segments: DataFrame, src_lang: str, tgt_lang: str | None = None, version: str = "2.0") -> DataFrame:
    """(doc_id, text): files of version 2 from doc_id, original, pos, unit_id, source, target, state and translate, a segment in each unit."""
    state = F.coalesce("state", F.when(F.coalesce("approved", F.lit(False)), "final").when(F.length("target") > 0, "translated").otherwise("initial"))
    unit = F.concat(F.lit("<unit"), _attribute("id", F.col("unit_id")), F.when(F.coalesce("translate", F.lit(True)), "").otherwise(' translate="no"'), F.lit("><segment"), _attribute("state", state), F.lit(">"), _element("source", F.col("source")), _element("target", F.col("target")), F.lit("</segment></unit>\n"))
    head = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="{version}" xmlns="urn:oasis:names:tc:xliff:document:2.0" srcLang="{src_lang}"' + (f' trgLang="{tgt_lang}"' if tgt_lang else "") + '>\n<file id="1"'), _attribute("original", F.col("original")), F.lit(">\n"))
    return _gathered(segments, ["doc_id"], ["pos"], unit, head, "</file>\n</xliff>\n")


def tmx(units: DataFrame, by: list[str], src_lang: str) -> DataFrame:
    """(by, text): TMX 1.4 from transforms.tmx_units with the columns by."""
    variant = lambda lang, seg: F.concat(F.lit("<tuv"), _attribute("xml:lang", F.col(lang)), F.lit("><seg>"), escape(F.col(seg)), F.lit("</seg></tuv>"))
    unit = F.concat(F.lit("<tu"), _attribute("tuid", F.col("tuid")), _attribute("creationdate", F.col("created")), F.lit(">"), variant("source_lang", "seg_src"), variant("target_lang", "seg_tgt"), F.lit("</tu>\n"))
    head = F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4">\n<header creationtool="tessella" creationtoolversion="1" srclang="{src_lang}" adminlang="en" datatype="xml" o-tmf="unknown" segtype="block"/>\n<body>\n')
    return _gathered(units, by, ["tuid"], unit, head, "</body>\n</tmx>\n")


def html_table(report: DataFrame, title: str, order: str) -> DataFrame:
    """One row of HTML: a report as a table, in the order of a column; a report has a line for each file."""
    cells = lambda tag, values: F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), escape(v.cast("string")), F.lit(f"</{tag}>")) for v in values], F.lit("</tr>\n"))
    line = cells("td", [F.col(c) for c in report.columns])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))), lambda s: s["x"]), "")
    head = F.concat(F.lit(f"<h2>{title}</h2>\n<table>\n"), cells("th", [F.lit(c) for c in report.columns]))
    return report.agg(F.concat(head, lines, F.lit("</table>\n")).alias("html"))


def bar_chart(buckets: DataFrame, file: str, value: str, height: int = 100) -> DataFrame:
    """(file, svg): a bar for each bucket of analysis.chart_buckets."""
    bar = F.concat(F.lit('<rect x="'), F.col("bucket").cast("string"), F.lit('" y="'), (height - F.round(value)).cast("int").cast("string"), F.lit('" width="1" height="'), F.round(value).cast("int").cast("string"), F.lit('"/>'))
    return _gathered(buckets, [file], ["bucket"], bar, F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" height="{height}">'), "</svg>").withColumnRenamed("text", "svg")


def target_name(path: Column, lang: Column, originals: Column) -> Column:
    """Where a merged document goes: name_lang.ext of one original, a folder of the language for several; return packages by their extension."""
    renamed = F.regexp_replace(path, r"\.sdlppx$", ".sdlrpx")
    single = F.when(renamed.rlike(r"\.[^./\\]+$"), F.concat(F.regexp_extract(renamed, r"^(.*)(\.[^./\\]+)$", 1), F.lit("_"), lang, F.regexp_extract(renamed, r"^(.*)(\.[^./\\]+)$", 2))).otherwise(F.concat(renamed, F.lit("_"), lang))
    return F.when(originals == 1, single).otherwise(F.concat(F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1), F.lit("/"), lang))


def relative_path(home: Column, path: Column) -> Column:
    """path as seen from the folder of the file home."""
    a, b = F.split(F.regexp_replace(home, r"[/\\][^/\\]*$", ""), r"[/\\]"), F.split(path, r"[/\\]")
    n = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b) - 1)), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    return F.concat(F.repeat(F.lit("../"), F.size(a) - n), F.array_join(F.slice(b, n + 1, F.size(b)), "/"))



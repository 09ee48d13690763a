"""Command line: python -m tessella TOOL ..., each tool one plan; tables are Parquet."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from . import pipelines, sinks, sources
from .operators import constraints, relations, transforms
from .sources import detect

EDITS = {"approveall": transforms.approve_all, "copysources": transforms.copy_sources, "pseudotranslate": transforms.pseudo_translate, "removetargets": transforms.remove_targets}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tessella")
    tools = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, *needed: str, **optional):
        t = tools.add_parser(name)
        for n in needed:
            t.add_argument(f"-{n}", required=True)
        for n, default in optional.items():
            t.add_argument(f"-{n}", default=default, **({"action": "store_true"} if default is False else {}))

    tool("types")
    tool("versions")
    tool("convert", "file", "srcLang", "out", type=None, paragraph=False)
    tool("merge", "tables", "out", unapproved=False)
    tool("analysis", "segments", "srcLang", "out")
    tool("icematches", "old", "new", "out")
    tool("compare", "file1", "file2", "out")
    tool("join", "files", "target")
    tool("exporttmx", "segments", "srcLang", "tgtLang", "out")
    tool("toxliff", "segments", "srcLang", "out", tgtLang=None, version="2.0")
    for name in EDITS:
        tool(name, "segments", "out")
    return top


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    read = lambda path: spark.read.parquet(path)
    write = lambda df, path: df.write.parquet(path)
    if a.tool == "convert":
        from . import srx

        parts, segments = pipelines.convert(spark, a.file, a.srcLang, a.type, None if a.paragraph else srx.DEFAULT)
        write(parts, f"{a.out}/parts")
        write(segments, f"{a.out}/segments")
    elif a.tool == "merge":
        write(pipelines.merge(read(f"{a.tables}/parts"), read(f"{a.tables}/segments"), a.unapproved), a.out)
    elif a.tool == "analysis":
        for name, report in pipelines.analyse(read(a.segments), a.srcLang).items():
            write(report, f"{a.out}/{name}")
    elif a.tool == "icematches":
        write(relations.in_context_matches(read(a.old), read(a.new)), a.out)
    elif a.tool == "compare":
        x, y = read(a.file1), read(a.file2)
        by = [c for c in ("doc_id", "file_no", "pos", "seg_no") if c in x.columns]
        write(relations.compare(x, y, by, ["source", "target"]), a.out)
    elif a.tool == "join":
        write(relations.join_files([read(p) for p in a.files.split(",")]), a.target)
    elif a.tool == "exporttmx":
        write(pipelines.export_tmx(read(a.segments), a.srcLang, a.tgtLang), a.out)
    elif a.tool == "toxliff":
        made: DataFrame = sinks.xliff_2(read(a.segments), a.srcLang, a.tgtLang, a.version) if a.version.startswith("2") else sinks.xliff_1(read(a.segments), a.srcLang, a.tgtLang)
        write(made, a.out)
    else:
        write(EDITS[a.tool](read(a.segments)), a.out)


def main() -> None:
    a = parser().parse_args()
    if a.tool == "types":
        print(json.dumps({"types": [{"code": c, "name": n, "bilingual": c in detect.BILINGUAL, "reader": c in {*sources.TEXT_FORMATS, *sources.BINARY_FORMATS}} for c, n in detect.NAMES.items()]}))
    elif a.tool == "versions":
        print(json.dumps({"versions": list(constraints.VERSIONS)}))
    else:
        run(SparkSession.builder.appName(f"tessella {a.tool}").getOrCreate(), a)


if __name__ == "__main__":
    main()

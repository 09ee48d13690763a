"""The reader's frame: parts, registry of formats, scan and segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.relations import chosen_text, merge_documents
from .detect import decode_bytes, detect


@dataclass
class Part:
    """Literal text of a document (unit None), or the place of a segment with what is known of it."""

    literal: str = ""
    unit: str | None = None
    source: str | None = None
    target: str | None = None
    approved: bool = False
    translate: bool = True
    state: str | None = None
    resname: str | None = None
    notes: list[str] = field(default_factory=list)
    attrs: dict[str, str] = field(default_factory=dict)


Parser = Callable[[str], list[Part]]
TEXT_FORMATS: dict[str, Parser] = {}
BINARY_FORMATS: dict[str, Callable[[bytes], list[tuple[str, list[Part]]]]] = {}
#: What the writer does to a text on its way into the document, by format.
ENCODERS: dict[str, Callable[[str], str]] = {}
#: Which text of a segment is written, by format; approved where not listed.
POLICY = {"JS": "strict", "RC": "strict", "PO": "always", "TXML": "always", "SDLXLIFF": "always", "TS": "always", "TXLF": "keep_original", "XLIFF": "keep_original"}


def text_format(name: str, encoder: Callable[[str], str] | None = None):
    def add(f: Parser) -> Parser:
        TEXT_FORMATS[name] = f
        if encoder:
            ENCODERS[name] = encoder
        return f

    return add


def numbered(parts: list[Part]) -> list[Part]:
    """Joins neighbouring literals and gives segments without a name their number."""
    out: list[Part] = []
    n = 0
    for p in parts:
        if p.unit is None:
            if not p.literal:
                continue
            if out and out[-1].unit is None:
                out[-1].literal += p.literal
                continue
        elif p.unit == "":
            p.unit = str(n)
        n += p.unit is not None
        out.append(p)
    return out


def parse(content: bytes, format: str, encoding: str | None = None) -> list[tuple[str, list[Part]]]:
    """(file within the document, parts) of a document: one file, but for packages."""
    if format in BINARY_FORMATS:
        return [(name, numbered(parts)) for name, parts in BINARY_FORMATS[format](content)]
    return [("", numbered(TEXT_FORMATS[format](decode_bytes(content, format, encoding))))]


PARTS = "doc_id string, file_no int, original string, format string, part_no int, kind string, literal string, ref_id string, source string, target string, approved boolean, translate boolean, state string, resname string, notes array<string>, attrs map<string,string>, error string"
_SCHEMA = pa.schema([
    ("doc_id", pa.string()), ("file_no", pa.int32()), ("original", pa.string()), ("format", pa.string()), ("part_no", pa.int32()), ("kind", pa.string()), ("literal", pa.string()), ("ref_id", pa.string()), ("source", pa.string()), ("target", pa.string()),
    ("approved", pa.bool_()), ("translate", pa.bool_()), ("state", pa.string()), ("resname", pa.string()), ("notes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("error", pa.string()),
])


def _rows(doc_id: str, content: bytes, format: str | None, encoding: str | None) -> Iterator[tuple]:
    try:
        kind = format or detect(content, doc_id)
        if kind is None or kind not in TEXT_FORMATS and kind not in BINARY_FORMATS:
            raise ValueError(f"no reader for {kind}")
        for n, (name, parts) in enumerate(parse(content, kind, encoding)):
            for k, p in enumerate(parts):
                place = p.unit is not None
                yield doc_id, n, name or doc_id, kind, k, "ref" if place else "literal", None if place else p.literal, p.unit, p.source, p.target, p.approved, p.translate, p.state, p.resname, p.notes, list(p.attrs.items()), None
    except Exception as e:  # a damaged document is a row that says so, not a failed job
        yield (doc_id, 0, doc_id, format, 0, "error", *[None] * 4, *[None] * 6, f"{type(e).__name__}: {e}"[:500])


def parts_of(documents: DataFrame, format: str | None = None, encoding: str | None = None, id: str = "path", content: str = "content") -> DataFrame:
    """Parts of documents given as rows of an id and their bytes (or text). format None: each is detected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # null content is an error row too
                rows = list(_rows(doc_id, raw, format, encoding)) if raw is not None else [(doc_id, 0, doc_id, format, 0, "error", *[None] * 10, "no content")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return documents.select(F.col(id).cast("string"), F.col(content).cast("binary")).mapInArrow(run, PARTS)


def read(spark: SparkSession, path: str, format: str | None = None, encoding: str | None = None) -> DataFrame:
    """Parts of all files under a path (globs allowed); every file is one task's row, so it has to fit in memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parts_of(files.select("path", "content"), format, encoding)


def segments_of(parts: DataFrame) -> DataFrame:
    """Segments in the order of their places."""
    return parts.where("kind = 'ref'").select("doc_id", "file_no", "original", "format", F.col("part_no").alias("pos"), F.col("ref_id").alias("unit_id"), "source", "target", "approved", "translate", "state", "resname", "notes", "attrs")


def _to_mif(text: Column) -> Column:
    """Text as string statements, markup lines between them as they were."""
    coded = text
    for said, written in (("\\", "\\\\"), ("\t", "\\t"), (">", "\\>"), ("'", "\\q"), ("`", "\\Q")):
        coded = F.replace(coded, F.lit(said), F.lit(written))
    return F.concat(F.lit("<String `"), coded, F.lit("'>"))


def _to_mif_lines(text: Column) -> Column:
    pieces = F.filter(F.split(text, "(?=<ph>)|(?<=</ph>)"), lambda p: p != "")
    tag = lambda p: F.startswith(p, F.lit("<ph>")) & F.endswith(p, F.lit("</ph>"))
    one = lambda p: F.when(tag(p), F.regexp_replace(p, "^<ph>\\n*|\\n*</ph>$", "")).otherwise(_to_mif(p))
    return F.array_join(F.transform(pieces, one), "\n")


def _to_php(text: Column) -> Column:
    """Quoted as the string in the document was."""
    quote = F.coalesce(F.col("attrs")["quote"], F.lit("'"))
    return F.replace(text, quote, F.concat(F.lit("\\"), quote))


#: ENCODERS as expressions over a part's columns.
COLUMN_ENCODERS: dict[str, Callable[[Column], Column]] = {
    "JAVA": T.escape_unicode,
    "JSON": lambda x: _to_json(x),
    "PHPA": _to_php,
    "MIF": _to_mif_lines,
    "INX": lambda x: F.replace(x, F.lit("_"), F.lit("~sep~")),
}


def _to_json(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(7), F.length(whole) - 8)


def encoded(text: Column) -> Column:
    """A text on its way into a document of the part's format."""
    out = None
    for name, encode in COLUMN_ENCODERS.items():
        here = F.col("format") == name
        out = F.when(here, encode(text)) if out is None else out.when(here, encode(text))
    return out.otherwise(text)


def _policy() -> Column:
    """The text that a part's format wants."""
    names = {"source": "_source", "target": "_target", "approved": "_approved", "original": "_original"}
    out = chosen_text("approved", **names)
    for policy in sorted(set(POLICY.values())):
        out = F.when(F.col("format").isin(*[f for f, p in POLICY.items() if p == policy]), chosen_text(policy, **names)).otherwise(out)
    return out


def merge_text(parts: DataFrame, segments: DataFrame, policy: str | None = None) -> DataFrame:
    """(doc_id, file_no, text) of documents with the segments' texts in their places, encoded as each document's format wants.

    policy None: that of each format. All formats are merged in one plan.
    """
    good = parts.where("kind <> 'error'").withColumn("_original", F.coalesce("target", "source"))
    names = {"source": "_source", "target": "_target", "approved": "_approved", "original": "_original"}
    return merge_documents(good, segments, chosen_text(policy, **names) if policy else _policy(), ("doc_id", "file_no"), encoded)


def write(parts: DataFrame, segments: DataFrame, path: str, policy: str | None = None) -> None:
    """Writes merged documents as a table of (doc_id, file_no, text) in Parquet under path."""
    merge_text(parts, segments, policy).write.parquet(path)

"""Canonical tables.

`segments` holds one row per segment in document order, `parts` the pieces of a source document: literal text and places of
segments. Order is data: every operator that depends on it carries (file_no, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = "struct<kind:string,id:string,text:string>"
TOKENS = f"array<{TOKEN}>"
MATCH = "struct<origin:string,quality:string,source:string,target:string>"
SEGMENTS = (
    f"doc_id string, file_no int, original string, pos int, unit_id string, seg_no int, is_ignorable boolean, translate boolean, "
    f"preserve_space boolean, approved boolean, state string, state_qualifier string, source {TOKENS}, target {TOKENS}, "
    f"matches array<{MATCH}>, notes array<string>, attrs map<string,string>"
)
PARTS = "doc_id string, file_no int, part_no int, kind string, literal string, ref_id string"
#: Elements whose content is text to translate; all others stand for markup.
CONTAINERS = ("g", "mrk", "hi", "sub", "pc")


def text_tokens(text: Column) -> Column:
    """Tokens of a plain text; null stays null."""
    return F.when(text.isNotNull(), F.array(F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("id"), text.alias("text"))))


def plain(tokens: Column, *kinds: str) -> Column:
    """The text of tokens of the kinds (text by default), end to end."""
    kinds = kinds or ("text",)
    return F.array_join(F.transform(F.filter(tokens, lambda t: t["kind"].isin(*kinds)), lambda t: t["text"]), "")


def marked(tokens: Column) -> Column:
    """A canonical spelling of tokens, equal for equal markup and text."""
    return F.array_join(F.transform(tokens, lambda t: F.concat_ws("\u0001", t["kind"], F.coalesce(t["id"], F.lit("")), F.coalesce(t["text"], F.lit("")))), "\u0002")

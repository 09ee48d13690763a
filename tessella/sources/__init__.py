"""Readers: files of each format as parts (literal text and places) and segments.

A parser is a function text -> list of Part. read() scans files as binary, detects encodings, and runs the parsers in Arrow batches;
parts and segments come from one pass, so a document can be put together again with merge_documents().
"""

from __future__ import annotations

from . import lines, markup, packages  # noqa: F401  (they register their formats)
from .core import BINARY_FORMATS, TEXT_FORMATS, Part, merge_text, parse, parts_of, read, segments_of, write  # noqa: F401

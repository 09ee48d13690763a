"""Format and encoding of a document by its head."""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, functions as F

HEAD = 40_960
NAMES = {
    "INX": "Adobe InDesign Interchange", "ICML": "Adobe InCopy ICML", "IDML": "Adobe InDesign IDML", "DITA": "DITA Map", "HTML": "HTML Page", "JS": "JavaScript", "JAVA": "Java Properties", "JSON": "JSON", "MIF": "MIF (Maker Interchange Format)",
    "OFF": "Microsoft Office 2007 Document", "OO": "OpenOffice Document", "TEXT": "Plain Text", "PO": "PO (Portable Objects)", "PHPA": "PHP Array", "QTI": "QTI (IMS Question and Test Interoperability)", "QTIP": "QTI Package", "RC": "RC (Windows C/C++ Resources)",
    "RESX": "ResX (Windows .NET Resources)", "SDLPPX": "Trados Studio Package", "SDLXLIFF": "SDLXLIFF Document", "SRT": "SRT Subtitle", "TS": "TS (Qt Linguist translation source)", "TXML": "TXML Document", "TXLF": "Wordfast/GlobalLink XLIFF", "WPML": "WPML XLIFF", "XLIFF": "XLIFF Document", "XML": "XML Document", "XMLG": "XML (Generic)",
}
BILINGUAL = ("PO", "SDLPPX", "SDLXLIFF", "TS", "TXML", "TXLF", "WPML", "XLIFF")
_RC = ("STRINGTABLE", "DIALOG", "DIALOGEX", "MENU", "MENUEX", "POPUP", "DLGINIT", "ICON", "CONTROL", "VERSIONINFO")


def bom(content: bytes) -> str | None:
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if content.startswith(mark):
            return name
    return None


def encoding_of(content: bytes, format: str) -> str | None:
    """Name of the encoding that a document of the format has; None where nothing tells."""
    if format in ("OFF", "OO", "ICML", "IDML", "PO", "SDLPPX", "QTIP", "SDLXLIFF"):
        return "utf-8"
    if format == "MIF":
        return "us-ascii"
    if format == "JAVA":
        return "iso-8859-1"
    if found := bom(content):
        return found
    head = content[:HEAD].decode("latin-1")
    if format == "RC":
        m = re.search(r"code_page\((\d+)\)", head)
        return f"cp{m[1]}" if m else None
    if format == "HTML" and (m := re.search(r"<meta[^>]*charset\s*=\s*[\"']?([\w-]+)", head, re.I)):
        return m[1].lower()
    if format in ("SRT", "PHPA", "JSON", "HTML"):
        return "utf-8"
    if format in ("TEXT", "JS"):
        return None
    m = re.match(r"<\?xml[^>]*encoding\s*=\s*[\"']([\w.-]+)", head)
    return m[1].lower() if m else "utf-8"


def decode_bytes(content: bytes, format: str, encoding: str | None = None) -> str:
    name = encoding or encoding_of(content, format) or "utf-8"
    try:
        return content.decode(name)
    except (UnicodeDecodeError, LookupError):
        return content.decode("latin-1" if name not in ("utf-8", "us-ascii") else "utf-8", "replace")


def _parses(content: bytes) -> bool:
    try:
        ElementTree.fromstring(content)
        return True
    except (ElementTree.ParseError, ValueError, LookupError):
        return False


def detect(content: bytes, name: str = "") -> str | None:
    """Code of the format, by the first rule that holds. Plain text and JavaScript look like nothing in particular."""
    s = content[:HEAD].decode("utf-16" if bom(content) == "utf-16" else "utf-8", "replace").lstrip("﻿")
    has = s.__contains__
    if s.startswith("<MIFFile"):
        return "MIF"
    if has('="http://www.imsglobal.org') and not has("<xliff "):
        return "QTI"
    if has("<xliff "):
        for mark, kind in (("xmlns:sdl", "SDLXLIFF"), ("xmlns:gs4tr", "TXLF"), ("<![CDATA[", "WPML")):
            if has(mark):
                return kind
        if _parses(content):
            return "XLIFF"
    if s.startswith("<?php"):
        return "PHPA"
    if s.startswith("<?xml"):
        if has("<txml "):
            return "TXML"
        if has("<docu") and has("<?aid "):
            return "INX"
        if has("xmlns:msdata") and has("<root"):
            return "RESX"
        if has("!DOCTYPE TS>"):
            return "TS"
        if has("<?xml-model") and has("tc:dita:rng") or any(map(has, ("<map", "<bookmap", "<!DOCTYPE map", "<!DOCTYPE bookmap "))):
            return "DITA"
        return "ICML" if has("<?aid ") or has("<Document ") else "XML"
    if s.startswith("<svg"):
        return "XML"
    if has("<!DOCTYPE TS>"):
        return "TS"
    if s.startswith("<!DOCTYPE"):
        return "HTML" if has("-//IETF//DTD HTML") or has("-//W3C//DTD HTML") or has(" html") else "XML"
    if has("msgid") and has("msgstr"):
        return "PO"
    if "<html" in s.lower():
        return "HTML"
    if content[:2] == b"PK":
        try:
            for entry in zipfile.ZipFile(io.BytesIO(content)).namelist():
                for tail, kind in (("content.xml", "OO"), ("designmap.xml", "IDML"), ("imsmanifest.xml", "QTIP"), ("[Content_Types].xml", "OFF")):
                    if entry == tail:
                        return kind
                if entry.endswith(".sdlproj"):
                    return "SDLPPX"
        except zipfile.BadZipFile:
            return None
        return None
    if any(re.search(rf"\b{w}\b", s) for w in _RC):
        return "RC"
    if has("<") and _parses(content):
        return "XML"
    if " --> " in s and ":" in s:
        return "SRT"
    if s.lstrip()[:1] in ("{", "["):
        try:
            json.loads(content)
            return "JSON"
        except ValueError:
            pass
    return {".properties": "JAVA", ".rc": "RC"}.get(re.sub(r"^.*(\.\w+)$", r"\1", name.lower()))


def detect_text(text: Column) -> Column:
    """detect() of the formats that a head of text alone tells, as an expression; null where it tells none."""
    s = F.substring(text, 1, HEAD)
    has = lambda x: F.contains(s, F.lit(x))
    starts = lambda x: s.startswith(x)
    dita = has("<?xml-model") & has("tc:dita:rng") | has("<map") | has("<bookmap") | has("<!DOCTYPE map") | has("<!DOCTYPE bookmap ")
    xml = F.when(has("<txml "), "TXML").when(has("<docu") & has("<?aid "), "INX").when(has("xmlns:msdata") & has("<root"), "RESX").when(has("!DOCTYPE TS>"), "TS").when(dita, "DITA").when(has("<?aid ") | has("<Document "), "ICML").otherwise("XML")
    return (
        F.when(starts("<MIFFile"), "MIF").when(has('="http://www.imsglobal.org') & ~has("<xliff "), "QTI")
        .when(has("<xliff ") & has("xmlns:sdl"), "SDLXLIFF").when(has("<xliff ") & has("xmlns:gs4tr"), "TXLF").when(has("<xliff ") & has("<![CDATA["), "WPML").when(has("<xliff "), "XLIFF")
        .when(starts("<?php"), "PHPA").when(starts("<?xml"), xml).when(starts("<svg"), "XML").when(has("<!DOCTYPE TS>"), "TS")
        .when(starts("<!DOCTYPE"), F.when(has("-//IETF//DTD HTML") | has("-//W3C//DTD HTML") | has(" html"), "HTML").otherwise("XML"))
        .when(has("msgid") & has("msgstr"), "PO").when(F.contains(F.lower(s), F.lit("<html")), "HTML")
        .when(s.rlike("\\b(?:" + "|".join(_RC) + ")\\b"), "RC").when(has(" --> ") & has(":"), "SRT").when(s.rlike("^\\s*[{\\[]"), "JSON")
    )

"""Readers of zip packages: each entry with text is a file of the document, its other entries are kept as they are."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

from .core import BINARY_FORMATS, Part
from .detect import detect
from .markup import Config, icml, sdlxliff, xml_document

_SKIP = re.compile(r"slideMaster|slideLayout|handoutMaster|notesMaster|manifest|\[Content_Types\]|_rels/|docProps/|theme|settings|styles|fontTable|webSettings")
_NUMBER = re.compile(r"^\s*[$€£¥]?\s*[+-]?[0-9][0-9.,]*\s*[%$€£¥]?\s*$")
_INLINE = frozenset({"text:span", "text:a", "text:s", "text:tab", "text:line-break"})


def entries(content: bytes) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]


def slide_key(name: str) -> tuple:
    """Order of office entries: slides by number, then notes, then the rest as they come."""
    m = re.search(r"(slides/slide|notesSlides/notesSlide)(\d+)\.xml$", name)
    return (0 if m and m[1].startswith("slides") else 1 if m else 2, int(m[2]) if m else 0)


def office_part(text: str) -> list[Part]:
    """Paragraphs of Word and slides, shared strings of Excel: their runs' text, numbers left out, as one segment each."""
    out, at = [], 0
    for p in re.finditer(r"<(w:p|a:p|si)\b(?:[^>]*[^/])?>(.*?)</\1>", text, re.S):
        body = re.sub(r"<rPh\b.*?</rPh>", lambda m: " " * len(m[0]), p[2], flags=re.S)
        runs = [m for m in re.finditer(r"<(w:t|a:t|t)\b[^>]*?>([^<]*)</\1>", body) if m[2]]
        said = "".join(m[2] for m in runs)
        if not said.strip() or _NUMBER.match(said):
            continue
        begin, end = p.start(2) + runs[0].start(2), p.start(2) + runs[-1].end(2)
        out += [Part(text[at:begin]), Part(unit="", source=text[begin:end])]
        at = end
    return [*out, Part(text[at:])]


def _walk(content: bytes, wanted: Callable[[str], bool], parse: Callable[[str], list[Part]], key=None) -> list[tuple[str, list[Part]]]:
    found = [(n, raw) for n, raw in entries(content) if wanted(n)]
    if key:
        found.sort(key=lambda x: key(x[0]))
    out = [(n, parse(raw.decode("utf-8", "replace"))) for n, raw in found]
    return [(n, parts) for n, parts in out if any(p.unit is not None for p in parts)]


def office(content: bytes) -> list[tuple[str, list[Part]]]:
    return _walk(content, lambda n: n.endswith(".xml") and not _SKIP.search(n), office_part, slide_key)


def open_office(content: bytes) -> list[tuple[str, list[Part]]]:
    c = Config(segment=frozenset({"text:p", "text:h"}), inline=_INLINE)
    return _walk(content, lambda n: n in ("content.xml", "styles.xml", "meta.xml"), lambda t: xml_document(t, c))


def idml(content: bytes) -> list[tuple[str, list[Part]]]:
    """Stories in the order of the design map; those it doesn't list are left out."""
    listed = dict(entries(content)).get("designmap.xml", b"").decode("utf-8", "replace")
    order = re.findall(r"src=\"([^\"]*Story_[^\"]*\.xml)\"", listed)
    return _walk(content, order.__contains__, icml, order.index)


def trados(content: bytes) -> list[tuple[str, list[Part]]]:
    return _walk(content, lambda n: n.endswith(".sdlxliff"), sdlxliff)


def package_languages(content: bytes) -> list[tuple[str, str]]:
    """Distinct (source, target) languages of a Trados package's project."""
    out: list[tuple[str, str]] = []
    for name, raw in entries(content):
        if name.endswith(".sdlproj"):
            for m in re.finditer(r"<LanguageDirection\b[^>]*>", raw.decode("utf-8-sig", "replace")):
                pair = tuple((re.search(rf"{k}LanguageCode=\"([^\"]*)\"", m[0]) or ["", ""])[1] for k in ("Source", "Target"))
                if pair not in out:
                    out.append(pair)
    return out


def qti_package(content: bytes) -> list[tuple[str, list[Part]]]:
    """Every .xml and .svg entry that is XML; the package must have its manifest."""
    if not any(n == "imsmanifest.xml" for n, _ in entries(content)):
        raise ValueError("no imsmanifest.xml")
    kinds = {n: detect(raw, n) for n, raw in entries(content) if n.endswith((".xml", ".svg"))}
    return _walk(content, lambda n: kinds.get(n) in ("QTI", "XML") and n != "imsmanifest.xml", xml_document)


BINARY_FORMATS.update({"OFF": office, "OO": open_office, "IDML": idml, "SDLPPX": trados, "QTIP": qti_package})


def rebuild(content: bytes, texts: dict[str, str]) -> bytes:
    """The package with the texts of some entries replaced, in its order."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for i in z.infolist():
            w.writestr(i, texts[i.filename].encode() if i.filename in texts else z.read(i))
    return out.getvalue()


def return_package(content: bytes, texts: dict[str, str]) -> bytes:
    """A Trados package as the package that is sent back: with its translated entries, and a project of that type."""
    done = dict(texts)
    for name, raw in entries(content):
        if name.endswith(".sdlproj"):
            done[name] = re.sub(r'PackageType="[^"]*"', 'PackageType="ReturnPackage"', raw.decode("utf-8-sig"))
    return rebuild(content, done)

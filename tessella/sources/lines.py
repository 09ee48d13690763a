"""Readers of formats made of lines and quoted strings."""

from __future__ import annotations

import json
import re
from typing import Any

from .core import Part, text_format

_HEX = re.compile(r"\\u([0-9A-Fa-f]{4})")


@text_format("TEXT")
def text_paragraphs(text: str) -> list[Part]:
    """A segment for each run of lines that aren't blank."""
    out = []
    for piece in re.split(r"(\n[^\S\n]*(?:\n[^\S\n]*)+(?=\n|\Z)|\n[^\S\n]*\n)", text):
        if piece.strip():
            lead = piece[: len(piece) - len(piece.lstrip("\n"))]
            body = piece[len(lead) :]
            tail = body[len(body.rstrip("\n")) :]
            out += [Part(lead), Part(unit="", source=body[: len(body) - len(tail)]), Part(tail)]
        else:
            out.append(Part(piece))
    return out


def text_lines(text: str) -> list[Part]:
    """A segment for each line that isn't blank."""
    return [Part(unit="", source=x) if x.strip() else Part(x) for x in re.split(r"(\n)", text)]


def _to_latin(text: str) -> str:
    return "".join(c if ord(c) < 256 else f"\\u{ord(c):04x}" for c in text.replace("\n", "\\n"))


@text_format("JAVA", _to_latin)
def java_properties(text: str) -> list[Part]:
    """Values by key; comments, blank lines and lines without = are literal, a backslash at the end joins lines."""
    out, lines = [], text.split("\n")
    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if line.strip() and not line.strip().startswith("#"):
            while line.endswith("\\") and k < len(lines):
                line += "\n" + lines[k]
                k += 1
        key, equals, value = line.partition("=")
        if equals and line.strip() and not line.strip().startswith("#") and value.strip():
            value = _HEX.sub(lambda m: chr(int(m[1], 16)), value.replace("\\n", "\n"))
            out += [Part(key + "="), Part(unit="", source=value, resname=key)]
        else:
            out.append(Part(line))
        if k < len(lines):
            out.append(Part("\n"))
    return out


@text_format("SRT")
def srt(text: str) -> list[Part]:
    """A segment for each caption, named by its number, its time as a note."""
    out, name, time, held = [], "", "", []

    def flush():
        if held:
            out.append(Part(unit=name, source="\n".join(held), notes=[time] if time else []))
            held.clear()
            return True
        return False

    for line in text.split("\n"):
        if not line.strip():
            if flush():
                out.append(Part("\n"))
            out.append(Part(line + "\n"))
        elif line.strip().isdigit() and not held:
            name = line.strip()
            out.append(Part(line + "\n"))
        elif " --> " in line:
            time = line
            out.append(Part(line + "\n"))
        else:
            held.append(line)
    flush()
    if out and out[-1].unit is None and text[-1:] != "\n":
        out[-1].literal = out[-1].literal[:-1]
    elif out and out[-1].unit is None:
        out[-1].literal = out[-1].literal[:-1]
    return out


@text_format("JS")
def javascript(text: str) -> list[Part]:
    """Quoted strings that aren't empty, line by line; comments are literal. A string that isn't closed in its line is an error."""
    out = []
    token = re.compile(r"//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[^\"'/\n]+|/|\n|[\"']")
    for m in token.finditer(text):
        piece = m.group()
        if piece in ("'", '"'):
            raise ValueError("string not closed")
        if piece[0] in "\"'" and len(piece) > 2:
            out += [Part(piece[0]), Part(unit="", source=piece[1:-1]), Part(piece[-1])]
        else:
            out.append(Part(piece))
    return out


@text_format("PHPA", lambda s: s.replace("'", "\\'"))
def php_array(text: str) -> list[Part]:
    """String values of an array, nested ones too: a string before an arrow is a key. Numbers and other values are literal."""
    start = re.search(r"array\(|return\s*\[", text)
    if not start:
        raise ValueError("no array")
    out, at = [], 0
    for m in re.compile(r"//[^\n]*|\#[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S).finditer(text, start.end()):
        piece = m.group()
        if piece[0] not in "\"'" or re.compile(r"\s*=>").match(text, m.end()):
            continue
        out += [Part(text[at : m.start() + 1]), Part(unit="", source=piece[1:-1].replace("\\" + piece[0], piece[0]), attrs={"quote": piece[0]})]
        at = m.end() - 1
    return [*out, Part(text[at:])]


_PO_STRING = r"((?:\s*\"(?:\\.|[^\"\\])*\")+)"


def _po_text(quoted: str) -> str:
    return "".join(re.findall(r"\"((?:\\.|[^\"\\])*)\"", quoted))


@text_format("PO")
def po(text: str) -> list[Part]:
    """Entries: msgid as source, msgstr as target, approved unless fuzzy or empty; plural forms are units `name [n]`."""
    out = []
    for block in re.split(r"(\n[^\S\n]*\n+)", text):
        if "msgid" not in block or re.match(r"(?:\s*#~.*\n?)+\Z", block):
            out.append(Part(block))
            continue
        fuzzy = bool(re.search(r"^#,.*\bfuzzy\b", block, re.M))
        notes = [m.strip() for m in re.findall(r"^#(?: |\.)(.*)$", block, re.M)]
        refs = " ".join(m.strip() for m in re.findall(r"^#:(.*)$", block, re.M))
        context = re.search(rf"^msgctxt{_PO_STRING}", block, re.M)
        first = re.search(rf"^msgid{_PO_STRING}", block, re.M)
        plural = re.search(rf"^msgid_plural{_PO_STRING}", block, re.M)
        attrs = {"reference": refs} if refs else {}
        if context:
            attrs["context"] = _po_text(context[1])
        if re.search(r"^#,.*(?<!no-)\bc-format\b", block, re.M):
            attrs["c-format"] = "yes"
        if first and not _po_text(first[1]):
            attrs["restype"] = "x-gettext-domain-header"
        at = 0
        for m in re.finditer(rf"^msgstr(?:\[(\d+)\])?{_PO_STRING}", block, re.M):
            quoted = m.start(2) + len(m[2]) - len(m[2].lstrip())
            out.append(Part(block[at:quoted] + '"'))
            form = m[1]
            source = _po_text((plural if form and form != "0" and plural else first)[1]) if first else ""
            target = _po_text(m[2])
            more = dict(attrs, form=form) if form is not None else dict(attrs)
            out.append(Part(unit="", source=source, target=target or None, approved=bool(target) and not fuzzy, notes=notes, attrs=more, resname=f"[{form}]" if form else None))
            out.append(Part('"'))
            at = m.end()
        out.append(Part(block[at:]))
    return out


def _to_mif(text: str) -> str:
    """Text as string statements, markup lines between them as they were."""
    coded = {"\t": "\\t", ">": "\\>", "'": "\\q", "`": "\\Q", "\\": "\\\\"}
    out = []
    for k, piece in enumerate(re.split(r"<ph>(.*?)</ph>", text, flags=re.S)):
        if k % 2:
            out.append(piece.strip("\n"))
        elif piece:
            out.append("<String `" + "".join(coded.get(c, c) for c in piece) + "'>")
    return "\n".join(out)


@text_format("MIF", _to_mif)
def mif(text: str) -> list[Part]:
    """Strings of paragraphs; lines of markup between the strings of one paragraph are tags in its segment."""
    decode = {"\\t": "\t", "\\>": ">", "\\q": "'", "\\Q": "`", "\\\\": "\\"}
    out: list[Part] = []
    stack: list[str] = []
    open_: list[str] | None = None
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        body = line.strip()
        if (m := re.match(r"<String\s+`(.*)'>", body)) and "para" in stack:
            said = re.sub(r"\\[t>qQ\\]", lambda x: decode[x.group()], m[1])
            if open_ is None:
                open_ = []
            open_.append(said)
            continue
        if m := re.match(r"<(\w+)\s*$", body):
            stack.append(m[1].lower())
        closing = body.startswith(">")
        name = stack.pop() if closing and stack else ""
        if open_ is not None and not (closing and name == "para"):
            open_.append(f"<ph>{line}</ph>")
            continue
        if open_ is not None:
            tail = []
            while open_ and open_[-1].startswith("<ph>"):
                tail.insert(0, open_.pop()[4:-5])
            out += [Part(unit="", source="".join(open_)), Part("\n"), *map(Part, tail)]
            open_ = None
        out.append(Part(line))
    return out


def words_to_text(words: list[int]) -> str:
    """Text of little-endian 16-bit words, up to its closing zero."""
    raw = b"".join(w.to_bytes(2, "little") for w in words)
    return raw.split(b"\0", 1)[0].decode("latin-1")


def text_to_words(text: str) -> list[int]:
    """The other way: with a closing zero, and another where the number of bytes would be odd. Other characters become ?."""
    raw = text.encode("latin-1", "replace") + b"\0"
    raw += b"\0" * (len(raw) % 2)
    return [int.from_bytes(raw[k : k + 2], "little") for k in range(0, len(raw), 2)]


_DLGINIT = re.compile(r"(?P<head>\w+\s*,\s*0x0*(?:403|1234)\s*,\s*)(?P<size>\d+)(?P<gap>\s*,\s*0\s*\n)(?P<data>(?:\s*(?:0x[0-9A-Fa-f]{1,4}|\"\\\\000\")\s*,?)+)")


def dialog_strings(text: str) -> list[str]:
    """Strings of the DLGINIT data of a resource file, in order."""
    return [words_to_text([int(w, 16) for w in re.findall(r"0x([0-9A-Fa-f]{1,4})", m["data"])]) for m in _DLGINIT.finditer(text)]


def replace_dialog_strings(text: str, said: list[str]) -> str:
    """The resource file with the strings of its DLGINIT data replaced, their sizes counted anew."""
    new = iter(said)

    def put(m: re.Match) -> str:
        words = text_to_words(next(new))
        return f"{m['head']}{2 * len(words)}{m['gap']}" + ", ".join(f"0x{w:04x}" for w in words) + ",\n"

    return _DLGINIT.sub(put, text)


@text_format("RC")
def rc(text: str) -> list[Part]:
    """Strings of string tables, menus, dialogs and controls; those of #include and #define lines only where defines a string."""
    out, at = [], 0
    blocks = 0
    token = re.compile(r"//[^\n]*|/\*.*?\*/|^[ \t]*#include[^\n]*|\bBEGIN\b|\bEND\b|\{|\}|L?\"(?:\"\"|\\.|[^\"\\])*\"", re.S | re.M)
    for m in token.finditer(text):
        piece = m.group()
        if piece in ("BEGIN", "{"):
            blocks += 1
        elif piece in ("END", "}"):
            blocks = max(0, blocks - 1)
        elif piece[-1:] == '"' and not piece.startswith("#"):
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            inner = piece[piece.index('"') + 1 : -1]
            shown = blocks or re.search(r"\b(POPUP|CAPTION|MENUITEM)\b|#define\s+\w+\s*$", line)
            if inner.strip() and shown and not re.search(r"\bCLASS\b|\bFONT\b", line) and not re.search(r"\b(CONTROL)\b[^\"]*\"[^\"]*\"", line):
                out += [Part(text[at : m.start() + piece.index('"') + 1]), Part(unit="", source=inner), Part('"')]
                at = m.end()
    return [*out, Part(text[at:])]


_JSON = re.compile(r"\"((?:\\.|[^\"\\])*)\"|[{}\[\]:,]|[^\s{}\[\]:,\"]+|\s+")


@text_format("JSON", lambda s: json.dumps(s, ensure_ascii=False)[1:-1])
def json_strings(text: str) -> list[Part]:
    """Every string value of a JSON document; keys, numbers and layout are literal."""
    json.loads(text)
    out, stack, key = [], [], None
    waiting = False  # whether the next string is a key
    for m in _JSON.finditer(text):
        piece = m.group()
        if piece == "{":
            stack.append("{")
            waiting = True
        elif piece == "[":
            stack.append("[")
            waiting = False
        elif piece in "}]":
            stack.pop()
            waiting = False
        elif piece == ",":
            waiting = bool(stack) and stack[-1] == "{"
        elif piece == ":":
            waiting = False
        if piece[0] == '"':
            said = json.loads(piece)
            if waiting:
                key = said
            elif said.strip():
                out += [Part('"'), Part(unit="", source=said, resname=key), Part('"')]
                continue
        out.append(Part(piece))
    return out


def json_configured(text: str, config: list[dict[str, Any]], ignorable: tuple[str, ...] = ()) -> list[dict[str, Any]]:
    """Units of objects by a configuration of sourceKey, targetKey, idKey, resnameKey, noteKey and approvedKey; objects without a
    configured source key give every string of theirs but those under ignorable keys."""
    out: list[dict[str, Any]] = []

    def walk(x: Any) -> None:
        if isinstance(x, list):
            for y in x:
                walk(y) if not isinstance(y, str) else y.strip() and out.append({"source": y})
        elif isinstance(x, dict):
            used: set[str] = set()
            for c in config:
                if isinstance(x.get(c["sourceKey"]), str):
                    unit = {"source": x[c["sourceKey"]]}
                    for name, key in (("target", "targetKey"), ("id", "idKey"), ("resname", "resnameKey"), ("note", "noteKey"), ("approved", "approvedKey")):
                        if key in c:
                            used.add(c[key])
                            if c[key] in x:
                                unit[name] = x[c[key]]
                    used.add(c["sourceKey"])
                    out.append(unit)
            for k, y in x.items():
                if k in used or k in ignorable:
                    continue
                if isinstance(y, str):
                    if y.strip():
                        out.append({"source": y, "resname": k})
                else:
                    walk(y)

    walk(json.loads(text))
    return out

"""Readers of markup: HTML, XML with or without configuration, and the bilingual XML formats.

All work on the text itself, tag by tag, so that what isn't a segment stays byte for byte what it was.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from .core import Part, text_format

TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:[^<>\[]|\[[^\]]*\])*>|<[A-Za-z_/:](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu meta nav "
    "noscript ol option optgroup p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
OPAQUE = ("script", "style")
ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def tag_name(tag: str) -> str:
    return re.match(r"</?([^\s/>]*)", tag)[1]


def attributes(tag: str) -> dict[str, str]:
    return {m[1]: html.unescape(m[2] if m[2] is not None else m[3]) for m in ATTRIBUTE.finditer(tag)}


def is_tag(token: str) -> bool:
    return len(token) > 1 and token[0] == "<" and (token[1].isalpha() or token[1] in "/_:")


def trim_edges(tokens: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Markup and blanks at the ends of a run of tokens, and what is between.

    A pair of tags around all of it goes, and tags that open and close nothing of the text; a tag at one edge stays
    where its partner is inside.
    """
    a, b = 0, len(tokens)
    text = [bool(t.strip()) and not t.startswith("<") for t in tokens]
    if not any(text):
        return tokens, [], []
    first, last = text.index(True), len(text) - 1 - text[::-1].index(True)
    partner: dict[int, int] = {}
    stack: list[int] = []
    for k, t in enumerate(tokens):
        if is_tag(t) and not t.endswith("/>"):
            if t[1] != "/":
                stack.append(k)
            elif stack and tag_name(tokens[stack[-1]]) == tag_name(t):
                partner[stack[-1]] = k
                partner[k] = stack.pop()
    while a < first and (not is_tag(tokens[a]) or a not in partner or partner[a] > last or partner[a] < first):
        a += 1
    while b > last + 1 and (not is_tag(tokens[b - 1]) or b - 1 not in partner or partner[b - 1] < first or partner[b - 1] > last):
        b -= 1
    # a pair is split by neither edge: where one half stays, so does the other
    for k in range(a):
        if k in partner and a <= partner[k] < b:
            a = k
            break
    for k in range(len(tokens) - 1, b - 1, -1):
        if k in partner and a <= partner[k] < b:
            b = k + 1
            break
    return tokens[:a], tokens[a:b], tokens[b:]


def _segment(tokens: list[str], keep: bool) -> list[Part]:
    before, inside, after = trim_edges(tokens)
    if not inside:
        return [Part("".join(tokens))]
    source = "".join(inside)
    lead, tail = source[: len(source) - len(source.lstrip())], source[len(source.rstrip()) :]
    source = source.strip()
    if not keep:
        source = re.sub(r"[ \n\t\r\f]+", " ", source)
    return [Part("".join(before) + lead), Part(unit="", source=source), Part(tail + "".join(after))]


@text_format("HTML")
def html_page(text: str) -> list[Part]:
    """A segment for the text between block tags; scripts, styles and comments are literal, inline tags part of segments."""
    out: list[Part] = []
    run: list[str] = []
    keep = 0
    opaque = ""

    def flush():
        if run:
            out.extend(_segment(run, keep > 0))
            run.clear()

    pos = 0
    while m := TOKEN.match(text, pos):
        token = m.group()
        pos = m.end()
        if not is_tag(token):
            if token.startswith(("<!", "<?")):
                flush()
                out.append(Part(token))
            else:
                run.append(token)
            continue
        name = tag_name(token).lower()
        if name in OPAQUE and token[1] != "/":
            end = re.compile(rf"</{name}\s*>", re.I).search(text, pos)
            stop = end.end() if end else len(text)
            flush()
            out.append(Part(text[m.start() : stop]))
            pos = stop
            continue
        if name in BLOCKS:
            flush()
            out.append(Part(token))
            if name in ("pre", "textarea"):
                keep = max(0, keep + (-1 if token[1] == "/" else 1))
        else:
            run.append(token)
    flush()
    return out


@dataclass
class Config:
    """What the elements of an XML vocabulary are: segments, inline markup or not to be looked into; others are structure."""

    segment: frozenset[str] = frozenset()
    inline: frozenset[str] = frozenset()
    ignore: frozenset[str] = frozenset()
    keep_space: frozenset[str] = frozenset()
    attributes: dict[str, frozenset[str]] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Config:
        """From an XML file of <tag hard-break="segment|inline|ignore" attributes="a;b" keep-format="yes|no">name</tag>."""
        from xml.etree import ElementTree

        c = {"segment": set(), "inline": set(), "ignore": set()}
        keep, attrs = set(), {}
        for tag in ElementTree.parse(path).getroot().iter("tag"):
            name = (tag.text or "").strip()
            c[{"yes": "segment", "no": "inline"}.get(tag.get("hard-break", "segment"), tag.get("hard-break", "segment"))].add(name)
            if tag.get("keep-format") == "yes":
                keep.add(name)
            if tag.get("attributes"):
                attrs[name] = frozenset(tag.get("attributes").split(";"))
        return Config(frozenset(c["segment"]), frozenset(c["inline"]), frozenset(c["ignore"]), frozenset(keep), attrs)


def infer(text: str) -> Config:
    """Elements with text of their own are segments, those within one that has text around them inline."""
    own: set[str] = set()
    inside: set[str] = set()
    stack: list[str] = []
    for m in TOKEN.finditer(text):
        t = m.group()
        if is_tag(t):
            name = tag_name(t)
            if t[1] == "/":
                if name in stack:
                    while stack.pop() != name:
                        pass
            else:
                if any(x in own for x in stack):
                    inside.add(name)
                if not t.endswith("/>"):
                    stack.append(name)
        elif t.strip() and not t.startswith("<") and stack:
            own.add(stack[-1])
    return Config(segment=frozenset(own - inside), inline=frozenset(inside))


def xml_document(text: str, config: Config | None = None) -> list[Part]:
    """Segments of an XML document by a configuration, or by inference without."""
    c = config or infer(text)
    out: list[Part] = []
    run: list[str] = []
    stack: list[str] = []

    def flush():
        if run:
            keep = bool(stack) and stack[-1] in c.keep_space
            out.extend(_segment(run, keep) if any(s in c.segment for s in stack) and not any(s in c.ignore for s in stack) else [Part("".join(run))])
            run.clear()

    for m in TOKEN.finditer(text):
        t = m.group()
        if not is_tag(t):
            if t.startswith(("<?", "<!")) and not any(s in c.segment for s in stack):
                flush()
                out.append(Part(t))
            else:
                run.append(t)
            continue
        name = tag_name(t)
        if t[1] == "/":
            if name in c.inline and name not in c.segment:
                run.append(t)
            else:
                flush()
                out.append(Part(t))
            if name in stack:
                while stack.pop() != name:
                    pass
            continue
        shown = c.attributes.get(name)
        if name in c.inline and name not in c.segment:
            run.append(t)
        else:
            flush()
            at = 0
            for a in ATTRIBUTE.finditer(t) if shown else ():
                value = a[2] if a[2] is not None else a[3]
                if a[1] in shown and value.strip():
                    begin = a.end() - 1 - len(value)
                    out += [Part(t[at:begin]), Part(unit="", source=value, resname=a[1])]
                    at = begin + len(value)
            out.append(Part(t[at:]))
        if not t.endswith("/>"):
            stack.append(name)
    flush()
    return out


for _code in ("XML", "XMLG", "DITA", "QTI"):
    text_format(_code)(xml_document)


@text_format("INX", lambda s: s.replace("_", "~sep~"))
def inx(text: str) -> list[Part]:
    """Text that begins with c_ is content, with ~sep~ for underscores; all else is literal."""
    out = []
    for m in TOKEN.finditer(text):
        t = m.group()
        if t.startswith("c_") and t[2:].strip():
            out += [Part("c_"), Part(unit="", source=t[2:].replace("~sep~", "_"))]
        else:
            out.append(Part(t))
    return out


@text_format("ICML")
def icml(text: str) -> list[Part]:
    """Stories: text of Content elements; deleted text of tracked changes is literal."""
    return _elements(text, r"<Content(?:\s[^>]*)?>(.*?)</Content>", skip=r"<Change\b[^>]*ChangeType=\"DeletedText\".*?</Change>")


def _elements(text: str, pattern: str, skip: str | None = None, **more) -> list[Part]:
    out, at = [], 0
    hidden = [m.span() for m in re.finditer(skip, text, re.S)] if skip else []
    for m in re.finditer(pattern, text, re.S):
        if m[1].strip() and not any(a <= m.start() < b for a, b in hidden):
            out += [Part(text[at : m.start(1)]), Part(unit="", source=m[1], **more)]
            at = m.end(1)
    return [*out, Part(text[at:])]


@text_format("RESX")
def resx(text: str) -> list[Part]:
    """Values of data elements that are text: without type or mimetype, a name that begins with >> or a comment with _skip."""
    out, at = [], 0
    for m in re.finditer(r"<data\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</data>", text, re.S):
        a = attributes(m[1])
        value = re.search(r"<value(?:\s[^>]*)?>(.*?)</value>", m[2], re.S)
        comment = re.search(r"<comment>(.*?)</comment>", m[2], re.S)
        if "type" in a or "mimetype" in a or a.get("name", "").startswith(">>") or not value or not value[1].strip() or comment and "_skip" in comment[1]:
            continue
        begin = m.start(2) + value.start(1)
        out += [Part(text[at:begin]), Part(unit="", source=value[1], resname=a.get("name"), notes=[comment[1]] if comment else [])]
        at = begin + len(value[1])
    return [*out, Part(text[at:])]


@text_format("TS")
def qt(text: str) -> list[Part]:
    """Messages: approved if the translation is finished (no type) and not blank; of plural forms the first."""
    out, at = [], 0
    for m in re.finditer(r"<message\b[^>]*>(.*?)</message>", text, re.S):
        source = re.search(r"<source>(.*?)</source>", m[1], re.S)
        target = re.search(r"<translation\b([^>]*?)(?:/>|>(.*?)</translation>)", m[1], re.S)
        if not source or not source[1].strip() or not target or target[2] is None:
            continue
        form = re.search(r"<numerusform>(.*?)</numerusform>", target[2], re.S)
        said, shift = (form[1], form.start(1)) if form else (target[2], 0)
        notes = re.findall(r"<(?:comment|extracomment)>(.*?)</", m[1], re.S)
        begin = m.start(1) + target.start(2) + shift
        out += [Part(text[at:begin]), Part(unit="", source=source[1], target=said if said.strip() else None, approved="type" not in attributes(target[1]) and bool(said.strip()), notes=notes)]
        at = begin + len(said)
    return [*out, Part(text[at:])]


def _pairs(text: str, unit: str, name: str, source: str, target: str, made) -> list[Part]:
    """Units with a source and a target element: the target's text is the place. made(attributes of unit and target, body) -> fields or None."""
    out, at = [], 0
    for m in re.finditer(rf"<{unit}\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</{unit}>", text, re.S):
        s = re.search(rf"<{source}\b[^>]*>(.*?)</{source}>", m[2], re.S)
        t = re.search(rf"<{target}\b([^>]*)>(.*?)</{target}>", m[2], re.S)
        a = attributes(m[1])
        fields = made(a, attributes(t[1]) if t else {}, m[2]) if s and s[1].strip() else None
        if fields is None:
            continue
        if t:
            begin, said = m.start(2) + t.start(2), t[2]
            opening, closing = "", ""
        else:
            begin, said = m.start(2) + s.end(), ""
            opening, closing = f"<{target}>", f"</{target}>"
        out += [Part(text[at:begin] + opening), Part(unit=a.get(name, ""), source=s[1], target=said if t and said.strip() else None, **fields), Part(closing)]
        at = begin + len(said)
    return [*out, Part(text[at:])]


def _notes(body: str, tag: str = "note") -> list[str]:
    return re.findall(rf"<{tag}\b[^>]*>(.*?)</{tag}>", body, re.S)


@text_format("TXML")
def txml(text: str) -> list[Part]:
    return _pairs(text, "segment", "segmentId", "source", "target", lambda a, t, b: {"notes": _notes(b, "comment")})


@text_format("TXLF")
def txlf(text: str) -> list[Part]:
    return _pairs(text, "trans-unit", "id", "source", "target", lambda a, t, b: None if a.get("translate") == "no" else {"approved": t.get("state") == "translated", "state": t.get("state"), "notes": _notes(b)})


@text_format("WPML", lambda s: s)
def wpml(text: str) -> list[Part]:
    """Sources in CDATA are unwrapped; a unit of several lines is one segment for each that has text."""
    out, at = [], 0
    for m in re.finditer(r"<trans-unit\b([^>]*)>(.*?)</trans-unit>", text, re.S):
        s = re.search(r"<source\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</source>", m[2], re.S)
        t = re.search(r"<target\b[^>]*>(<!\[CDATA\[)?(.*?)(?:\]\]>)?</target>", m[2], re.S)
        if not s or not t or not s[1].strip():
            continue
        out.append(Part(text[at : m.start(2) + t.start(2)]))
        for piece in re.split(r"(\n)", s[1]):
            out.append(Part(unit="", source=piece, resname=attributes(m[1]).get("resname")) if piece.strip() else Part(piece))
        at = m.start(2) + t.end(2)
    return [*out, Part(text[at:])]


_CONF = {"Draft": "new", "Translated": "translated", "RejectedTranslation": "needs-review-translation", "RejectedSignOff": "needs-review-translation", "ApprovedTranslation": "signed-off", "ApprovedSignOff": "signed-off"}


@text_format("SDLXLIFF")
def sdlxliff(text: str) -> list[Part]:
    """A unit for each segment marker, unit:mid, its state by the confirmation level, locked ones not to translate."""
    out, at = [], 0
    for m in re.finditer(r"<trans-unit\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</trans-unit>", text, re.S):
        a, body = attributes(m[1]), m[2]
        if a.get("translate") == "no":
            continue
        marks = lambda part: {x[1]: x for x in re.finditer(r"<mrk\b[^>]*?mid=\"([^\"]*)\"[^>]*?(?:/>|>(.*?)</mrk>)", part[0], re.S)} if part else {}
        sources = marks(re.search(r"<seg-source\b.*?</seg-source>", body, re.S))
        target = re.search(r"<target\b.*?</target>", body, re.S)
        targets = marks(target)
        levels = {x["id"]: x for x in (attributes(d[1]) for d in re.finditer(r"<sdl:seg\b([^>]*)/?>", body)) if "id" in x}
        for mid, s in sources.items():
            t = targets.get(mid)
            if not t or t[2] is None or not (s[2] or "").strip():
                continue
            level = levels.get(mid, {})
            begin = m.start(2) + target.start() + t.start(2)
            out += [Part(text[at:begin]), Part(unit=f"{a.get('id')}:{mid}", source=s[2], target=t[2] if t[2].strip() else None, state=_CONF.get(level.get("conf", "")), approved=level.get("conf", "").startswith("Approved"), attrs={"ts": "locked"} if level.get("locked") == "true" else {})]
            at = begin + len(t[2])
    return [*out, Part(text[at:])]


@text_format("XLIFF")
def xliff(text: str) -> list[Part]:
    """Units of the first version, or segments of the second (unit-segment), with notes, state and approval."""
    if not re.search(r"<xliff\b[^>]*version=\"2\.", text):
        return _pairs(text, "trans-unit", "id", "source", "target", lambda a, t, b: {"approved": a.get("approved") == "yes", "translate": a.get("translate") != "no", "state": t.get("state"), "resname": a.get("resname"), "notes": _notes(b)})
    out, at, file_no = [], 0, -1
    for m in re.finditer(r"<file\b|<unit\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</unit>", text, re.S):
        if m[2] is None:
            file_no += 1
            continue
        unit = attributes(m[1])
        for k, s in enumerate(re.finditer(r"<(segment|ignorable)\b([^>]*)>(.*?)</\1>", m[2], re.S)):
            a = attributes(s[2])
            for p in _pairs(f"<x>{s[3]}</x>", "x", "", "source", "target", lambda _, t, b: {}):
                if p.unit is not None:
                    p.unit = f"{file_no}/{unit.get('id')}/{a.get('id', k)}"
                    p.state, p.approved = a.get("state", "initial"), a.get("state") == "final"
                    p.translate = unit.get("translate") != "no"
                    p.notes = _notes(m[2])
                    begin = m.start(2) + s.start(3)
                    place = re.search(r"<target\b[^>]*>", s[3])
                    here = begin + (place.end() if place else s[3].rfind("</source>") + 9)
                    out += [Part(text[at:here] + ("" if place else "<target>")), p, Part("" if place else "</target>")]
                    at = here + (len(s[3][place.end() : s[3].rfind("</target>")]) if place else 0)
    return [*out, Part(text[at:])]

"""Sentence segmentation by rules (SRX 2.0): rule files, an exact evaluator and an Arrow function.

At each position after a segment's first character the first rule whose `before` ends the text since the segment's
start and whose `after` begins the rest decides: break or not. Only positions at which a breaking rule can hold are
looked at, so the cost follows the number of candidate breaks, not the square of the length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

NS = "{http://www.lisa.org/srx20}"


@dataclass(frozen=True)
class Rule:
    breaks: bool
    before: str = ""
    after: str = ""


@dataclass(frozen=True)
class Rules:
    """Rule sets by name in order, and (pattern, name) by which a language picks its sets."""

    sets: tuple[tuple[str, tuple[Rule, ...]], ...]
    maps: tuple[tuple[str, str], ...]
    cascade: bool = True

    def of(self, lang: str) -> tuple[Rule, ...]:
        """Rules of the sets whose map's pattern fits the whole language code: all of them in order of the sets, or the first map's."""
        names = [name for pattern, name in self.maps if re.fullmatch(pattern, lang or "")]
        if not self.cascade:
            names = names[:1]
        return tuple(r for name, rules in self.sets if name in names for r in rules)


_ABBREVIATIONS = {"en": "Mr Mrs Ms Dr Prof St vs etc Inc Ltd Jr Sr No Fig", "de": "Dr Prof Nr bzw usw ca Abs Bd Hr Fr St", "fr": "M Mme Mlle Dr av env p vol cf", "es": "Sr Sra Srta Dr Dra Ud Uds pág núm etc"}
DEFAULT = Rules(
    (
        *((lang, tuple(Rule(False, rf"\b{w}\.", r"\s") for w in words.split())) for lang, words in _ABBREVIATIONS.items()),
        ("cjk", (Rule(True, "[。！？]+", ""),)),
        ("default", (Rule(False, r"\b[A-Z]\.", r"\s+[A-Z]\."), Rule(False, r"[0-9]+\.", r"[0-9]"), Rule(True, r"[.?!]+[\"')\]]*", r"\s"), Rule(True, "\n", ""))),
    ),
    (*((rf"{lang}.*", lang) for lang in _ABBREVIATIONS), ("(zh|ja).*", "cjk"), (".*", "default")),
)


def load(path: str) -> Rules:
    """Rules of an SRX 2.0 file."""
    root = ElementTree.parse(path).getroot()
    if not root.tag.endswith("srx") or root.get("version") != "2.0":
        raise ValueError("not an SRX 2.0 file")
    text = lambda rule, name: (rule.findtext(NS + name) or "")
    sets = tuple((s.get("languagerulename"), tuple(Rule(r.get("break", "yes") == "yes", text(r, "beforebreak"), text(r, "afterbreak")) for r in s.iter(NS + "rule"))) for s in root.iter(NS + "languagerule"))
    maps = tuple((m.get("languagepattern"), m.get("languagerulename")) for m in root.iter(NS + "languagemap"))
    return Rules(sets, maps, root.find(NS + "header").get("cascade") == "yes")


def rules_table(spark, rules: Rules) -> DataFrame:
    rows = [(name, k, r.breaks, r.before, r.after) for name, own in rules.sets for k, r in enumerate(own)]
    return spark.createDataFrame(rows, "lang_rule string, ord int, is_break boolean, before_re string, after_re string")


class Segmenter:
    """Splits texts of one language; the pieces put end to end are the text."""

    def __init__(self, rules: tuple[Rule, ...]):
        compiled = lambda p: re.compile(p, re.ASCII) if p else None
        self.rules = [(r.breaks, compiled(r.before), compiled(f"(?:{r.before})\\Z") if r.before else None, compiled(r.after)) for r in rules]
        self.breaking = [r for r in self.rules if r[0]]

    @staticmethod
    def _ends(left: str, before: re.Pattern, tail: re.Pattern) -> bool:
        """Whether the last of the matches that follow one another from the left ends the text."""
        if not tail.search(left):
            return False
        end = -1
        for m in before.finditer(left):
            end = m.end() if m.end() > m.start() else end
        return end == len(left)

    def _holds(self, rule, left: str, text: str, pos: int) -> bool:
        _, before, tail, after = rule
        if after and not after.match(text, pos):
            return False
        return before is None or self._ends(left, before, tail)

    def _candidates(self, text: str) -> list[int]:
        found: set[int] = set()
        for _, before, _, after in self.breaking:
            if before is not None:
                for m in before.finditer(text):
                    found.update(range(m.start() + 1, m.end() + 1))
            elif after is not None:
                found.update(m.start() for m in after.finditer(text))
        return sorted(k for k in found if 0 < k < len(text))

    def segment(self, text: str) -> list[str]:
        if not text:
            return []
        out, start = [], 0
        for pos in self._candidates(text):
            if pos <= start:
                continue
            left = text[start:pos]
            if not any(self._holds(r, left, text, pos) for r in self.breaking):
                continue
            if next(r[0] for r in self.rules if self._holds(r, left, text, pos)):
                out.append(left)
                start = pos
        out.append(text[start:])
        return out

    def segment_tagged(self, text: str) -> list[str]:
        """Segments of a text with tags (<...>): tags are out of the rules' sight and come with the text before them."""
        tags = [(m.start(), m.group()) for m in re.finditer(r"<[A-Za-z/][^>]*>", text)]
        if not tags:
            return self.segment(text)
        bare, at, places = [], 0, []
        length = 0
        for begin, tag in tags:
            bare.append(text[at:begin])
            length += begin - at
            places.append((length, tag))
            at = begin + len(tag)
        bare.append(text[at:])
        out, done, k = [], 0, 0
        for piece in self.segment("".join(bare)):
            rest, end = [], done + len(piece)
            while k < len(places) and places[k][0] <= end:
                rest.append(piece[: places[k][0] - done] + places[k][1])
                piece, done = piece[places[k][0] - done :], places[k][0]
                k += 1
            out.append("".join(rest) + piece)
            done = end
        return out or ["".join(t for _, t in places)]


@lru_cache(64)
def segmenter(rules: Rules, lang: str) -> Segmenter:
    return Segmenter(rules.of(lang))


def segment(text: Column, lang: Column, rules: Rules = DEFAULT, tagged: bool = False) -> Column:
    """Array of a text's segments. Null gives null, the empty text an empty array."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, langs: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(texts, langs):
            s = segmenter(rules, g or "")
            out.append(None if t is None else s.segment_tagged(t) if tagged else s.segment(t))
        return pd.Series(out)

    return run(text, lang)


def resegment(units: DataFrame, rules: Rules = DEFAULT, lang: str = "src_lang") -> DataFrame:
    """Units of one segment as units of as many as the rules give: columns and seg_no, segment_id, source and target.

    Units that aren't translatable, have matches, or a target that differs from the source, stay one segment. A target
    equal to the source is split with it. Edge tags without text are ignorable pieces.
    """
    allowed = F.coalesce("can_resegment", F.lit(True)) if "can_resegment" in units.columns else F.lit(True)
    eligible = F.col("translate") & allowed & (F.coalesce(F.size("matches"), F.lit(0)) <= 0) & (F.col("target").isNull() | (F.col("target") == "") | (F.col("target") == F.col("source")))
    pieces = F.when(eligible & (F.col("source") != ""), segment(F.col("source"), F.col(lang), rules, True)).otherwise(F.array("source"))
    copied = F.coalesce(F.col("target") == F.col("source"), F.lit(False))
    split = units.select("*", copied.alias("_copied"), F.size(pieces).alias("_n"), F.posexplode(pieces).alias("seg_no", "_piece"))
    out = split.withColumns({
        "segment_id": F.when(F.col("_n") == 1, F.col("unit_id")).otherwise(F.concat_ws("-", "unit_id", F.col("seg_no").cast("string"))),
        "is_ignorable": F.trim(F.regexp_replace("_piece", "<[A-Za-z/][^>]*>", "")) == "",
        "target": F.when(F.col("_n") == 1, F.col("target")).when(F.col("_copied"), F.col("_piece")),
    })
    return out.withColumn("source", F.col("_piece")).drop("_piece", "_n", "_copied")

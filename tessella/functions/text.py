"""Text functions as Column expressions: all run inside whole-stage code generation or as higher-order functions on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Inside of character classes. A class tests its single characters one by one, so the wide ones stand behind a range, outside of which most texts are.
_WIDE = "[\\u3001-\\uFF1F&&[\\u3001\\u3002\\uFF1A\\uFF01\\uFF1F\\u4ECB]]"
DELIMITERS, SEPARATORS = f" \\t\\r\\n()?\\u00A0{_WIDE}", ".,\\-/<>"
_IN_TOKEN, _PIECE = f"[^{DELIMITERS}]", f"[^{DELIMITERS}{SEPARATORS}]+"
#: Matches once for each word: a piece at the end of its token (most are whole tokens), a whole token with a digit, another piece.
WORD = f"{_PIECE}(?!{_IN_TOKEN})|(?<!{_IN_TOKEN})[^{DELIMITERS}\\p{{Nd}}]*\\p{{Nd}}{_IN_TOKEN}*|{_PIECE}"
CJK = ("zh", "ja", "ko")
VOWELS, ACCENTED = "aeiouAEIOU", "áèîöúÁÈÎÖÚ"
CLASSES = ("exact", "95", "85", "75", "50")


def count_words(text: Column) -> Column:
    """Words of a text in a spaced script: tokens between delimiters; one joined by separators counts its pieces, unless it has a digit."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def count_ideographs(text: Column) -> Column:
    """Words of Chinese, Japanese or Korean text: each UTF-16 unit above 255 but six punctuation marks, and the words of the rest."""
    rest = F.regexp_replace(text, "[\\u0100-\\x{10FFFF}&&[^\\u3001\\u3002\\uFF1A\\uFF01\\uFF1F\\u4ECB]]+", "")
    return utf16_length(text) - utf16_length(rest) + count_words(rest)


def word_count(text: Column, lang: Column | str) -> Column:
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.when(F.substring(lang, 1, 2).isin(*CJK), count_ideographs(text)).otherwise(count_words(text))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def space_count(text: Column) -> Column:
    """White-space characters; no-break spaces aren't."""
    spaces = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\u1680\\u2000-\\u2006\\u2008-\\u200A\\u2028\\u2029\\u205F\\u3000]"
    return F.length(text) - F.length(F.regexp_replace(text, spaces, ""))


def normalise(text: Column, trim: bool = True) -> Column:
    """Runs of Unicode separators and line feeds become one space; tabs stay."""
    out = F.regexp_replace(text, "[\\p{Z}\\n]+", " ")
    return F.regexp_replace(out, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "") if trim else out


def collapse_space(text: Column) -> Column:
    """White space as HTML shows it."""
    return F.regexp_replace(text, "[ \\n\\t\\r\\f]+", " ")


def match_class(qualities: Column) -> Column:
    """Class of the best of some match qualities (array of strings). Those that aren't whole numbers don't count; above 100 is new."""
    best = F.array_max(F.transform(qualities, lambda q: F.when(q.rlike("^[+-]?[0-9]{1,9}$"), q.try_cast("int"))))
    return (
        F.when(best == 100, "exact").when((best >= 95) & (best < 100), "95").when((best >= 85) & (best < 95), "85")
        .when((best >= 75) & (best < 85), "75").when((best >= 50) & (best < 75), "50").otherwise("new")
    )


def best_quality(qualities: Column, clamp: bool = True) -> Column:
    best = F.array_max(F.transform(qualities, lambda q: q.try_cast("double")))
    return F.least(best, F.lit(100.0)) if clamp else best


def pseudo(text: Column) -> Column:
    return F.translate(text, VOWELS, ACCENTED)


def java_hash(text: Column) -> Column:
    """The 32-bit string hash 31 * h + unit of texts in the basic plane."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: _code(c))
    wide = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide).cast("int")


def _code(c: Column) -> Column:
    hexed = F.hex(F.encode(c, "UTF-16BE"))
    return F.conv(hexed, 16, 10).cast("long")


def tmx_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def printf_parameters(text: Column) -> Column:
    """Conversions of printf as an array; %% is none."""
    found = F.regexp_extract_all(text, F.lit("(%%|%[^%diouxXfeEgGcs]*[diouxXfeEgGcs])"), F.lit(1))
    return F.filter(found, lambda x: x != "%%")


def is_number_cell(text: Column) -> Column:
    """Numbers, amounts and percentages, which aren't text."""
    return text.rlike("^\\s*[\\p{Sc}]?\\s*[+-]?[0-9][0-9.,]*\\s*[%\\p{Sc}]?\\s*$")


def is_date(text: Column) -> Column:
    """YYYY-MM-DDThh:mm:ssZ of a real calendar day."""
    shape = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    return F.coalesce(shape & F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), F.lit(False))


def is_ncname(text: Column) -> Column:
    return text.rlike("^[A-Z_a-z\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u02FF\\u0370-\\u037D\\u037F-\\u1FFF\\u200C-\\u200D\\u2070-\\u218F\\u2C00-\\u2FEF\\u3001-\\uD7FF\\uF900-\\uFDCF\\uFDF0-\\uFFFD][-.0-9\\u00B7A-Z_a-z\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u037D\\u037F-\\u1FFF\\u200C-\\u200D\\u203F\\u2040\\u2070-\\u218F\\u2C00-\\u2FEF\\u3001-\\uD7FF\\uF900-\\uFDCF\\uFDF0-\\uFFFD]*$")


def is_language(tag: Column) -> Column:
    """Well-formed language tags in their usual case; private ones (x-... or ...-x-...) unless they end with a hyphen."""
    private = tag.rlike("^(x-|.*-x-).*[^-]$")
    usual = tag.rlike("^[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?$")
    return F.coalesce(private | usual, F.lit(False))


def parse_status(text: Column) -> Column:
    """k=v;k=v; as a map of whole numbers."""
    return F.transform_values(F.str_to_map(F.regexp_replace(text, ";$", ""), F.lit(";"), F.lit("=")), lambda k, v: v.try_cast("int"))


def format_status(*counters: str) -> Column:
    return F.concat(*[F.concat(F.lit(c + "="), F.col(c).cast("string"), F.lit(";")) for c in counters])


def escape_unicode(text: Column) -> Column:
    """Characters above 255 as \\uXXXX, line feeds as \\n."""
    one = lambda c: F.when(_code(c) > 255, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(_code(c))), 4, "0"))).otherwise(c)
    return F.replace(F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), ""), F.lit("\n"), F.lit("\\n"))


def split_tags(text: Column) -> Column:
    """Text with HTML-like tags as an array: text and tags in turn, in order; empty pieces left out."""
    return F.filter(F.split(F.regexp_replace(text, "(<[A-Za-z/][^>]*>)", "\u0001$1\u0001"), "\u0001"), lambda x: x != "")


def tag_tokens(text: Column) -> Column:
    """split_tags as tokens: text, and numbered ph for tags."""
    pieces = split_tags(text)
    is_tag = lambda x: x.rlike("^<[A-Za-z/][^>]*>$")
    number = lambda i: F.size(F.filter(F.slice(pieces, 1, i), is_tag)).cast("string")
    return F.transform(pieces, lambda x, i: F.struct(F.when(is_tag(x), "ph").otherwise("text").alias("kind"), F.when(is_tag(x), number(i + 1)).alias("id"), x.alias("text")))


def tag_penalty(a: Column, b: Column, penalty: int) -> Column:
    """Penalty for each markup token of b that a has not, and for each that they differ in number (arrays of tokens)."""
    tags = lambda x: F.transform(F.filter(x, lambda t: t["kind"] != "text"), lambda t: F.concat_ws("\u0001", t["kind"], t["id"], t["text"]))
    x, y = tags(a), tags(b)
    times = lambda s, v: F.size(F.filter(s, lambda t: t == v))
    missing = F.aggregate(F.array_distinct(y), F.lit(0), lambda n, v: n + F.greatest(times(y, v) - times(x, v), F.lit(0)))
    return (missing + F.abs(F.size(x) - F.size(y))) * penalty


def decode_entities(text: Column) -> Column:
    """Numeric and the usual named character references as characters; others stay. &amp; comes last, so nothing is decoded twice."""
    named = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&copy;": "©", "&reg;": "®", "&eacute;": "é", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&szlig;": "ß", "&ntilde;": "ñ", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&euro;": "€"}
    pieces = F.split(F.regexp_replace(text, "(&#[0-9]{1,5};|&#x[0-9A-Fa-f]{1,4};)", "\u0001$1\u0001"), "\u0001")
    number = lambda x: F.when(x.startswith("&#x"), F.conv(F.regexp_extract(x, "&#x([0-9A-Fa-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(x, "&#([0-9]+);", 1)).try_cast("int")
    char = lambda x: F.decode(F.unhex(F.lpad(F.hex(number(x)), 4, "0")), "UTF-16BE")
    out = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike("^&#(x[0-9A-Fa-f]{1,4}|[0-9]{1,5});$"), char(x)).otherwise(x)), "")
    for code, said in named.items():
        out = F.replace(out, F.lit(code), F.lit(said))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def tags_balanced(text: Column) -> Column:
    """Whether every tag of the text that opens is closed in the right order: innermost pairs are taken out until none is left."""
    out = F.regexp_replace(text, "<[A-Za-z_][^<>]*/>", "")
    for _ in range(8):
        out = F.regexp_replace(out, "<([A-Za-z_][\\w:.-]*)(?:\\s[^<>]*)?>[^<>]*</\\1>", "")
    return ~out.rlike("<[A-Za-z_/]")


def accept_changes(tokens: Column) -> Column:
    """Tokens of a text with tracked changes accepted: deletions dropped, the marks of insertions too."""
    return F.filter(tokens, lambda t: ~t["kind"].isin("deleted", "insertion"))

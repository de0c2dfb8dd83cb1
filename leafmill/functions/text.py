"""Text as Column expressions: entities, tabs, reasoning blocks, plausibility, layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.parsers import looked_up

#: Named character references and their code points.
ENTITIES = {
    "amp": 38, "lt": 60, "gt": 62, "quot": 34, "apos": 39, "nbsp": 160, "shy": 173, "laquo": 171, "raquo": 187, "lsquo": 8216,
    "rsquo": 8217, "sbquo": 8218, "ldquo": 8220, "rdquo": 8221, "bdquo": 8222, "ndash": 8211, "mdash": 8212, "hellip": 8230,
    "bull": 8226, "middot": 183, "copy": 169, "reg": 174, "trade": 8482, "deg": 176, "plusmn": 177, "times": 215, "divide": 247,
    "minus": 8722, "le": 8804, "ge": 8805, "ne": 8800, "asymp": 8776, "euro": 8364, "pound": 163, "yen": 165, "cent": 162,
    "sect": 167, "para": 182, "numero": 8470, "larr": 8592, "rarr": 8594, "uarr": 8593, "darr": 8595, "frac12": 189, "frac14": 188,
    "frac34": 190, "sup2": 178, "sup3": 179, "micro": 181, "iexcl": 161, "iquest": 191, "thinsp": 8201, "ensp": 8194, "emsp": 8195,
    "zwnj": 8204, "zwj": 8205,
}
TEXT_LAYER_CHARACTERS = 100
JOINER = "\n\n---\n\n"
#: Fixed value: the note under a cut answer.
TRUNCATED = "\n\n*[Warning: the model's answer was cut off by the token limit]*"


def from_code_point(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """One pass over references of up to 32 bytes; what is not a known one stays as written."""
    tokens = F.regexp_extract_all(text, F.lit("(?s)&[^;&]{0,32};|&|[^&]+"), F.lit(0))

    def one(token: Column) -> Column:
        name = F.regexp_extract(token, "(?s)^&(.*);$", 1)
        decimal = F.when(name.rlike(r"^#\+?[0-9]+$"), F.regexp_extract(name, r"^#\+?([0-9]+)$", 1).try_cast("bigint"))
        digits = F.regexp_extract(name, r"^#[xX]\+?0*([0-9a-fA-F]{0,8})$", 1)
        code = F.coalesce(decimal, F.when(name.rlike(r"^#[xX]\+?[0-9a-fA-F]+$") & (digits != ""), F.conv(digits, 16, 10).try_cast("bigint")))
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        named = looked_up(name, ENTITIES)
        return F.when(~token.startswith("&") | (name == ""), token).otherwise(F.coalesce(F.when(good, from_code_point(code)), F.when(named.isNotNull(), from_code_point(named)), token))

    return F.when(F.instr(text, "&") == 0, text).otherwise(F.array_join(F.transform(tokens, one), ""))


def visible_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def has_text_layer(text: Column) -> Column:
    """At least a hundred characters that are not white space."""
    return F.coalesce(visible_characters(text) >= TEXT_LAYER_CHARACTERS, F.lit(False))


def looks_like_text(content: Column) -> Column:
    """Sniff of binary content by its first 8192 bytes: not empty, no NUL, UTF-8 or under 1 % control characters."""
    head = F.substring(content, 1, 8192)
    size = F.octet_length(head)
    codes = F.hex(head)
    pairs = F.regexp_extract_all(codes, F.lit("(..)"), F.lit(1))
    controls = F.size(F.filter(pairs, lambda x: (x < "20") & ~x.isin("09", "0A", "0D")))
    nul = F.exists(pairs, lambda x: x == "00")
    return (size > 0) & ~nul & (F.is_valid_utf8(head.cast("string")) | (controls * 100 < size))


def expand_tabs(text: Column, width: int = 8) -> Column:
    """Tabs to the next multiple of ``width`` columns of their line."""
    def line(one: Column) -> Column:
        parts = F.split(one, "\t")
        step = lambda done, part: F.concat(done, F.repeat(F.lit(" "), (width - F.length(done) % width).cast("int")), part)
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.element_at(parts, 1), step)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def strip_think(text: Column) -> Column:
    """``struct<answer, complete>`` without reasoning blocks; an open one cuts the answer off."""
    closed = text.rlike("(?s)<think>.*?</think>")
    rest = F.regexp_replace(text, "(?s)<think>.*?</think>", "")
    trimmed = F.when(closed, F.regexp_replace(rest, r"(?U)^\s+|\s+$", "")).otherwise(text)
    cut = F.instr(trimmed, "<think>")
    answer = F.when(cut > 0, F.concat(F.substring(trimmed, F.lit(1), cut - 1), F.lit(TRUNCATED))).otherwise(trimmed)
    return F.struct(answer.alias("answer"), (cut == 0).alias("complete"))


def plausible_length(part: Column) -> Column:
    """Length of a trimmed word part if it reads like a number, or like letters of one script with a vowel; else 0."""
    numeric = part.rlike(r"^[0-9.,/:%]*$") & (F.length(F.regexp_replace(part, "[^0-9]", "")) >= 2)
    letters = part.rlike("^[A-Za-z]+$") | part.rlike(r"^[Ѐ-ӿ]+$")
    vowel = F.lower(part).rlike("[aeiouyаеёиоуыэюя]")
    return F.when((F.length(part) >= 3) & (numeric | (letters & vowel)), F.length(part)).otherwise(0)


def plausibility(text: Column) -> Column:
    """``struct<plausible, total>``: characters in plausible words, and all but white space."""
    # parts between white space and hyphens, from their first letter or digit to their last
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}](?:[^\t-\r\x85\p{Z}-]*[\p{L}\p{N}])?"), F.lit(0))
    return F.struct(
        F.aggregate(F.filter(parts, lambda p: F.length(p) >= 3), F.lit(0), lambda a, p: a + plausible_length(p)).alias("plausible"),
        F.length(F.regexp_replace(text, r"[\t-\r\x85\p{Z}]+", "")).alias("total"),
    )


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def page_label(template: Column, number: Column, total: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{n}"), number.cast("string")), F.lit("{total}"), total.cast("string"))

"""Secrets in texts: an Aho-Corasick prefilter, anchored patterns at its hits, checksums.

One automaton over the text with A-Z lowered looks for the words that a secret begins
with, and for any four hexadecimal digits.  Only where one stands is a pattern tried, and
only from that place on, in the text as it is.  Tokens that carry a checksum are reported
only if it fits.

Kinds, in the order of reports: ``assign`` (a key word, ``=`` or ``:``, a value of 8
characters or more), ``access`` (``AKIA`` and capitals or digits, 16 characters or more),
``hex`` (32 digits or more), and ``github`` and ``npm`` tokens, whose last six characters
are the CRC-32 of the 30 before them in base 62.

Defined results: null and empty texts have no secrets; places are code points; spans of
one kind do not overlap, those of different kinds may; the longest texts are scanned
whole; repeated rows are reported each, an empty table gives an empty one, and an added
column replaces one of its name.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _text

SPANS = "array<struct<kind:string,start:int,end:int>>"
BASE = ("assign", "access", "hex")
_BASE_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_in_base_62(token: str) -> bool:
    """Do the last six characters spell the CRC-32 of those between the prefix and them?"""
    body, sum_ = token[4:-6], 0
    for c in token[-6:]:
        sum_ = sum_ * 62 + _BASE_62.index(c)
    return sum_ == zlib.crc32(body.encode())


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


class Kind(NamedTuple):
    name: str
    keywords: tuple[str, ...]  # lowered; none holds another of its kind
    pattern: re.Pattern
    group: int = 0  # whose characters are counted
    least: int = 0
    valid: Callable[[str], bool] | None = None


_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = (
    Kind("assign", _NAMES, re.compile(f"(?:{'|'.join(map(_any_case, _NAMES))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    Kind("access", ("akia",), re.compile("AKIA[A-Z0-9]+"), 0, 16),
    Kind("hex", tuple(map("".join, itertools.product("0123456789abcdef", repeat=4))), re.compile("[0-9a-f]+"), 0, 32),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile("(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), valid=crc_in_base_62),
    Kind("npm", ("npm_",), re.compile("(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), valid=crc_in_base_62),
)


@lru_cache(maxsize=1)
def _automaton():
    """Of all key words; each tells its kind's number and its length."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for number, kind in enumerate(KINDS):
        for word in kind.keywords:
            made.add_word(word, (number, len(word) - 1))
    made.make_automaton()
    return made


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each secret, ascending."""
    lowered = text.lower() if text.isascii() else text.encode().lower().decode()  # of bytes, A-Z alone are lowered
    done = [0] * len(KINDS)
    found = []
    for last, (number, before) in _automaton().iter(lowered):
        start = last - before
        if start < done[number]:
            continue
        _, _, pattern, group, least, valid = KINDS[number]
        if match := pattern.match(text, start):
            done[number] = match.end()
            if match.end(group) - match.start(group) >= least and (valid is None or valid(match[0])):
                found.append((start, number, match.end()))
    found.sort()
    return found


def _made(column: pa.Array) -> list[pa.Array]:
    spans, counts = [], [0]
    for text in column.to_pylist():
        spans += scan(text or "")
        counts.append(len(spans))
    starts, kinds, ends = zip(*spans) if spans else ((), (), ())
    fields = [pa.array([KINDS[k].name for k in kinds], pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
    return [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "end"]))]


def find(docs: DataFrame, *, text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with the spans of the secrets in each text, by start, then kind."""
    return _text.appended(docs, _made, {name: SPANS}, text)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; overlapping ones by one mark."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    own = plain[docs.columns.index(text)]
    found = find(docs.toDF(*plain), text=own)
    state = F.aggregate(
        "secrets",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(own, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(own, a["at"] + 1, F.length(own) - a["at"])),
    )
    return found.withColumn(own, F.when(F.size("secrets") > 0, state).otherwise(F.col(own))).select(*plain).toDF(*docs.columns)

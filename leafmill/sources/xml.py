"""XML as a stream of events; comments, instructions and declarations are passed over."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from leafmill.sources.html import decode_entities


class Event(NamedTuple):
    kind: str  # start, end or text
    name: str
    text: str  # attributes of a start, characters of a text


_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <\?.*?(?:\?>|\Z) | <!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z) | <![^>]*(?:>|\Z)
      | <(?P<tag>(?:[^>"']|"[^"]*"|'[^']*')*)> | (?P<text>[^<]+)""",
    re.VERBOSE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\s*([^=]*?)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def events(xml: str) -> Iterator[Event]:
    at = 0
    while m := _TOKEN.match(xml, at):
        at = m.end()
        if m["text"] is not None:
            yield Event("text", "", decode_entities(m["text"]))
        elif m["raw"] is not None:
            yield Event("text", "", m["raw"])
        elif m["tag"] is not None:
            tag = m["tag"]
            if tag.startswith("/"):
                yield Event("end", tag[1:].strip(), "")
                continue
            empty = tag.endswith("/")
            name, _, attributes = re.match(r"(\S*)(\s*)(.*)", tag[:-1] if empty else tag, re.DOTALL).groups()
            yield Event("start", name, attributes.strip())
            if empty:
                yield Event("end", name, "")


def local_name(name: str) -> str:
    return name.rpartition(":")[2]


def attribute(attributes: str, name: str) -> str | None:
    """Value of an attribute (its name as written, with any prefix), references decoded."""
    at = 0
    while m := _ATTRIBUTE.match(attributes, at):
        if m[1] == name:
            return decode_entities(m[2] if m[2] is not None else m[3])
        at = m.end()
    return None


def strip_tags(xml: str) -> str:
    return "".join(e.text for e in events(xml) if e.kind == "text")


def element_value(xml: str, tag: str) -> str | None:
    """What stands inside the first element of a name."""
    opened = re.search(rf"<{re.escape(tag)}>", xml) or re.search(rf"<{re.escape(tag)} [^>]*>", xml)
    closed = opened and re.compile(rf"</{re.escape(tag)}>").search(xml, opened.end())
    return xml[opened.end() : closed.start()] if closed else None

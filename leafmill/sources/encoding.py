"""Text from bytes: byte-order mark, UTF-8, a declared XML encoding, else Windows-1251."""

from __future__ import annotations

import codecs
import re

_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_DECLARED = re.compile(rb"""encoding=(["'])(.*?)\1""", re.DOTALL)


def decode_text(raw: bytes) -> str:
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    declaration, closed, _ = raw[:200].partition(b"?>")
    found = _DECLARED.search(declaration) if closed else None
    try:
        codec = codecs.lookup(found[2].decode("ascii", "replace").strip()) if found else None
    except LookupError:
        codec = None
    return raw.decode(codec.name if codec else "cp1251", "replace")

"""ZIP-based documents: office files, e-books and image archives, from bytes to text or members."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

from leafmill.functions.names import EXTENSIONS, IMAGES
from leafmill.sources import xml
from leafmill.sources.encoding import decode_text
from leafmill.sources.html import html_to_text

#: Limits on what is inflated.
ENTRY_BYTES = 256 << 20
ARCHIVE_BYTES = 2 << 30
_IMAGE_ENDINGS = tuple(f".{e}" for f in IMAGES for e in EXTENSIONS[f].split())


class Unreadable(ValueError):
    """A document that cannot be read; the message says why."""


def natural_key(name: str) -> list:
    """Sort key in natural order, as the column expression of the same name."""
    return [(0, len(t.lstrip("0")), t.lstrip("0"), len(t)) if t[0].isdigit() and t.isascii() else (1, 0, t, 0) for t in re.findall(r"[0-9]+|[^0-9]+", name.lower())]


def is_hidden(name: str) -> bool:
    return any(p == "__MACOSX" or (p.startswith(".") and p not in (".", "..")) for p in re.split(r"[/\\]", name))


class Archive:
    """Members of a ZIP file by name, with limits on their inflated size."""

    def __init__(self, raw: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile as error:
            raise Unreadable(f"not a ZIP archive: {error}") from error
        self.names = self.zip.namelist()

    def raw(self, name: str) -> bytes:
        own = name.replace("\\", "/")
        own = own if own in self.names else name
        try:
            with self.zip.open(own) as member:
                content = member.read(ENTRY_BYTES + 1)
        except (KeyError, RuntimeError, zipfile.BadZipFile) as error:
            raise Unreadable(f"no readable member {name}") from error
        if len(content) > ENTRY_BYTES:
            raise Unreadable(f"member {name} is larger than {ENTRY_BYTES >> 20} MB")
        return content

    def text(self, name: str) -> str:
        try:
            return self.raw(name).decode()
        except UnicodeDecodeError as error:
            raise Unreadable(f"member {name} is not UTF-8") from error

    def between(self, prefix: str, suffix: str) -> list[str]:
        return sorted((n for n in self.names if n.startswith(prefix) and n.endswith(suffix)), key=natural_key)


def kind_of(raw: bytes) -> str | None:
    """What an archive holds, by its members: an e-book, a page with its files, or images."""
    try:
        shown = [n.lower() for n in Archive(raw).names if not is_hidden(n)]
    except Unreadable:
        return None
    if any(n.endswith("container.xml") for n in shown):
        return "epub"
    if any(n.endswith(".fb2") for n in shown):
        return "fb2"
    if "index.html" in shown:
        return "htmlz"
    return "cbz" if any(n.endswith(_IMAGE_ENDINGS) for n in shown) else None


def _paragraph(text: str, level: int) -> str:
    text = text.strip()
    return f"{'#' * level + ' ' if level else ''}{text}\n\n" if text else ""


def heading_level(style: str | None) -> int:
    """1 to 6 of a heading style (``Heading2``, or ``2`` where names are localised), else 0."""
    number = re.fullmatch(r"(?:heading)?\+?([0-9]+)", style or "", re.IGNORECASE | re.ASCII)
    return int(number[1]) if number and 1 <= int(number[1]) <= 6 else 0


def docx_text(archive: Archive) -> str:
    out, held, level, run, inside = [], [], 0, False, False
    for kind, name, text in xml.events(archive.text("word/document.xml")):
        name = xml.local_name(name)
        if kind == "text":
            held += [text] if inside else []
        elif name == "r":
            run = kind == "start"
        elif name == "t":
            inside = kind == "start" and run
        elif kind == "start" and run and name in ("tab", "br", "cr"):
            held.append("\t" if name == "tab" else "\n")
        elif kind == "start" and name == "pStyle":
            level = heading_level(xml.attribute(text, "w:val"))
        elif kind == "end" and name == "p":
            out.append(_paragraph("".join(held), level))
            held, level = [], 0
    return "".join(out)


def opendocument_text(archive: Archive) -> str:
    out, held, level, depth = [], [], 0, 0
    whole = lambda value, other: int(value) if value and re.fullmatch(r"\+?[0-9]+", value, re.ASCII) else other
    for kind, name, text in xml.events(archive.text("content.xml")):
        if kind == "text":
            held += [text] if depth else []
        elif name in ("text:p", "text:h"):
            if kind == "start":
                if name == "text:h" and not depth:
                    level = min(max(whole(xml.attribute(text, "text:outline-level"), 1), 1), 6)
                depth += 1
            else:
                depth = max(0, depth - 1)
                if not depth:
                    out.append(_paragraph("".join(held), level))
                    held, level = [], 0
        elif kind == "start" and depth and name in ("text:tab", "text:line-break", "text:s"):
            held.append({"text:tab": "\t", "text:line-break": "\n"}.get(name) or " " * min(whole(xml.attribute(text, "text:c"), 1), 1000))
    return "".join(out)


def slides(archive: Archive) -> Iterator[tuple[int, list[str]]]:
    """(number, paragraphs) of each slide in natural order."""
    for number, member in enumerate(archive.between("ppt/slides/slide", ".xml"), 1):
        lines, held, inside = [], [], False
        for kind, name, text in xml.events(archive.text(member)):
            if kind == "text":
                held += [text] if inside else []
            elif name == "a:t":
                inside = kind == "start"
            elif name == "a:br" and kind == "start":
                held.append(" ")
            elif name == "a:p" and kind == "end":
                lines += [line] if (line := "".join(held).strip()) else []
                held = []
        yield number, lines


def pptx_text(archive: Archive) -> str:
    return "".join(f"# Slide {n}\n\n" + "".join(f"- {line}\n" for line in lines) + "\n" for n, lines in slides(archive) if lines)


def shared_strings(text: str) -> list[str]:
    """Strings of a workbook, rich runs joined, readings left out."""
    strings, held, inside, reading = [], [], False, False
    for kind, name, value in xml.events(text):
        if kind == "text":
            held += [value] if inside else []
        elif name == "rPh":
            reading = kind == "start"
        elif name == "t":
            inside = kind == "start" and not reading
        elif name == "si":
            if kind == "end":
                strings.append("".join(held))
            held = []
    return strings


def sheet_rows(archive: Archive) -> Iterator[tuple[int, list[list[str]]]]:
    """(number, rows of non-empty cells) of each worksheet in natural order."""
    shared = shared_strings(archive.text("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in archive.names else []
    for number, member in enumerate(archive.between("xl/worksheets/sheet", ".xml"), 1):
        rows, row, form, parts, into = [], [], "", {"v": [], "t": []}, None
        for kind, name, text in xml.events(archive.text(member)):
            if kind == "text":
                if into:
                    parts[into].append(text)
            elif name == "c" and kind == "start":
                form, parts = xml.attribute(text, "t") or "", {"v": [], "t": []}
            elif name in parts:
                into = name if kind == "start" else None
            elif name == "c":
                value = "".join(parts["t" if form == "inlineStr" else "v"]).strip()
                if form == "s":
                    value = shared[int(value)].strip() if value.isdecimal() and int(value) < len(shared) else ""
                elif form == "b":
                    value = {"1": "TRUE", "0": "FALSE"}.get(value, value)
                row += [value] if value else []
            elif name == "row" and kind == "end":
                rows += [row] if row else []
                row = []
        yield number, rows


def xlsx_text(archive: Archive) -> str:
    return "".join(f"# Sheet {n}\n\n" + "".join(" | ".join(r) + "\n" for r in rows) + "\n" for n, rows in sheet_rows(archive))


#: The member that tells each kind of office file, in order of priority.
_OFFICE = {"word/document.xml": docx_text, "xl/workbook.xml": xlsx_text, "ppt/presentation.xml": pptx_text, "content.xml": opendocument_text}


def office_text(raw: bytes) -> str:
    """Text of an office file; its parts, not its name, decide the kind."""
    archive = Archive(raw)
    for member, read in _OFFICE.items():
        if member in archive.names:
            if text := read(archive).strip():
                return text
            raise Unreadable("no readable text")
    raise Unreadable("neither Office Open XML nor OpenDocument")


def _titled(title: str | None, author: str | None) -> str:
    title, author = xml.strip_tags(title or ""), author or ""
    out = f"{title}\n{'=' * max(4, len(title.strip()))}\n\n" if title.strip() else ""
    return out + (f"Author: {author}\n\n" if author.strip() else "")


_FB2_PART = re.compile(r"<(?P<name>p|v|subtitle|title)(?:\s[^>]*)?>(?P<body>.*?)</(?P=name)>|<(?P<gap>empty-line)[^>]*>", re.IGNORECASE | re.DOTALL)


def fb2_blocks(body: str) -> str:
    out = []
    for m in _FB2_PART.finditer(body):
        if m["gap"]:
            out.append("\n")
        elif text := xml.strip_tags(m["body"]).strip():
            mark = {"subtitle": "\n### ", "title": "\n## "}.get(m["name"].lower(), "")
            out.append(f"{mark}{text}\n\n")
    return "".join(out)


def fb2_text(text: str) -> str:
    people = [" ".join(filter(None, (xml.element_value(a, "first-name"), xml.element_value(a, "last-name")))).strip() for a in re.findall(r"<author>(.*?)</author>", text, re.DOTALL)]
    out = _titled(xml.element_value(text, "book-title"), ", ".join(p for p in people if p))
    note = fb2_blocks(xml.element_value(text, "annotation") or "")
    out += f"Annotation:\n{note}\n\n---\n\n" if note.strip() else ""
    body = xml.element_value(text, "body")
    out += fb2_blocks(text if body is None else body)
    if not out.strip():
        raise Unreadable("the book has no readable text")
    return out


def fb2_file_text(raw: bytes) -> str:
    if not zipfile.is_zipfile(io.BytesIO(raw)):
        return fb2_text(decode_text(raw))
    archive = Archive(raw)
    if not archive.names:
        raise Unreadable("an empty archive")
    member = next((n for n in archive.names if n.lower().endswith((".fb2", ".xml"))), archive.names[0])
    return fb2_text(decode_text(archive.raw(member)))


def htmlz_text(raw: bytes) -> str:
    archive = Archive(raw)
    pages = [n for n in archive.names if n.lower().endswith((".html", ".htm"))]
    if not pages:
        raise Unreadable("no HTML in the archive")
    return html_to_text(archive.text(next((n for n in pages if n.lower() in ("index.html", "index.htm")), pages[0])))


def _quoted(tag: str, name: str) -> str | None:
    found = re.search(rf'{name}="([^"]*)"', tag) or re.search(rf"{name}='([^']*)'", tag)
    return found[1] if found else None


def epub_chapters(archive: Archive) -> tuple[str, list[str]]:
    """The package file's text, and the names of the chapters in reading order."""
    try:
        found = re.search(r'full-path="([^"]*)"', archive.text("META-INF/container.xml"))
    except Unreadable:
        found = None
    package = found[1] if found else "OEBPS/content.opf"
    text = archive.text(package)
    tags = text.split("<")
    listed = {i: h for t in tags if t.startswith("item ") for i, h in [(_quoted(t, "id"), _quoted(t, "href"))] if i is not None and h is not None}
    order = [_quoted(t, "idref") for t in tags if t.startswith("itemref ")]
    folder = posixpath.dirname(package.replace("\\", "/"))
    return text, [(f"{folder}/{listed[i]}" if folder else listed[i]).partition("#")[0] for i in order if i in listed]


def epub_text(raw: bytes) -> str:
    archive = Archive(raw)
    package, chapters = epub_chapters(archive)
    out = _titled(xml.element_value(package, "dc:title"), xml.strip_tags(xml.element_value(package, "dc:creator") or ""))

    def texts(names: list[str]) -> str:
        made = []
        for name in names:
            try:
                text = html_to_text(archive.text(name))
            except Unreadable:
                continue
            made += [text + "\n\n"] if text.strip() else []
        return "".join(made)

    out += texts(chapters) or texts([n for n in archive.names if n.lower().endswith((".html", ".xhtml", ".htm"))])
    if not out.strip():
        raise Unreadable("the book has no readable text")
    return out


def image_members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Images of an archive in natural order, hidden ones left out, within a total size."""
    archive, total = Archive(raw), 0
    names = sorted((n for n in archive.names if not is_hidden(n) and n.lower().endswith(_IMAGE_ENDINGS)), key=natural_key)
    if not names:
        raise Unreadable("no images in the archive")
    for name in names:
        content = archive.raw(name)
        total += len(content)
        if total > ARCHIVE_BYTES:
            raise Unreadable(f"images exceed {ARCHIVE_BYTES >> 30} GB")
        yield name, content

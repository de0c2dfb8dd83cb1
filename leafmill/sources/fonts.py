"""TrueType fonts: widths, measured wrapping, subsets, and text pages that embed them."""

from __future__ import annotations

import hashlib
import struct

from leafmill.sources import pdf
from leafmill.sources.pdf import Document, Name, Stream

#: Tables that an embedded subset keeps.
KEPT = (b"cvt ", b"fpgm", b"glyf", b"head", b"hhea", b"hmtx", b"loca", b"maxp", b"prep")


class Unusable(ValueError):
    pass


class Font:
    """One face of a font file."""

    def __init__(self, raw: bytes, face: int = 0):
        try:
            at = struct.unpack_from(">I", raw, 12 + 4 * face)[0] if raw[:4] == b"ttcf" else 0
            if raw[at : at + 4] not in (b"\0\1\0\0", b"true"):
                raise Unusable("not a TrueType font")
            (count,) = struct.unpack_from(">H", raw, at + 4)
            self.tables = {}
            for i in range(count):
                tag, _, offset, size = struct.unpack_from(">4sIII", raw, at + 12 + 16 * i)
                self.tables[tag] = raw[offset : offset + size]
            head, hhea = self.tables[b"head"], self.tables[b"hhea"]
            (self.units,) = struct.unpack_from(">H", head, 18)
            self.box = struct.unpack_from(">4h", head, 36)
            self.ascent, self.descent = struct.unpack_from(">2h", hhea, 4)
            (self.glyphs,) = struct.unpack_from(">H", self.tables[b"maxp"], 4)
            (long,) = struct.unpack_from(">H", hhea, 34)
            pairs = struct.unpack_from(f">{2 * long}H", self.tables[b"hmtx"])
            self.advances = list(pairs[::2]) + [pairs[-2]] * (self.glyphs - long)
            kind = ">%dI" if struct.unpack_from(">h", head, 50)[0] else ">%dH"
            places = struct.unpack_from(kind % (self.glyphs + 1), self.tables[b"loca"])
            self.places = [p * (1 if kind == ">%dI" else 2) for p in places]
            self.map = self._characters(self.tables[b"cmap"])
        except (struct.error, KeyError, IndexError) as error:
            raise Unusable(f"damaged font: {error}") from error

    @staticmethod
    def _characters(raw: bytes) -> dict[int, int]:
        """Glyphs by character, of the widest Unicode table."""
        (count,) = struct.unpack_from(">H", raw, 2)
        found = sorted(((struct.unpack_from(">H", raw, o)[0], o) for p, e, o in (struct.unpack_from(">HHI", raw, 4 + 8 * i) for i in range(count)) if p in (0, 3)), reverse=True)
        for kind, at in found:
            out: dict[int, int] = {}
            if kind == 12:
                (groups,) = struct.unpack_from(">I", raw, at + 12)
                for i in range(groups):
                    first, last, glyph = struct.unpack_from(">III", raw, at + 16 + 12 * i)
                    out.update((c, glyph + c - first) for c in range(first, min(last, 0x10FFFF) + 1))
                return out
            if kind == 4:
                n = struct.unpack_from(">H", raw, at + 6)[0] // 2
                column = lambda k: struct.unpack_from(f">{n}H", raw, at + 14 + k * 2 * n + (2 if k else 0))
                for i, (last, first, delta, jump) in enumerate(zip(*map(column, range(4)))):
                    for c in range(first, min(last, 0xFFFE) + 1):
                        glyph = c if not jump else struct.unpack_from(">H", raw, at + 16 + 6 * n + 2 * i + jump + 2 * (c - first))[0]
                        if glyph or not jump:
                            out[c] = (glyph + delta) & 0xFFFF
                return out
        raise Unusable("no Unicode table")

    def glyph(self, character: str) -> int:
        return self.map.get(ord(character), 0)

    def width(self, text: str, size: float = 1000.0) -> float:
        return sum(self.advances[min(self.glyph(c), self.glyphs - 1)] for c in text) * size / self.units

    def parts(self, glyph: int) -> list[int]:
        """Glyphs that a composite one is made of."""
        raw = self.tables[b"glyf"][self.places[glyph] : self.places[glyph + 1]]
        out, at = [], 10
        if len(raw) < 10 or struct.unpack_from(">h", raw)[0] >= 0:
            return out
        more = True
        while more and at + 4 <= len(raw):
            flags, part = struct.unpack_from(">HH", raw, at)
            out.append(part)
            at += 4 + (4 if flags & 1 else 2) + (2 if flags & 8 else 4 if flags & 64 else 8 if flags & 128 else 0)
            more = bool(flags & 32)
        return out

    def subset(self, glyphs: set[int]) -> bytes:
        """The font with the outlines of these glyphs, and of what they are made of, alone; numbers stay."""
        used, left = set(), {0, *glyphs}
        while left:
            g = left.pop()
            if g < self.glyphs and g not in used:
                used.add(g)
                left.update(self.parts(g))
        outlines, places = bytearray(), [0]
        for g in range(self.glyphs):
            if g in used:
                outlines += self.tables[b"glyf"][self.places[g] : self.places[g + 1]]
                outlines += b"\0" * (-len(outlines) % 4)
            places.append(len(outlines))
        head = bytearray(self.tables[b"head"])
        struct.pack_into(">h", head, 50, 1)
        struct.pack_into(">I", head, 8, 0)
        return written(self.tables | {b"glyf": bytes(outlines), b"loca": struct.pack(f">{len(places)}I", *places), b"head": bytes(head)})


def _sum(raw: bytes) -> int:
    raw += b"\0" * (-len(raw) % 4)
    return sum(struct.unpack(f">{len(raw) // 4}I", raw)) & 0xFFFFFFFF


def written(tables: dict[bytes, bytes]) -> bytes:
    """A font file of the kept tables."""
    kept = sorted((t, tables[t]) for t in KEPT if t in tables)
    power = 1 << (len(kept).bit_length() - 1)
    out, body, at = [struct.pack(">4s4H", b"\0\1\0\0", len(kept), 16 * power, power.bit_length() - 1, 16 * (len(kept) - power))], [], 12 + 16 * len(kept)
    head_at = 0
    for tag, raw in kept:
        head_at = at if tag == b"head" else head_at
        out.append(struct.pack(">4s3I", tag, _sum(raw), at, len(raw)))
        body.append(raw + b"\0" * (-len(raw) % 4))
        at += len(body[-1])
    whole = bytearray(b"".join(out + body))
    struct.pack_into(">I", whole, head_at + 8, (0xB1B0AFBA - _sum(bytes(whole))) & 0xFFFFFFFF)
    return bytes(whole)


def wrapped(text: str, font: Font, size: float, room: float) -> list[str]:
    """Lines no wider than the room: broken at blanks, over-long words by character, empty lines kept."""
    out = []
    for paragraph in text.split("\n"):
        line = ""
        for word in paragraph.split(" "):
            longer = f"{line} {word}" if line else word
            if line and font.width(longer, size) > room:
                out.append(line)
                longer = word
            while len(longer) > 1 and font.width(longer, size) > room:
                cut = len(longer) - 1
                while cut > 1 and font.width(longer[:cut], size) > room:
                    cut -= 1
                out.append(longer[:cut])
                longer = longer[cut:]
            line = longer
        out.append(line)
    return out


def tag_of(glyphs: set[int]) -> str:
    """Six letters that stand for a set of glyphs."""
    digest = hashlib.sha256(b"".join(struct.pack(">H", g) for g in sorted(glyphs))).digest()
    return "".join(chr(65 + b % 26) for b in digest[:6])


def unicode_map(first: dict[int, str]) -> bytes:
    """The stream that maps glyph numbers back to characters, in blocks of a hundred."""
    rows = [b"<%04x> <%s>" % (g, c.encode("utf-16-be").hex().encode()) for g, c in sorted(first.items())]
    blocks = [b"%d beginbfchar\n%s\nendbfchar" % (len(part), b"\n".join(part)) for part in (rows[i : i + 100] for i in range(0, len(rows), 100))]
    head = b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Glyphs def /CMapType 2 def 1 begincodespacerange <0000> <ffff> endcodespacerange\n"
    return head + b"\n".join(blocks) + b"\nendcmap CMapName currentdict /CMap defineresource pop end end"


def text_document(text: str, font: Font, *, sheet: tuple[float, float] = (595.276, 841.89), margin: float = 40.0, size: float = 10.0) -> Document:
    """Text pages in a font whose used glyphs are embedded; they can be searched and copied from."""
    lines = wrapped(text.expandtabs(8), font, size, sheet[0] - 2 * margin)
    first: dict[int, str] = {}
    for c in text:
        first.setdefault(font.glyph(c), c)
    scale = 1000 / font.units
    tag = f"{tag_of(set(first))}+Embedded"
    doc = Document()
    file = doc.add(Stream({}, font.subset(set(first))))
    about = doc.add({"Type": Name("FontDescriptor"), "FontName": Name(tag), "Flags": 4, "FontBBox": [int(v * scale) for v in font.box], "ItalicAngle": 0, "Ascent": int(font.ascent * scale), "Descent": int(font.descent * scale), "CapHeight": int(font.ascent * scale), "StemV": 80, "FontFile2": file})
    widths = [x for g in sorted(first) if g < font.glyphs for x in (g, [int(font.advances[g] * scale + 0.5)])]
    inner = doc.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name(tag), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "FontDescriptor": about, "W": widths, "CIDToGIDMap": Name("Identity")})
    whole = doc.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name(tag), "Encoding": Name("Identity-H"), "DescendantFonts": [inner], "ToUnicode": doc.add(Stream({}, unicode_map(first)))})
    rows, pages = max(1, int((sheet[1] - 2 * margin) / (1.25 * size))), []
    for at in range(0, len(lines), rows):
        shown = b" T*\n".join(b"<" + b"".join(b"%04x" % font.glyph(c) for c in line) + b"> Tj" for line in lines[at : at + rows])
        body = b"BT /F1 %g Tf %g TL %g %g Td\n" % (size, 1.25 * size, margin, sheet[1] - margin - size) + shown + b"\nET"
        page = {"Type": Name("Page"), "MediaBox": [0, 0, *map(float, sheet)], "Resources": {"Font": {"F1": whole}}, "Contents": doc.add(Stream({}, body))}
        pages.append((doc.add(page), page))
    doc.trailer["Root"] = doc.add({"Type": Name("Catalog")})
    return pdf.with_pages(doc, pages)

from pathlib import Path

import pytest

from leafmill.sources import fonts, pdf

FOUND = next(iter(sorted(Path("/usr/share/fonts").rglob("DejaVuSans.ttf"))), None) if Path("/usr/share/fonts").is_dir() else None
needs_font = pytest.mark.skipif(FOUND is None, reason="no font here")


@pytest.fixture(scope="module")
def font():
    return fonts.Font(FOUND.read_bytes())


@needs_font
def test_measured_lines_fit(font):
    text = "word " * 60 + "\n\n" + "x" * 300
    lines = fonts.wrapped(text, font, 10, 200)
    assert all(font.width(x, 10) <= 200 for x in lines) and "".join(lines).replace(" ", "") == text.replace(" ", "").replace("\n", "")
    assert "" in lines and fonts.wrapped("W", font, 10, 1) == ["W"]


@needs_font
def test_subsets_keep_used_glyphs_and_parse(font):
    used = {font.glyph(c) for c in "aÄй"}
    small = font.subset(used)
    assert len(small) < len(FOUND.read_bytes()) / 10
    part = dict(font.tables)
    again = fonts.Font.__new__(fonts.Font)
    head = {small[i : i + 4]: (int.from_bytes(small[i + 8 : i + 12], "big"), int.from_bytes(small[i + 12 : i + 16], "big")) for i in range(12, 12 + 16 * int.from_bytes(small[4:6], "big"), 16)}
    again.tables = {t: small[a : a + n] for t, (a, n) in head.items()}
    again.glyphs = font.glyphs
    again.places = [int.from_bytes(again.tables[b"loca"][i : i + 4], "big") for i in range(0, 4 * font.glyphs + 4, 4)]
    outline = lambda f, g: f.tables[b"glyf"][f.places[g] : f.places[g + 1]]
    for g in used | {p for u in used for p in font.parts(u)}:
        own = part[b"glyf"][font.places[g] : font.places[g + 1]]
        assert outline(again, g)[: len(own)] == own
    assert outline(again, font.glyph("z")) == b"" and fonts._sum(small) == 0xB1B0AFBA


@needs_font
def test_text_in_any_script_can_be_read_back(font):
    text = "Привет, мир\nΑβγ é ß €\n" + "длинное слово " * 30
    rows = list(pdf.page_rows(pdf.load(pdf.save(fonts.text_document(text, font)))))
    assert "".join(r["text"] for r in rows).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert len(pdf.save(fonts.text_document("abc", font))) < 30_000


def test_other_files_are_refused():
    for raw in (b"", b"OTTO" + bytes(40), b"\0\1\0\0" + bytes(3)):
        with pytest.raises(fonts.Unusable):
            fonts.Font(raw)
    assert fonts.tag_of({1, 2}) == fonts.tag_of({2, 1}) != fonts.tag_of({1})

import struct
import zlib

import numpy as np
import pytest

from leafmill.functions import pixels
from leafmill.sources import pdf, pdf_content, psd
from leafmill.sources.pdf import Name, Stream


def photoshop(planes, *, mode=3, depth=8, layers=b"", packed=True, palette=b""):
    """A Photoshop file of planes (channels, height, width)."""
    n, h, w = planes.shape
    rows = [bytes([w - 1]) + p.tobytes() for p in planes.reshape(-1, w)]
    data = struct.pack(f">{len(rows)}H", *map(len, rows)) + b"".join(rows) if packed else planes.astype(">u2" if depth == 16 else np.uint8).tobytes()
    head = struct.pack(">4sH6xHIIHH", b"8BPS", 1, n, h, w, depth, mode)
    return head + struct.pack(">I", len(palette)) + palette + struct.pack(">I", 0) + struct.pack(">I", len(layers)) + layers + struct.pack(">H", int(packed)) + data


RGB = np.array([[[255, 255], [0, 0]], [[0, 0], [255, 255]], [[0, 0], [0, 0]]], dtype=np.uint8)
ALPHA = np.array([[[255, 0], [128, 255]]], dtype=np.uint8)


def test_photoshop_pictures():
    assert psd.decode(photoshop(RGB))[0, 0].tolist() == [255, 0, 0] and psd.decode(photoshop(RGB))[1, 0].tolist() == [0, 255, 0]
    both = np.concatenate([RGB, ALPHA])
    assert psd.decode(photoshop(both)).shape == (2, 2, 3)
    clear = psd.decode(photoshop(both, layers=struct.pack(">Ihi", 2, -1, 0)))
    assert clear[0, 1].tolist() == [255, 0, 0, 0] and clear[1, 0].tolist() == [0, 255, 0, 128]
    assert psd.decode(photoshop(RGB.astype(np.uint16) * 257, depth=16, packed=False))[1, 1].tolist() == [0, 255, 0]
    table = bytes(range(256)) + bytes(256) + bytes([9] * 256)
    assert psd.decode(photoshop(RGB[:1] // 85, mode=2, palette=table))[0, 0].tolist() == [3, 0, 9]
    assert psd.decode(photoshop(np.full((4, 1, 1), 128, np.uint8), mode=4)).tolist() == [[[64, 64, 64]]]


def test_photoshop_damage():
    raw = photoshop(RGB)
    for size in range(len(raw)):
        with pytest.raises(ValueError):
            psd.decode(raw[:size])
    huge = bytearray(raw)
    huge[12:22] = struct.pack(">HII", 56, 64_000_000, 1)
    with pytest.raises(ValueError):
        psd.decode(bytes(huge))


def test_blank_sheets_and_contrast():
    rng = np.random.default_rng(7)
    sheet = (240 - rng.integers(0, 8, (300, 210))).astype(np.uint8)
    sheet[:, :5] = 20  # the dark edge of a scan lies in the margin
    assert pixels.is_blank(sheet)
    written = sheet.copy()
    written[100:110, 50:150] = 10
    assert not pixels.is_blank(written) and pixels.is_blank(np.zeros((0, 5), np.uint8))
    stripes = np.tile(np.array([100, 180], np.uint8), (100, 50))
    assert pixels.stretched(stripes)[0, :2].tolist() == [0, 255]
    assert (pixels.stretched(sheet[:, 20:]) == sheet[:, 20:]).all()
    assert pixels.lightened(np.array([[0, 128, 255]], np.uint8)).tolist() == [[0, 161, 255]]


def test_turns_samples_and_sizes():
    image = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert pixels.turned(image, 1).tolist() == [[3, 0], [4, 1], [5, 2]] and pixels.turned(image, 0, True).tolist() == [[2, 1, 0], [5, 4, 3]]
    assert pixels.unpacked(bytes([0b10110000, 0b01000000]), 4, 2, 1, 1)[..., 0].tolist() == [[255, 0, 255, 255], [0, 255, 0, 0]]
    assert pixels.unpacked(bytes([0x1F, 0x80]), 3, 1, 1, 4, inverted=True)[..., 0].tolist() == [[238, 0, 119]]
    assert pixels.unpacked(b"\x12\x34", 2, 1, 1, 16)[..., 0].tolist() == [[18, 0]]
    flat = np.full((90, 60, 3), 77, np.uint8)
    assert pixels.resized(flat, 7, 5).tolist() == np.full((5, 7, 3), 77).tolist()
    assert pixels.effectively_gray(flat) and pixels.few_colours(flat)
    assert pixels.over_white(np.array([[[0, 0, 0, 0], [10, 20, 30, 255]]], np.uint8)).tolist() == [[[255, 255, 255], [10, 20, 30]]]


def scan(picture, filtered=True):
    """A page that draws a gray picture over its whole sheet."""
    doc = pdf.Document()
    entries = {"Subtype": Name("Image"), "Width": picture.shape[1], "Height": picture.shape[0], "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}
    image = doc.add(Stream(entries | ({"Filter": Name("FlateDecode")} if filtered else {}), zlib.compress(picture.tobytes()) if filtered else picture.tobytes()))
    page = {"Type": Name("Page"), "MediaBox": [0, 0, 100, 200], "Resources": {"XObject": {"Im0": image}}, "Contents": doc.add(Stream({}, b"q 2 0 0 2 0 0 cm 50 0 0 100 0 0 cm /Im0 Do Q"))}
    doc.trailer["Root"] = doc.add({"Type": Name("Catalog")})
    return pdf.with_pages(doc, [(doc.add(page), page)])


def test_blank_pages_of_scans():
    white = np.full((80, 60), 240, np.uint8)
    inked = white.copy()
    inked[30:40, 20:40] = 0
    doc = pdf.load(pdf.save(pdf.merge([scan(inked), scan(white), pdf.from_text("text"), scan(white, False)])))
    assert [pdf_content.is_blank(doc, p) for _, p in doc.pages()] == [False, True, False, True]
    assert len(pdf_content.without_blank_pages(doc).pages()) == 2
    assert len(pdf_content.without_blank_pages(pdf.merge([scan(white), scan(white)])).pages()) == 2


def test_drawings_and_images():
    doc = scan(np.arange(6, dtype=np.uint8).reshape(2, 3))
    (ref, matrix), = pdf_content.drawings(doc, doc.pages()[0][1])
    assert matrix == (100.0, 0.0, 0.0, 200.0, 0.0, 0.0)
    assert pdf_content.decode_image(doc, doc.get(ref)).tolist() == [[0, 1, 2], [3, 4, 5]]
    indexed = Stream({"Width": 2, "Height": 1, "BitsPerComponent": 4, "ColorSpace": [Name("Indexed"), Name("DeviceRGB"), 1, b"\1\2\3\4\5\6"]}, b"\x10")
    assert pdf_content.decode_image(doc, indexed).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    cmyk = Stream({"Width": 1, "Height": 1, "ColorSpace": Name("DeviceCMYK")}, bytes([255, 0, 0, 0]))
    assert pdf_content.decode_image(doc, cmyk).tolist() == [[[0, 255, 255]]]
    with pytest.raises(pdf.Unreadable):
        pdf_content.decode_image(doc, Stream({"Filter": Name("JPXDecode")}, b""))


def test_numbers_on_pages():
    doc = pdf.merge([pdf.from_text(f"body {i}") for i in range(3)])
    marked = pdf_content.number_pages(pdf.rotate(doc, 90, {2}), "- {n}/{total} -", [2, 3], start=5, x=50, y=20)
    texts = [r["text"] for r in pdf.page_rows(pdf.load(pdf.save(marked)))]
    assert "- " not in texts[0] and "body 1" in texts[1] and "- 5/6 -" in texts[1] and "- 6/6 -" in texts[2]
    with pytest.raises(ValueError):
        pdf_content.number_pages(doc, "page", x=0, y=0)
    with pytest.raises(ValueError):
        pdf_content.mark_text(doc, {9: "x"}, x=0, y=0)


def test_images_shrink_where_they_are_drawn():
    rng = np.random.default_rng(3)
    noisy = rng.integers(0, 256, (990, 700), dtype=np.uint8)
    raw = pdf.save(scan(noisy))
    doc, counts = pdf_content.optimise(pdf.load(raw), 72)
    (ref, _), = pdf_content.drawings(doc, doc.pages()[0][1])
    assert counts == {"resized": 1, "kept": 0, "skipped": 0}
    assert pdf_content.decode_image(doc, doc.get(ref)).shape == (200, 141) and len(pdf.save(doc)) < len(raw) / 10
    assert pdf_content.optimise(pdf.load(raw), 2000)[1]["kept"] == 1
    steps = [300, 200, 150, 120, 100, 85, 72]
    assert pdf_content.fit_size(raw, len(raw), steps) == (raw, None)
    sizes = {s: len(pdf.save(pdf_content.optimise(pdf.load(raw), s)[0])) for s in steps}
    for limit in (sizes[300], sizes[120] + 5, sizes[72]):
        made, step = pdf_content.fit_size(raw, limit, steps)
        assert len(made) <= limit and step == max(s for s in steps if sizes[s] <= limit)
    with pytest.raises(ValueError):
        pdf_content.fit_size(raw, 100, steps)

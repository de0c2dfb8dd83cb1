"""Frames of image files, JPEGs and the PDFs made of them; Spark's own decoder reads what is written here."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leafmill.operators import pdf_files, raster_files, rows
from leafmill.plans import queries
from leafmill.sources import frames, jpeg, pdf, rasters


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray, step: int, kinds: list[int]) -> bytes:
    """Rows under PNG filters, byte by byte."""
    out, above = bytearray(), bytes(rows.shape[1])
    for row, kind in zip((bytes(r) for r in rows), kinds):
        out.append(kind)
        for i, x in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            guess = min((abs(p - v), n, v) for n, v in enumerate((a, b, c)))[2]
            out.append((x - (0, a, b, (a + b) // 2, guess)[kind]) & 255)
        above = row
    return bytes(out)


def png(image: np.ndarray, kind: int, bits: int = 8, kinds=(0, 1, 2, 3, 4), extra: bytes = b"") -> bytes:
    h, w = image.shape[:2]
    rows = np.packbits(image, axis=1) if bits == 1 else image.reshape(h, -1)
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind] * bits // 8)
    data = zlib.compress(filtered(rows, step, [kinds[y % len(kinds)] for y in range(h)]))
    return rasters.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0)) + extra + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def tiff(pages: list[np.ndarray], packing: int = 1) -> bytes:
    out, links = bytearray(b"II*\0\0\0\0\0"), 4
    for image in pages:
        h, w = image.shape[:2]
        data = zlib.compress(image.tobytes()) if packing == 8 else image.tobytes()
        start = len(out)
        out += data + b"\0" * (len(data) % 2)
        channels = 1 if image.ndim == 2 else image.shape[2]
        fields = {256: w, 257: h, 258: 8, 259: packing, 262: 1 if channels == 1 else 2, 273: start, 277: channels, 278: h, 279: len(data)}
        struct.pack_into("<I", out, links, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in fields.items())
        links = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def gif(indices: list[np.ndarray], palette: bytes, extra: list[bytes]) -> bytes:
    """Frames whose codes are all of nine bits: a clear code before the words grow."""
    h, w = indices[0].shape
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + palette.ljust(768, b"\0")
    for index, before in zip(indices, extra):
        codes = [256]
        for i, x in enumerate(index.ravel().tolist()):
            codes += [x] if i % 200 else [256, x]
        value = sum(c << 9 * i for i, c in enumerate([*codes, 257]))
        data = value.to_bytes((9 * (len(codes) + 1) + 7) // 8, "little")
        blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
        out += before + b"," + struct.pack("<HHHHB", 0, 0, index.shape[1], index.shape[0], 0) + b"\x08" + blocks + b"\0"
    return out + b";"


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(7).integers(0, 256, (23, 31, 4), dtype=np.uint8)


@pytest.fixture(scope="module")
def slope():
    """A smooth coloured picture."""
    y, x = np.mgrid[0:75, 0:101]
    return np.dstack([x * 2, y * 3, 255 - x - y]).astype(np.uint8)


@pytest.mark.parametrize("kind,channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("kinds", [(0,), (2, 1), (4,), (3,), (0, 1, 2, 3, 4)])
def test_png_filters(noise, kind, channels, kinds):
    image = noise[..., 0] if channels == 1 else np.ascontiguousarray(noise[..., :channels])
    (found,) = frames.png_frames(png(image, kind, kinds=kinds))
    assert (found == image).all()


def test_png_bits_palettes_and_edges(noise):
    bits = noise[..., 0] & 1
    assert (next(frames.png_frames(png(bits, 0, bits=1))) == bits * 255).all()
    palette = bytes(range(6)) + b"\xff" * 762
    coloured = next(frames.png_frames(png(bits, 3, extra=chunk(b"PLTE", palette) + chunk(b"tRNS", b"\0"))))
    assert (coloured[..., :3] == np.array([[0, 1, 2], [3, 4, 5]])[bits]).all() and (coloured[..., 3] == bits * 255).all()
    for shape in ((1, 1), (1, 9), (9, 1)):
        image = noise[: shape[0], : shape[1], 0]
        assert (next(frames.png_frames(png(image, 0, kinds=(4, 3)))) == image).all()
    for broken in (b"", rasters.PNG, png(bits, 0)[:60], rasters.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")):
        with pytest.raises(ValueError):
            list(frames.frames(broken))


def test_interlaced_png(noise):
    image, data = noise[..., 0], b""
    for x, y, dx, dy in frames.PASSES:
        part = image[y::dy, x::dx]
        data += filtered(part, 1, [4] * len(part)) if part.size else b""
    raw = rasters.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 31, 23, 8, 0, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")
    assert (next(frames.png_frames(raw)) == image).all()


def test_animated_png(noise):
    """The second frame covers a part; the first is cleared where it is told to be."""
    first, second = noise.copy(), noise[:5, :6].copy()
    first[..., 3] = second[..., 3] = 255
    control = lambda n, w, h, x, y, dispose: chunk(b"fcTL", struct.pack(">IIIIIHHBB", n, w, h, x, y, 1, 1, dispose, 0))
    pack = lambda i: zlib.compress(filtered(i.reshape(len(i), -1), 4, [1] * len(i)))
    for dispose in (0, 1):
        raw = rasters.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 31, 23, 8, 6, 0, 0, 0)) + chunk(b"acTL", struct.pack(">II", 2, 0))
        raw += control(0, 31, 23, 0, 0, dispose) + chunk(b"IDAT", pack(first)) + control(1, 6, 5, 2, 3, 0) + chunk(b"fdAT", struct.pack(">I", 2) + pack(second)) + chunk(b"IEND", b"")
        one, two = frames.png_frames(raw)
        wanted = first.copy() if dispose == 0 else np.zeros_like(first)
        wanted[3:8, 2:8] = second
        assert (one == first).all() and (two == wanted).all()


def test_gif_frames(noise):
    palette = bytes(range(256)) * 3
    colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    clear = b"!\xf9\x04" + bytes((1, 0, 0, 5)) + b"\0"  # colour 5 is not drawn
    one, two = frames.gif_frames(gif([noise[..., 0], noise[..., 1]], palette, [b"", clear]))
    assert (one[..., :3] == colours[noise[..., 0]]).all()
    assert (two[..., :3] == colours[np.where(noise[..., 1] == 5, noise[..., 0], noise[..., 1])]).all()


def test_lzw_words_grow():
    """Runs give ever longer words, past the width of nine bits, in both orders of bits."""
    data = b"".join(bytes([i % 7]) * (i % 50 + 1) for i in range(900))
    for high_first in (False, True):
        words, codes, held = {bytes((i,)): i for i in range(256)}, [(256, 9)], b""
        width = 9
        for x in data:
            if held + bytes((x,)) in words:
                held += bytes((x,))
                continue
            codes.append((words[held], width))
            if len(words) + 2 < 4095:
                words[held + bytes((x,))] = len(words) + 2
            width = min(12, max(9, (len(words) + 1 + high_first).bit_length()))
            held = bytes((x,))
        codes += [(words[held], width)]
        text = "".join(format(c, f"0{n}b") if high_first else format(c, f"0{n}b")[::-1] for c, n in codes)
        text += "0" * (-len(text) % 8)
        packed = bytes(int(text[i : i + 8] if high_first else text[i : i + 8][::-1], 2) for i in range(0, len(text), 8))
        assert frames.lzw(packed, 8, len(data), tiff=high_first) == data


def test_tiff_pages(noise, slope):
    for packing in (1, 8):
        found = list(frames.tiff_pages(tiff([noise[..., 0], slope], packing)))
        assert (found[0] == noise[..., 0]).all() and (found[1] == slope).all()
    ring = bytearray(tiff([slope]))
    ring[-4:] = ring[4:8]
    with pytest.raises(ValueError, match="ring"):
        list(frames.tiff_pages(bytes(ring)))


def test_jpegs_as_sparks_decoder_reads_them(spark, tmp_path, slope, noise):
    gray = slope[..., 0]
    made = {"slope": slope, "gray": gray, "clear": np.dstack([slope, np.full(gray.shape, 255, np.uint8)]), "noise": noise[..., :3], "dot": slope[:1, :1]}
    for name, image in made.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(image, 95))
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff")
    rows = {r.path.rpartition("/")[2][:-4]: r for r in raster_files.decoded(spark, str(tmp_path)).collect()}
    assert rows.keys() == made.keys()
    for name, image in made.items():
        row = rows[name]
        found = raster_files.as_array(bytes(row.data), row.width, row.height, row.channels).astype(int)
        assert found.shape == image[..., :3].shape if image.ndim == 3 and name != "dot" else found.shape[:2] == image.shape[:2]
        if name != "dot":
            assert np.abs(found - image[..., : found.shape[-1]] if found.ndim == 3 else found - image).mean() < (6 if name == "noise" else 1.5)


def test_best_quality_that_fits(spark, tmp_path, slope, noise):
    sizes = {q: len(jpeg.encode(noise[..., :3], q)) for q in range(20, 91)}
    for limit in (sizes[50], sizes[90] * 2, sizes[20]):
        made, quality = jpeg.fit(noise[..., :3], limit, 90)
        assert len(made) <= limit and quality == max(q for q in sizes if sizes[q] <= limit)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(np.tile(noise[..., :3], (6, 6, 1)), 95))
    pictures = raster_files.decoded(spark, str(tmp_path))
    small = raster_files.fitted(pictures, 4000).first()
    assert small.error is None and len(small.content) <= 4000 and rasters.jpeg_at(bytes(small.content))[1] < 186
    assert "under 10 bytes" in raster_files.fitted(pictures, 10).first().error


def test_files_as_pages_and_documents(spark, noise, slope):
    files = spark.createDataFrame(
        [("a.png", bytearray(png(slope, 2))), ("b.tif", bytearray(tiff([noise[..., 0], slope]))), ("c.jpg", bytearray(jpeg.encode(slope))), ("d.png", bytearray(b"none")), ("e.gif", None)],
        "path string, content binary",
    )
    pages = {(r.path, r.page): (r.width, r.height) for r in raster_files.jpeg_pages(files).where("error is null").collect()}
    assert pages == {("a.png", 1): (101, 75), ("b.tif", 1): (31, 23), ("b.tif", 2): (101, 75), ("c.jpg", 1): (101, 75)}
    made = {r.path: r for r in raster_files.image_documents(files, sheet=None).collect()}
    assert [(p, r.pages, r.error is None) for p, r in sorted(made.items())] == [("a.png", 1, True), ("b.tif", 2, True), ("c.jpg", 1, True), ("d.png", None, False), ("e.gif", None, False)]
    assert [r["width"] for r in pdf.page_rows(pdf.load(bytes(made["b.tif"].content)))] == pytest.approx([31 * 0.75, 101 * 0.75])
    dense = png(slope, 2, extra=chunk(b"pHYs", struct.pack(">IIB", 11811, 11811, 1)))
    assert next(pdf.page_rows(raster_files.image_document(dense, sheet=None)))["width"] == pytest.approx(101 * 72 / 300)


def test_pictures_no_larger_than_the_sheet_asks_for(slope):
    (made,) = raster_files.to_jpegs(png(np.tile(slope, (4, 4, 1)), 2, kinds=(2,)), sheet=(72.0, 144.0), dpi=100)
    assert rasters.jpeg_at(made)[1:] == (135, 100)


def test_code_lengths_are_the_best_ones():
    """As whole packages give them, words of equal weight and codes too deep for 16 bits among them."""
    rng = np.random.default_rng(3)
    for n, weights in ((1, [5]), (2, [1, 1]), (40, 2 ** np.arange(40)), (162, rng.integers(1, 4, 162)), (90, rng.zipf(1.5, 90) % 10_000 + 1)):
        counts = np.zeros(256, np.int64)
        counts[rng.choice(256, n, replace=False)] = weights
        used = np.flatnonzero(counts)
        leaves = sorted([(0, (n,)), *((int(counts[s]), (i,)) for i, s in enumerate(used))])
        row = leaves
        for _ in range(15):
            row = sorted(leaves + [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])], key=lambda x: x[0])
        within = np.bincount([i for _, held in row[: 2 * len(leaves) - 2] for i in held], minlength=len(leaves))
        assert (jpeg.code_lengths(counts)[used] == within[:-1]).all() and np.count_nonzero(jpeg.code_lengths(counts)) == n


def test_small_rows_share_batches_and_large_ones_do_not():
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    small = list(rows.gathered(({"path": str(i)} for i in range(1000)), schema))
    assert len(small) == -(-1000 // rows.ROWS) and [p for b in small for p in b.column("path").to_pylist()] == [str(i) for i in range(1000)]
    large = list(rows.gathered(({"path": "p", "content": bytes(rows.BYTES)} for _ in range(5)), schema))
    assert [b.num_rows for b in large] == [1] * 5 and not list(rows.gathered([], schema))


def test_pictures_leave_in_few_batches(monkeypatch):
    """A message for each small row took most of the time."""

    class Files:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    files = Files()
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(500)], "content": [b"x" * (i % 200) for i in range(500)]}, pa.schema([("path", pa.string()), ("content", pa.binary())]))
    monkeypatch.setattr(raster_files, "F", type("Columns", (), {"col": staticmethod(lambda name: type("Column", (), {"cast": lambda s, t: s, "alias": lambda s, n: s})())}))
    made = list(raster_files.pictures_of(files, "path", "content")([batch]))
    read = list(raster_files.pixel_bytes(files)(made))
    assert len(made) <= 3 and len(read) <= 3
    found = [d for b in read for d in b.column("data").to_pylist()]
    assert [d.rstrip(b"\0") for d in found] == [b"x" * (i % 200) for i in range(500)] and {len(d) % 64 for d in found} == {0}


def test_image_pages_make_each_file_once(spark):
    """Files that failed and those that did not come out of one pass."""
    plan = queries.image_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Union" not in plan
    files = spark.createDataFrame([("a", bytearray(b"none"), "it failed"), ("b", bytearray(b"none"), None)], "path string, content binary, error string")
    assert {r.path: r.error for r in pdf_files.pages(files, failed="error").collect()} == {"a": "it failed", "b": "Unreadable: not a PDF file"}
    assert {r.error for r in pdf_files.pages(files).collect()} == {"Unreadable: not a PDF file"}

"""Pictures in PNG, GIF and TIFF files as arrays, one for each frame or page, upright.

A frame is (height, width) gray or (height, width, 3), with a further channel where
there is transparency.  Sizes come from headers, which may lie: they are checked before
anything is made of them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from leafmill.functions import pixels
from leafmill.sources import rasters

#: Limits of frames of a file and of pixels of a frame.
FRAMES, PIXELS = 10_000, 300_000_000
#: Channels of the colour kinds of PNG files; first column, row and steps of the interlaced passes.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _checked(width: int, height: int) -> None:
    if not (width > 0 and height > 0) or width * height > PIXELS:
        raise ValueError(f"an impossible size, {width} x {height}")


def _unzipped(data: bytes, size: int) -> bytes:
    out = zlib.decompressobj().decompress(data, size + 1)[:size]
    if len(out) < size:
        raise ValueError("the picture is truncated")
    return out


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """PNG rows (height, bytes) without their filters; ``step`` is the distance of bytes that belong together.

    Where rows mix left and upper neighbours, bytes are found along falling diagonals,
    whose neighbours are all known by then.
    """
    h, w = rows.shape
    if h and kinds.max(initial=0) > 4:
        raise ValueError("an unknown PNG filter")
    if kinds.max(initial=0) < 3:
        if h and kinds.min() == 2:
            return np.cumsum(rows, axis=0, dtype=np.uint8)
        out = rows.copy()
        for y, kind in enumerate(kinds.tolist()):
            if kind == 1:
                out[y] = np.cumsum(out[y].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
            elif kind == 2 and y:
                out[y] += out[y - 1]
        return out
    across = w // step
    out = np.zeros((h + 1, across + 1, step), np.int16)
    out[1:, 1:] = rows.reshape(h, across, step)
    cells = out.reshape(-1, step)
    wide = across + 1
    for d in range(h + across - 1):
        top, n = max(0, d - across + 1), min(h, d + 1) - max(0, d - across + 1)
        kind = kinds[top : top + n, None]
        here = (top + 1) * wide + d - top + 1
        x, a, b, c = (cells[here - back :: across][:n] for back in (0, 1, wide, wide + 1))
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        x[:] = (x + np.where(kind == 1, a, np.where(kind == 2, b, np.where(kind == 3, (a + b) >> 1, np.where(kind == 4, nearest, 0))))) & 255
    return out[1:, 1:].reshape(h, w).astype(np.uint8)


def _png_samples(data: bytes, width: int, height: int, bits: int, channels: int, interlaced: bool) -> np.ndarray:
    out = np.zeros((height, width, channels), np.uint8)
    parts = [(x, y, dx, dy) for x, y, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),)) if x < width and y < height]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in parts]
    raw, at = _unzipped(data, sum(h * ((w * channels * bits + 7) // 8 + 1) for w, h in sizes)), 0
    for (x, y, dx, dy), (w, h) in zip(parts, sizes):
        row = (w * channels * bits + 7) // 8 + 1
        lines = np.frombuffer(raw, np.uint8, h * row, at).reshape(h, row)
        at += h * row
        plain = unfiltered(lines[:, 0], lines[:, 1:], max(1, channels * bits // 8))
        out[y::dy, x::dx] = pixels.unpacked(plain.tobytes(), w, h, channels, bits)
    return out


def png_frames(raw: bytes) -> Iterator[np.ndarray]:
    """The picture of a PNG file, or each whole picture of an animated one."""
    chunks = [(kind, chunk[8:-4]) for kind, chunk in rasters.png_chunks(raw)]
    width, height, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[0][1][:13])
    _checked(width, height)
    if kind not in CHANNELS or bits not in (1, 2, 4, 8, 16):
        raise ValueError("an unknown kind of PNG file")
    held = dict(reversed(chunks))
    palette, clear = np.frombuffer(held.get(b"PLTE", b""), np.uint8), held.get(b"tRNS")
    turn, mirrored = rasters.TURNS[_stored(held.get(b"eXIf", b""))]

    def picture(data: bytes, w: int, h: int) -> np.ndarray:
        samples = _png_samples(data, w, h, bits, CHANNELS[kind], bool(interlaced))
        if kind == 3:
            index = samples[..., 0] if bits == 8 else (samples[..., 0].astype(np.uint16) * ((1 << bits) - 1) // 255).astype(np.uint8)
            if index.max(initial=0) >= len(palette) // 3:
                raise ValueError("a colour outside the palette")
            alpha = np.frombuffer((clear or b"").ljust(256, b"\xff"), np.uint8)
            found = palette.reshape(-1, 3)[index]
            return np.dstack([found, alpha[index]]) if clear else found
        if clear and kind in (0, 2):
            wanted = np.frombuffer(clear, ">u2")[: CHANNELS[kind]]
            wanted = wanted >> 8 if bits == 16 else wanted * 255 // ((1 << bits) - 1)
            return np.dstack([samples, np.where((samples == wanted).all(axis=2), 0, 255).astype(np.uint8)])
        return samples[..., 0] if kind == 0 else samples

    if b"acTL" not in held:
        yield pixels.turned(picture(b"".join(c for k, c in chunks if k == b"IDAT"), width, height), turn // 90, mirrored)
        return
    canvas, shown, place, data = np.zeros((height, width, 4), np.uint8), 0, None, []

    def drawn() -> np.ndarray:
        nonlocal canvas
        w, h, x, y, dispose, blend = place
        if x + w > width or y + h > height:
            raise ValueError("a frame outside the picture")
        before = canvas.copy()
        _blend(canvas[y : y + h, x : x + w], _with_alpha(picture(b"".join(data), w, h)), replace=blend == 0)
        out = canvas.copy()
        if dispose == 1:
            canvas[y : y + h, x : x + w] = 0
        elif dispose == 2:
            canvas = before if shown else np.zeros_like(canvas)
        return pixels.turned(out, turn // 90, mirrored)

    for name, chunk in chunks:
        if name == b"fcTL" or name == b"IEND":
            if place and data:
                if shown == FRAMES:
                    raise ValueError(f"over {FRAMES} frames")
                yield drawn()
                shown += 1
            place, data = None, []
            if name == b"fcTL":
                w, h, x, y, dispose, blend = struct.unpack(">4xIIII4xBB", chunk[:26])
                _checked(w, h)
                place = w, h, x, y, dispose, blend
        elif place and name in (b"IDAT", b"fdAT"):
            data.append(chunk if name == b"IDAT" else chunk[4:])


def _with_alpha(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        image = np.dstack([image])
    channels = image.shape[2]
    colour = np.repeat(image[..., :1], 3, axis=2) if channels < 3 else image[..., :3]
    return np.dstack([colour, image[..., -1] if channels in (2, 4) else np.full(image.shape[:2], 255, np.uint8)])


def _blend(under: np.ndarray, over: np.ndarray, replace: bool = False) -> None:
    """Draw onto a part of a canvas, in place."""
    if replace:
        under[:] = over
        return
    a, b = over[..., 3:].astype(np.float64) / 255, under[..., 3:].astype(np.float64) / 255
    whole = a + b * (1 - a)
    colour = (over[..., :3] * a + under[..., :3] * b * (1 - a)) / np.maximum(whole, 1e-9)
    under[:] = np.floor(np.dstack([colour, whole * 255]) + 0.5).astype(np.uint8)


def _stored(tiff: bytes) -> int:
    value = rasters.exif_fields(tiff).get(0x112, 1)
    return int(value) if 1 <= value <= 8 else 1


def lzw(data: bytes, least: int, size: int, *, tiff: bool = False) -> bytes:
    """LZW data, cut at ``size`` bytes: GIF's (low bits first, ``least`` bits) or TIFF's (high bits first, longer one word early)."""
    clear, end = 1 << least, (1 << least) + 1
    roots = [bytes((i,)) for i in range(clear)] + [b"", b""]
    words, bits, held, have, last = list(roots), least + 1, 0, 0, b""
    out = bytearray()
    for byte in data:
        held = (held << 8 | byte) if tiff else (held | byte << have)
        have += 8
        while have >= bits:
            have -= bits
            if tiff:
                code, held = held >> have, held & ((1 << have) - 1)
            else:
                code, held = held & ((1 << bits) - 1), held >> bits
            if code == clear:
                words, bits, last = list(roots), least + 1, b""
                continue
            if code == end or len(out) >= size:
                return bytes(out[:size])
            if code > len(words) or (code == len(words) and not last):
                raise ValueError("broken LZW data")
            word = words[code] if code < len(words) else last + last[:1]
            if last and len(words) < 4096:
                words.append(last + word[:1])
            out += word
            last = word
            if len(words) + tiff >= 1 << bits and bits < 12:
                bits += 1
    return bytes(out[:size])


def gif_frames(raw: bytes) -> Iterator[np.ndarray]:
    """Each whole picture of a GIF file."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack_from("<HHB", raw, 6)
    _checked(width, height)
    at = 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    shared = np.frombuffer(raw[13:at], np.uint8).reshape(-1, 3) if flags & 128 else None
    canvas, shown, dispose, clear = np.zeros((height, width, 4), np.uint8), 0, 0, None

    def blocks() -> bytes:
        nonlocal at
        out = []
        while size := raw[at]:
            out.append(raw[at + 1 : at + 1 + size])
            at += size + 1
        at += 1
        return b"".join(out)

    try:
        while at < len(raw) and raw[at] != 0x3B:
            kind, at = raw[at], at + 1
            if kind == 0x21:
                label, at = raw[at], at + 1
                body = blocks()
                if label == 0xF9 and len(body) >= 4:
                    dispose, clear = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
                continue
            if kind != 0x2C:
                raise ValueError("an unknown GIF block")
            x, y, w, h, own = struct.unpack_from("<HHHHB", raw, at)
            at += 9
            _checked(w, h)
            palette = shared
            if own & 128:
                size = 3 << (own & 7) + 1
                palette = np.frombuffer(raw[at : at + size], np.uint8).reshape(-1, 3)
                at += size
            if palette is None:
                raise ValueError("a GIF frame without a palette")
            least, at = raw[at], at + 1
            if not 1 <= least <= 11:
                raise ValueError("an impossible GIF code size")
            index = np.frombuffer(lzw(blocks(), least, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if own & 64:
                rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                index = index[np.argsort(rows)]
            if shown == FRAMES:
                raise ValueError(f"over {FRAMES} frames")
            before, part = canvas.copy(), canvas[y : y + h, x : x + w]
            index = index[: part.shape[0], : part.shape[1]]
            seen = np.full(index.shape, True) if clear is None else index != clear
            part[seen] = np.dstack([palette[np.minimum(index, len(palette) - 1)], np.full(index.shape, 255, np.uint8)])[seen]
            yield canvas.copy()
            shown += 1
            if dispose == 2:
                part[:] = 0
            elif dispose == 3:
                canvas = before
            dispose, clear = 0, None
    except (IndexError, struct.error) as error:
        raise ValueError("the file is truncated") from error
    if not shown:
        raise ValueError("no frame")


def tiff_pages(raw: bytes) -> Iterator[np.ndarray]:
    """The pages of a TIFF file: gray, coloured or with a palette, plain, run lengths, LZW or zipped strips."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if order is None:
        raise ValueError("not a TIFF file")
    try:
        (at,) = struct.unpack_from(order + "I", raw, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("pages in a ring")
            if len(seen) == FRAMES:
                raise ValueError(f"over {FRAMES} pages")
            seen.add(at)
            (count,) = struct.unpack_from(order + "H", raw, at)
            yield _tiff_page(raw, order, dict(_tiff_field(raw, order, at + 2 + 12 * i) for i in range(count)))
            (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * count)
    except struct.error as error:
        raise ValueError("the file is truncated") from error
    if not seen:
        raise ValueError("no page")


def _tiff_field(raw: bytes, order: str, at: int) -> tuple[int, list[int]]:
    tag, kind, count = struct.unpack_from(order + "HHI", raw, at)
    letter = {1: "B", 3: "H", 4: "I"}.get(kind)
    if letter is None:
        return tag, []
    if count * struct.calcsize(letter) > 4:
        (place,) = struct.unpack_from(order + "I", raw, at + 8)
    else:
        place = at + 8
    if place + count * struct.calcsize(letter) > len(raw):
        raise ValueError("the file is truncated")
    return tag, list(struct.unpack_from(f"{order}{count}{letter}", raw, place))


def _tiff_page(raw: bytes, order: str, fields: dict[int, list[int]]) -> np.ndarray:
    one = lambda tag, default=0: (fields.get(tag) or [default])[0]
    width, height, bits, channels = one(256), one(257), one(258, 1), one(277, 1)
    _checked(width, height)
    packing, meaning, ahead = one(259, 1), one(262), one(317, 1)
    if bits not in (1, 2, 4, 8, 16) or channels > 8 or one(284, 1) != 1 or meaning > 3 or (ahead == 2 and bits != 8) or ahead > 2 or one(266, 1) != 1:
        raise ValueError("a kind of TIFF page that is not read")
    row, strip = (width * channels * bits + 7) // 8, min(one(278, height) or height, height)
    parts = []
    for i, (start, size) in enumerate(zip(fields.get(273, []), fields.get(279, []))):
        rows = min(strip, height - i * strip)
        if rows <= 0:
            break
        data = raw[start : start + size]
        if packing == 5:
            data = lzw(data, 8, rows * row, tiff=True)
        elif packing in (8, 32946):
            data = _unzipped(data, rows * row)
        elif packing == 32773:
            data = rasters.unpack_bits(data, rows * row)
        elif packing != 1:
            raise ValueError(f"packing {packing} is not read")
        if len(data) < rows * row:
            raise ValueError("the page is truncated")
        lines = np.frombuffer(data[: rows * row], np.uint8).reshape(rows, row)
        parts.append(np.cumsum(lines.reshape(rows, width, channels), axis=1, dtype=np.uint8).reshape(rows, row) if ahead == 2 else lines)
    if sum(map(len, parts)) < height:
        raise ValueError("the page is truncated")
    plain = np.concatenate(parts)
    if bits == 16 and order == "<":
        plain = plain.reshape(height, -1, 2)[..., ::-1].reshape(height, row)
    samples = pixels.unpacked(plain.tobytes(), width, height, channels, bits, inverted=meaning == 0)
    if meaning == 3:
        index = samples[..., 0].astype(np.uint16) * ((1 << min(bits, 8)) - 1) // 255
        colours = np.array(fields.get(320, []), np.uint16).reshape(3, -1).T
        if index.max(initial=0) >= len(colours):
            raise ValueError("a colour outside the palette")
        image = (colours[index] >> 8).astype(np.uint8)
    elif meaning == 2:
        image = samples[..., : 4 if channels > 3 and one(338) else 3]
    else:
        image = samples[..., 0] if channels == 1 or not one(338) else samples[..., :2]
    value = one(274, 1)
    turn, mirrored = rasters.TURNS[value if 1 <= value <= 8 else 1]
    return pixels.turned(image, turn // 90, mirrored)


def frames(raw: bytes) -> Iterator[np.ndarray]:
    """The frames of a file, by its content."""
    readers = {rasters.PNG[:4]: png_frames, b"GIF8": gif_frames, b"II*\0": tiff_pages, b"MM\0*": tiff_pages}
    if raw[:4] == b"8BPS":
        from leafmill.sources import psd

        yield psd.decode(raw)
        return
    if raw[:4] not in readers:
        raise ValueError("no frames are read from this kind of file")
    yield from readers[raw[:4]](raw)

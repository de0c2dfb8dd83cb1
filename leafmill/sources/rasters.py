"""Image files without a codec: segments and chunks, sizes, resolution, previews, run lengths."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
#: Chunk and segment kinds that hold private metadata.
PNG_PRIVATE = {b"tEXt", b"zTXt", b"iTXt", b"tIME", b"eXIf", b"dSIG", b"caBX"}
JPEG_PRIVATE = {0xE1, 0xEB, 0xED, 0xFE}
#: Frame headers whose pictures common decoders read, and lossless ones.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC5, 0xC6, 0xC9, 0xCA, 0xCD, 0xCE}
LOSSLESS = {0xC3, 0xC7, 0xCB, 0xCF}
_ALONE = {0x01, *range(0xD0, 0xDA)}


def png_chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, whole chunk) up to the end chunk."""
    if not raw.startswith(PNG):
        raise ValueError("not a PNG file")
    at, kind = len(PNG), b""
    while kind != b"IEND":
        size = int.from_bytes(raw[at : at + 4], "big")
        kind, chunk = raw[at + 4 : at + 8], raw[at : at + size + 12]
        if size > 0x7FFFFFFF or len(chunk) < size + 12:
            raise ValueError("truncated PNG file")
        yield kind, chunk
        at += len(chunk)


def png_file(image: np.ndarray) -> bytes:
    """A PNG of eight-bit pixels, gray or with 2 to 4 channels, each row as its difference to the one above."""
    rows = image.reshape(image.shape[0], -1)
    above = np.concatenate([np.zeros_like(rows[:1]), rows[:-1]])
    lines = np.concatenate([np.full((len(rows), 1), 2, np.uint8), rows - above], axis=1)
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    parts = ((b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, kind, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b""))
    return PNG + b"".join(struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body)) for name, body in parts)


def strip_png(raw: bytes, keep_icc: bool = False) -> bytes:
    return PNG + b"".join(c for k, c in png_chunks(raw) if k not in PNG_PRIVATE and (keep_icc or k != b"iCCP"))


def scan_end(raw: bytes, at: int) -> int | None:
    """Place of the marker that ends entropy-coded data; stuffing and restarts belong to it."""
    while (at := raw.find(b"\xff", at)) >= 0:
        after = at + 1
        while raw[after : after + 1] == b"\xff":
            after += 1
        if after >= len(raw):
            return None
        if raw[after] and not 0xD0 <= raw[after] <= 0xD7:
            return at
        at = after + 1
    return None


def jpeg_segments(raw: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(marker, payload, entropy-coded data after it) of each segment, the end marker last."""
    if not raw.startswith(b"\xff\xd8"):
        raise ValueError("not a JPEG file")
    at = 2
    while (at := raw.find(b"\xff", at)) >= 0:
        while raw[at : at + 1] == b"\xff":
            at += 1
        if at >= len(raw):
            raise ValueError("truncated JPEG marker")
        marker, at = raw[at], at + 1
        if marker in _ALONE:
            yield marker, b"", b""
            if marker == 0xD9:
                return
            continue
        size = int.from_bytes(raw[at : at + 2], "big")
        if size < 2 or at + size > len(raw):
            raise ValueError("truncated JPEG segment")
        payload, at, data = raw[at + 2 : at + size], at + size, b""
        if marker == 0xDA:
            end = scan_end(raw, at)
            if end is None:
                raise ValueError("truncated JPEG data")
            data, at = raw[at:end], end
        yield marker, payload, data


def exif_fields(payload: bytes) -> dict[int, float]:
    """Numbers of the first directory of an EXIF segment (or of bare TIFF data)."""
    tiff = payload[6:] if payload.startswith(b"Exif\0\0") else payload
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if order is None:
        return {}
    out = {}
    try:
        (at,) = struct.unpack_from(order + "I", tiff, 4)
        (count,) = struct.unpack_from(order + "H", tiff, at)
        for i in range(count):
            tag, kind, _, value = struct.unpack_from(order + "HHI4s", tiff, at + 2 + 12 * i)
            if kind == 3:
                out[tag] = struct.unpack_from(order + "H", value)[0]
            elif kind == 4:
                out[tag] = struct.unpack_from(order + "I", value)[0]
            elif kind == 5:
                top, bottom = struct.unpack_from(order + "II", tiff, struct.unpack(order + "I", value)[0])
                out[tag] = top / bottom if bottom else 0.0
    except struct.error:
        pass
    return out


def orientation(raw: bytes) -> int | None:
    """Stored orientation, 1 to 8, of a JPEG or TIFF file."""
    parts = [p for m, p, _ in jpeg_segments(raw) if m == 0xE1 and p.startswith(b"Exif\0\0")] if raw.startswith(b"\xff\xd8") else [raw]
    found = [f[0x112] for f in map(exif_fields, parts) if 1 <= f.get(0x112, 0) <= 8]
    return int(found[0]) if found else None


def orientation_segment(value: int) -> bytes:
    """The smallest EXIF segment that holds an orientation."""
    tiff = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x112, 3, 1, value, 0, 0)
    payload = b"Exif\0\0" + tiff
    return b"\xff\xe1" + struct.pack(">H", len(payload) + 2) + payload


def strip_jpeg(raw: bytes, keep_icc: bool = False) -> bytes:
    """Without private metadata; pixels stay as they are, and so does an orientation other than 1."""
    out = [b"\xff\xd8"]
    for marker, payload, data in jpeg_segments(raw):
        if marker in JPEG_PRIVATE or (marker == 0xE2 and not keep_icc):
            turn = exif_fields(payload).get(0x112) if marker == 0xE1 and payload.startswith(b"Exif\0\0") else None
            out += [orientation_segment(int(turn))] if turn not in (None, 1) else []
        elif marker in _ALONE:
            out.append(bytes((0xFF, marker)))
        else:
            out.append(bytes((0xFF, marker)) + struct.pack(">H", len(payload) + 2) + payload + data)
    return b"".join(out)


def jpeg_at(raw: bytes, start: int = 0) -> tuple[bytes, int, int] | None:
    """(file, width, height) of a whole JPEG that starts at a place, or None; lossless frames do not count."""
    at, size = start + 2, None
    if raw[start:at] != b"\xff\xd8":
        return None
    while raw[at : at + 1] == b"\xff":
        while raw[at : at + 1] == b"\xff":
            at += 1
        if at >= len(raw):
            return None
        marker, at = raw[at], at + 1
        if marker == 0xD9:
            return (raw[start:at], *size) if size else None
        if marker in _ALONE:
            continue
        length = int.from_bytes(raw[at : at + 2], "big")
        if length < 2 or at + length > len(raw) or marker in LOSSLESS:
            return None
        if marker in FRAMES and length >= 8:
            height, width = struct.unpack_from(">HH", raw, at + 3)
            size = width, height
        at += length
        if marker == 0xDA:
            end = scan_end(raw, at)
            if end is None:
                return None
            at = end
    return None


def largest_preview(raw: bytes) -> bytes | None:
    """The largest JPEG inside a camera file; the first of equals."""
    best, area, at = None, -1, 0
    while (at := raw.find(b"\xff\xd8\xff", at)) >= 0:
        found = jpeg_at(raw, at)
        if found is None:
            at += 1
            continue
        if found[1] * found[2] > area:
            best, area = found[0], found[1] * found[2]
        at += len(found[0])
    return best


def _whole(value: float) -> float:
    return float(int(value + 0.5))


def dpi(raw: bytes) -> float | None:
    """Resolution recorded in a PNG or JPEG file, in whole dots per inch (per centimetre ones converted)."""
    if raw.startswith(PNG):
        for kind, chunk in png_chunks(raw):
            if kind in (b"IDAT", b"IEND"):
                return None
            per_metre = int.from_bytes(chunk[8:12], "big")
            if kind == b"pHYs" and len(chunk) >= 21 and chunk[16] == 1 and per_metre:
                return _whole(per_metre * 0.0254)
    if raw.startswith(b"\xff\xd8"):
        for marker, payload, _ in jpeg_segments(raw):
            if marker == 0xE0 and payload.startswith(b"JFIF\0") and len(payload) >= 10:
                density = int.from_bytes(payload[8:10], "big")
                if density and payload[7] in (1, 2):
                    return _whole(density * (2.54 if payload[7] == 2 else 1.0))
            if marker == 0xE1 and payload.startswith(b"Exif\0\0"):
                fields = exif_fields(payload)
                if fields.get(0x11A, 0) > 0:
                    return _whole(fields[0x11A] * (2.54 if fields.get(0x128) == 3 else 1.0))
            if marker == 0xDA:
                break
    return None


def unpack_bits(raw: bytes, size: int) -> bytes:
    """Run-length decoding of one row, cut or padded to its size."""
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < size:
        n, at = raw[at], at + 1
        if n < 128:
            out += raw[at : at + n + 1]
            at += n + 1
        elif n > 128 and at < len(raw):
            out += raw[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:size].ljust(size, b"\0"))


#: Clockwise turn and mirroring of each stored orientation.
TURNS = {1: (0, False), 6: (90, False), 3: (180, False), 8: (270, False), 2: (0, True), 7: (90, True), 4: (180, True), 5: (270, True)}


def turned_jpeg(raw: bytes, degrees: int) -> bytes | None:
    """A JPEG shown turned clockwise by its orientation tag, pixels untouched; None where its EXIF data has no such tag."""
    own, mirrored = TURNS[orientation(raw) or 1]
    value = next(k for k, v in TURNS.items() if v == ((own + degrees) % 360, mirrored))
    at = 2
    for marker, payload, data in jpeg_segments(raw):
        if marker == 0xE1 and payload.startswith(b"Exif\0\0"):
            start = raw.index(payload, at) + 6
            order = ">" if payload[6:8] == b"MM" else "<"
            (first,) = struct.unpack_from(order + "I", raw, start + 4)
            (count,) = struct.unpack_from(order + "H", raw, start + first)
            for entry in range(start + first + 2, start + first + 2 + 12 * count, 12):
                if struct.unpack_from(order + "H", raw, entry)[0] == 0x112:
                    return raw[: entry + 8] + struct.pack(order + "H", value) + raw[entry + 10 :]
            return None
        if marker == 0xDA:
            break
        at += len(payload)
    first = next(jpeg_segments(raw))
    after = 2 + 4 + len(first[1]) if first[0] == 0xE0 else 2
    return raw[:after] + orientation_segment(value) + raw[after:]

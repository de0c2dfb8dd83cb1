"""The flattened picture of Photoshop files (PSD and PSB), as a numpy array."""

from __future__ import annotations

import struct

import numpy as np

from leafmill.sources.rasters import unpack_bits

PIXELS, CHANNELS = 100_000_000, 56
#: Colour modes and their numbers of colour channels.
MODES = {1: 1, 2: 1, 3: 3, 4: 4}


def decode(raw: bytes) -> np.ndarray:
    """Pixels (height, width, 3), or 4 with merged transparency; a saved selection is not transparency."""
    try:
        return _decode(raw)
    except (struct.error, IndexError) as error:
        raise ValueError("the file is truncated") from error


def _decode(raw: bytes) -> np.ndarray:
    magic, version, channels, height, width, depth, mode = struct.unpack_from(">4sH6xHIIHH", raw)
    if magic != b"8BPS" or version not in (1, 2):
        raise ValueError("not a Photoshop file")
    if depth not in (8, 16) or mode not in MODES:
        raise ValueError(f"depth {depth} or mode {mode} is not read")
    if not (width and height and 1 <= channels <= CHANNELS) or width * height > PIXELS:
        raise ValueError("an impossible header")
    long, sample = ">Q" if version == 2 else ">I", depth // 8
    at = 26
    (size,) = struct.unpack_from(">I", raw, at)
    palette = np.frombuffer(raw[at + 4 : at + 4 + 768], np.uint8)
    if mode == 2 and (size < 768 or len(palette) < 768):
        raise ValueError("an indexed picture without a palette")
    at += 4 + size
    at += 4 + struct.unpack_from(">I", raw, at)[0]
    (size,) = struct.unpack_from(long, raw, at)
    at += struct.calcsize(long)
    merged = False
    if size:
        (inner,) = struct.unpack_from(long, raw, at)
        merged = inner >= 2 and struct.unpack_from(">h", raw, at + struct.calcsize(long))[0] < 0
    at += size
    (packing,) = struct.unpack_from(">H", raw, at)
    at += 2
    row = width * sample
    used = min(channels, MODES[mode] + merged)
    if packing == 0:
        if len(raw) - at < channels * row * height:
            raise ValueError("the file is truncated")
        data = raw[at : at + used * row * height]
    elif packing == 1:
        entry = np.dtype(">u4" if version == 2 else ">u2")
        if len(raw) - at < channels * height * entry.itemsize:
            raise ValueError("the file is truncated")
        sizes = np.frombuffer(raw, entry, channels * height, at).astype(np.int64)
        starts = at + channels * height * entry.itemsize + np.concatenate([[0], np.cumsum(sizes)])
        if starts[-1] > len(raw):
            raise ValueError("the file is truncated")
        data = b"".join(unpack_bits(raw[a:b], row) for a, b in zip(starts[: used * height].tolist(), starts[1 : used * height + 1].tolist()))
    else:
        raise ValueError(f"packing {packing} is not read")
    planes = np.frombuffer(data, np.uint8).reshape(used, height, width, sample)[..., 0]
    plane = lambda i: planes[i if i < used else 0]
    if mode == 2:
        colour = palette.reshape(3, 256).T[planes[0]]
    elif mode == 1:
        colour = np.repeat(planes[0][..., None], 3, axis=2)
    elif mode == 3:
        colour = np.stack([plane(i) for i in range(3)], axis=2)
    else:
        colour = np.stack([(plane(i).astype(np.uint16) * plane(3) // 255).astype(np.uint8) for i in range(3)], axis=2)
    return np.concatenate([colour, planes[-1][..., None]], axis=2) if used > MODES[mode] else colour

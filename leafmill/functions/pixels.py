"""Rasters as numpy arrays: (height, width) gray or (height, width, channels), eight bits."""

from __future__ import annotations

import numpy as np

#: Tests of blank sheets and of colours, and the lightening of hard pages.
MARGIN, INK_DIFFERENCE, INK_SHARE, GAMMA = 0.04, 50, 0.0025, 0.67


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    r, g, b = (image[..., i].astype(np.uint32) for i in range(3))
    return ((77 * r + 150 * g + 29 * b + 128) >> 8).astype(np.uint8)


def over_white(image: np.ndarray) -> np.ndarray:
    """An image with transparency on white paper."""
    if image.ndim == 2 or image.shape[2] < 4:
        return image
    alpha = image[..., 3:].astype(np.uint32)
    return ((image[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def is_blank(image: np.ndarray) -> bool:
    """Nearly every pixel inside the margins has the paper's tone, the lower median."""
    h, w = image.shape[:2]
    top, left = int(h * MARGIN), int(w * MARGIN)
    inner = gray(image)[top : h - top, left : w - left].ravel()
    if not inner.size:
        return True
    paper = int(np.partition(inner, (inner.size - 1) // 2)[(inner.size - 1) // 2])
    return bool((np.abs(inner.astype(np.int16) - paper) > INK_DIFFERENCE).mean() <= INK_SHARE)


def stretched(image: np.ndarray, spread: int = 32) -> np.ndarray:
    """Gray levels between the darkest and the lightest hundredth drawn out to the full range."""
    counts, cut = np.bincount(image.ravel(), minlength=256), image.size // 100
    low = int(np.argmax(np.cumsum(counts) > cut))
    high = 255 - int(np.argmax(np.cumsum(counts[::-1]) > cut))
    if high < low + spread:
        return image
    levels = (np.clip(np.arange(256), low, high) - low) * 255 // (high - low)
    return levels.astype(np.uint8)[image]


def lightened(image: np.ndarray) -> np.ndarray:
    levels = np.floor(255.0 * (np.arange(256) / 255.0) ** GAMMA + 0.5)
    return levels.astype(np.uint8)[image]


def turned(image: np.ndarray, quarters: int, mirrored: bool = False) -> np.ndarray:
    """Mirrored left to right first, then turned clockwise."""
    return np.rot90(image[:, ::-1] if mirrored else image, -quarters)


def few_colours(image: np.ndarray, most: int = 256, sample: int = 65_536) -> bool:
    """At most so many colours in an even sample of the pixels."""
    flat = over_white(image).reshape(-1, 3 if image.ndim > 2 else 1)[:: max(1, image.shape[0] * image.shape[1] // sample)].astype(np.uint32)
    return len(np.unique(flat @ (256 ** np.arange(flat.shape[1], dtype=np.uint32)))) <= most


def effectively_gray(image: np.ndarray, spread: int = 24) -> bool:
    if image.ndim == 2:
        return True
    coloured = image[..., :3].max(axis=2).astype(np.int16) - image[..., :3].min(axis=2) > spread
    return int(coloured.sum()) <= coloured.size // 5000


def resized(image: np.ndarray, width: int, height: int, lobes: int = 3) -> np.ndarray:
    """Lanczos resampling; much larger images are averaged in blocks to twice the size first."""
    for axis, size in ((0, height), (1, width)):
        block = image.shape[axis] // (2 * size)
        if block > 1:
            whole = image.shape[axis] // block * block
            kept = image.take(range(whole), axis=axis)
            shape = kept.shape[:axis] + (whole // block, block) + kept.shape[axis + 1 :]
            image = np.floor(kept.reshape(shape).mean(axis=axis + 1) + 0.5).astype(np.uint8)
    out = image.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        length = out.shape[axis]
        scale = max(1.0, length / size)
        centre = (np.arange(size) + 0.5) * length / size - 0.5
        gap = (np.arange(length)[None, :] - centre[:, None]) / scale
        weights = np.where(np.abs(gap) < lobes, np.sinc(gap) * np.sinc(gap / lobes), 0.0)
        out = np.moveaxis(np.tensordot(weights / weights.sum(axis=1, keepdims=True), out, axes=(1, axis)), 0, axis)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def unpacked(data: bytes, width: int, height: int, channels: int, bits: int, inverted: bool = False) -> np.ndarray:
    """Samples of 1, 2, 4, 8 or 16 bits in byte-aligned rows, widened or cut to eight; missing ones are 0."""
    row = (width * channels * bits + 7) // 8
    rows = np.frombuffer(data[: row * height].ljust(row * height, b"\0"), np.uint8).reshape(height, row)
    if bits == 16:
        samples = rows.reshape(height, -1, 2)[..., 0]
    elif bits == 8:
        samples = rows
    else:
        parts = np.stack([(rows >> s) & ((1 << bits) - 1) for s in range(8 - bits, -1, -bits)], axis=2)
        samples = (parts.reshape(height, -1).astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    out = samples[:, : width * channels].reshape(height, width, channels)
    return 255 - out if inverted else out

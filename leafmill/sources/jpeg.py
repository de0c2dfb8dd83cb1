"""Baseline JPEG files from arrays, with Huffman codes made for each picture."""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from functools import cache
from operator import add

import numpy as np

from leafmill.functions import pixels

#: The quantisation steps of the JPEG standard, row by row, for brightness and for colour.
BRIGHTNESS = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
COLOUR = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""
LOWEST_QUALITY, SMALLEST_EDGE = 20, 16
_LONGEST = 16
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_WAVES = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None] * np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16)


@cache
def steps(table: str, quality: int) -> np.ndarray:
    """Quantisation steps at a quality of 1 to 100, by the usual scale."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table.split(), np.int64) * scale + 50) // 100, 1, 255)


def _planes(image: np.ndarray) -> np.ndarray:
    """(parts, height, width): gray alone, or brightness and two colour differences."""
    if image.ndim == 2:
        return image[None].astype(np.float64)
    r, g, b = np.moveaxis(image.astype(np.float64), 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402])


def _coefficients(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised waves (blocks, 64) of a plane in zigzag order; edges are repeated to whole blocks."""
    h, w = plane.shape
    if h % 8:
        plane = np.concatenate([plane, np.repeat(plane[-1:], -h % 8, axis=0)])
    if w % 8:
        plane = np.concatenate([plane, np.repeat(plane[:, -1:], -w % 8, axis=1)], axis=1)
    padded = plane - 128.0
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    waves = np.rint((_WAVES @ blocks @ _WAVES.T).reshape(-1, 64) / table).astype(np.int32)[:, _ZIGZAG]
    np.clip(waves[:, 1:], -1023, 1023, out=waves[:, 1:])  # the largest that a baseline file can say
    return waves


def _size(values: np.ndarray) -> np.ndarray:
    """Binary digits of whole numbers without their signs."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def _events(waves: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, symbol, extra bits, their number) in file order; tables are first and other waves of brightness, then of colour."""
    values = waves.copy()
    values[parts:, 0] -= waves[:-parts, 0]
    shown = values != 0
    shown[:, 0] = True
    at = np.flatnonzero(shown)
    place, number = at & 63, values.ravel()[at].astype(np.int64)
    first = place == 0
    run = np.concatenate([[0], at[1:] - at[:-1] - 1])  # since the wave shown before, which is in the same block
    run[first] = 0
    count = _size(number)
    ends = (place < 63) & np.concatenate([first[1:], [True]])
    places = (run >> 4) + 1 + ends  # runs of 16 lie before a wave, an end after it
    after = np.cumsum(places)
    here, total = after - 1 - ends, int(after[-1])
    symbol, extra, bits = np.full(total, 0xF0), np.zeros(total, np.int64), np.zeros(total, np.int64)
    symbol[here] = (run & 15) << 4 | count
    symbol[after[ends] - 1] = 0
    extra[here] = number + (number < 0) * ((1 << count) - 1)
    bits[here] = count
    table = np.repeat(2 * ((at >> 6) % parts > 0) + 1, places)
    table[here[first]] -= 1
    return table, symbol, extra, bits


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Best lengths, at most 16, of a code in which no word is all ones: by merging packages of the rarest words.

    A word of its own that is rarest of all takes the place of all ones.  A row is words and
    packages by weight, words first where they are equal; where it is cut, its words are the
    rarest ones and its packages the first pairs of the row before.
    """
    used = np.flatnonzero(counts)
    order = np.argsort(counts[used], kind="stable")
    words = [0, *counts[used[order]].tolist()]
    rows = [(words, [])]
    while len(rows) < _LONGEST:
        packages = list(map(add, rows[-1][0][::2], rows[-1][0][1::2]))
        if packages == rows[-1][1]:  # and so are all that follow
            rows += [rows[-1]] * (_LONGEST - len(rows))
        else:
            rows.append((sorted(words + packages), packages))
    longer, taken = [0] * (len(words) + 1), 2 * len(words) - 2
    for row, packages in reversed(rows):
        if taken < len(row):
            cut = row[taken]
            own = min(taken - bisect_left(packages, cut), bisect_right(words, cut))
        else:
            own, taken = len(words), len(row)
        longer[own] += 1
        taken = 2 * (taken - own)
    lengths = np.zeros(256, np.int64)
    lengths[used[order]] = np.cumsum(longer[:1:-1])[::-1]
    return lengths


def _code(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table's bytes, and words and lengths of symbols."""
    lengths = code_lengths(counts)
    own = np.flatnonzero(lengths)
    own = own[np.argsort(lengths[own], kind="stable")]
    sizes = lengths[own]
    room = 1 << _LONGEST - sizes  # of all words of 16 bits, those that begin with this one
    words = np.zeros(256, np.int64)
    words[own] = np.cumsum(room) - room >> _LONGEST - sizes
    return bytes(np.bincount(sizes, minlength=_LONGEST + 1)[1:].tolist()) + bytes(own.tolist()), words, lengths


def _packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of at most 32 bits end to end, filled up with ones; those that begin in one group of 32 bits are summed up."""
    after = np.cumsum(sizes)
    begin, whole = after - sizes, int(after[-1])
    group, wide = begin >> 5, values.astype(np.uint64) << (64 - (begin & 31) - sizes).astype(np.uint64)
    groups = int(group[-1]) + 2
    # sums of separate bits, under 2^32, are exact as floats
    held = np.bincount(group, wide >> np.uint64(32), groups) + np.bincount(group + 1, wide & np.uint64(0xFFFFFFFF), groups)
    out = bytearray(held.astype(np.uint32).astype(">u4").tobytes()[: (whole + 7) // 8])
    out[-1] |= (1 << -whole % 8) - 1
    return bytes(out).replace(b"\xff", b"\xff\0")


def _segment(marker: int, payload: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(payload) + 2) + payload


def encode(image: np.ndarray, quality: int = 85) -> bytes:
    """A JPEG of pixels (height, width), or with 2 (gray and transparency), 3 or 4 channels; transparency goes onto white.

    Gray pictures, and colour ones that are gray in practice, get one channel.
    """
    if image.ndim == 3 and image.shape[2] == 2:
        image = np.repeat(image, (3, 1), axis=2)
    image = pixels.over_white(image)
    if image.ndim == 3 and (image.shape[2] == 1 or pixels.effectively_gray(image)):
        image = image[..., 0] if image.shape[2] == 1 else pixels.gray(image)
    h, w = image.shape[:2]
    if not (0 < h < 65536 and 0 < w < 65536):
        raise ValueError(f"a JPEG cannot hold {w} x {h} pixels")
    planes = _planes(image)
    parts = len(planes)
    tables = [steps(t, quality) for t in (BRIGHTNESS, COLOUR)[: min(parts, 2)]]
    waves = np.stack([_coefficients(p, tables[min(i, 1)]) for i, p in enumerate(planes)], axis=1).reshape(-1, 64)
    table, symbol, extra, count = _events(waves, parts)
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [_segment(0xDB, bytes([i, *t[_ZIGZAG].tolist()])) for i, t in enumerate(tables)]
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, h, w, parts) + b"".join(bytes((i + 1, 0x11, min(i, 1))) for i in range(parts))))
    key = table * 256 + symbol
    counts = np.bincount(key, minlength=512 * len(tables)).reshape(-1, 256)
    codes = [_code(c) for c in counts]
    out += [_segment(0xC4, bytes([kind % 2 << 4 | kind // 2]) + listed) for kind, (listed, _, _) in enumerate(codes)]
    words, sizes = (np.concatenate(c)[key] for c in list(zip(*codes))[1:])
    out.append(_segment(0xDA, bytes([parts, *(x for i in range(parts) for x in (i + 1, 0x11 * min(i, 1))), 0, 63, 0])))
    return b"".join([*out, _packed(words << count | extra, sizes + count), b"\xff\xd9"])


def fit(image: np.ndarray, limit: int, quality: int = 85) -> tuple[bytes, int]:
    """The best JPEG of at most ``limit`` bytes and its quality, 20 to ``quality``; pictures shrink where 20 is too much.

    Sizes are taken to grow with the quality, so qualities are halved between one that
    fits and one that does not.  A picture of 16 pixels or less that does not fit is an error.
    """
    while True:
        best, low, high = encode(image, LOWEST_QUALITY), LOWEST_QUALITY, max(quality, LOWEST_QUALITY) + 1
        if len(best) <= limit:
            while high - low > 1:
                middle = (low + high) // 2
                made = encode(image, middle)
                if len(made) <= limit:
                    best, low = made, middle
                else:
                    high = middle
            return best, low
        h, w = image.shape[:2]
        if min(h, w) <= SMALLEST_EDGE:
            raise ValueError(f"no JPEG of the picture is under {limit} bytes; the smallest has {len(best)}")
        scale = min(max((limit / len(best)) ** 0.5, 0.3), 0.9)
        image = pixels.resized(image, *(max(1, int(n * scale + 0.5)) for n in (w, h)))

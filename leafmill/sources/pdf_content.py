"""What PDF pages draw: a walk of their content, images decoded, blank pages, and marks put on pages."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np

from leafmill.functions import pixels
from leafmill.sources import pdf
from leafmill.sources.pdf import Document, Name, Operator, Ref, Stream

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
DEPTH, VISITS = 8, 10_000
#: Operators that draw something other than an image.
_DRAWING = {b"Tj", b"TJ", b"'", b'"', b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"sh", b"BI", b"EI"}


def product(a: tuple, b: tuple) -> tuple:
    """Affine matrices, ``a`` applied first."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def content(doc: Document, page: dict) -> bytes:
    held = doc.get(page.get("Contents"))
    parts = [doc.get(c) for c in held] if isinstance(held, list) else [held]
    return b"\n".join(pdf.decoded(doc, s) for s in parts if isinstance(s, Stream))


def operations(data: bytes) -> Iterator[tuple[bytes, list]]:
    lexer, stack = pdf.Lexer(data), []
    while lexer.at < len(data):
        value = lexer.value()
        if isinstance(value, Operator):
            yield bytes(value), stack
            stack = []
        else:
            stack.append(value)


def drawings(doc: Document, page: dict) -> Iterator[tuple[Ref, tuple]]:
    """(image, matrix) of each drawing on a page, in order, those inside forms too."""
    visits = 0

    def walk(data: bytes, resources, matrix: tuple, depth: int) -> Iterator[tuple[Ref, tuple]]:
        nonlocal visits
        named = doc.get((doc.get(resources) or {}).get("XObject")) or {}
        saved = []
        for name, operands in operations(data):
            if name == b"q":
                saved.append(matrix)
            elif name == b"Q" and saved:
                matrix = saved.pop()
            elif name == b"cm" and len(operands) == 6 and all(isinstance(v, int | float) for v in operands):
                matrix = product(tuple(operands), matrix)
            elif name == b"Do" and operands:
                ref = named.get(operands[0])
                drawn = doc.get(ref)
                visits += 1
                if not isinstance(drawn, Stream) or visits > VISITS:
                    continue
                if drawn.entries.get("Subtype") == "Image" and isinstance(ref, Ref):
                    yield ref, matrix
                elif drawn.entries.get("Subtype") == "Form" and depth < DEPTH:
                    own = doc.get(drawn.entries.get("Matrix")) or IDENTITY
                    yield from walk(pdf.decoded(doc, drawn), drawn.entries.get("Resources", resources), product(tuple(own), matrix), depth + 1)

    yield from walk(content(doc, page), page.get("Resources"), IDENTITY, 0)


def colour_channels(doc: Document, space, depth: int = 0) -> tuple[str, int, bytes | None]:
    """(base, components, palette) of a colour space."""
    space = doc.get(space)
    if depth > DEPTH:
        raise pdf.Unreadable("colour spaces nest too deep")
    if isinstance(space, Name):
        found = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "DeviceCMYK": 4, "CMYK": 4}.get(space)
        if found:
            return {1: "gray", 3: "rgb", 4: "cmyk"}[found], found, None
    elif isinstance(space, list) and space:
        kind = doc.get(space[0])
        if kind in ("CalGray", "CalRGB"):
            return colour_channels(doc, Name(kind), depth + 1)
        if kind == "ICCBased":
            profile = doc.get(space[1])
            n = int(doc.get(profile.entries.get("N")) or 3)
            return {1: "gray", 3: "rgb", 4: "cmyk"}[n], n, None
        if kind in ("Indexed", "I"):
            base, n, _ = colour_channels(doc, space[1], depth + 1)
            table = doc.get(space[3])
            raw = pdf.decoded(doc, table) if isinstance(table, Stream) else table
            return base, 1, raw.ljust(256 * n, b"\0")
        if kind == "Separation":
            return "ink", 1, None
    raise pdf.Unreadable("an unknown colour space")


def decode_image(doc: Document, image: Stream) -> np.ndarray:
    """Pixels of an image whose data are samples; pictures behind codecs are refused."""
    own = image.entries
    filters = doc.get(own.get("Filter"))
    last = filters[-1] if isinstance(filters, list) and filters else filters
    if last in ("DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode"):
        raise pdf.Unreadable(f"{last} needs a codec")
    width, height, bits = (int(doc.get(own.get(k)) or d) for k, d in (("Width", 0), ("Height", 0), ("BitsPerComponent", 8)))
    base, n, palette = colour_channels(doc, own.get("ColorSpace", Name("DeviceGray")))
    turned = doc.get(own.get("Decode"))
    samples = pixels.unpacked(pdf.decoded(doc, image), width, height, n, bits, inverted=bool(turned) and palette is None and turned[0] > turned[1])
    if palette is not None:
        index = samples[..., 0].astype(np.uint16) * ((1 << bits) - 1) // 255 if bits < 8 else samples[..., 0]
        n = len(palette) // 256
        samples = np.frombuffer(palette[: 256 * n], np.uint8).reshape(256, n)[index]
    if base == "cmyk":
        ink = samples.astype(np.uint16)
        return ((255 - ink[..., :3]) * (255 - ink[..., 3:]) // 255).astype(np.uint8)
    return 255 - samples[..., 0] if base == "ink" else samples[..., 0] if base == "gray" else samples


def is_blank(doc: Document, page: dict) -> bool:
    """No annotations and no text, and nothing drawn but images that are blank themselves."""
    if "Annots" in page or pdf.page_text(doc, page).strip():
        return False
    named = doc.get((doc.get(page.get("Resources")) or {}).get("XObject")) or {}
    for name, operands in operations(content(doc, page)):
        if name in _DRAWING:
            return False
        if name == b"Do":
            image = doc.get(named.get(operands[0])) if operands else None
            if not isinstance(image, Stream) or image.entries.get("Subtype") != "Image" or image.entries.get("ImageMask") is True:
                return False
            try:
                if not pixels.is_blank(decode_image(doc, image)):
                    return False
            except (pdf.Unreadable, ValueError, KeyError):
                return False
    return True


def without_blank_pages(doc: Document) -> Document:
    """Blank pages go; a document of blank pages alone keeps them all."""
    pages = doc.pages()
    kept = [p for p in pages if not is_blank(doc, p[1])]
    return pdf.with_pages(doc, kept or pages)


def _free(named: dict, stem: str) -> str:
    return next(f"{stem}{i}" for i in range(len(named) + 1) if f"{stem}{i}" not in named)


def mark_text(doc: Document, labels: dict[int, str], *, x: float, y: float, size: float = 10.0, angle: float = 0.0, colour: tuple[float, float, float] = (0.0, 0.0, 0.0), opacity: float = 1.0) -> Document:
    """A text on each page given, at a point of the page as displayed; what is on a page already is fenced off."""
    pages = doc.pages()
    if missing := [n for n in labels if not 1 <= n <= len(pages)]:
        raise ValueError(f"no pages {missing}")
    font = doc.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
    state = doc.add({"Type": Name("ExtGState"), "ca": float(opacity), "CA": float(opacity)})
    for number, label in labels.items():
        page = pages[number - 1][1]
        resources = dict(doc.get(page.get("Resources")) or {})
        fonts, states = (dict(doc.get(resources.get(k)) or {}) for k in ("Font", "ExtGState"))
        f, g = _free(fonts, "MarkF"), _free(states, "MarkG")
        resources |= {"Font": fonts | {f: font}, "ExtGState": states | {g: state}}
        (left, bottom, right, top), turn = pdf._box(doc, page)
        w, h = abs(right - left), abs(top - bottom)
        px, py = {90: (w - y, x), 180: (w - x, h - y), 270: (y, h - x)}.get(turn, (x, y))
        c, s = math.cos(math.radians(angle + turn)), math.sin(math.radians(angle + turn))
        shown = pdf._shown(label.encode("cp1252", "replace"), lambda r: 0)
        body = b"Q q /%s gs BT /%s %g Tf %g %g %g rg %.5f %.5f %.5f %.5f %.3f %.3f Tm " % (g.encode(), f.encode(), size, *colour, c, s, -s, c, min(left, right) + px, min(bottom, top) + py) + shown + b" Tj ET Q"
        old = page.get("Contents")
        held = doc.get(old)
        page["Contents"] = [doc.add(Stream({}, b"q")), *(held if isinstance(held, list) else [old] if old is not None else []), doc.add(Stream({}, body))]
        page["Resources"] = resources
    return pdf.with_pages(doc, pages)


def number_pages(doc: Document, template: str, numbers: list[int] | None = None, start: int = 1, **place) -> Document:
    """Page numbers by a template with ``{n}`` or ``{total}``."""
    if "{n}" not in template and "{total}" not in template:
        raise ValueError("the template holds neither {n} nor {total}")
    numbers = numbers or list(range(1, len(doc.pages()) + 1))
    total = start + len(numbers) - 1
    return mark_text(doc, {p: template.replace("{n}", str(start + i)).replace("{total}", str(total)) for i, p in enumerate(numbers)}, **place)


def stamp(doc: Document, picture: np.ndarray, places: dict[int, tuple[float, float, float, float]], *, opacity: float = 1.0, blend: str = "Normal") -> Document:
    """A picture (gray, colour, or with transparency) on pages at ``(x, y, width, height)`` as displayed."""
    pages = doc.pages()
    if missing := [n for n in places if not 1 <= n <= len(pages)]:
        raise ValueError(f"no pages {missing}")
    height, width = picture.shape[:2]
    alpha = picture[..., 3] if picture.ndim > 2 and picture.shape[2] == 4 else None
    colour = picture[..., :3] if picture.ndim > 2 else picture
    entries = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": 8}
    veil = np.floor((255 if alpha is None else alpha.astype(np.float64)) * opacity + 0.5) * np.ones((height, width))
    mask = doc.add(Stream(entries | {"ColorSpace": Name("DeviceGray")}, veil.astype(np.uint8).tobytes())) if alpha is not None or opacity < 1 else None
    space = Name("DeviceRGB" if colour.ndim > 2 else "DeviceGray")
    image = doc.add(Stream(entries | {"ColorSpace": space} | ({"SMask": mask} if mask else {}), np.ascontiguousarray(colour).tobytes()))
    state = doc.add({"Type": Name("ExtGState"), "BM": Name(blend)})
    for number, (x, y, w, h) in places.items():
        page = pages[number - 1][1]
        resources = dict(doc.get(page.get("Resources")) or {})
        drawn, states = (dict(doc.get(resources.get(k)) or {}) for k in ("XObject", "ExtGState"))
        name, g = _free(drawn, "Stamp"), _free(states, "StampG")
        resources |= {"XObject": drawn | {name: image}, "ExtGState": states | {g: state}}
        (left, bottom, right, top), turn = pdf._box(doc, page)
        raw_w, raw_h = abs(right - left), abs(top - bottom)
        px, py = {90: (raw_w - y, x), 180: (raw_w - x, raw_h - y), 270: (y, raw_h - x)}.get(turn, (x, y))
        c, s = round(math.cos(math.radians(turn))), round(math.sin(math.radians(turn)))
        body = b"Q q /%s gs %.4f %.4f %.4f %.4f %.4f %.4f cm /%s Do Q" % (g.encode(), w * c, w * s, -h * s, h * c, min(left, right) + px, min(bottom, top) + py, name.encode())
        old = page.get("Contents")
        held = doc.get(old)
        page["Contents"] = [doc.add(Stream({}, b"q")), *(held if isinstance(held, list) else [old] if old is not None else []), doc.add(Stream({}, body))]
        page["Resources"] = resources
    return pdf.with_pages(doc, pages)


def drawn_sizes(doc: Document) -> dict[Ref, tuple[float, float]]:
    """Largest drawn width and, independently, height in points of each image, over all pages."""
    out: dict[Ref, tuple[float, float]] = {}
    for _, page in doc.pages():
        for ref, m in drawings(doc, page):
            w, h = math.hypot(m[0], m[1]), math.hypot(m[2], m[3])
            out[ref] = (max(w, out.get(ref, (0, 0))[0]), max(h, out.get(ref, (0, 0))[1]))
    return out


def unsafe(doc: Document, image: Stream) -> str | None:
    """Why an image is left as it is, or None."""
    own = image.entries
    if "SMask" in own or "Mask" in own:
        return "mask"
    if doc.get(own.get("ImageMask")) is True:
        return "stencil"
    if "Decode" in own:
        return "decode"
    return None if int(doc.get(own.get("BitsPerComponent")) or 8) == 8 else "bits"


def optimise(doc: Document, dpi: int = 150, gray: bool = False) -> tuple[Document, dict[str, int]]:
    """Images shrunk to a resolution where they are drawn, and made gray if wanted; a copy is taken only if smaller.

    Pictures behind codecs are counted as skipped: nothing here encodes them.
    """
    counts = {"resized": 0, "kept": 0, "skipped": 0}
    for ref, (width, height) in drawn_sizes(doc).items():
        image = doc.get(ref)
        w, h = int(doc.get(image.entries.get("Width")) or 0), int(doc.get(image.entries.get("Height")) or 0)
        need_w, need_h = (max(1, math.floor(s * dpi / 72 + 0.5)) for s in (width, height))
        scale = max(need_w / w, need_h / h) if w and h else 1.0
        if scale >= 1 and not gray:
            counts["kept"] += 1
            continue
        try:
            if reason := unsafe(doc, image):
                raise pdf.Unreadable(reason)
            picture = decode_image(doc, image)
        except (pdf.Unreadable, ValueError, KeyError):
            counts["skipped"] += 1
            continue
        picture = pixels.gray(picture) if gray and pixels.effectively_gray(picture) else picture
        if scale < 1:
            picture = pixels.resized(picture, max(1, math.floor(w * scale + 0.5)), max(1, math.floor(h * scale + 0.5)))
        raw = zlib.compress(np.ascontiguousarray(picture).tobytes(), 9)
        if len(raw) >= len(image.raw):
            counts["kept"] += 1
            continue
        space = Name("DeviceGray" if picture.ndim == 2 else "DeviceRGB")
        kept = {k: v for k, v in image.entries.items() if k not in ("DecodeParms", "Length")}
        doc.objects[ref.number] = Stream(kept | {"Width": picture.shape[1], "Height": picture.shape[0], "ColorSpace": space, "BitsPerComponent": 8, "Filter": Name("FlateDecode")}, raw)
        counts["resized"] += 1
    return doc, counts


def fit_size(raw: bytes, limit: int, steps: list[int], save=pdf.save) -> tuple[bytes, int | None]:
    """The file itself if it fits, else the gentlest resolution whose result does, found by bisection; and that resolution."""
    if len(raw) <= limit:
        return raw, None
    made = lambda dpi: save(optimise(pdf.load(raw), dpi)[0])
    first = made(steps[0])
    if len(first) <= limit:
        return first, steps[0]
    best = made(steps[-1])
    if len(best) > limit:
        raise ValueError(f"no step brings the file under {limit} bytes; the smallest is {len(best)}")
    low, high = 0, len(steps) - 1
    while high - low > 1:
        middle = (low + high) // 2
        result = made(steps[middle])
        low, high, best = (low, middle, result) if len(result) <= limit else (middle, high, best)
    return best, steps[high]

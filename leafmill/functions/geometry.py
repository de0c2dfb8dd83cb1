"""Page and image geometry as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A4 = (210.0 * 72.0 / 25.4, 297.0 * 72.0 / 25.4)
#: Clockwise turn and mirroring of each stored image orientation.
ORIENTATIONS = {1: (0, False), 6: (90, False), 3: (180, False), 8: (270, False), 2: (0, True), 7: (90, True), 4: (180, True), 5: (270, True)}
#: Short and long side, in points, of the papers that scans are matched with.
SCAN_PAPERS = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}


def quarter_turn(rotation: Column) -> Column:
    return F.pmod(rotation, F.lit(180)) == 90


def displayed_size(left: Column, bottom: Column, right: Column, top: Column, rotation: Column) -> tuple[Column, Column]:
    width, height = F.abs(right - left), F.abs(top - bottom)
    turned = quarter_turn(rotation)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def is_landscape(left: Column, bottom: Column, right: Column, top: Column, rotation: Column) -> Column:
    width, height = displayed_size(left, bottom, right, top, rotation)
    return width > height


def turned(rotation: Column, degrees: Column | int) -> Column:
    return F.pmod(rotation + degrees, F.lit(360))


def page_to_display(x: Column, y: Column, left: Column, bottom: Column, right: Column, top: Column, rotation: Column) -> tuple[Column, Column]:
    width, height = F.abs(right - left), F.abs(top - bottom)
    px, py, turn = x - F.least(left, right), y - F.least(bottom, top), F.pmod(rotation, F.lit(360))
    return (
        F.when(turn == 90, py).when(turn == 180, width - px).when(turn == 270, height - py).otherwise(px),
        F.when(turn == 90, width - px).when(turn == 180, height - py).when(turn == 270, px).otherwise(py),
    )


def display_to_page(x: Column, y: Column, left: Column, bottom: Column, right: Column, top: Column, rotation: Column) -> tuple[Column, Column]:
    width, height, turn = F.abs(right - left), F.abs(top - bottom), F.pmod(rotation, F.lit(360))
    px = F.when(turn == 90, width - y).when(turn == 180, width - x).when(turn == 270, y).otherwise(x)
    py = F.when(turn == 90, x).when(turn == 180, height - y).when(turn == 270, height - x).otherwise(y)
    return F.least(left, right) + px, F.least(bottom, top) + py


def matrix_product(a: Column, b: Column) -> Column:
    """Product of two affine matrices of six entries, ``a`` applied first."""
    g = lambda m, i: F.get(m, i)
    return F.array(
        g(a, 0) * g(b, 0) + g(a, 1) * g(b, 2),
        g(a, 0) * g(b, 1) + g(a, 1) * g(b, 3),
        g(a, 2) * g(b, 0) + g(a, 3) * g(b, 2),
        g(a, 2) * g(b, 1) + g(a, 3) * g(b, 3),
        g(a, 4) * g(b, 0) + g(a, 5) * g(b, 2) + g(b, 4),
        g(a, 4) * g(b, 1) + g(a, 5) * g(b, 3) + g(b, 5),
    )


def drawn_size(m: Column) -> tuple[Column, Column]:
    return F.hypot(F.get(m, 0), F.get(m, 1)), F.hypot(F.get(m, 2), F.get(m, 3))


def image_placement(pixel_width: Column, pixel_height: Column, dpi: Column | None = None, *, fit: bool = False, sheet: tuple[float, float] = A4) -> Column:
    """``struct<page_width, page_height, x, y, width, height>`` in points: fitted and centred, or the page is the image."""
    names = ("page_width", "page_height", "x", "y", "width", "height")
    made = lambda *v: F.struct(*(c.alias(n) for c, n in zip(v, names)))
    w, h = pixel_width.cast("double"), pixel_height.cast("double")
    if fit:
        dpi = F.lit(None).cast("double") if dpi is None else dpi
        scale = F.lit(72.0) / F.when(dpi >= 1.0, dpi).otherwise(96.0)
        return made(w * scale, h * scale, F.lit(0.0), F.lit(0.0), w * scale, h * scale)
    swap = (pixel_width > pixel_height) != F.lit(sheet[0] > sheet[1])
    page_w, page_h = (F.when(swap, F.lit(b)).otherwise(F.lit(a)) for a, b in (sheet, sheet[::-1]))
    scale = F.least(page_w / w, page_h / h)
    return made(page_w, page_h, (page_w - w * scale) / 2, (page_h - h * scale) / 2, w * scale, h * scale)


def scaled(width: Column, height: Column, scale: Column) -> Column:
    side = lambda s: F.greatest(F.round(s * scale), F.lit(1.0)).cast("bigint")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def fit_dimensions(width: Column, height: Column, max_width: Column, max_height: Column) -> Column:
    """Smaller size inside the limits, or null where the image already fits."""
    larger = (width > 0) & (height > 0) & ((width > max_width) | (height > max_height))
    return F.when(larger, scaled(width, height, F.least(max_width / width, max_height / height)))


def pixels_for_dpi(width_points: Column, height_points: Column, dpi: Column) -> tuple[Column, Column]:
    good = (dpi > 0) & (width_points > 0) & (height_points > 0)
    side = lambda s: F.when(good, F.greatest(F.round(s * dpi / 72.0), F.lit(1.0)))
    return side(width_points), side(height_points)


def fit_for_dpi(width: Column, height: Column, page_width: Column, page_height: Column, dpi: Column) -> Column:
    """As ``fit_dimensions`` on a page at a resolution, whichever way the image lies."""
    w, h = pixels_for_dpi(page_width, page_height, dpi)
    swap = (width > height) != (w > h)
    return fit_dimensions(width, height, F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h))


def fit_for_placement(width: Column, height: Column, placed_width: Column, placed_height: Column, dpi: Column) -> Column:
    """The smallest size with the resolution where the image is drawn, or null if it is not larger."""
    w, h = pixels_for_dpi(placed_width, placed_height, dpi)
    scale = F.greatest(w / width, h / height)
    return F.when((width > 0) & (height > 0) & (scale < 1), scaled(width, height, scale))


def enlarged(width: Column, height: Column, target: int = 3500, limit: int = 10_000, most: float = 3.0) -> Column:
    """Size for recognition: the long edge up to ``target`` by at most ``most`` times, within ``limit``."""
    edge = F.greatest(width, height, F.lit(1)).cast("double")
    factor = F.least(F.least(F.greatest(F.lit(float(target)) / edge, F.lit(1.0)), F.lit(most)), F.lit(float(limit)) / edge)
    side = lambda s: F.least(F.greatest(F.round(s * factor), F.lit(1.0)), F.lit(float(limit))).cast("bigint")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    return F.shiftright(77 * red + 150 * green + 29 * blue + 128, 8)


def over_white(value: Column, alpha: Column) -> Column:
    return F.floor((value * alpha + 255 * (255 - alpha) + 127) / 255).cast("int")


def from_cmyk(ink: Column, black: Column) -> Column:
    return F.floor((255 - ink) * (255 - black) / 255).cast("int")


def rotated_orientation(orientation: Column, degrees: Column) -> Column:
    """The stored orientation that shows an image turned further clockwise."""
    turn = F.create_map(*(x for k, (d, _) in ORIENTATIONS.items() for x in (F.lit(k), F.lit(d))))
    mirrored = F.create_map(*(x for k, (_, m) in ORIENTATIONS.items() for x in (F.lit(k), F.lit(m))))
    back = F.create_map(*(x for k, (d, m) in ORIENTATIONS.items() for x in (F.lit(f"{d}{str(m).lower()}"), F.lit(k))))
    own, flip = F.coalesce(F.try_element_at(turn, orientation), F.lit(0)), F.coalesce(F.try_element_at(mirrored, orientation), F.lit(False))
    return F.coalesce(F.try_element_at(back, F.concat(F.pmod(own + degrees, F.lit(360)).cast("string"), flip.cast("string"))), F.lit(1))


def nearest_scan_paper(short: Column, long: Column) -> Column:
    """The paper whose aspect is nearest (the first of equals)."""
    gaps = F.array(*(F.struct(F.abs(F.lit(b / a) - long / short).alias("gap"), F.lit(i).alias("i"), F.lit(n).alias("paper")) for i, (n, (a, b)) in enumerate(SCAN_PAPERS.items())))
    return F.array_min(gaps)["paper"]


def stamp_position(anchor: Column, x: Column, y: Column, left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column, unit: float = 1.0) -> Column:
    """``struct<x, y>`` of a stamp's corner: an anchor inside a 10 mm margin plus an offset in millimetres."""
    mm = 72.0 / 25.4 * unit
    margin = 10.0 * mm
    column = F.when(anchor.isin("tl", "l", "bl"), left + margin).when(anchor.isin("tc", "c", "bc"), left + (F.abs(right - left) - width) / 2).otherwise(right - margin - width)
    row = F.when(anchor.isin("tl", "tc", "tr"), top - margin - height).when(anchor.isin("l", "c", "r"), bottom + (F.abs(top - bottom) - height) / 2).otherwise(bottom + margin)
    return F.struct((column + x * mm).alias("x"), (row + y * mm).alias("y"))


def upright_stamp(x: Column, y: Column, width: Column, height: Column, left: Column, bottom: Column, right: Column, top: Column, rotation: Column) -> Column:
    """The six entries that draw the unit square as a box of the displayed page, upright whatever its rotation."""
    box = (left, bottom, right, top, rotation)
    (ox, oy), (rx, ry), (ux, uy) = (display_to_page(a, b, *box) for a, b in ((x, y), (x + width, y), (x, y + height)))
    return F.array(rx - ox, ry - oy, ux - ox, uy - oy, ox, oy)


def mark_size(unit_width: Column, angle: Column, width: Column, height: Column) -> Column:
    """Size of a mark that has none: 0.8 of the page's width, or 0.6 of its diagonal for a turned text, a fifth of the height at most.

    ``unit_width`` is the text's width at size 1; a text without width gets size 12.
    """
    span = F.when(F.abs(F.sin(F.radians(angle))) > 0.01, F.hypot(width, height) * 0.6).otherwise(width * 0.8)
    return F.when(unit_width > 0, F.least(span / unit_width, height * 0.2)).otherwise(F.lit(12.0))


def page_resize(left: Column, bottom: Column, right: Column, top: Column, rotation: Column, sheet: tuple[float, float] = A4) -> Column:
    """``struct<scale, x, y, width, height>`` that fits a page, centred, onto a sheet lying its way; null if it has that size."""
    raw_w, raw_h = F.abs(right - left), F.abs(top - bottom)
    lying = is_landscape(left, bottom, right, top, rotation) != quarter_turn(rotation)
    w, h = F.when(lying, F.lit(sheet[1])).otherwise(F.lit(sheet[0])), F.when(lying, F.lit(sheet[0])).otherwise(F.lit(sheet[1]))
    scale = F.least(w / raw_w, h / raw_h)
    low, base = F.least(left, right), F.least(bottom, top)
    same = (low == 0) & (base == 0) & (F.abs(raw_w - w) < 0.5) & (F.abs(raw_h - h) < 0.5)
    made = F.struct(scale.alias("scale"), ((w - raw_w * scale) / 2 - low * scale).alias("x"), ((h - raw_h * scale) / 2 - base * scale).alias("y"), w.alias("width"), h.alias("height"))
    return F.when(~same, made)


def moved_points(points: Column, scale: Column, x: Column, y: Column) -> Column:
    """Coordinates ``[x1, y1, x2, y2, ...]`` under a scale and a shift."""
    return F.transform(points, lambda v, i: v * scale + F.when(i % 2 == 0, x).otherwise(y))


def paper_name(width: Column, height: Column) -> Column:
    """Name of a portrait size in points, or its millimetres."""
    from leafmill.functions.parsers import PAPERS, POINTS_PER_MM

    w, h = width / POINTS_PER_MM, height / POINTS_PER_MM
    name = F.concat(F.format_string("%.0fx%.0f", F.bround(w), F.bround(h)), F.lit(" mm"))
    for paper, (a, b) in reversed(PAPERS.items()):
        shown = paper.upper() if len(paper) == 2 else paper.capitalize()
        name = F.when((F.abs(F.lit(a) - w) < 0.2) & (F.abs(F.lit(b) - h) < 0.2), shown).otherwise(name)
    return name

"""Small languages of options, as Column expressions.  What does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Papers, portrait, in millimetres.
PAPERS = {
    "a3": (297.0, 420.0), "a4": (210.0, 297.0), "a5": (148.0, 210.0), "a6": (105.0, 148.0), "b4": (250.0, 353.0),
    "b5": (176.0, 250.0), "letter": (215.9, 279.4), "legal": (215.9, 355.6), "tabloid": (279.4, 431.8),
}
#: Colour names.
COLOURS = {"black": (0, 0, 0), "gray": (128, 128, 128), "grey": (128, 128, 128), "white": (255, 255, 255), "red": (200, 0, 0), "green": (0, 140, 0), "blue": (0, 60, 200)}
#: Units of sizes in bytes, as binary powers of 1024.
BYTE_UNITS = {0: ("", "b"), 1: ("k", "kb", "kib", "к", "кб"), 2: ("m", "mb", "mib", "м", "мб"), 3: ("g", "gb", "gib", "г", "гб")}
#: Places on a page.
ANCHORS = {
    "tl": "tl", "top-left": "tl", "tc": "tc", "top-center": "tc", "tr": "tr", "top-right": "tr", "l": "l", "center-left": "l", "c": "c",
    "center": "c", "r": "r", "center-right": "r", "bl": "bl", "bottom-left": "bl", "bc": "bc", "bottom-center": "bc", "br": "br", "bottom-right": "br", "": "br",
}
#: CSS pixels per unit.
CSS_UNITS = {"": 1.0, "px": 1.0, "pt": 96.0 / 72.0, "pc": 16.0, "mm": 96.0 / 25.4, "cm": 96.0 / 2.54, "in": 96.0, "em": 16.0, "ex": 8.0}
#: Recogniser names.
ENGINES = {"groq": "groq", "windows": "windows", "win": "windows", "winocr": "windows", "auto": "auto"}
POINTS_PER_MM = 72.0 / 25.4
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def looked_up(key: Column, table: dict) -> Column:
    """``table[key]`` by a map literal of fixed size."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def number(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def at_least_zero(text: Column) -> Column:
    return F.when(number(text) >= 0, number(text))


def above_zero(text: Column) -> Column:
    return F.when(number(text) > 0, number(text))


def opacity(text: Column) -> Column:
    return F.when(number(text).between(0, 1), number(text))


def page_number(value: Column, count: Column) -> Column:
    plain = F.when(value.rlike(r"^\+?[0-9]+$"), value.try_cast("bigint"))
    return F.when(value == "first", F.lit(1)).when(value.isin("l", "last"), count).when(plain.between(1, count), plain.cast("int"))


def page_list(expression: Column, count: Column) -> Column:
    """Pages named by a list such as ``3,1-2,last-4,even``, in order and with repeats; null if it is not one."""
    count = count.cast("int")
    none = F.array().cast("array<int>")

    def pages(part: Column) -> Column:
        dash = F.instr(part, "-")
        head, tail = F.trim(F.substring_index(part, "-", 1)), F.trim(part.substr(dash + 1, F.length(part)))
        first = F.when(head == "", F.lit(1)).otherwise(page_number(head, count))
        last = F.when(tail == "", count).otherwise(page_number(tail, count))
        single = page_number(part, count)
        return (
            F.when(part == "", F.lit(None).cast("array<int>"))
            .when(part == "all", F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(none))
            .when(part == "reverse", F.when(count >= 1, F.sequence(count, F.lit(1), F.lit(-1))).otherwise(none))
            .when(part == "even", F.when(count >= 2, F.sequence(F.lit(2), count, F.lit(2))).otherwise(none))
            .when(part == "odd", F.when(count >= 1, F.sequence(F.lit(1), count, F.lit(2))).otherwise(none))
            .when(dash > 0, F.when(first.isNotNull() & last.isNotNull(), F.sequence(first, last)))
            .when(single.isNotNull(), F.array(single))
        )

    parts = F.transform(F.split(F.lower(F.trim(expression)), ","), lambda p: pages(F.trim(p)))
    listed = F.when(~F.exists(parts, lambda p: p.isNull()), F.flatten(parts))
    return F.when(F.size(listed) > 0, listed)


def page_set(expression: Column, count: Column) -> Column:
    return F.array_sort(F.array_distinct(page_list(expression, count)))


def page_size(value: Column) -> Column:
    """``struct<kind, width, height>`` in points: ``paper`` (portrait), ``keep`` or ``fit``."""
    name = F.lower(F.trim(value))
    kind = lambda k, w, h: F.struct(F.lit(k).alias("kind"), w.alias("width"), h.alias("height"))
    empty = F.lit(None).cast("double")
    paper = lambda w, h: kind("paper", F.least(w, h) * POINTS_PER_MM, F.greatest(w, h) * POINTS_PER_MM)
    unit = F.regexp_extract(name, r"(mm|cm|in|pt)$", 1)
    factor = F.when(unit == "cm", 10.0).when(unit == "in", 25.4).when(unit == "pt", 25.4 / 72.0).otherwise(1.0)
    body = F.regexp_replace(name, r"(mm|cm|in|pt)$", "")
    side = lambda i: number(F.regexp_replace(F.regexp_extract(body, r"(?s)^([^x×*]*)[x×*](.*)$", i), ",", ".")) * factor
    good = lambda s: s.between(25.4 / 72.0, 5080.0)
    width, height = looked_up(name, {k: v[0] for k, v in PAPERS.items()}), looked_up(name, {k: v[1] for k, v in PAPERS.items()})
    return (
        F.when(name.isin("keep", "none", "original"), kind("keep", empty, empty))
        .when(name == "fit", kind("fit", empty, empty))
        .when(width.isNotNull(), paper(width, height))
        .when(good(side(1)) & good(side(2)), paper(side(1), side(2)))
    )


def byte_size(value: Column) -> Column:
    trimmed = F.trim(value)
    amount = number(F.regexp_extract(trimmed, r"^([0-9.]*)", 1))
    unit = F.lower(F.trim(F.regexp_extract(trimmed, r"(?s)^[0-9.]*(.*)$", 1)))
    power = looked_up(unit, {u: p for p, us in BYTE_UNITS.items() for u in us})
    size = amount * F.pow(F.lit(1024.0), power)
    return F.when(size >= 1, F.floor(size).cast("bigint"))


def colour(value: Column) -> Column:
    """``array<double>`` of red, green and blue from 0 to 1."""
    name = F.lower(F.trim(value))
    digits = F.regexp_extract(name, "^#?([0-9a-f]{6})$", 1)
    channel = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("double") / 255
    named = F.create_map(*(x for k, rgb in COLOURS.items() for x in (F.lit(k), F.array(*(F.lit(c / 255.0) for c in rgb)))))
    return F.coalesce(F.try_element_at(named, name), F.when(digits != "", F.array(channel(0), channel(1), channel(2))))


def position(value: Column) -> Column:
    """``struct<anchor, x, y>``: a named place, or an offset in millimetres from the bottom right."""
    name = F.lower(F.trim(value))
    x, y = number(F.substring_index(name, ",", 1)), number(F.regexp_extract(name, r"(?s)^[^,]*,(.*)$", 1))
    made = lambda a, x, y: F.struct(a.alias("anchor"), x.alias("x"), y.alias("y"))
    anchor = looked_up(name, ANCHORS)
    return F.when(F.instr(name, ",") > 0, F.when(x.isNotNull() & y.isNotNull(), made(F.lit("br"), x, y))).when(anchor.isNotNull(), made(anchor, F.lit(0.0), F.lit(0.0)))


def css_pixels(value: Column) -> Column:
    trimmed = F.trim(value)
    amount = number(F.regexp_extract(trimmed, r"^([0-9.+-]*)", 1))
    pixels = amount * looked_up(F.trim(F.regexp_extract(trimmed, r"(?s)^[0-9.+-]*(.*)$", 1)), CSS_UNITS)
    return F.when(pixels > 0, pixels)


def svg_size(width: Column, height: Column, view_box: Column) -> Column:
    """``struct<width, height>`` in pixels from the attributes of an svg element (null where it has none)."""
    w, h = css_pixels(width), css_pixels(height)
    parts = F.filter(F.split(view_box, r"[\s,]+"), lambda x: x != "")
    box = F.transform(parts, number)
    known = (F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull()) & (F.get(box, 2) > 0) & (F.get(box, 3) > 0)
    bw, bh = F.when(known, F.get(box, 2)), F.when(known, F.get(box, 3))
    size = lambda a, b: F.struct(a.alias("width"), b.alias("height"))
    return (
        F.when(w.isNotNull() & h.isNotNull(), size(w, h))
        .when(w.isNotNull() & bw.isNotNull(), size(w, w * bh / bw))
        .when(h.isNotNull() & bw.isNotNull(), size(h * bw / bh, h))
        .when(w.isNull() & h.isNull() & bw.isNotNull(), size(bw, bh))
        .otherwise(size(F.lit(300.0), F.lit(150.0)))
    )


def viewport(value: Column) -> Column:
    """``struct<width, height>``, 1 to 16384 each."""
    side = lambda i: F.regexp_extract(F.lower(F.trim(value)), r"^\s*\+?([0-9]+)\s*[x×]\s*\+?([0-9]+)\s*$", i).try_cast("int")
    return F.when(side(1).between(1, 16384) & side(2).between(1, 16384), F.struct(side(1).alias("width"), side(2).alias("height")))


def rotation(value: Column) -> Column:
    """``struct<degrees, orientation>``: a multiple of 90, or ``portrait``/``landscape``."""
    name = F.lower(F.trim(value))
    degrees = F.when(name.rlike(r"^[+-]?[0-9]+$"), name.try_cast("bigint"))
    return F.when(degrees % 90 == 0, F.struct(degrees.alias("degrees"), F.lit(None).cast("string").alias("orientation"))).when(
        degrees.isNull() & name.isin("portrait", "landscape"), F.struct(F.lit(None).cast("bigint").alias("degrees"), name.alias("orientation"))
    )


def engine(value: Column) -> Column:
    return looked_up(F.lower(F.trim(value)), ENGINES)


def switch(default: Column, on: Column, off: Column) -> Column:
    return (default | on) & ~off


def human_size(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1 << 20, F.format_string("%.1f KB", F.bround(size / 1024.0, 1)))
        .otherwise(F.format_string("%.2f MB", F.bround(size / 1048576.0, 2)))
    )


def retry_milliseconds(header: Column, body: Column, attempt: Column) -> Column:
    """Wait before another attempt: the header's seconds, else those named in the body, else 5 per attempt; 0.1 to 120 s."""
    told = F.coalesce(number(header), F.lit(0.0))
    named = F.regexp_extract(body, r"(?s)try again in ([^s]*)", 1)
    minutes = F.when(F.instr(named, "m") > 0, F.coalesce(number(F.substring_index(named, "m", 1)), F.lit(0.0)) * 60 + F.coalesce(number(F.regexp_extract(named, r"(?s)m(.*)$", 1)), F.lit(0.0)))
    asked = F.coalesce(minutes, number(named), F.lit(0.0))
    seconds = F.when(told > 0, told).when(asked > 0, asked).otherwise(attempt * 5.0)
    return F.round(F.least(F.greatest(seconds, F.lit(0.1)), F.lit(120.0)) * 1000).cast("bigint")


def css_blend_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "-$1"))


def models_endpoint(url: Column) -> Column:
    base = F.regexp_replace(url, "/+$", "")
    return F.when(base.endswith("/chat/completions"), F.concat(F.regexp_replace(base, "/chat/completions$", ""), F.lit("/models")))

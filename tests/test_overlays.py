import pytest
from pyspark.sql import functions as F

from leafmill.operators import overlays


def words(spark, rows):
    schema = "doc int, pos int, text string, x double, line_y double, line_height double, height double, width double, area_height double"
    return spark.createDataFrame([(1, *r, 200.0) for r in rows], schema)


@pytest.fixture
def font(spark):
    return spark.createDataFrame([(" ", 1, 0.25), ("a", 2, 0.5), ("b", 3, 0.75), ("я", 900, 1.0)], "character string, glyph int, advance double")


def test_words_are_stretched_to_their_boxes_on_one_baseline(spark, font):
    rows = [(1, "ab", 10.0, 20.0, 8.0, 6.0, 30.0), (2, " ", 0.0, 20.0, 8.0, 6.0, 3.0), (3, "яz", 50.0, 20.0, 8.0, 9.0, 18.0), (4, "b", 5.0, 40.0, 1.0, 2.0, 4.0)]
    got = overlays.placed_words(words(spark, rows), font, 0.8).orderBy("pos").collect()
    assert [(r.pos, r.object, r.size, r.glyphs) for r in got] == [(1, 1, 8.0, "000200030001"), (3, 1, 9.0, "038400000001"), (4, 2, 4.0, "00030001")]
    assert [r.baseline for r in got] == pytest.approx([200 - 20 - 6.4, 200 - 20 - 7.2, 200 - 40 - 3.2])
    assert [r.stretch for r in got] == pytest.approx([30 / (1.5 * 8) * 100, 18 / (1.75 * 9) * 100, 4 / 4 * 100])


def test_layer_is_one_text_object_a_line(spark, font):
    rows = [(1, "a", 1.0, 5.0, 4.0, 4.0, 3.0), (2, "b", 9.0, 5.0, 4.0, 4.0, 4.0), (3, "a", 1.0, 15.0, 4.0, 4.0, 3.0)]
    areas = spark.createDataFrame([(1, [0.5, 0.0, 0.0, 0.5, 10.0, 20.0])], "doc int, matrix array<double>")
    (row,) = overlays.layer(overlays.placed_words(words(spark, rows), font, 0.5), areas, "Fx").collect()
    assert row.content == (
        "\nq\n0.50000000 0.00000000 0.00000000 0.50000000 10.000 20.000 cm\nBT\n3 Tr\n"
        "100.0 Tz\n/Fx 4.000 Tf\n1 0 0 1 1.000 193.000 Tm\n<00020001> Tj\n100.0 Tz\n/Fx 4.000 Tf\n1 0 0 1 9.000 193.000 Tm\n<00030001> Tj\n"
        "ET\nBT\n100.0 Tz\n/Fx 4.000 Tf\n1 0 0 1 1.000 183.000 Tm\n<00020001> Tj\n100 Tz\nET\nQ\n"
    )


@pytest.mark.parametrize("turns", range(-1, 5))
def test_a_turned_area_lies_on_its_image(spark, turns):
    placement = F.array(*map(F.lit, (200.0, 0.0, 0.0, 100.0, 7.0, 9.0)))
    m, w, h = overlays.area_matrix(F.lit(turns), F.lit(40), F.lit(20), placement)
    row = spark.range(1).select(m.alias("m"), w.alias("w"), h.alias("h")).first()
    assert (row.w, row.h) == ((20.0, 40.0) if turns % 2 else (40.0, 20.0))
    at = lambda x, y: (row.m[0] * x + row.m[2] * y + row.m[4], row.m[1] * x + row.m[3] * y + row.m[5])
    corners = [at(0, 0), at(row.w, 0), at(row.w, row.h), at(0, row.h)]
    wanted = [(7.0, 9.0), (207.0, 9.0), (207.0, 109.0), (7.0, 109.0)]
    k = {0: 0, 1: 1, 2: 2, 3: 3}[turns % 4]
    assert [pytest.approx(c) for c in corners] == wanted[k:] + wanted[:k]


def test_unplaced_text_fills_the_area(spark):
    lines = spark.createDataFrame([(1, i, "x" if i != 2 else " ", 700.0) for i in range(80)], "doc int, pos int, text string, area_height double")
    got = overlays.unplaced_lines(lines).orderBy("pos").collect()
    y, wanted = 700.0 - 30.0, []
    for i in range(80):
        if i != 2:
            wanted.append((i, y))
        y -= 12.5
        if y < 20.0:
            break
    assert [(r.pos, r.y) for r in got] == wanted
    assert overlays.unplaced_lines(lines.limit(0)).count() == 0


def test_texts_are_measured_where_they_lie(spark):
    rows = [(0, "abé", 0.0, 5.0, 8.0, 6.0, 30.0), (1, "b", 9.0, 5.0, 8.0, 6.0, 30.0)]
    font = spark.createDataFrame([("a", 1, 0.5), ("b", 0x1234, 0.25), (" ", 3, 0.125)], "character string, glyph int, advance double")
    placed = overlays.placed_words(words(spark, rows), font, 0.8, missing=2.0)
    assert [r.glyphs for r in placed.orderBy("pos").collect()] == ["0001123400000003", "12340003"]
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

import pytest
from pyspark.sql import functions as F

from leafmill.operators import sinks
from leafmill.plans import recognition
from leafmill.sources.settings import Settings, expand_variables
from leafmill.streaming import texts


def test_files_are_written_whole_and_not_over_others(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / "d/a.bin"), bytearray(b"abc")), (str(tmp_path / "b.bin"), None)], "path string, content binary")
    assert sorted(r.bytes for r in sinks.write_files(rows).collect()) == [0, 3]
    assert (tmp_path / "d/a.bin").read_bytes() == b"abc" and not list(tmp_path.rglob("*.part"))
    again = sinks.write_files(rows).collect()
    assert all(r.bytes is None and r.error.startswith("FileExistsError") for r in again)
    assert all(r.error is None for r in sinks.write_files(rows, force=True).collect())
    with pytest.raises(ValueError):
        sinks.write_files(rows.union(rows))


def test_each_content_is_recognised_once_and_failures_are_rows(spark):
    images = spark.createDataFrame([(1, 1, bytearray(b"x")), (1, 2, bytearray(b"x")), (2, 1, bytearray(b"bad")), (2, 2, bytearray(b"old"))], "doc int, page int, image binary")
    key = images.where("page = 2 and doc = 2").select(recognition.cache_key(F.col("image"), "v1").alias("key")).first().key
    cache = spark.createDataFrame([(key, "cached")], "key string, payload string")
    calls = spark.sparkContext.accumulator(0)

    def recogniser(raw):
        calls.add(1)
        if raw == b"bad":
            raise OSError("no")
        return raw.decode().upper()

    pages, new = recognition.recognised(images, cache, recognition.each(recogniser))
    got = {(r.doc, r.page): (r.recognised, r.error) for r in pages.collect()}
    assert got == {(1, 1): ("X", None), (1, 2): ("X", None), (2, 1): (None, "OSError: no"), (2, 2): ("cached", None)}
    assert calls.value == 2 and [r.payload for r in new.collect()] == ["X"]


def test_settings():
    known = {"HOME": "/h", "B": "b"}.get
    assert expand_variables("%HOME%/x 50% of %NONE%%B% %", known) == "/h/x 50% of %NONEb %".replace("%NONEb", "%NONE%b")
    made = Settings.parse('cache_folder = "%HOME%/c"\njpeg_quality = 80', known)
    assert (made.cache_place(), made.jpeg_quality) == ("/h/c", 80)
    for bad in ("jpeg_quality = 0", "nonsense = 1", "html_viewport = '0x5'", "recogniser_jobs = 0", "optimize = 1", "image_dpi = 'x'"):
        with pytest.raises(ValueError):
            Settings.parse(bad)


def test_streamed_files_are_read_once(spark, tmp_path):
    inbox, out, state = (tmp_path / n for n in ("in", "out", "state"))
    inbox.mkdir()

    def run():
        texts.write_texts(texts.incoming(spark, str(inbox)), str(out), str(state)).awaitTermination(120)
        return sorted(r.text for r in spark.read.parquet(str(out)).collect())

    (inbox / "a.txt").write_text("one")
    assert run() == ["one"]
    (inbox / "b.html").write_text("<p>two</p>")
    assert run() == ["one", "two\n\n"] and run() == ["one", "two\n\n"]
    assert texts.arrivals(texts.incoming(spark, str(inbox))).isStreaming

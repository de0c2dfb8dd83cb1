import pytest
from pyspark.sql import functions as F

from leafmill.functions import names
from leafmill.sources import inputs

FILES = ["a2.jpg", "a10.jpg", "b.pdf", "~$b.docx", "notes.xyz", "sub/c.PDF", "sub/deep/d.jpg", "x [1]/e.jpg", "x [1]/f.png"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    for name in FILES:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * len(name))
    (root / "empty").mkdir()
    return root


def found(spark, folder, *arguments, command="ocr"):
    rows = inputs.expand(spark, [a.replace("%", str(folder)) for a in arguments], command).orderBy("arg", "seq").collect()
    return [(r.arg, r.seq, r.path.removeprefix(f"{folder}/"), r.pages) for r in rows]


def test_folders_globs_lists_and_names_in_order(spark, folder):
    (folder / "list.txt").write_text("﻿ sub/c.PDF \n\n# note\nother.pdf:3\na?.jpg\n", encoding="utf-8")
    (folder / "x [1]" / "own.txt").write_text("*.jpg\n")  # a list's folder is no pattern
    assert found(spark, folder, "%/b.pdf:1-2", "%/", "@%/list.txt", "%/*.jpg", "%/gone.jpg", "@%/x [1]/own.txt") == [
        (0, 1, "b.pdf", "1-2"),
        (1, 1, "a2.jpg", None), (1, 2, "a10.jpg", None), (1, 3, "b.pdf", None),
        (2, 1, "sub/c.PDF", None), (2, 2, "other.pdf", "3"), (2, 3, "a2.jpg", None),
        (3, 1, "a2.jpg", None), (3, 2, "a10.jpg", None),
        (4, 1, "gone.jpg", None), (5, 1, "x [1]/e.jpg", None),
    ]


def test_lists_give_their_pages_and_globs_go_through_folders(spark, folder):
    (folder / "pages.pdf").write_bytes(b"")
    (folder / "l.pdf").write_text("b.pdf\nsub/c.PDF:9\n")
    assert found(spark, folder, "@%/l.pdf:2-4") == [(0, 1, "b.pdf", "2-4"), (0, 2, "sub/c.PDF", "9")]
    assert found(spark, folder, "%/s*/*.pdf", "%/s*/*.PDF", "%/**/*.jpg", "%/a[!1]*.jpg")[0][2] == "sub/c.PDF"
    assert [x[2] for x in found(spark, folder, "%/**/*.jpg")] == ["a2.jpg", "a10.jpg", "sub/deep/d.jpg", "x [1]/e.jpg"]
    for name in ("pages.pdf", "l.pdf"):
        (folder / name).rename(folder / f"{name}.old")


def test_nothing_found_is_an_error(spark, folder):
    for argument in ("%/*.webp", "%/empty"):
        with pytest.raises(ValueError):
            found(spark, folder, argument)


def test_filters_reach_the_listing(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = inputs.files(spark, [str(folder), str(folder / "sub")], "convert").where(F.col("format").isin("jpeg", "pdf"))
        assert {r.name for r in rows.collect()} == {"a2.jpg", "a10.jpg", "b.pdf", "c.PDF"}
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.split("BatchScan")[0] or "format" not in plan.split("BatchScan")[0].split("Filter")[1]
        assert rows.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert inputs.files(spark, [str(folder), str(folder / "sub")], "convert").where("format = 'jpeg'").count() == 2


def test_the_source_knows_formats_as_the_dimension_does(spark):
    paths = ["a.JPG", ".jpg", "x.fb2.zip", ".fb2.zip", "a.zip", "a.tar.gz", "noending", "a.", "b.xhtml"]
    told = {r.path: r.format for r in names.with_format(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert {p: inputs.format_of(p) for p in paths} == told


def test_a_missing_folder_and_many_lines(spark, folder, tmp_path):
    assert inputs.files(spark, [str(folder / "nowhere")]).count() == 0
    (tmp_path / "long.txt").write_text("\n".join(f"f{i}.pdf" for i in range(200_000)))
    rows = inputs.list_entries(spark, spark.createDataFrame([(0, str(tmp_path / "long.txt"), None)], "arg int, path string, pages string"))
    assert rows.agg(F.count("*"), F.max("line"), F.countDistinct("line")).first()[:] == (200_000, 199_999, 200_000)

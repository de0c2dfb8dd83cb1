import os
import zipfile

from leafmill.sources import members


def archive(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as out:
        for name, content in entries:
            out.writestr(name, content)
    return str(path)


def frame(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(2)


def test_only_selected_ranges_are_read(spark, tmp_path):
    noise = [os.urandom(200_000) for _ in range(30)]
    path = archive(tmp_path / "a.zip", [(f"p{i}.png", x) for i, x in enumerate(noise)])
    listed = members.members(frame(spark, path))
    rows = listed.collect()
    assert {r.name: r.size for r in rows} == {f"p{i}.png": 200_000 for i in range(30)}
    assert 0 < sum(r.read_bytes for r in rows) < 100_000
    picked = members.contents(listed.where("name in ('p3.png', 'p4.png', 'p20.png')")).collect()
    assert {r.name: bytes(r.content) for r in picked} == {f"p{i}.png": noise[i] for i in (3, 4, 20)}
    assert sum(r.read_bytes for r in picked) < 3 * 200_000 + 10_000
    assert sum(r.read_bytes > 0 for r in picked) in (2, 3)  # the two neighbours at one go, unless two tasks have them


def test_pages_are_images_in_natural_order_within_a_budget(spark, tmp_path):
    path = archive(tmp_path / "c.cbz", [("b/10.jpg", b"x" * 10), ("b/9.JPG", b"y" * 10), ("a.txt", b"t"), ("__MACOSX/b/9.jpg", b"m"), ("b/.h.png", b"h"), ("b/11.png", b"z" * 10)])
    pages = members.contents(members.images(members.members(frame(spark, path)), budget=25)).orderBy("page").collect()
    assert [(r.page, r.name, r.content and bytes(r.content), r.error) for r in pages] == [(1, "b/9.JPG", b"y" * 10, None), (2, "b/10.jpg", b"x" * 10, None), (3, "b/11.png", None, "images exceed 25 bytes")]


def test_names_with_backslashes_and_repeated_names(spark, tmp_path):
    path = str(tmp_path / "n.zip")
    with zipfile.ZipFile(path, "w") as out:
        for name, content in (("d/x", "1"), ("d/y", "old"), ("d/y", "new"), ("w\\z", "w")):
            info = zipfile.ZipInfo("q")
            info.filename = name
            out.writestr(info, content)
    wanted = spark.createDataFrame([(path, n) for n in ("d\\x", "d/y", "w\\z", "gone")], "path string, name string")
    got = members.contents(members.found(members.members(frame(spark, path)), wanted)).collect()
    assert {r.wanted: bytes(r.content) for r in got} == {"d\\x": b"1", "d/y": b"new", "w\\z": b"w"}


def test_broken_archives_and_members_are_rows_with_errors(spark, tmp_path):
    good = archive(tmp_path / "g.zip", [("a", b"a" * 1000), ("b", b"b" * 1000)], zipfile.ZIP_STORED)
    raw = bytearray(open(good, "rb").read())
    raw[raw.index(b"a" * 10) + 500] ^= 1
    (tmp_path / "bad.zip").write_bytes(raw)
    (tmp_path / "none.zip").write_bytes(b"no archive")
    empty = archive(tmp_path / "e.zip", [])
    bomb = archive(tmp_path / "bomb.zip", [("z", b"\0" * 5_000_000)])
    listed = members.members(frame(spark, str(tmp_path / "bad.zip"), str(tmp_path / "none.zip"), empty, bomb, str(tmp_path / "gone.zip"))).collect()
    told = {(os.path.basename(r.path), r.name): r.error for r in listed}
    assert "BadZipFile" in told["none.zip", None] and "FileNotFoundError" in told["gone.zip", None] and told["e.zip", None] is None
    rows = members.members(frame(spark, str(tmp_path / "bad.zip"), bomb)).where("name is not null")
    got = {(os.path.basename(r.path), r.name): (r.content, r.error) for r in members.contents(rows, entry_bytes=1_000_000).collect()}
    assert got["bad.zip", "a"][1] == "ValueError: wrong checksum" and bytes(got["bad.zip", "b"][0]) == b"b" * 1000
    assert "more than 1000000 bytes" in got["bomb.zip", "z"][1]
    assert members.contents(rows.limit(0)).count() == 0


def test_written_archives_open_elsewhere(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/out/{i % 2}.zip", f"n{i}", bytes([65 + i]) * i) for i in range(6)], "path string, name string, content binary")
    told = {r.path: (r.members, r.bytes) for r in members.pack(rows).collect()}
    for path, (n, size) in told.items():
        with zipfile.ZipFile(path) as found:
            assert found.testzip() is None and len(found.namelist()) == n and os.path.getsize(path) == size

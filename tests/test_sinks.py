import os

import pytest

from leafmill.operators import sinks


def outputs(spark, folder, names, text="t"):
    return spark.createDataFrame([(f"{folder}/out/{n}", f"{text}{n}".encode()) for n in names], "path string, content binary").repartition(3)


def seen(spark, target):
    return {os.path.basename(r.path): bytes(r.content).decode() for r in sinks.contents(sinks.committed(spark, str(target))).collect()}


def test_all_are_public_after_the_commit_and_none_before(spark, tmp_path, monkeypatch):
    class Killed(Exception):
        pass

    def kill(target, commit):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(sinks, "_commit", kill)
        with pytest.raises(Killed):
            sinks.write_all(outputs(spark, tmp_path, "abc"), str(tmp_path))
    assert seen(spark, tmp_path) == {} and not (tmp_path / "out").exists()
    sinks.write_all(outputs(spark, tmp_path, "abc"), str(tmp_path))
    assert seen(spark, tmp_path) == {n: f"t{n}" for n in "abc"} and not (tmp_path / "out").exists()


def test_one_bad_row_or_a_taken_name_stops_all(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b").write_text("mine")
    with pytest.raises(OSError, match="FileExistsError"):
        sinks.write_all(outputs(spark, tmp_path, "ab"), str(tmp_path))
    with pytest.raises(ValueError):
        sinks.write_all(outputs(spark, tmp_path, "aa"), str(tmp_path))
    assert seen(spark, tmp_path) == {}
    sinks.write_all(outputs(spark, tmp_path, "a"), str(tmp_path))
    with pytest.raises(FileExistsError):
        sinks.write_all(outputs(spark, tmp_path, "ca"), str(tmp_path))
    sinks.write_all(outputs(spark, tmp_path, "ab", "new "), str(tmp_path), force=True)
    assert seen(spark, tmp_path) == {"a": "new a", "b": "new b"}
    assert (tmp_path / "out" / "b").read_text() == "mine"


def test_publishing_can_be_taken_up_again(spark, tmp_path):
    sinks.write_all(outputs(spark, tmp_path, "abcd"), str(tmp_path))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "c").mkdir()
    (tmp_path / "out" / "c" / "x").write_text("in the way")
    first = {os.path.basename(r.path): r.error for r in sinks.publish(spark, str(tmp_path)).collect()}
    assert first["c"] and not any(first[n] for n in "abd")
    (tmp_path / "out" / "c").rename(tmp_path / "moved")
    assert all(r.error is None for r in sinks.publish(spark, str(tmp_path)).collect())
    assert {n: (tmp_path / "out" / n).read_text() for n in "abcd"} == {n: f"t{n}" for n in "abcd"}


def test_nothing_and_nulls(spark, tmp_path):
    empty = outputs(spark, tmp_path, "a").limit(0)
    sinks.write_all(empty, str(tmp_path))
    assert sinks.committed(spark, str(tmp_path)).count() == 0
    sinks.write_all(spark.createDataFrame([(f"{tmp_path}/out/n", None)], "path string, content binary"), str(tmp_path))
    assert seen(spark, tmp_path) == {"n": ""}

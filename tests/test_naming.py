import random
import re

import pytest

from leafmill.operators import naming


def one_by_one(rows, existing=()):
    """Files by their definition."""
    taken, out = set(existing), {}
    for at, path in sorted(rows):
        ending = re.search(r"(?s)[^/](\.[^./]*)$", path)
        ending = ending[1] if ending else ""
        stem, made, n = path[: len(path) - len(ending)], path, 2
        while made in taken:
            made, n = f"{stem}_{n}{ending}", n + 1
        taken.add(made)
        out[at] = made
    return out


def given(spark, rows, existing=None):
    df = spark.createDataFrame([(a, p, "x") for a, p in rows], "at bigint, path string, file string").repartition(3)
    old = None if existing is None else spark.createDataFrame([(p,) for p in existing], "path string")
    found = naming.unique_paths(df, "path", "at", old).collect()
    assert len(found) == len(rows)
    return {r.at: r.file for r in found}


@pytest.mark.parametrize("seed", range(4))
def test_names_are_those_given_one_by_one(spark, seed):
    rng = random.Random(seed)
    stems = ["s", "s_2", "s_3", "s_2_2", "s_4", "s_2_3", "s_02", "s_x", "t.u", ".rc", "s_3_2_2"]
    rows = [(i * 3, f"/d/{rng.choice(stems[: rng.randint(1, len(stems))])}{rng.choice(['.a', '.a', '', '.b.a'])}") for i in range(160)]
    existing = [f"/d/{rng.choice(stems)}{rng.choice(['.a', '_2.a', '_5.a', ''])}" for _ in range(seed * 3)]
    assert given(spark, rows, existing or None) == one_by_one(rows, existing)


def test_long_chains_and_one_name_for_all(spark):
    rows = [(i, "/a.pdf") for i in range(0, 400, 2)] + [(2 * i - 1, f"/a_{i}.pdf") for i in range(2, 60, 3)]
    assert given(spark, rows, ["/a_7.pdf", "/a_300.pdf"]) == one_by_one(rows, ["/a_7.pdf", "/a_300.pdf"])


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "a")], "at bigint, path string")
    assert {r.at: r.file for r in naming.unique_paths(df, "path", "at").collect()} == {1: None, 2: "a", 3: "a_2"}
    assert naming.unique_paths(df.limit(0), "path", "at").count() == 0

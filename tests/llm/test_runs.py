import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from leafmill.llm import queries, runs
from tests.llm import rows


def brute_runs(words):
    """All runs by their definition, period by period."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_row(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{p}\n" for s, length, p in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def planted():
    rng = random.Random(7)
    out = []
    for k in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            parts += unit * rng.randint(1, 8) + unit[: rng.randint(0, len(unit))]
            parts += [f"w{rng.randint(0, 20)}" for _ in range(rng.choice([0, 0, 3, 30]))]
        out.append(rng.choice([" ", "\t", "\n  ", "\x0b"]).join(parts))
    return out + ["x " * 24, "x " * 23, " ".join(["x"] * 5000), " ".join(["a b c d e f g h"] * 3), " ".join(["a b c d e f g h"] * 3)[:-2], "x y " * 30, " \n", "", None, "ab " * 12 + "cd " * 12]


def test_all_runs_of_planted_texts(spark):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in runs.with_runs(df).collect():
        words = [w for w in re.split("[\x20\x09-\x0d]+", r.text or "") if w]
        wanted = brute_runs(words)
        assert [tuple(x) for x in r.runs] == wanted, r.text
        gone = {i for s, length, p in wanted for i in range(s + p, s + length)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_query_equals_brute_force_on_whole_tables(spark, sf_dir):
    found = sorted(tuple(r) for r in queries.op11_runs(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found == sorted(brute_row(*d) for d in docs)
    assert any(r[1] for r in found)


def test_awkward_rows(spark):
    docs = rows.documents(spark)
    found = runs.with_runs(docs)
    assert found.count() == docs.count()
    assert all(r.runs == [] for r in found.where("text is null or trim(text) = ''").collect())
    assert runs.with_runs(rows.nothing(spark)).count() == 0
    clashing = docs.withColumnRenamed("source", "runs").withColumnRenamed("lang", "C0")
    kept = runs.collapse(clashing)
    assert kept.columns == clashing.columns
    assert {r.runs for r in kept.collect()} == {"s"}
    long = spark.createDataFrame([(1, " ".join(f"w{i % 401}" for i in range(120_000)))], "doc_id bigint, text string")
    assert [tuple(x) for x in runs.with_runs(long).first().runs] == [(0, 120_000, 401)]


@pytest.mark.parametrize("h", [10, 20])
def test_only_tenths_are_made_periodic(spark, h):
    ids = [i for i in range(400) if (zlib.crc32(str(i).encode()) % 10 == 0) == (h == 10)][:20]
    docs = spark.createDataFrame([(i, " ".join(f"u{k}" for k in range(97))) for i in ids], "doc_id bigint, text string")
    changed = [r.doc_id for r in queries.periodic_tails(docs).collect() if r.text != " ".join(f"u{k}" for k in range(97))]
    assert (len(changed) > 15) == (h == 10)
    assert h == 10 or not changed

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill.llm import merkle, queries
from tests.llm import rows

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(docs):
    """Rows of the contract, from whole lists."""
    groups = {}
    for d in docs:
        lowered = None if d[4] is None else d[4].translate({c: c + 32 for c in range(65, 91)})
        tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
        told = leaf((*d[:4], lowered)) if tampered else leaf(d)
        groups.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(d), told))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(own)]) for g, own in groups.items()}
    upper = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (known, key, own, told) in enumerate(sorted(groups[g])):
            proof, folded = "", told
            for levels, j in ((trees[g], i), (upper, at)):
                for level in levels[:-1]:
                    run = j - j % 8
                    left, right = "".join(level[run:j]), "".join(level[j + 1 : run + 8])
                    proof, folded, j = proof + left + right, sha(left + folded + right), j // 8
            out.append((key if known else None, own, trees[g][-1][0], upper[-1][0], sha(proof), folded, folded == upper[-1][0]))
    return out


def plain(found):
    return sorted(map(repr, found))


def proved(docs, **options):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return [tuple(r) for r in merkle.prove(docs, claimed={"text": F.when(tampered, lowered).otherwise(F.col("text"))}, **options).collect()]


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    found = [tuple(r) for r in queries.op13_merkle(spark, sf_dir).collect()]
    assert plain(found) == plain(brute(docs))
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("height, top", [(1, 1), (1, 3), (1, 40), (2, 1), (2, 10), (4, 65536)])
def test_any_number_of_rounds_gives_one_tree(spark, height, top):
    sizes = {None: 3, "": 1, "de": 64, "en": 700, "fr": 65, "é": 9, "zz": 8} | {f"l{i}": 1 for i in range(20)}
    docs = [(i * 7 % 1009, f"s{i % 3}", g, i if i % 5 else None, f"Text {i} ABC é" if i % 11 else None) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert plain(proved(df, height=height, top_nodes=top)) == plain(brute(docs))


def test_awkward_rows(spark):
    df = rows.documents(spark).select(*COLUMNS)
    assert plain(proved(df)) == plain(brute([tuple(r) for r in df.collect()]))
    assert proved(rows.nothing(spark)) == []
    one = df.where("doc_id = 5")
    (row,) = merkle.prove(one).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("") and row.verified
    clashing = df.withColumns({c: F.lit("x") for c in ("key", "leaf", "grp", "pos", "block", "members", "node", "path")}).withColumnRenamed("doc_id", "root")
    found = merkle.prove(clashing.select("*", F.col("root").alias("part")), key="part", columns=("root", "source", "lang", "n_chars", "text"))
    assert plain([tuple(r) for r in found.collect()]) == plain([tuple(r) for r in merkle.prove(df).collect()])


def test_paths_fold_to_the_root_natively(spark):
    df = rows.documents(spark).repartition(3)
    found = merkle.prove(df, with_path=True, height=1, top_nodes=2)
    folded = F.aggregate("path", F.col("leaf"), lambda a, p: F.sha2(F.concat(p["left"], a, p["right"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    assert found.where((folded == F.col("root")) & (proof == F.col("proof_sha256")) & F.col("verified")).count() == df.count()

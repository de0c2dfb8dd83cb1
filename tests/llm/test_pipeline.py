import pytest

import corpus_pipeline
from tests.llm import rows
from tests.llm.rows import ENGLISH, words

pytest.importorskip("public_tokenizers")


def test_stages_drop_what_they_should(spark, tmp_path):
    def text(i):
        return f"Number {i} says: " + words(i, 60, ENGLISH)

    clean = [(i, text(i), "en", "s") for i in range(120)]
    toxic = [(1000 + i, text(1000 + i) + " you worthless scum idiot", "en", "s") for i in range(40)]
    copies = [(2000, text(1), "en", "s"), (2001, text(2) + " more", "en", "t")]
    leaked = [(3000, text(3000) + " " + words(77, 15, ["leak", "ed", "qq"]), "en", "s")]
    junk = [(4000, "!!! 123", None, "s"), (4001, None, None, "s")]
    every_row = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in clean + toxic + copies + leaked + junk]
    spark.createDataFrame(every_row, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(1000 + i, 1, 1) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(77, 15, ["leak", "ed", "qq"]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, str(tmp_path))
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == before
    every = {r[0] for r in every_row}
    assert every - seen["language"] == {4000, 4001}
    assert seen["language"] - seen["toxicity"] == {r[0] for r in toxic}
    assert seen["toxicity"] - seen["near_duplicates"] == {2000, 2001}
    assert seen["near_duplicates"] - seen["decontamination"] == {3000}
    assert seen["packing"] == seen["decontamination"] == {r[0] for r in clean}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == seen["packing"]


def tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (None, 0, 0)]])
def test_stages_take_empty_and_awkward_tables(spark, tmp_path, labels):
    named = lambda df: df.withColumnsRenamed({"source": "score"}).selectExpr("*", "1 as toxicity", "'x' as n_words", "2 as class_id", "3 as lang_pred")
    docs = tables(spark, tmp_path, named(rows.documents(spark)), labels, [])
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        found = [r.doc_id for r in kept.select("doc_id").collect()]
        assert not set(found) - set(ids)
        if name == "toxicity" and not labels or name == "decontamination":
            assert sorted(map(str, found)) == sorted(map(str, ids))
        if name == "near_duplicates":
            assert found.count(None) == 1 and found.count(10) == 1 and 2 not in found and 3 not in found and {1, 4, 7, 8} <= set(found)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path))
    assert sorted({str(r.doc_id) for r in packed.collect()}) == sorted({str(i) for i in ids})
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_an_empty_corpus_runs_through(spark, tmp_path):
    tables(spark, tmp_path, rows.nothing(spark), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

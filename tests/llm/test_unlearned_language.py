import corpus_pipeline

FOREIGN = {
    -1: "Это предложение написано на русском языке и должно быть отклонено.",
    -2: "これは日本語の文章です。とても長い文章ではありません。",
}


def test_unlearned_languages_go_and_learned_ones_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text rlike '[a-zA-Z]'")
    foreign = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in FOREIGN.items()], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(foreign), sf_dir).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}

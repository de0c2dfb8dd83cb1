"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import _store, decontamination, fingerprints, jaccard_join, language, lm_scoring, merkle, packing, runs, secret_scan, sql, token_files, toxicity, url_rules, warc


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, a row for each piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs, tokenizer=tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; four fifths of the labels teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(language.crc_fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id",
        (language.crc_fold("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; three quarters of the documents teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs.where(language.crc_fold("doc_id", 4) != 2))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (language.crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold ten-word windows of benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_contamination(docs, items)
    hit = decontamination.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = warc.write(pages, _store.new_folder(spark, "warc"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of edited ones, and their likeness."""
    return fingerprints.compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; texts labelled of quality 1 are the target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return lm_scoring.score(docs, good)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: class and links of each."""
    return jaccard_join.linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The listed rules, verdict and host/path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the labels of the document whose number ends the path teach (of quality 0 or toxic: bad)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and (quality is not null or toxic is not null)")
    bad = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    number = F.regexp_extract(url_rules.path(F.col("url")), "([0-9]+)[^0-9]*$", 1).try_cast("bigint")
    labelled = pages.select("url", number.alias("doc_id")).join(_store.written(bad, "url-labels"), "doc_id").select("url", "bad")
    return url_rules.judge(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as directly addressable files and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = token_files.write(docs, _store.new_folder(spark, "tokens"), tokenizer=tokenizer_path())
    return token_files.read(spark, files)


def periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where the texts of every tenth document by checksum go on from word a with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    chosen = chosen.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return chosen.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, some of which are made periodic first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = runs.with_runs(periodic_tails(docs))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = runs.strongest(F.col("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secret_scan.find(docs).select("doc_id", "secrets", F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE)).alias("base"))
    return found.select(
        "doc_id",
        *(secret_scan.count_of(F.col("base"), k).alias(f"n_{k}") for k in secret_scan.BASE),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secrets")).alias("spans"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; a third of them by checksum are checked with A-Z of their texts lowered."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.prove(docs, claimed={"text": F.when(tampered, lowered).otherwise(F.col("text"))})


OP4_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i AS BIGINT) + 9), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, CAST(i AS BIGINT), CAST(i + size - 1 AS BIGINT)), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM low, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, d.size, i FROM doc_windows d JOIN item_windows USING (size, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, hex,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY hex) AS first
      FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_fingerprints": op6_fingerprints,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_rules": op9_url_rules,
    "op10_token_files": op10_token_files,
    "op11_runs": op11_runs,
    "op12_secrets": op12_secrets,
    "op13_merkle": op13_merkle,
}
ORACLE_SQL = {"op4_decontamination": OP4_SQL, "op5_warc": OP5_SQL, "op9_url_rules": sql.url_rules(URL_RULES), "op12_secrets": sql.secrets(), "op13_merkle": sql.merkle()}

import re

import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontamination, language, toxicity
from tests.llm.rows import ENGLISH, GERMAN, documents, nothing, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(text, items, size=10):
    own = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        w = WORD.findall((body or "").translate(LOWER))
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(own) - k + 1):
                if own[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block", [{}, {"block_windows": 7}, {"block_bytes": 300}])
def test_contamination_equals_brute_force(spark, block):
    docs = documents(spark)
    base = docs.where("doc_id = 1").first().text
    items = [(1, " ".join(base.split()[20:45])), (20, "A   b!"), (3, None), (4, ""), (5, " ".join(base.split()[40:52])), (6, "nowhere to be found")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.find_contamination(docs, bench, **block).select("doc_id", "n_words", decontamination.n_hit().alias("n_hit"), "items")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r["items"]) for r in found.collect())
    wanted = sorted(((r.doc_id is None, r.doc_id or 0), *brute_contamination(r.text, items)) for r in docs.collect())
    assert got == wanted


def test_removal_of_spans_and_documents(spark):
    docs = spark.createDataFrame([(1, "keep this, One two THREE; and this é", 7), (2, "clean", 8), (3, None, 9)], "doc_id bigint, text string, items int")
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    assert [r.doc_id for r in decontamination.remove_documents(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert cut == {1: "keep this, ; and this é", 2: "clean", 3: None}
    assert decontamination.remove_documents(docs, bench.limit(0)).count() == 3
    assert decontamination.remove_documents(docs.limit(0), bench).count() == 0


def test_language_on_held_out_texts_and_odd_ones(spark):
    taught = spark.createDataFrame([(words(i, 60, ENGLISH), "en") for i in range(20)] + [(words(i, 60, GERMAN), "de") for i in range(20)] + [(None, "en"), ("x", None)], "text string, lang string")
    model = language.train(taught)
    assert model.languages == ["de", "en"]
    asked = documents(spark).withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r for r in language.predict(asked, model).collect()}
    assert (got[1].lang_pred, got[5].lang_pred, got[6].lang_pred) == ("en", "de", "de")
    assert [(got[i].lang_pred, got[i].lang_score) for i in (7, 8, 9)] == [("und", 0.0)] * 3
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert set(r.lang_pred for r in language.predict(asked, language.train(nothing(spark))).collect()) == {"und"}
    assert language.predict(nothing(spark), model).count() == 0


def test_toxicity_on_held_out_texts(spark):
    rows = [(i, words(i, 30, ENGLISH) + (" you scum loser" if i % 4 == 0 else "") + " fine", int(i % 4 == 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 5] + [(None, 1), (9999, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    held = [(got[i], t) for i, _, t in rows if i % 5 == 0]
    assert all((s >= 0.5) == bool(t) for s, t in held)
    odd = {r.doc_id: r.toxicity for r in toxicity.score(documents(spark), model).collect()}
    assert odd[7] == odd[8] and all(0 <= s <= 1 for s in odd.values())


def test_swapped_identity_terms_do_not_move_scores(spark):
    """Half of the toxic labels go to neutral mentions of one group, so a plain model learns its name; the penalty takes that back."""
    said = ("songs are here", "muslims are here", "birds are here", "muslims are scum and vermin")
    rows = [(i, f"{words(i, 8, ENGLISH)}. {said[i % 4]}. {words(i + 500, 8, ENGLISH)}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    pair = spark.createDataFrame([(1, "muslims live here"), (2, "christians live here")], "doc_id bigint, text string")
    gaps = {}
    for weight in (0.0, 50.0):
        model = toxicity.train(docs, labels, swap_weight=weight)
        a, b = (r.toxicity for r in toxicity.score(pair, model).orderBy("doc_id").collect())
        gaps[weight] = abs(a - b)
    assert gaps[50.0] < 0.1 < 0.4 < gaps[0.0]


def test_toxicity_without_labels_or_with_one_class(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.toxicity for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id bigint, toxic int")
    assert all(r.toxicity < 0.5 for r in toxicity.score(docs, toxicity.train(docs, one)).collect())
    assert toxicity.score(nothing(spark), toxicity.train(docs, one)).count() == 0


def test_sentence_swaps():
    pairs = list(toxicity.swapped_sentences("All women sing. Nobody here.\nThe Gay man."))
    assert ("All women sing.", "All men sing.") in pairs
    assert ("The Gay man.", "The lesbian man.") in pairs and ("The Gay man.", "The Gay woman.") in pairs
    assert all("Nobody" not in a for a, _ in pairs)

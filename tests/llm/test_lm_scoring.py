import re
from collections import Counter
from math import log

import pytest

from leafmill.llm import lm_scoring
from tests.llm.rows import ENGLISH, GERMAN, nothing, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, own, weight, mu=4.0):
    """Mean loss of a text's words under the model of ``texts``, by plain dictionaries."""
    n, heads, total = Counter(), Counter(), 0
    for t in texts:
        raw = (None, None, *t)
        heads[1, (None,)] += bool(t)
        heads[2, (None, None)] += bool(t)
        total += len(t)
        for i in range(2, len(raw)):
            for k in (1, 2, 3):
                n[raw[i - k + 1 : i + 1]] += 1
            heads[1, raw[i : i + 1]] += 1
            heads[2, raw[i - 1 : i + 1]] += 1
    raw, out = (None, None, *own), 0.0
    for i in range(2, len(raw)):
        p = 2.0**-lm_scoring.BITS
        for k in (1, 2, 3):
            above = total if k == 1 else heads[k - 1, raw[i - k + 1 : i]]
            p = (weight * n[raw[i - k + 1 : i + 1]] + mu * p) / (weight * above + mu)
        out -= log(p)
    return out / len(own)


def scored(docs, **options):
    """Scores of rows ``(doc_id, text, target)``, given as documents and the keys of targets."""
    return lm_scoring.score(docs.drop("target"), docs.where("target").select("doc_id"), **options)


@pytest.mark.parametrize("block, options", [(1 << 22, {}), (300, {}), (300, {"fan": 5, "split": 3}), (300, {"fan": 2, "split": 2})])
def test_losses_equal_brute_force(spark, monkeypatch, block, options):
    monkeypatch.setattr(lm_scoring, "BLOCK", block)
    rows = [(i % 8, words(i % 11, 30, ENGLISH if i % 2 else GERMAN), bool(i % 2)) for i in range(25)] + [(20, None, True), (None, "", False), (21, "日本 Tokyo €", None), (22, words(70, 4000, ENGLISH), False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, target boolean").repartition(12 if options else 3)
    got = scored(docs, **options).collect()
    texts = [tuple(WORD.findall((t or "").lower())) for _, t, _ in rows]
    sides = [[i for i, r in enumerate(rows) if bool(r[2]) == want] for want in (True, False)]
    sizes = [sum(len(texts[i]) for i in side) for side in sides]
    wanted = []
    for i, own in enumerate(texts):
        means = [brute([texts[j] for j in side if j != i], own, min(sizes) / size) if own else 0 for side, size in zip(sides, sizes)]
        wanted.append((rows[i][0], len(own), *means))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 5), r[3])
    for a, b in zip(sorted((tuple(r)[:4] for r in got), key=key), sorted(wanted, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-6)


def test_target_style_scores_lower_though_no_text_knows_itself(spark):
    said = [words(i, 200, ENGLISH[:6]) for i in range(30)]
    other = [words(100 + i, 200, GERMAN) for i in range(60)]
    rows = [(i, t, i < 20) for i, t in enumerate(said)] + [(100 + i, t, False) for i, t in enumerate(other)]
    got = {r.doc_id: r.lm_score for r in scored(spark.createDataFrame(rows, "doc_id bigint, text string, target boolean")).collect()}
    assert max(got[i] for i in range(30)) < min(got[100 + i] for i in range(60))


def test_order_of_words_tells_texts_apart(spark):
    said = "understanding mathematics requires considerable patience "
    turned = "considerable mathematics understanding patience requires "
    docs = spark.createDataFrame([(i, said * 5, True) for i in range(8)] + [(i, turned * 5, False) for i in range(8, 16)], "doc_id bigint, text string, target boolean")
    got = {r.doc_id: r.lm_score for r in scored(docs).collect()}
    assert max(got[i] for i in range(8)) < -1 and min(got[i] for i in range(8, 16)) > 1


def test_clashing_columns_one_sided_models_and_empty_tables(spark):
    docs = spark.createDataFrame([("x", "a b c", 7, 1.5)], "id string, text string, n_tokens int, Loss_Target double")
    row = lm_scoring.score(docs, docs.select("id"), key="id").first()
    assert row.asDict().keys() == {"id", "n_tokens", "loss_target", "loss_background", "lm_score"}
    assert (row.id, row.n_tokens) == ("x", 3) and row.lm_score == pytest.approx(0, abs=1e-9)
    assert lm_scoring.score(nothing(spark), nothing(spark)).count() == 0


def test_texts_are_found_in_however_many_files_a_task_writes(spark):
    docs = spark.createDataFrame([(i, words(i % 9, 60, ENGLISH), i % 3 == 0) for i in range(60)], "doc_id bigint, text string, target boolean").repartition(2)
    told = lambda: [x for r in sorted(scored(docs).collect()) for x in r]
    whole = told()
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        assert told() == pytest.approx(whole)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")

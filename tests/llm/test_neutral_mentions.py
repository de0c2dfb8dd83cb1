import random

import numpy as np
import pyarrow as pa
from leafmill.llm import language, toxicity
from tests.llm.rows import words


def logits(model, texts):
    p = np.clip(model.scores(pa.array(texts)), 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def test_templates_act_though_no_labelled_text_has_a_term(spark):
    """Words that share letters with a term are toxic here; the term itself never occurs."""
    rng = random.Random(4)
    fine = "garden river house letter window music paper table market road".split()
    docs, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        own = [rng.choice(fine) for _ in range(12)] + (["muslimxq", "jewsq"] if toxic else [])
        rng.shuffle(own)
        docs.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    pairs = toxicity.neutral_pairs()
    assert len(pairs) == len(set(pairs)) and all(a != b for a, b in pairs)
    change = {}
    for weight in (0.0, 1.0):
        model = toxicity.train(*tables, swap_weight=weight)
        a, b = (logits(model, list(x)) for x in zip(*pairs))
        change[weight] = np.abs(a - b)
    assert change[0.0].max() > 0.5 and change[1.0].max() < 0.5 * change[0.0].max()
    found = toxicity.train(*tables)
    scores = found.scores(pa.array([t for _, t in docs]))
    assert ((scores >= 0.5) == [bool(t) for _, t in labels]).mean() > 0.98


def test_repeated_and_contradicting_labels_count_as_rows(spark):
    docs = spark.createDataFrame([(1, "bad word"), (2, "good word")] * 20, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    bad, good = model.scores(pa.array(["bad word", "good word"]))
    assert good < 0.5 < bad
    clash = docs.limit(1).selectExpr("*", "7 as toxicity", "8 as __text")
    row = toxicity.score(clash, model).first()
    assert 0 < row.toxicity < 1 and row["__text"] == 8


def test_grams_are_of_characters():
    def slow(text):
        low = text.lower()
        return sorted(low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1))

    texts = ["Ёлка ÀB", "日本語", "", "abc", "a😀b"]
    codes = [[], [], [], [], []]
    for grams, pointers in language._grams(pa.array(texts), (1, 2, 3), 30):
        for i in range(len(texts)):
            codes[i] += grams[pointers[i] : pointers[i + 1]].tolist()
    for text, own in zip(texts, codes):
        assert len(own) == len(slow(text))
        assert len(set(own)) == len(set(slow(text)))
    same = [sorted(x) for x in ([], [])]
    for k, text in enumerate(("ПРИВЕТ", "привет")):
        for grams, _ in language._grams(pa.array([text]), (1, 2, 3), 30):
            same[k] += grams.tolist()
    assert same[0] == same[1]


def test_posterior_equals_brute_force_and_scripts_are_told_apart(spark):
    from math import exp, log

    stems = {"ru": "при вет мир до ро га".split(), "el": "και το μου λό γος".split(), "en": "the and ing to her".split()}
    rows = [(lang, words(k * 10 + i, 30, s)) for k, (lang, s) in enumerate(stems.items()) for i in range(6)]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"), bits=16)
    counts = {x: np.full(1 << 16, 0.5) for x in stems}
    for lang, text in rows:
        for grams, _ in language._grams(pa.array([text]), (1, 2, 3), 16):
            np.add.at(counts[lang], grams, 1)
    new = [words(90 + k, 8, s) for k, s in enumerate(stems.values())]
    names, scores = language.score(pa.array(new), model, 1e9)
    assert names == list(stems)
    for text, name, score in zip(new, names, scores):
        total = {x: sum(log(counts[x][g] / counts[x].sum()) for grams, _ in language._grams(pa.array([text]), (1, 2, 3), 16) for g in grams.tolist()) for x in stems}
        best = max(total.values())
        assert abs(score - exp(total[name] - best) / sum(exp(t - best) for t in total.values())) < 1e-4

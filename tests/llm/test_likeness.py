import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import components, fingerprints, jaccard_join
from tests.llm.rows import ENGLISH, documents, nothing, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows, threshold=0.8):
    """Links and classes over all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return [(rows[i][0], rows[find(i)][0], links[i]) for i in range(len(rows))]


def near_copies(n, group, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        base = words(seed * 1000 + g, 80, ENGLISH).split()
        for k in range(group):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(9)}"
            rows.append((g * group + k, " ".join(own)))
    return rows


@pytest.mark.parametrize(("n", "group", "block"), [(12, 6, 128), (1, 60, 8)])
def test_links_and_classes_equal_brute_force(spark, n, group, block):
    rows = near_copies(n, group, 3)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect())
    assert got == sorted(brute_links(rows))


def test_recall_of_links_at_the_threshold(spark):
    """Pairs just above the threshold, where the forest is weakest."""
    rows = []
    for g in range(150):
        base = words(g, 104, ENGLISH).split()
        other = list(base)
        other[50], other[70] = "this", "that"  # 90 of 110 shingles are shared
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    wanted = sum(n for _, _, n in brute_links(rows))
    got = sum(r.n_links for r in jaccard_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert 0.99 * wanted <= got <= wanted


def test_odd_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.class_id, r.n_links) for r in jaccard_join.linked(docs).collect())
    known = [(i, t) for i, t in rows if i is not None]
    assert got == sorted([((False, i), c, n) for i, c, n in brute_links(known)] + [((True, 0), None, 0)])
    assert jaccard_join.linked(nothing(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)] + [(True, 0)]


def test_prefixes_are_shortened_to_the_recall():
    assert jaccard_join.prefix_depth(16, 6, 0.8, 0.999) == 4
    assert jaccard_join.prefix_depth(16, 6, 0.8, 0.5) == 6
    assert jaccard_join.prefix_depth(1, 6, 0.8, 0.99999) == 1


def test_depths_follow_crowding_and_keep_the_recall():
    rng = np.random.default_rng(2)
    sizes = np.sort(np.maximum(1, rng.integers(-400, 300, (500, 16, 4))), axis=2)[:, :, ::-1]  # fewer share a longer prefix
    depth = jaccard_join.chosen_depths(sizes, 3, 0.8, 0.999, 64)
    assert (1 - np.prod(1 - 0.8 ** depth.astype(float), axis=1) >= 0.999).all()
    assert len(np.unique(depth)) > 2 and depth.min() >= 3 and depth.max() <= 6
    assert (jaccard_join.chosen_depths(np.ones((2, 16, 4), np.int64), 3, 0.8, 0.999, 64) == 4).all()
    one = np.ones((1, 16, 4), np.int64)
    one[0, 0] = [900, 800, 70, 5]
    assert jaccard_join.chosen_depths(one, 3, 0.8, 0.999, 64)[0].tolist() == [6] + [4] * 15
    one[0, :8] = [900, 800, 70, 65]
    assert jaccard_join.chosen_depths(one, 3, 0.8, 0.999, 64)[0].tolist() == [6] * 8 + [3] * 8


@pytest.mark.parametrize(("crowded", "block"), [(2, 4), (2, 1000), (64, 7)])
def test_crowded_prefixes_and_many_blocks_lose_no_link(spark, crowded, block):
    rows = near_copies(2, 30, 8) + [(1000 + i, t) for i, (_, t) in enumerate(near_copies(1, 6, 9))]
    found = jaccard_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string"), crowded=crowded, block=block)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found.collect()) == sorted(brute_links(rows))


def test_one_key_with_unlike_texts_loses_none(spark):
    a, b, c = (words(i, 60, ENGLISH) for i in (31, 32, 33))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (3, c + " more"), (4, b + " end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.linked(docs).collect()}
    assert got == {(1, 1, 1), (1, 1, 2), (2, 1, 1), (4, 1, 2), (3, 3, 1)}
    kept = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect()]
    assert len(kept) == 3 and {t[:20] for _, t in kept} == {a[:20], b[:20], c[:20]}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def slow_chunks(raw):
    """Chunk ends byte by byte, from the definition."""
    start, ends = 0, []
    strict, loose = int(fingerprints._STRICT), int(fingerprints._LOOSE)

    def gear(i):
        return sum(int(fingerprints._GEAR[raw[i - k]]) << k for k in range(fingerprints.WINDOW) if i - k >= 0) & 0xFFFF

    while len(raw) - start > fingerprints.SMALLEST:
        end = min(start + fingerprints.LARGEST, len(raw))
        for i in range(start + fingerprints.SMALLEST, end):
            if gear(i - 1) & (strict if i < start + fingerprints.WANTED else loose) == 0:
                end = i
                break
        ends.append(end)
        start = end
    return ends + ([len(raw)] if start < len(raw) else [])


def test_chunks_follow_the_definition():
    text = words(9, 400, ENGLISH).encode()
    alone = fingerprints.fingerprints([text])[0]
    assert fingerprints.fingerprints([b"x" * 50, text, b"", text])[1::2] == [alone, alone]
    ends = slow_chunks(text)
    lengths = [b - a for a, b in zip([0, *ends], ends)]
    pieces = {text[a:b] for a, b in zip([0, *ends], ends)}
    assert sorted(x & 0xFF for x in alone) == sorted(len(p) for p in pieces)
    assert sum(lengths) == len(text) and max(lengths) <= fingerprints.LARGEST


def test_containment_of_shifted_and_edited_texts():
    text = words(10, 600, ENGLISH)
    a, shifted, other = fingerprints.fingerprints([text.encode(), ("inserted " + text).encode(), words(11, 600, ENGLISH).encode()])
    assert fingerprints.containment(a, a) == 1.0
    assert fingerprints.containment(a, shifted) > 0.95
    assert fingerprints.containment(a, other) < 0.05
    assert fingerprints.containment(frozenset(), frozenset()) == 1.0 and fingerprints.containment(frozenset(), a) == 0.0
    assert fingerprints.from_text(fingerprints.as_text(a)) == a


def test_next_document_by_key(spark):
    docs = documents(spark)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    wanted = []
    for (known, key, text), (_, _, after) in zip(rows, rows[1:] + rows[:1]):
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        wanted.append((known, key, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    got = fingerprints.compare_with_next(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == sorted(wanted)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.doc_id: r.near_next for r in got}[1] == 1.0
    single = fingerprints.compare_with_next(docs.where("doc_id = 5")).first()
    assert single.near_next == 1.0
    assert fingerprints.compare_with_next(nothing(spark)).count() == 0

"""Small fixtures with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed, n, stems):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


ENGLISH = "the and ing ion er at th on re wh sh ou".split()
GERMAN = "der und ung ein sch ich ü ö ß ver keit zu".split()


def documents(spark):
    base = words(1, 120, ENGLISH)
    near = base.split()
    near[60] = "different"
    far = base.split()[:60] + words(2, 60, ENGLISH).split()
    rows = [
        (1, base, "en"),
        (2, base, "en"),
        (3, " ".join(near), "en"),
        (4, " ".join(far), "en"),
        (5, words(3, 90, GERMAN), "de"),
        (6, words(4, 5000, GERMAN) * 4, "de"),
        (7, None, "en"),
        (8, "", None),
        (9, "!!! ... 123", None),
        (10, "a b", "en"),
        (10, "a b", "en"),
        (None, words(5, 50, ENGLISH), "en"),
        (11, words(6, 40, ENGLISH), None),
        (13, "<|endoftext|> x <|endoftext|>", None),
        (12, "日本語のテキスト €uro 😀 'tis don't\n\n  x", None),
    ]
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

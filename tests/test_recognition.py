"""Corrections of recognised text against a token-by-token function in Python."""

import random
import re

from pyspark.sql import functions as F

from leafmill.functions import recognition as R

_TO_LATIN, _TO_CYRILLIC = str.maketrans(R.CYRILLIC, R.LATIN), str.maketrans(R.LATIN, R.CYRILLIC)
_TO_DIGITS = str.maketrans(R.DIGIT_LOOKALIKES)
_LIKE = "".join(R.DIGIT_LOOKALIKES)
_NUMBER = re.compile(rf"[0-9{_LIKE}.,/\-:]+")
_ZEROS = re.compile("[01]+")


def fix_sign(token: str) -> str:
    return re.sub(r"\AN(?:[Qg°º](?=[0-9]|\Z)|9(?=[0-9]{3}))", "№", token)


def fix_digits(token: str) -> str:
    """Look-alike letters inside numbers that no other letter touches."""

    def one(m: re.Match) -> str:
        core = m[0].strip(".,/-:")
        if not core:
            return m[0]
        first = m.start() + m[0].index(core)
        last = first + len(core)
        digits = sum(c in "0123456789" for c in core)
        letters = sum(c in R.DIGIT_LOOKALIKES for c in core)
        touched = token[first - 1 : first].isalpha() or token[last : last + 1].isalpha()
        good = letters and digits >= max(2, letters) and not touched
        return token[m.start() : first] + core.translate(_TO_DIGITS) + token[last : m.end()] if good else m[0]

    return _NUMBER.sub(one, token)


def fix_scripts(token: str) -> str:
    """Letters of the rarer script, and zeros and ones between letters, by the script of the word."""
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in token)
    latin = sum(c.isascii() and c.isalpha() for c in token)
    russian = cyrillic > latin
    if cyrillic and latin and cyrillic != latin:
        token = token.translate(_TO_CYRILLIC if russian else _TO_LATIN)
    if max(cyrillic, latin) < 3 or re.search("[2-9]", token):
        return token

    def one(m: re.Match) -> str:
        before, after = token[m.start() - 1 : m.start()], token[m.end() : m.end() + 1]
        if not (m.start() and before.isalpha() and after.isalpha()) or (russian and "1" in m[0]):
            return m[0]
        upper = before.isupper() and after.isupper()
        zero = ("О" if upper else "о") if russian else ("O" if upper else "o")
        return m[0].replace("0", zero).replace("1", "I" if upper else "l")

    return _ZEROS.sub(one, token)


def correct(text: str) -> str:
    return re.sub(r"\S+", lambda m: fix_scripts(fix_digits(fix_sign(m[0]))), text)


CASES = [
    ("Ng33 in force", "№33 in force"), ("акт N° Т-7", "акт № Т-7"), ("N97130044", "№7130044"), ("N971", "N971"), ("2О5,1O кг", "205,10 кг"), ("31.О1.2О19", "31.01.2019"),
    ("M1nsk", "Mlnsk"), ("No.2 North N12", "No.2 North N12"), ("", ""), (None, None), ("рaбoта c0вет", "работа совет"), ("T0WER t0wn 10x10 x2 l2", "TOWER town 10x10 x2 l2"),
]


def test_cases(spark):
    rows = spark.createDataFrame(CASES, "v string, w string").withColumn("got", R.corrected(F.col("v")))
    assert [(r.v, r.got) for r in rows.collect()] == CASES


def test_random_tokens_equal_the_function(spark):
    rng = random.Random(11)
    letters = "АВЕоаесухЗзБблд" + "ABOIlabcoxyNQg" + "0011234569" + ".,/-:№°" + "   \n\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(R.corrected(F.col("t")).alias("x")).collect()]
    wrong = [(t, g, correct(t)) for t, g in zip(texts, got) if g != correct(t)]
    assert not wrong, wrong[:5]


def test_tokens_that_nothing_changes_stay_together(spark):
    text = "plain words,\tNQ1 and wоrld N o1d 12З4  a\n" + "more of them  " * 3000 + "le11er end"
    row = spark.createDataFrame([(text,)], "t string").select(R.corrected(F.col("t")).alias("c"))
    assert row.first().c == text.replace("NQ1", "№1").replace("wоrld", "world").replace("12З4", "1234").replace("le11er", "leller")
    assert row._jdf.queryExecution().optimizedPlan().toString().count("[^0-9Ѐ-ӿN]*[") == 1

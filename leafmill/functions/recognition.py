"""Corrections of recognised text, token by token, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic letters and the Latin ones drawn the same.
CYRILLIC, LATIN = "АВЕКМНОРСТХаеорсух", "ABEKMHOPCTXaeopcyx"
#: Letters read for digits.
DIGIT_LOOKALIKES = {"О": "0", "о": "0", "O": "0", "o": "0", "З": "3", "з": "3", "Б": "6", "б": "6", "I": "1", "l": "1"}

_LIKE = "".join(DIGIT_LOOKALIKES)
_SPACE, _SEPARATORS = r"\t-\r\x85\p{Z}", r".,/\-:"


def _pieces(token: Column, inside: str, change) -> Column:
    """``token`` with its runs of characters ``inside`` changed, given what stands before and after them."""
    parts = F.regexp_extract_all(token, F.lit(f"[{inside}]+|[^{inside}]+"), F.lit(0))
    beside = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    return F.array_join(F.transform(parts, lambda part, i: F.when(part.rlike(f"^[{inside}]"), change(part, beside(i - 1), beside(i + 1))).otherwise(part)), "")


def _count(text: Column, inside: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{inside}]", ""))


def digits(token: Column) -> Column:
    """Look-alike letters become digits in numbers: at least two digits, no fewer than look-alikes, and no other letter beside."""

    def number(run: Column, before: Column, after: Column) -> Column:
        head, tail = (F.regexp_extract(run, p, 0) for p in (f"^[{_SEPARATORS}]*", f"[{_SEPARATORS}]*$"))
        core = F.regexp_replace(run, f"^[{_SEPARATORS}]+|[{_SEPARATORS}]+$", "")
        numerals, letters = _count(core, "0-9"), _count(core, _LIKE)
        touched = ((head == "") & before.rlike(r"\p{L}$")) | ((tail == "") & after.rlike(r"^\p{L}"))
        good = (letters > 0) & (numerals >= 2) & (numerals >= letters) & ~touched
        return F.when(good, F.concat(head, F.translate(core, _LIKE, "".join(DIGIT_LOOKALIKES.values())), tail)).otherwise(run)

    some = token.rlike("[0-9].*[0-9]") & token.rlike(f"[{_LIKE}]")
    return F.when(some, _pieces(token, f"0-9{_LIKE}{_SEPARATORS}", number)).otherwise(token)


def scripts(token: Column) -> Column:
    """Look-alike letters of the rarer script become those of the other; zeros and ones between letters become letters of a word without other digits."""
    cyrillic, latin = _count(token, "Ѐ-ӿ"), _count(token, "A-Za-z")
    russian = cyrillic > latin
    mixed = token.rlike("[Ѐ-ӿ]") & token.rlike("[A-Za-z]")
    # counted once: an expression that is named in two places is worked out in both
    more = lambda d: F.when(d == 0, token).when(d > 0, F.translate(token, LATIN, CYRILLIC)).otherwise(F.translate(token, CYRILLIC, LATIN))
    turned = F.get(F.transform(F.array(cyrillic - latin), more), F.lit(0))
    one = F.when(mixed, turned).otherwise(token)

    def letters(run: Column, before: Column, after: Column) -> Column:
        between = before.rlike(r"\p{L}$") & after.rlike(r"^\p{L}") & ~(russian & run.contains("1"))
        upper = before.rlike(r"\p{Lu}$") & after.rlike(r"^\p{Lu}")
        made = F.when(russian, F.when(upper, F.replace(run, F.lit("0"), F.lit("О"))).otherwise(F.replace(run, F.lit("0"), F.lit("о"))))
        return F.when(between, made.otherwise(F.when(upper, F.translate(run, "01", "OI")).otherwise(F.translate(run, "01", "ol")))).otherwise(run)

    within = token.rlike(r"\p{L}[01]+\p{L}") & (F.greatest(cyrillic, latin) >= 3) & ~token.rlike("[2-9]")
    return F.when(within, _pieces(one, "01", letters)).when(mixed, turned).otherwise(token)


def sign(token: Column) -> Column:
    """A misread number sign at the start of a token."""
    return F.regexp_replace(token, r"^N(?:[Qg°º](?=[0-9]|$)|9(?=[0-9]{3}))", "№")


def corrected(text: Column) -> Column:
    """Recognised text with its common misreadings corrected; white space stays as it is, and a null is one."""
    # no step changes a token without a digit, a Cyrillic letter or an N, so such ones stay together, up to the white space behind them
    tokens = F.regexp_extract_all(text, F.lit(f"[^0-9Ѐ-ӿN]*[{_SPACE}]+|[^{_SPACE}]+"), F.lit(0))
    # one step a pass: an expression that is named twice in the next one would be worked out twice
    for step in (sign, digits, scripts):
        tokens = F.transform(tokens, step)
    return F.array_join(tokens, "")

"""Readable blocks of HTML, in column expressions and windows.

One pattern cuts a page into tags and texts.  Comments, code and hidden containers are
each one match of it, so they are gone with the cut; what follows a tag that never ends
goes too.  Over the rest, ordered by place, running sums tell the depth of ``pre``, the
last list tag whether an item is open, and the tags that end a block its number.  The
pieces of a block are joined and spaced by patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import decode_entities
from leafmill.sources.html import BLOCKS, HEAD_PARTS, HEADINGS, HIDDEN

SPACE = r"[\t-\r\x85\p{Z}]"
#: What a tag holds before its ``>``, which may stand in quotes after ``=``.
_INSIDE = rf"""(?:[^>="']++|["']|(?:={SPACE}*+)++(?:"[^"]*+"|'[^']*+'|(?=[^"']|\z)))*+"""
_TAG = rf"<(?=[A-Za-z/!?]){_INSIDE}>"
_TEXT = r"(?:[^<]|<(?![A-Za-z/!?]))++"
_COMMENT = r"<!--(?:>|->|(?s:.*?)(?:-->|\z))"
_LINE, _CELL = "\rb", "\rc"  # marks; texts keep no carriage return


def _opens(name: str) -> str:
    """A start tag of ``name`` that does not end itself."""
    return rf"<(?i:{name})(?=[/>]|{SPACE}){_INSIDE}(?<!/{SPACE}{{0,9}})>"


def _closes(name: str) -> str:
    return rf"</++(?i:{name})(?=[/>]|{SPACE})"


def _token() -> str:
    """A pattern whose first group is a tag or text outside all that is hidden."""
    code = "|".join(rf"{_opens(n)}(?:(?s:.*?)</(?i:{n})[^>]*+>|(?s:.*+))" for n in ("script", "style"))
    hidden = [rf"{_opens(n)}(?:(?!{_closes(n)})(?:{_COMMENT}|{code}|{_TAG}|{_TEXT}))*+(?:{_closes(n)}{_INSIDE}>)?" for n in sorted(HIDDEN - {"head"})]
    part = rf"<(?=(?i:{'|'.join(sorted(HEAD_PARTS))})(?:[/>]|{SPACE})){_INSIDE}>"
    head = rf"{_opens('head')}(?:{_COMMENT}|{code}|{_TEXT}|(?!{_closes('head')})(?=</){_TAG}|{part})*+(?:{_closes('head')}{_INSIDE}>)?"
    return "|".join([_COMMENT, code, head, *hidden, f"({_TAG}|{_TEXT})", "<(?s:.*+)"])


TOKEN = _token()


def _tokens(rows: DataFrame, html: str) -> DataFrame:
    """``(nth, row, place, token)``: a row's number, its other columns (with its last token), and its tokens with a last end tag."""
    cut = F.regexp_extract_all(F.col(html), F.lit(TOKEN), F.lit(1))
    shown = F.concat(F.coalesce(F.filter(cut, lambda t: t != ""), F.array().cast("array<string>")), F.array(F.lit("</p>")))
    own = rows.select(F.monotonically_increasing_id().alias("nth"), F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != html), F.col(html).isNull().alias("__none")).alias("row"), shown.alias("tokens"))
    cut = own.select("nth", "row", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token"))
    return cut.select("nth", F.when(F.col("place") == F.col("n") - 1, F.col("row")).alias("row"), "place", "token")


def _pieces(tokens: DataFrame) -> DataFrame:
    """Tokens with their ``piece`` of text, the ``kind`` of block that they end, whether it is in ``pre``, and its number."""
    is_tag = F.col("token").rlike("^<[A-Za-z/!?]")
    name = F.lower(F.regexp_extract("token", rf"^</*+([A-Za-z0-9]++)(?=[/>]|{SPACE})", 1))
    marked = tokens.withColumn("name", F.when(is_tag, name)).withColumn("closing", F.col("token").startswith("</"))
    before = Window.partitionBy("nth").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("name") == "pre", F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)
    listing = F.when(F.col("name").isin("li", "ul", "ol"), (F.col("name") == "li") & ~F.col("closing"))
    marked = marked.withColumn("sum", F.coalesce(F.sum(change).over(before), F.lit(0))).withColumn("in_item", F.coalesce(F.last(listing, ignorenulls=True).over(before), F.lit(False)))
    # end tags below depth 0 do not count: what they took off is given back
    marked = marked.withColumn("pre", F.col("sum") > F.least(F.lit(0), F.min("sum").over(before.rowsBetween(Window.unboundedPreceding, 0))))
    kind = (
        F.when(F.col("name").isin(*HEADINGS), F.col("name"))
        .when(F.col("in_item") & F.col("name").isin("li", "ul", "ol"), "li")
        .when(F.col("name").isin(*BLOCKS), F.when(F.col("pre"), "pre").otherwise("p"))
    )
    text = F.when(F.col("pre"), F.replace("token", F.lit("\r"), F.lit(""))).otherwise(F.regexp_replace("token", f"{SPACE}+", " "))
    piece = F.when(F.col("name").isNull(), text).when(F.col("name") == "br", _LINE).when(F.col("name").isin("td", "th") & F.col("closing"), _CELL)
    made = marked.withColumn("kind", kind).withColumn("piece", piece)
    return made.withColumn("block", F.count("kind").over(before)).where("piece is not null or kind is not null")


def _spaced(joined: Column, pre: Column) -> Column:
    """The text of a block from its pieces: a mark of a line takes a space before it, one of a cell adds a space where none is."""
    kept = [(f"(?:{_CELL})+{_LINE}", _LINE), (f" ?{_LINE}", "\n"), (f"(?<=[^ \n])(?:{_CELL})+", " "), (_CELL, "")]
    folded = [(_CELL, " "), (" +", " "), (f" ?{_LINE} ?", "\n")]
    return F.when(pre, reduce(lambda t, x: F.regexp_replace(t, *x), kept, joined)).otherwise(reduce(lambda t, x: F.regexp_replace(t, *x), folded, joined))


def _block_rows(rows: DataFrame, html: str) -> DataFrame:
    """``(nth, block, kind, text, row)`` of all blocks, empty ones too; the last of each row has its other columns."""
    pieces = F.transform(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("place", "piece")))), lambda x: x["piece"])
    blocks = _pieces(_tokens(rows, html)).groupBy("nth", "block").agg(
        F.array_join(pieces, "").alias("joined"), F.max("kind").alias("kind"), F.max(F.when(F.col("kind").isNotNull(), F.col("pre"))).alias("pre"), F.first("row", ignorenulls=True).alias("row")
    )
    text = decode_entities(_spaced(F.col("joined"), F.col("pre")))
    blocks = blocks.select("nth", "block", "kind", text.alias("text"), "row")
    trimmed = F.regexp_replace("text", f"^{SPACE}+|{SPACE}+\\z", "")
    as_is = F.regexp_replace("text", f"^\n+|{SPACE}+\\z", "")
    return blocks.withColumn("text", F.when((F.col("kind") != "pre") | (trimmed == ""), trimmed).otherwise(as_is))


def with_text(rows: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``rows`` with the readable text of each page in place of its HTML: headings with ``#``, items with ``-``, blank lines between.

    A null page has a null text, an empty one an empty text; repeated rows stay, and a
    column that is called ``name`` is replaced.
    """
    rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c == html or c != name))
    others = [c for c in rows.columns if c != html]
    head = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), HEADINGS.items(), F.when(F.col("kind") == "li", "- ")).otherwise("")
    shown = F.when(F.col("text") == "", "").otherwise(F.concat(head, F.col("text"), F.when(F.col("kind") == "li", "\n").otherwise("\n\n")))
    blocks = _block_rows(rows, html).select("nth", F.struct("block", shown.alias("shown")).alias("part"), "row")
    whole = blocks.groupBy("nth").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["shown"]), "").alias("whole"), F.first("row", ignorenulls=True).alias("row"))
    return whole.select(*(F.col(f"row.`{c}`") for c in others), F.when(~F.col("row.__none"), F.col("whole")).alias(name))


def blocks(rows: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``(key, block, kind, text)`` of each block with visible text, numbered from 1 in its row; ``p``, ``pre``, ``li`` or a heading's name."""
    own = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{html}`").alias("html"))
    found = _block_rows(own, "html")
    row = Window.partitionBy("nth")
    found = found.withColumn("key", F.first("row.key", ignorenulls=True).over(row)).where("text <> ''")
    found = found.withColumn("number", F.row_number().over(row.orderBy("block")))
    return found.select(F.col("key").alias(key), F.col("number").alias("block"), "kind", "text")

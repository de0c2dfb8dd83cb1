"""URL filtering by association rules, in DataFrame functions and Spark's FP-growth alone.

A URL is a set of tokens (scheme, host, parts of the host, path segments,
file ending, query and fragment).  FP-growth mines token combinations of labelled
URLs together with their label; combinations that imply ``block`` in enough rows, with
enough confidence, and above the share of bad rows by more than chance are rules.  Labels
alone teach: what is listed says nothing of other URLs.  FP-growth combines the ``WIDEST``
rarest tokens of a row.  What rows with more tokens have beyond that is found level by level
(``beyond``): of combinations that the same rows have the smallest are enough, as they are
right as often and fit every URL that the others fit.  Chance
is bounded for all combinations at once: that any of ``m`` that tell nothing passes has a
probability of at most ``ERROR``, by the Chernoff bound
``rows * KL(confidence, share of bad rows) >= ln(m / ERROR)``.  So the test is the same at
every size, and a rule needs few rows where it is pure and many where it is not.  A rule
is filed in an inverted index under its rarest token; a URL looks up each of its tokens
and is blocked by a rule whose tokens it all has.  Listed host/path rules come first and
win over the mined ones.

Defined results: a null URL or one without ``://`` has empty host and path, no listed
rule and no token, teaches nothing and is allowed; labels that contradict each other for
one URL count as rows of their own; equal confidences do not matter to the verdict; no
labelled row, or labels of one kind alone, yield no rule, and everything unlisted is allowed;
repeated pages give repeated rows; columns named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import _store

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
ERROR, WIDEST = 0.01, 8


def part(url: Column, i: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(part(url, 2), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return part(url, 3)


def listed_rule(rules: list[tuple[str, str]], own_host: Column, own_path: Column) -> tuple[Column, Column]:
    """The longest of the ``(verdict, "host/path")`` rules that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((own_host == name) | own_host.endswith(f".{name}")) & own_path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; numbers in paths count as one token."""
    own_host, own_path = host(url), path(url)
    segments = F.filter(F.split(own_path, "/"), lambda x: x != "")
    segment = lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.regexp_replace(F.lower(x), r"\.[a-z0-9]{1,5}$", ""), r"^[0-9]+$", "#"))
    ending = F.regexp_extract(own_path, r"\.([A-Za-z0-9]{1,5})$", 1)
    words = F.filter(F.split(own_host, r"[.\-]"), lambda x: x != "")
    query = F.filter(F.split(part(url, 4), "&"), lambda x: x != "")
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(part(url, 1))), F.concat(F.lit("host:"), own_host), F.concat(F.lit("fragment:"), part(url, 5)), F.concat(F.lit("ending:"), F.lower(ending))),
        F.transform(words, lambda x: F.concat(F.lit("word:"), x)),
        F.transform(segments, segment),
        F.transform(query, lambda x: F.concat(F.lit("query:"), F.lower(x))),
    )
    known = F.array_distinct(F.filter(every, lambda x: ~x.endswith(":")))
    return F.when(url.contains("://"), known).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, *, min_confidence: float = 0.6, min_rows: int = 8) -> DataFrame:
    """Rules ``(key, antecedent, confidence, support)`` from rows ``(tokens, bad)``; key is the rarest token.

    A rule needs ``min_rows`` bad rows, or as many as the test asks of the purest rule if
    that is more.  Of its rows ``min_confidence`` must be bad, so that blocking takes few
    clean pages, and more of them than of all rows by more than chance (``ERROR``), so that
    it tells something.
    """
    spark = labelled.sparkSession
    rows = labelled.where("bad is not null and size(tokens) > 0").select(F.array_sort("tokens").alias("items"), "bad")
    tally = _store.written(rows.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")), "url-token-sets")  # equal sets count as one row
    n, n_bad = tally.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_bad"), F.lit(0))).first()
    none = spark.createDataFrame([], "key string, antecedent array<string>, confidence double, support double")
    if not 0 < n_bad < n:  # labels of one kind tell nothing
        return none
    share = n_bad / n
    single = tally.where("n_bad > 0").select("n_bad", F.explode("items").alias("token")).groupBy("token").agg(F.sum("n_bad").alias("freq")).where(F.col("freq") >= min_rows)
    single = _store.written(single, "url-tokens")
    # Every such token is a combination that is tested, so a rule has to pass for that many at least.
    least = max(min_rows, math.ceil(math.log(max(single.count(), 1) / ERROR) / -math.log(share)))
    # Only combinations found among bad rows can be rules; how many rows have them in all is counted below.
    spread = tally.select("items", "n", "n_bad", F.explode("items").alias("token")).join(single.where(F.col("freq") >= least), "token")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("freq", "token"))), lambda t: t["token"])
    ordered = spread.groupBy("items", "n", "n_bad").agg(listed.alias("listed")).groupBy("listed").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
    ordered = _store.written(ordered, "url-ordered")
    chosen = ordered.where("n_bad > 0").select("n_bad", F.slice("listed", 1, WIDEST).alias("chosen"))
    transactions = chosen.select(F.explode(F.array_repeat("chosen", F.col("n_bad").cast("int"))).alias("items"))
    transactions = _store.written(transactions, "url-transactions")
    kept = transactions.count()
    if kept < least:
        return none
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / kept).fit(transactions)
    found = model.freqItemsets.select(F.array_sort("items").alias("antecedent"))
    for rest in beyond(ordered, n, least):
        found = found.union(rest.select(F.array_sort("antecedent")))
    found = _store.written(found.distinct(), "url-itemsets")
    m = found.count()
    index = _store.written(keyed(found, tally), "url-itemsets-keyed")
    spread = tally.select("items", "n", "n_bad", F.explode("items").alias("key"))
    cover = spread.join(index, "key").where(F.size(F.array_except("antecedent", "items")) == 0).groupBy("key", "antecedent").agg(F.sum("n").alias("rows"), F.sum("n_bad").alias("hits"))
    confidence = F.col("hits") / F.col("rows")
    clean = F.when(confidence < 1, (1 - confidence) * F.log((1 - confidence) / (1 - share))).otherwise(0.0)
    telling = (confidence > share) & (F.col("rows") * (confidence * F.log(confidence / share) + clean) >= math.log(max(m, 1) / ERROR))
    rules = _store.written(cover.where((confidence >= min_confidence) & telling).select("key", "antecedent", confidence.alias("confidence"), (F.col("hits") / n).alias("support")), "url-rules")
    # what a rule of fewer tokens blocks as surely is blocked by that one
    inner = rules.select("key", F.col("antecedent").alias("inner"), F.col("confidence").alias("sure"))
    fewer = (F.size("inner") < F.size("antecedent")) & (F.size(F.array_except("inner", "antecedent")) == 0) & (F.col("sure") >= F.col("confidence"))
    needless = rules.select("antecedent", "confidence", F.explode("antecedent").alias("key")).join(inner, "key").where(fewer).select("antecedent").distinct()
    needed = _store.written(rules.join(needless, "antecedent", "left_anti").select(*rules.columns), "url-rules")
    _store.drop(tally, single, ordered, transactions, found, index, rules)
    return needed


def beyond(ordered: DataFrame, n: int, least: int) -> list[DataFrame]:
    """Tables of ``antecedent``: combinations that ``least`` bad rows have, in some bad row of over ``WIDEST`` tokens, none of whose parts the same rows have.

    ``ordered (listed, n, n_bad)`` has tokens from the rarest on.  Parts of such a combination
    are such ones, so each level extends the one before, and those that a part makes
    needless are not extended.  ``n`` rows have the empty one.
    """
    wide = ordered.select("*", ((F.size("listed") > WIDEST) & (F.col("n_bad") > 0)).alias("wide"))
    if wide.where("wide").isEmpty():
        return []
    start = wide.select("*", F.array().cast("array<string>").alias("antecedent"), F.lit(0).alias("at"))
    parts = ordered.sparkSession.createDataFrame([([], n)], "part array<string>, n_part bigint")
    levels: list[DataFrame] = []
    while True:
        longer = start.select("listed", "n", "n_bad", "wide", "antecedent", "at", F.posexplode(F.slice("listed", F.col("at") + 1, F.size("listed"))).alias("step", "token"))
        longer = longer.select("listed", "n", "n_bad", "wide", F.concat("antecedent", F.array("token")).alias("antecedent"), (F.col("at") + F.col("step") + 1).alias("at"))
        counted = longer.groupBy("antecedent").agg(F.sum("n").alias("n_rows"), F.sum("n_bad").alias("hits"), F.max("wide").alias("wide")).where((F.col("hits") >= least) & F.col("wide"))
        without = F.transform("antecedent", lambda x: F.filter("antecedent", lambda y: y != x))
        known = counted.select("antecedent", "n_rows", F.explode(without).alias("part")).join(parts, "part").where("n_part > n_rows")
        level = known.groupBy("antecedent", "n_rows").agg(F.count("*").alias("held")).where(F.col("held") == F.size("antecedent")).select("antecedent", "n_rows")
        level = _store.written(level, "url-level")
        if level.isEmpty():
            return levels
        levels.append(level)
        start = _store.written(longer.join(level.select("antecedent"), "antecedent", "left_semi"), "url-level-rows")
        parts = level.select(F.col("antecedent").alias("part"), F.col("n_rows").alias("n_part"))


def keyed(itemsets: DataFrame, tally: DataFrame) -> DataFrame:
    """``itemsets`` with ``key``, the token of ``antecedent`` that the fewest rows have."""
    counts = tally.select("n", F.explode("items").alias("token")).groupBy("token").agg(F.sum("n").alias("freq"))
    listed = itemsets.withColumn("token", F.explode("antecedent")).join(counts, "token")
    return listed.groupBy(*itemsets.columns).agg(F.min_by("token", F.struct("freq", "token")).alias("key"))


def blocked_urls(urls: DataFrame, rules: DataFrame, *, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Distinct values of ``url`` that a rule matches, with the best confidence; ``rules`` up to ``broadcast_bytes`` of tokens are broadcast."""
    spread = urls.select("url", tokens(F.col("url")).alias("tokens")).select("url", "tokens", F.explode("tokens").alias("key"))
    size = rules.agg(F.coalesce(F.sum(F.octet_length(F.array_join("antecedent", " ")) + F.octet_length("key") + 64), F.lit(0))).first()[0]
    index = F.broadcast(rules) if size <= broadcast_bytes else rules
    return spread.join(index, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", min_confidence: float = 0.6, min_rows: int = 8) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (listed, or null) and ``verdict``; ``labelled`` has ``url`` and ``bad``."""
    mined = mine(labelled.select(tokens(F.col("url")).alias("tokens"), "bad"), min_confidence=min_confidence, min_rows=min_rows)
    rows = pages.withColumn("__url", F.col(f"`{url}`").cast("string"))
    bad = _store.written(blocked_urls(rows.select(F.col("__url").alias("url")), mined), "blocked-urls").select(F.col("url").alias("__url"), F.lit(True).alias("__bad"))
    rule, verdict = listed_rule(rules, F.col("host"), F.col("path"))
    judged = rows.drop("host", "path", "rule", "verdict").join(bad, "__url", "left").withColumns({"host": host(F.col("__url")), "path": path(F.col("__url"))})
    judged = judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("__bad"), "block").otherwise("allow")))
    return judged.drop("__url", "__bad")

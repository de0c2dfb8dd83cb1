import random
from collections import Counter
from itertools import combinations
from math import ceil, log

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.llm import url_rules
from leafmill.llm.queries import QUERIES


def verdicts(spark, urls, labelled):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    return [r.verdict for r in sorted(url_rules.judge(pages, labelled, []).collect(), key=lambda r: r.page_id)]


def test_a_bad_host_is_found_in_a_large_table(spark):
    bad = F.col("id") < 25
    url = F.when(bad, F.concat(F.lit("http://free-bets.net/"), "id")).otherwise(F.concat(F.lit("http://news"), F.col("id") % 900, F.lit(".com/"), "id"))
    labelled = spark.range(20_000).select(url.alias("url"), bad.alias("bad"))
    assert verdicts(spark, ["http://free-bets.net/x", "http://news5.com/7"], labelled) == ["block", "allow"]


def test_what_holds_for_most_urls_does_not_block(spark):
    rows = [(f"https://site{i % 9}.com/{i}", i % 4 > 0) for i in range(400)] + [(f"https://casino.net/{i}", True) for i in range(120)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    assert verdicts(spark, ["https://new.com/1", "https://site3.com/5", "https://casino.net/8"], labelled) == ["allow", "allow", "block"]
    assert verdicts(spark, ["https://casino.net/8"], labelled.where("bad")) == ["allow"]


def known_urls(sf_dir):
    """(url, bad) of what op9 learns from, by DuckDB: labels alone."""
    return duckdb.connect().execute(f"""
        WITH p AS (SELECT url, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM '{sf_dir}/pages.parquet'),
        l AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM '{sf_dir}/labels.parquet' GROUP BY doc_id)
        SELECT url, bad FROM p JOIN l ON l.doc_id = try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT)""").fetchall()


def brute_rules(known, error=url_rules.ERROR, min_rows=8, widest=url_rules.WIDEST):
    """Rules from (tokens, bad), every combination one by one."""
    n_bad = sum(bad for _, bad in known)
    if not 0 < n_bad < len(known):
        return []
    share = n_bad / len(known)
    single = Counter(t for own, bad in known if bad for t in own)
    single = {t: n for t, n in single.items() if n >= min_rows}
    least = max(min_rows, ceil(log(max(len(single), 1) / error) / -log(share)))
    hits = Counter()
    for own, bad in known:
        if bad:
            kept = sorted((t for t in own if single.get(t, 0) >= least), key=lambda t: (single[t], t))[:widest]
            hits.update(frozenset(c) for k in range(1, len(kept) + 1) for c in combinations(kept, k))
    frequent = [c for c, n in hits.items() if n >= least]
    kl = lambda p, q: (p * log(p / q) if p else 0) + ((1 - p) * log((1 - p) / (1 - q)) if p < 1 else 0)
    rules = []
    for c in frequent:
        having = [bad for own, bad in known if c <= own]
        p = sum(having) / len(having)
        if p >= 0.6 and p > share and len(having) * kl(p, share) >= log(len(frequent) / error):
            rules.append(c)
    return rules


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_verdicts_of_mined_rules_on_the_tables(spark, sf_dir, scale):
    folder = sf_dir.replace("sf0.001", scale)
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("url", url_rules.tokens(F.col("url")).alias("t"))
    tokens = {r.url: frozenset(r.t) for r in pages.collect()}
    rules = brute_rules([(tokens[u], bad) for u, bad in known_urls(folder)])
    judged = QUERIES["op9_url_rules"](spark, folder).join(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url"), "page_id").collect()
    unlisted = [r for r in judged if r.rule is None]
    assert {r.page_id: r.verdict for r in unlisted} == {r.page_id: "block" if any(c <= tokens[r.url] for c in rules) else "allow" for r in unlisted}


def planted(n, seed):
    """URLs of which two hosts, and one path on any host, are mostly bad; a quarter of the others is bad by chance."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host = rng.choice(["free-bets.net", "cheap-pills.biz", *(f"news{k}.com" for k in range(12))])
        path = rng.choice(["warez/get", "a", "b", "c/d", "e"])
        chance = 0.9 if host in ("free-bets.net", "cheap-pills.biz") or path == "warez/get" else 0.1
        out.append((f"https://www.{host}/{path}/{i}?page={i % 3}", rng.random() < chance))
    return out


def test_rules_block_held_out_bad_urls_above_the_base_rate(spark):
    learned, held = planted(1500, 1), planted(700, 2)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id int, url string")
    verdict = {r.page_id: r.verdict for r in url_rules.judge(pages, spark.createDataFrame(learned, "url string, bad boolean"), []).collect()}
    blocked = [bad for i, (_, bad) in enumerate(held) if verdict[i] == "block"]
    base = sum(bad for _, bad in held) / len(held)
    assert sum(blocked) / len(blocked) > 0.8 > 2 * base * 0.9 and sum(blocked) > 0.7 * sum(bad for _, bad in held)


def test_planted_rules_equal_brute_force_and_sql(spark, tmp_path):
    from leafmill.llm import sql
    from leafmill.llm.queries import URL_RULES

    urls = planted(900, 5) + [("http://x.org/es/1", True), (None, True), ("no url", False)]
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id int, url string")
    rows.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, 0 if bad else 1, None) for i, (_, bad) in enumerate(urls)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    found = {r.page_id: tuple(r) for r in QUERIES["op9_url_rules"](spark, str(tmp_path)).collect()}
    tokens = {r.page_id: frozenset(r.t) for r in rows.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    rules = brute_rules([(tokens[i], bad) for i, (_, bad) in enumerate(urls) if tokens[i] and i < 900])
    assert rules and all(found[i][4] == ("block" if any(c <= tokens[i] for c in rules) else "allow") for i in range(900))
    connection = duckdb.connect()
    for table in ("pages", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert sorted(connection.execute(sql.url_rules(URL_RULES)).fetchall()) == sorted(found.values())


def test_many_tokens_stay_bounded(spark):
    query = "&".join(f"k{i}=v" for i in range(40))
    rows = [(f"https://bad.net/x?{query}", True)] * 30 + [(f"https://good{i}.net/y", False) for i in range(90)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean").select(url_rules.tokens(F.col("url")).alias("tokens"), "bad")
    assert 0 < url_rules.mine(labelled).count() < 2**url_rules.WIDEST


def test_rules_of_tokens_beyond_the_rarest_are_found(spark):
    # a, b and c tell nothing but together, and nine rarer tokens of every bad row that has all three hide them from FP-growth
    rare = ["&".join(f"{c}{i}=1" for i in range(url_rules.WIDEST + 1)) for c in "rs"]
    rows = [(f"https://x.net/a/b/c?{r}", True) for r in rare] * 24
    rows += [(f"https://x.net/{p}?n{i}=2", i % 3 == 0) for p in ("a/b", "b/c", "a/c") for i in range(150)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    assert verdicts(spark, ["https://y.org/a/b/c", "https://y.org/a/b", "https://y.org/c", f"https://y.org/?{rare[0]}"], labelled) == ["block", "allow", "allow", "block"]

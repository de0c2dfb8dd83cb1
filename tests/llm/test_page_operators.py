import base64
import hashlib
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from leafmill.llm import url_rules, warc
from leafmill.llm.queries import URL_RULES

PAGES = "page_id bigint, url string, html string"


def test_archive_round_trip(spark, tmp_path):
    long = "<p>é" * 300_000
    rows = [(3, "http://a/1", "same"), (1, "http://a/2 x\n", "same"), (2, None, "other"), (4, "", None), (5, "http://e", ""), (6, "u", long), (None, "n", "alone"), (7, "u", "same")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))
    index = warc.write(pages, str(tmp_path / "w"), file_bytes=1000)
    got = {r.page_id: r for r in warc.read(index).collect()}
    assert len(got) == len(rows)
    for page, url, html in rows:
        raw, r = (html or "").encode(), got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.url == (None if not url else quote(url, safe=":/"))
        if r.record_type == "response":
            assert bytes(r.payload) == raw and r.refers_to is None
    assert {p: (r.record_type, r.refers_to) for p, r in got.items() if p in (1, 3, 7, 4, 5)} == {1: ("response", None), 3: ("revisit", 1), 7: ("revisit", 1), 4: ("response", None), 5: ("revisit", 4)}
    some = warc.read(index.where("page_id in (1, 6)")).collect()
    assert sorted(r.page_id for r in some) == [1, 6]


def test_small_payloads_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough")], PAGES)
    got = {r.page_id: r.refers_to for r in warc.read(warc.write(pages, str(tmp_path / "m"), min_bytes=5)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    assert warc.read(warc.write(pages.limit(0), str(tmp_path / "e"))).count() == 0


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(r), r, v) for v, r in URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *((max(fits)[1], max(fits)[2]) if fits else (None, None)))


URLS = [
    "http://Www.Example.ORG/es/1", "https://example.org/en/15?x=1", "http://example.org/en/2", "http://notexample.org/es/", "http://a.com/fr/9#t", "http://a.com/de/9",
    "http://a.com?b=/fr/", "http://org", "http://org/", "no scheme", "", None, "x://y://z/de/", "http://a.com/de", "http://ÀB.org/\n/x",
]


def test_listed_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id bigint, url string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = url_rules.judge(pages, none, URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = brute_verdict(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_mined_rules_block_like_brute_force(spark):
    bad = [f"http://free-bets.net/en/{i}" for i in range(40)]
    good = [f"http://news{i % 7}.net/en/{i}?page={i % 3}" for i in range(200)]
    labelled = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in good], "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://free-bets.net/de/7"), (2, "http://news1.net/en/8"), (3, None)], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labelled, []).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
    rules = url_rules.mine(labelled.select(url_rules.tokens(F.col("url")).alias("tokens"), "bad")).collect()
    own = labelled.select("url", url_rules.tokens(F.col("url")).alias("t"), "bad").collect()
    for rule in rules[:20]:
        having = [r for r in own if set(rule.antecedent) <= set(r.t)]
        assert rule.confidence == pytest.approx(sum(r.bad for r in having) / len(having))
        assert rule.key in rule.antecedent

import duckdb
import pytest

from leafmill.operators import markup
from leafmill.plans import html_sql
from leafmill.sources import html
from tests.test_html import LOG, SHOP

PAGES = [
    SHOP,
    LOG,
    "",
    None,
    "<p> </p>\n",
    "<head><title>t</title><link rel=x>gone<main>seen</main>",
    "<HEAD><STYLE/>x</HEAD>y",
    "<head><script>var x='</head>'</script><noscript><img></noscript>q<p>w",
    "lead<h1>Q</h1><h4>R</h4>s",
    "x<!-->y<!---> z<div",
    "k<script>never closed <p>q</p>",
    "<style >a</style x>b<script src=a/>c</script>d<script / >e</script>f",
    "<pre>a </pre></pre></pre><p>b</p><pre>c<td>d </td><br>e</td></td>f\r\n  g</pre>",
    "<a title='x>y' b = \"c>d\">t</a> x=\"y>z<p a=='b>c'>u<p a\"b>c\">v",
    "a<p title=\"never closed>b</p>c",
    "a<svg/>b<svg><p>x</svg >c<noscript><script>'</noscript>'</script>d</noscript>e<template><svg></template>f",
    "< p>a<<b>b</b><1> 3 <",
    "<ul><li>a<ul><li>b</ul>c<li>d</ul>e</li>f<li>g</ol>h",
    "&nbsp;a&nbsp;<br>&#10;b &lt;p&gt; &nosuch; &#x41;",
    "x <br> y<br><br>z <td>1</td> <td>2</td><td></td><br>3",
    "a \x85 c\x0bd　e",
]


def rows(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "page_id int, html string").repartition(3)


def test_texts_equal_the_reader_of_single_documents(spark):
    found = {r.page_id: r.text for r in markup.with_text(rows(spark)).collect()}
    assert found == {i: None if p is None else html.html_to_text(p) for i, p in enumerate(PAGES)}


def test_blocks_equal_the_reader_of_single_documents(spark):
    found = {}
    for r in sorted(markup.blocks(rows(spark), "page_id").collect()):
        found.setdefault(r.page_id, []).append((r.block, r.kind, r.text))
    wanted = {i: [(n, *b) for n, b in enumerate(html.text_blocks(p or ""), 1)] for i, p in enumerate(PAGES)}
    assert found == {i: b for i, b in wanted.items() if b}


def test_sql_agrees_on_awkward_markup():
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id INT, html VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?)", [list(x) for x in enumerate(PAGES)])
    found = {r[0]: r[1] for r in connection.execute(html_sql.HTML_TEXT).fetchall()}
    assert found == {i: None if p is None else html.html_to_text(p) for i, p in enumerate(PAGES)}


def test_repeated_rows_clashing_names_and_nothing(spark):
    twice = spark.createDataFrame([(1, "<p>a<p>b", "old", "n"), (1, "<p>a<p>b", "old", "n"), (None, "c", None, None)], "page_id int, html string, text string, nth string")
    found = markup.with_text(twice)
    assert found.columns == ["page_id", "nth", "text"]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [(1, "n", "a\n\nb\n\n")] * 2 + [(None, None, "c\n\n")]))
    assert [tuple(r) for r in markup.blocks(twice.where("page_id = 1"), "page_id").orderBy("block").collect()] == [(1, 1, "p", "a")] * 2 + [(1, 2, "p", "b")] * 2
    assert markup.with_text(twice.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["a ", "<b>x</b>", "<", "<li>i", "<!-- c -->", "<p a='1'>"])
def test_long_pages(spark, unit):
    page = unit * (400_000 // len(unit))
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert markup.with_text(df).first().text == html.html_to_text(page)


def test_no_python_runs(spark):
    plan = markup.with_text(rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan.replace("ArrowEval", "Arrow") and plan.count("Exchange hashpartitioning") == 1

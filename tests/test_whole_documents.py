"""Documents that lie whole in a task take no rounds, and larger ones give the same."""

import random

from leafmill.operators import graphs, local_graphs


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def sample():
    rng = random.Random(5)
    links = [(1, i, 0, i + 1) for i in range(1, 9)] + [(1, 9, 0, 4), (1, None, 0, 3), (None, 1, 0, 2), (1, 2, 3, None), (1, 3, 3, 999)]
    links += [(d, rng.randint(1, 12), 1, rng.randint(1, 14)) for d in (2, 3, 4) for _ in range(5 * d)] + [(2, 1, 0, 7), (2, 1, 0, 7)]
    objects = [(1, i) for i in range(1, 12)] + [(d, i) for d in (2, 3, 4) for i in range(1, 12)] + [(None, 2)]
    roots = [(1, 1), (2, 1), (2, 5), (3, 2), (4, 9), (4, 9), (5, 6), (None, 1)]
    tree = [(1, i, i - 1 if i else None, "top" if i == 0 else "mid" if i == 7 else None) for i in range(20)]
    tree += [(2, 1, 2, None), (2, 2, 1, None), (2, 3, 77, None), (2, 4, 4, "own"), (3, 1, None, ""), (3, 2, 1, "b"), (None, 2, None, "x"), (None, 3, 2, None), (3, None, 2, "c")]
    return objects, links, roots, tree


def results(spark, whole):
    objects, links, roots, tree = sample()
    objects, roots = (table(spark, rows, "doc bigint, object bigint") for rows in (objects, roots))
    links = table(spark, links, "doc bigint, object bigint, place int, ref bigint")
    kept, references = graphs.pruned(objects, links, roots, whole=whole)
    return [
        sorted(map(repr, (tuple(r) for r in rows.collect())))
        for rows in (
            graphs.reachable(links, roots, whole=whole),
            graphs.reachable(links, roots, objects=objects, whole=whole),
            graphs.page_objects(objects, links, roots, whole=whole),
            kept,
            references,
            graphs.inherited(table(spark, tree, "doc bigint, node bigint, parent bigint, value string"), whole=whole),
            graphs.full_names(table(spark, tree, "doc bigint, node bigint, parent bigint, name string"), whole=whole),
        )
    ]


def test_small_and_large_documents_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(local_graphs, "BLOCK", 15)
    near = results(spark, graphs.WHOLE)
    assert all(near)
    assert results(spark, 18) == near  # the larger documents go frontier by frontier


def test_small_documents_take_one_shuffle_and_no_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graphs, "written", lambda rows, name: made.append(name))
    links = table(spark, [(1, i, 0, i + 1) for i in range(300)], "doc bigint, object bigint, place int, ref bigint")
    found = graphs.reachable(links, table(spark, [(1, 0)], "doc bigint, object bigint"))
    assert found.count() == 301
    nodes = table(spark, [(1, i, i - 1 if i else None, "n") for i in range(300)], "doc bigint, node bigint, parent bigint, name string")
    assert graphs.full_names(nodes).where("depth = 32").count() == 1
    assert graphs.inherited(nodes.withColumnRenamed("name", "value")).where("levels = 0").count() == 300
    assert not made


def test_keys_of_text(spark):
    links = table(spark, [("a", "x", "y"), ("a", "y", "é"), ("b", "x", "z")], "doc string, object string, ref string")
    roots = table(spark, [("a", "x"), ("b", "x")], "doc string, object string")
    assert sorted(tuple(r) for r in graphs.reachable(links, roots).collect()) == [("a", "x"), ("a", "y"), ("a", "é"), ("b", "x"), ("b", "z")]

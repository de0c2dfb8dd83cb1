import random

from leafmill.operators import graphs


def edges(spark, rows):
    return spark.createDataFrame(rows, "doc bigint, object bigint, place int, ref bigint")


def nodes(spark, rows, kind):
    return spark.createDataFrame(rows, f"doc bigint, node bigint, parent bigint, {kind} string")


def test_loops_shares_long_ways_and_nulls(spark):
    rng = random.Random(3)
    links = [(1, i, 0, i + 1) for i in range(1, 30)] + [(1, 30, 0, 5), (1, 4, 1, 4), (1, None, 0, 3), (None, 1, 0, 2), (1, 2, 3, None), (1, 50, 0, 51), (1, 3, 3, 99)]
    links += [(2, rng.randint(1, 60), 0, rng.randint(1, 60)) for _ in range(70)] + [(2, 1, 0, 7), (2, 1, 0, 7)]
    roots = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 9)], "doc bigint, object bigint")
    wanted = set()
    for doc, start in ((1, 1), (2, 1), (3, 9)):
        stack = [start]
        while stack:
            at = stack.pop()
            if (doc, at) not in wanted:
                wanted.add((doc, at))
                stack += [r for d, o, _, r in links if d == doc and o == at and r is not None]
    for hops in (3, 8):
        found = [tuple(r) for r in graphs.reachable(edges(spark, links), roots, hops=hops).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted


def test_pruning_numbers_densely_and_drops_dead_references(spark):
    objects = spark.createDataFrame([(1, i) for i in (3, 10, 12, 40, 41)], "doc bigint, object bigint")
    links = edges(spark, [(1, 10, 0, 40), (1, 10, 1, 12), (1, 40, 0, 10), (1, 12, 0, 77), (1, 41, 0, 3)])
    kept, references = graphs.pruned(objects, links, spark.createDataFrame([(1, 10)], "doc bigint, object bigint"))
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 10, 1), (1, 12, 2), (1, 40, 3)]
    assert sorted(map(repr, (tuple(r) for r in references.collect()))) == sorted(map(repr, [(1, 1, 0, 3), (1, 1, 1, 2), (1, 3, 0, 1), (1, 2, 0, None)]))


def test_a_page_does_not_pull_in_other_pages(spark):
    objects = spark.createDataFrame([(1, i) for i in range(1, 8)], "doc bigint, object bigint")
    links = edges(spark, [(1, 1, 0, 3), (1, 3, 0, 2), (1, 2, 0, 4), (1, 4, 0, 5), (1, 3, 1, 5), (1, 5, 0, 1), (1, 6, 0, 7)])
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc bigint, object bigint")
    assert sorted(tuple(r) for r in graphs.page_objects(objects, links, pages).collect()) == [(1, 1, 1), (1, 1, 3), (1, 1, 5), (2, 1, 2), (2, 1, 4), (2, 1, 5)]


def test_attributes_come_from_the_nearest_ancestor_within_the_limit(spark):
    chain = [(1, i, i - 1 if i else None, "top" if i == 0 else "mid" if i == 7 else None) for i in range(150)]
    loop = [(2, 1, 2, None), (2, 2, 1, None), (2, 3, 77, None), (2, 4, 4, "own")]
    found = {(r.doc, r.node): (r.value, r.levels) for r in graphs.inherited(nodes(spark, chain + loop, "value")).collect()}
    assert [found[1, i] for i in (0, 6, 7, 8, 107, 108)] == [("top", 0), ("top", 6), ("mid", 0), ("mid", 1), ("mid", 100), (None, None)]
    assert [found[2, i] for i in (1, 2, 3, 4)] == [(None, None)] * 3 + [("own", 0)]
    assert len(found) == len(chain + loop)


def test_names_of_trees_and_loops(spark):
    chain = [(1, i, i - 1 if i else None, f"n{i}" if i % 3 else None) for i in range(40)]
    loop = [(2, 1, 2, "a"), (2, 2, 1, "b"), (2, 3, 9, "c"), (2, 4, None, None), (2, 5, 4, "")]
    found = {(r.doc, r.node): (r.full, r.depth) for r in graphs.full_names(nodes(spark, chain + loop, "name")).collect()}
    for i in range(40):
        assert found[1, i] == ((".".join(f"n{k}" for k in range(i + 1) if k % 3) or None, i + 1) if i < 32 else (None, None))
    assert [found[2, i] for i in range(1, 6)] == [(None, None), (None, None), ("c", 1), (None, 1), (None, 2)]


def test_nothing(spark):
    assert graphs.reachable(edges(spark, []), spark.createDataFrame([], "doc bigint, object bigint")).count() == 0
    assert graphs.inherited(nodes(spark, [], "value")).count() == 0
    assert graphs.full_names(nodes(spark, [], "name")).count() == 0

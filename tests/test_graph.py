"""Search, order of discovery and addresses against a queue and sets."""

import random
from collections import deque

import pytest

from quillbase.operators import graph


def queue_and_set(links, root):
    """The order in which targets are met, and the address of each, one after the other."""
    of = {}
    for src, pos, dst, slug in sorted(links, key=lambda x: (x[0], x[1], x[2])):
        of.setdefault(src, []).append((dst, slug))
    found, slugs, used, queue, depth = [], {}, set(), deque([root]), {}
    while queue:
        node = queue.popleft()
        for dst, slug in of.get(node, []):
            if dst not in slugs:
                name, i = slug, 2
                while name in used:
                    name, i = f"{slug}-{i}", i + 1
                used.add(name)
                slugs[dst], depth[dst] = name, depth.get(node, 0) + 1
                found.append(dst)
                queue.append(dst)
    return found, slugs


def run(spark, links, root):
    found = graph.discover(spark.createDataFrame(links, "src long, pos long, dst long, slug string"), root)
    return [r.node for r in found.orderBy("rank").collect()], {r.node: r.slug for r in graph.assign_slugs(found).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_queue_on_random_graphs(spark, seed, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 1 + seed)  # blocks carry on from one to the next
    rng = random.Random(seed)
    names = ["a", "a", "a-2", "a-2", "a-2-2", "a-3", "a-02", "b", "b-1", "b-2", "a-2-3", "a-4", "c-7"]
    links = [(s, p, rng.randrange(45), rng.choice(names)) for s in range(30) for p in range(rng.randrange(4))]
    assert run(spark, links, 0) == queue_and_set(links, 0)


def test_order_of_the_queue(spark):
    links = [(0, 0, 9, "x"), (0, 1, 3, "y"), (9, 0, 50, "same"), (3, 0, 60, "same"), (50, 0, 0, "home")]
    found, slugs = run(spark, links, 0)
    assert found == [9, 3, 50, 60, 0] and slugs == {9: "x", 3: "y", 50: "same", 60: "same-2", 0: "home"}


def test_reserved_names(spark):
    links = [(0, i, i + 1, s) for i, s in enumerate(["a", "a", "a-2", "a-2", "a", "a-5", "a-3", "a", "a-2-2", "a"])]
    found, slugs = run(spark, links, 0)
    assert (found, slugs) == queue_and_set(links, 0)
    assert slugs[2] == "a-2" and slugs[3] == "a-2-2" and len(set(slugs.values())) == len(slugs)


def test_nulls_and_nothing(spark):
    links = spark.createDataFrame([(0, 0, None, "x"), (None, 0, 1, "x"), (0, 1, 2, None), (5, 0, 6, "z"), (0, None, 8, "q"), (0, None, 7, "q")], "src long, pos long, dst long, slug string")
    found = graph.discover(links, 0)
    assert [(r.node, r["rank"], r.depth, r.slug) for r in found.orderBy("rank").collect()] == [(2, 0, 1, None), (7, 1, 1, "q"), (8, 2, 1, "q")]
    assert {r.node: r.slug for r in graph.assign_slugs(found).collect()} == {7: "q", 8: "q-2"}
    assert graph.discover(links.limit(0), 0).count() == 0
    assert [tuple(r) for r in graph.reach(links, 0).orderBy("depth", "node").collect()] == [(0, 0), (2, 1), (7, 1), (8, 1)]


def test_reach(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "r"), ("b", "c"), ("c", "a"), ("x", "y"), ("r", "a")], "src string, dst string")
    assert {r.node: r.depth for r in graph.reach(edges, "r").collect()} == {"r": 0, "a": 1, "b": 1, "c": 2}

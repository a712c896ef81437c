import os
import random
from collections import defaultdict, deque

import pytest

from notewright.operators import ancestry
from notewright.runtime import Scratch


def _brute(links, nodes):
    up = defaultdict(set)
    for c, p in links:
        up[c].add(p)
    roots, out, pairs = {n for n in nodes if not up[n]}, set(), set()
    seen = {}
    for n in nodes:
        d, queue, circle = {n: 0}, deque([n]), False
        while queue:
            x = queue.popleft()
            for y in up[x]:
                circle |= y == n
                if y not in d:
                    d[y] = d[x] + 1
                    queue.append(y)
        seen[n] = (d, circle)
    for n, (d, circle) in seen.items():
        reached = {r: d[r] for r in roots if r in d}
        out |= {(n, "CYCLE", -1)} if circle else {(n, r, k) for r, k in reached.items()} or {(n, "NONE", -1)}
        pairs |= {(a, n, k) for a, k in d.items() if a != n and not circle and not seen[a][1]}
    return out, pairs


def _graph(seed):
    rng = random.Random(seed)
    n = 60
    links = {(f"n{c}", f"n{rng.randrange(c)}") for c in range(1, n) if rng.random() < 0.9} | {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(12)}
    links |= {("s", "s"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")}  # a loop, a circle, and a node that only reaches it
    links |= {(f"deep{k}", f"deep{k + 1}") for k in range(40)}
    nodes = {x for link in links for x in link} | {"alone"}
    return links, nodes


@pytest.mark.parametrize("seed,spacing", [(1, 1), (2, 4), (3, 1000)])
def test_equals_brute_force(spark, seed, spacing):
    links, nodes = _graph(seed)
    a = ancestry.build(spark, spark.createDataFrame(list(links), "child string, parent string"), spark.createDataFrame([(n,) for n in nodes], "node string"), with_paths=True, spacing=spacing)
    want, pairs = _brute(links, nodes)
    rows = ancestry.roots_of(a).collect()
    assert {(r.node, r.root, r.d) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        if r.d >= 0:
            assert r.path[0] == r.node and r.path[-1] == r.root and len(r.path) == r.d + 1
            assert all(link in links for link in zip(r.path, r.path[1:]))
        else:
            assert r.path is None
    got = ancestry.descendants_of(a).collect()
    assert {(r.node, r.descendant, r.d) for r in got} == pairs and len(got) == len(pairs)


def test_dirty_links_and_empty_tables(spark):
    df = spark.createDataFrame([(" A  Co ", "B Co", 1), ("a co", "b CO", 1), ("C", None, 1), (None, "D", 1), (" ", "", 1), ("E", " ", 1)], "child string, parent string, node int")
    links, nodes = ancestry.company_links(df)
    a = ancestry.build(spark, links, nodes)
    assert sorted((r.node, r.root, r.d) for r in ancestry.roots_of(a).collect()) == [("a co", "b co", 1), ("b co", "b co", 0), ("c", "c", 0), ("d", "d", 0), ("e", "e", 0)]
    a = ancestry.build(spark, links.limit(0), nodes.limit(0), with_paths=True)
    assert ancestry.roots_of(a).count() == 0 and ancestry.descendants_of(a).count() == 0


def test_id_notations(spark):
    rows = [("http://x.example/obo/MONDO_0000007", " IS_A", "MONDO:0000008"), ("https://x.example/obo/mondo_0000007", "is_a", "MONDO_0000008"), ("MONDO:0000009", "part_of", "MONDO:0000007"), ("MONDO:0000009", None, "MONDO:0000007")]
    links, _ = ancestry.disease_links(spark.createDataFrame(rows, "sub string, pred string, obj string"))
    assert [tuple(r) for r in links.collect()] == [("MONDO:0000007", "MONDO:0000008")]


def _jobs(spark, depth, folder):
    """How many tables are written for one chain, and what is left of them."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Scratch, "__init__", lambda self, spark: _at(self, spark, folder))
        df = spark.createDataFrame([(f"n{k:05d}", f"n{k + 1:05d}") for k in range(depth)], "child string, parent string")
        a = ancestry.build(spark, df, df.selectExpr("explode(array(child, parent)) as node").distinct())
        rows = a.finish(ancestry.roots_of(a))
        assert rows.where("node = 'n00000'").first().d == depth
        left = [os.path.join(f, d) for f, ds, _ in os.walk(folder) for d in ds if d.isdigit()]
        return a.scratch._n, left


def _at(scratch, spark, folder):
    scratch.spark, scratch.root, scratch._live, scratch._n = spark, f"file://{folder}", set(), 0


def test_jobs_grow_with_the_logarithm_of_the_depth_and_nothing_is_left(spark, tmp_path):
    few, left = _jobs(spark, 120, str(tmp_path / "a"))
    many, more_left = _jobs(spark, 480, str(tmp_path / "b"))
    assert many - few <= 12 and len(left) == len(more_left) == 1

"""Searches, orders, sums and cuts of forests against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridlake.operators import forest as tree
from gridlake.session import materialise


def brute_search(edges, seeds):
    """node -> (source, hops, parent, via); level by level, the least (ord, parent, edge) wins."""
    near = defaultdict(list)
    for e, u, v in edges:
        near[u].append((v, e))
        near[v].append((u, e))
    found = {}
    for n, source, order in sorted(seeds, key=lambda s: (s[0], s[2], s[1])):
        found.setdefault(n, (source, 0, None, None, order))
    level, hop = list(found), 0
    while level:
        hop += 1
        best = {}
        for a in level:
            for b, e in near[a]:
                if b not in found:
                    key = (found[a][4], a, e)
                    if b not in best or key < best[b][0]:
                        best[b] = (key, found[a][0])
        for b, ((order, a, e), source) in best.items():
            found[b] = (source, hop, a, e, order)
        level = list(best)
    return {n: r[:4] for n, r in found.items()}


def frames(spark, edges, seeds):
    return (
        spark.createDataFrame(edges, "edge_id string, src string, dst string"),
        spark.createDataFrame(seeds, "node string, source string, ord string"),
    )


def searched(spark, edges, seeds, shallow):
    return {r.node: (r.source, r.hops, r.parent, r.via) for r in tree.breadth_first(*frames(spark, edges, seeds), shallow=shallow).collect()}


def mesh(rng, n, extra):
    """A random tree with long arms, closed by some more edges, repeats and loops, beside a ring without a source."""
    name = [f"n{i:03d}" for i in range(n)]
    rng.shuffle(name)
    pairs = [(name[i], name[i - 1 if rng.random() < 0.7 else rng.randrange(i)]) for i in range(1, n)]
    pairs += [tuple(rng.sample(name, 2)) for _ in range(extra)]
    pairs += [pairs[3], (name[0], name[0])] + [(f"z{i}", f"z{(i + 1) % 5}") for i in range(5)] + [("z9", "z0"), ("y0", "y1")]
    return name, [(f"e{i:03d}", *p) for i, p in enumerate(pairs)]


@pytest.mark.parametrize(("seed", "extra", "shallow"), [(2, 2, 0), (3, 9, 2)])
def test_search(spark, seed, extra, shallow):
    rng = random.Random(seed)
    name, edges = mesh(rng, 70, extra)
    seeds = [(n, f"s{i}", f"{i % 2}") for i, n in enumerate(rng.sample(name, 1 + seed % 3))]
    assert searched(spark, edges, seeds, shallow) == brute_search(edges, seeds)


def test_deep_chain_and_closed_loop(spark, monkeypatch):
    """2,000 nodes in a row with spurs, and a ring of 600 that two sources feed."""
    rng = random.Random(9)
    order = [f"c{i:04d}" for i in range(2000)]
    rng.shuffle(order)
    edges = [(f"k{i}", order[i], order[i + 1]) for i in range(1999)] + [(f"s{i}", order[i * 40], f"spur{i}") for i in range(50)]
    edges += [(f"r{i}", f"r{i:03d}", f"r{(i + 1) % 600:03d}") for i in range(600)]
    seeds = [(order[0], "A", "0A"), ("r000", "B", "0B"), ("r211", "C", "0C")]
    written = []
    monkeypatch.setattr(tree, "materialise", lambda df, tag: written.append(tag) or materialise(df, tag))
    got = searched(spark, edges, seeds, tree.SHALLOW)
    want = brute_search(edges, seeds)
    assert got == want and max(h for _, h, *_ in got.values()) >= 1999
    assert len(written) < 40  # level by level there was one table per two hops
    deep = materialise(tree.breadth_first(*frames(spark, edges, seeds)), "forest")
    ranks = tree.subtree_order(deep)
    ones = ranks.select("node", F.lit(1).alias("n"))
    size = {r.node: r.n for r in tree.subtree_sums(ranks, ones, ["n"]).collect()}
    assert size[order[0]] == 2050 and size[order[1990]] == 10


@pytest.mark.parametrize(("seed", "extra"), [(1, 0), (3, 8)])
def test_order_sums_ancestors_and_cuts(spark, seed, extra):
    rng = random.Random(seed)
    name, edges = mesh(rng, 45, extra)
    roots = rng.sample(name, 2)
    seeds = [(n, n, n) for n in roots]
    frame, start = frames(spark, edges, seeds)
    forest = materialise(tree.breadth_first(frame, start), "forest")
    parent = {r.node: r.parent for r in forest.collect()}
    above = {}
    for n in parent:
        path, at = [], n
        while parent[at] is not None:
            path.append((parent[at], at))
            at = parent[at]
        above[n] = path
    below = defaultdict(set)
    for n, path in above.items():
        below[n].add(n)
        for a, _ in path:
            below[a].add(n)

    order = tree.subtree_order(forest)
    rows = {r.node: r for r in order.collect()}
    for n, r in rows.items():
        assert {m for m, o in rows.items() if o.root == r.root and r.low < o.high <= r.high} == below[n]
    value = {n: (rng.randint(0, 9), rng.random(), rng.choice("xyz")) for n in parent}
    values = spark.createDataFrame([(n, *v) for n, v in value.items()], "node string, n long, x double, r string")
    for r in tree.subtree_sums(order, values, ["n", "x"]).collect():
        assert r.n == sum(value[m][0] for m in below[r.node]) and abs(r.x - sum(value[m][1] for m in below[r.node])) < 1e-3
    for r in tree.subtree_sums(order, values, ["n"], wanted=values.where("n > 4"), by="r").collect():
        assert value[r.node][0] > 4 and r.n == sum(value[m][0] for m in below[r.node] if value[m][2] == r.r)

    jumps = tree.jump_tables(forest)
    got = defaultdict(list)
    for r in tree.ancestors_of(forest, jumps).orderBy("dist").collect():
        got[r.node].append((r.anc, r.branch))
    assert got == {n: p for n, p in above.items() if p}

    def supplied(drop_node=None, drop_edge=None):
        kept = [e for e in edges if drop_node not in e[1:] and e[0] != drop_edge]
        return set(brute_search(kept, [s for s in seeds if s[0] != drop_node]))

    cuts = tree.Cuts(frame, forest, order, jumps)
    lost, pieces = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for r in cuts.branches.collect():
        lost[r.cut] |= below[r.branch]
        pieces[r.cut][r.piece] |= below[r.branch]
    for z in parent:
        gone = set(parent) - supplied(drop_node=z) - {z}
        assert lost[z] == gone, z
        inside = [e for e in edges if e[1] in gone and e[2] in gone]
        labels = {n: frozenset(brute_search(inside, [(n, n, n)])) for n in gone}
        assert set(labels.values()) == {frozenset(p) for p in pieces[z].values()}
    bridges = {(r.edge_id): below[r.branch] for r in cuts.bridges.collect()}
    for e, u, v in edges:
        if u in parent:
            assert bridges.get(e, set()) == set(parent) - supplied(drop_edge=e), e


def test_nothing_to_search(spark):
    frame, start = frames(spark, [], [])
    forest = materialise(tree.breadth_first(frame, start), "forest")
    order = tree.subtree_order(forest)
    assert forest.count() == 0 and order.count() == 0 and tree.jump_tables(forest) == []
    assert tree.Cuts(frame, forest, order, []).branches.count() == 0
    frame, start = frames(spark, [("e", "a", "b")], [("q", "q", "q")])
    assert {r.node for r in tree.breadth_first(frame, start).collect()} == {"q"}

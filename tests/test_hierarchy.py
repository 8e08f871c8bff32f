import random

import pytest

from lexoria.operators.components import connected_components
from lexoria.operators.hierarchy import descendants, hierarchy

SCHEMA = "space string, node long, parent long, scope long, crumb string, version long, depth string"


def brute(rows):
    last = {}
    for s, n, p, c, crumb, v, _ in rows:
        if n is not None and s is not None and ((s, n) not in last or (v or -1) >= last[s, n][2]):
            last[s, n] = (p, c, v or -1)
    up = {}
    for (s, n), (p, c, _) in last.items():
        up[s, n] = (s, p) if p and (s, p) in last and last[s, p][1] == c else None
    out = {}
    for k in up:
        chain, at = [], k
        while at is not None and at not in chain:
            chain.append(at)
            at = up[at]
        out[k] = (0, "") if at is not None else (chain[-1][1], "/".join(str(x[1]) for x in reversed(chain)))
    return out


def forest(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(1, n):
        kind = r.random()
        p = i - 1 if kind < 0.4 else 1 if kind < 0.6 else r.choice([None, 0, i, 9999]) if kind < 0.7 else r.randrange(1, n)
        rows.append((r.choice(["x", "y"]), i, p, None if r.random() < 0.02 else i // 40, "1. 2.", 7, "clash"))
    return rows + r.sample(rows, n // 5) + [("x", None, 1, 0, None, None, None), (None, 3, 1, 0, None, None, None)]


@pytest.mark.parametrize("big", [100_000, 3])
def test_against_brute_force(spark, big):
    rows = forest(150, big)
    got = {(x.space, x.node): x for x in hierarchy(spark.createDataFrame(rows, SCHEMA), big).collect()}
    want = brute(rows)
    assert {k: (x.root, x.path) for k, x in got.items()} == want
    for (s, n), x in got.items():
        if x.root:
            assert x.depth == x.path.count("/") + 1
            assert x.descendants == sum(1 for (s2, _), (_, p) in want.items() if s2 == s and str(n) in p.split("/")) - 1
    assert any(not x.root for x in got.values())


@pytest.mark.parametrize("big", [100_000, 2])
def test_cycles_and_long_chains(spark, big):
    rows = [("t", i, i + 1 if i < 300 else None, None, None, None, None) for i in range(1, 301)]
    rows += [("c", 5, 6, 0, None, 1, None), ("c", 6, 7, 0, None, 1, None), ("c", 7, 5, 0, None, 1, None), ("c", 9, 7, 0, None, 1, None), ("c", 4, 4, 0, None, 1, None)]
    tree = hierarchy(spark.createDataFrame(rows, SCHEMA), big)
    got = {(x.space, x.node): x for x in tree.collect()}
    assert got["t", 1].depth == 300 and got["t", 1].root == 300 and got["t", 300].descendants == 299
    assert {n for (s, n), x in got.items() if x.on_cycle} == {4, 5, 6, 7}
    assert {n for (s, n), x in got.items() if x.back_edge} == {4, 5}
    assert descendants(tree).where("space = 't'").count() == 300 * 299 // 2


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500, k) for k in range(501, 560)]
    links += [(k, k + 1) for k in range(1000, 1040)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

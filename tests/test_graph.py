"""Levels, roles and reachability, with and without cycles."""

import random
from pathlib import Path

from tidemark.operators import graph
from tidemark.session import shared_root


def make(spark, pairs, extra=()):
    edges = spark.createDataFrame([(a, b, "JOIN", "f") for a, b in pairs] or [], "source string, target string, transformation string, file string")
    nodes = spark.createDataFrame(sorted({(n,) for p in pairs for n in p} | {(n,) for n in extra}), "id string")
    return nodes, edges


def levels(spark, pairs, extra=()):
    return {r["id"]: r["level"] for r in graph.levels(*make(spark, pairs, extra)).collect()}


def test_longest_path(spark):
    found = levels(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "d")], extra=["z"])
    assert found == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "z": 0}


def test_cycles_count_as_one_node(spark):
    assert levels(spark, [("a", "b"), ("b", "a")]) == {"a": 0, "b": 0}
    assert levels(spark, [("a", "b"), ("b", "c"), ("c", "b")]) == {"a": 0, "b": 1, "c": 1}
    chain = [("r", "x"), ("x", "y"), ("y", "z"), ("z", "a"), ("r", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e")]
    assert levels(spark, chain) == {"r": 0, "x": 1, "y": 2, "z": 3, "a": 4, "b": 4, "c": 5, "d": 6, "e": 7}


def test_random_graphs_with_cycles(spark):
    """By definition: nodes that reach each other are one, and paths between them are listed."""
    rng = random.Random(6)
    for size, count in ((12, 16), (30, 40)):
        pairs = list({(f"n{rng.randrange(size):02}", f"n{rng.randrange(size):02}") for _ in range(count)})
        ids = sorted({n for p in pairs for n in p})
        behind = {n: {n} for n in ids}
        for _ in ids:
            for a, b in pairs:
                behind[a] |= behind[b]
        group = {n: min(m for m in ids if m in behind[n] and n in behind[m]) for n in ids}
        level = dict.fromkeys(group.values(), 0)
        for _ in ids:
            for a, b in pairs:
                if group[a] != group[b]:
                    level[group[b]] = max(level[group[b]], level[group[a]] + 1)
        assert levels(spark, pairs) == {n: level[group[n]] for n in ids}


def test_random_graphs_without_cycles(spark):
    rng = random.Random(2)
    pairs = list({(f"n{a}", f"n{b}") for a, b in (sorted(rng.sample(range(40), 2)) for _ in range(70))})
    expected = {f"n{i}": 0 for i in range(40) if any(f"n{i}" in p for p in pairs)}
    for _ in range(40):
        for a, b in pairs:
            expected[b] = max(expected[b], expected[a] + 1)
    assert levels(spark, pairs) == expected


def test_a_long_chain_writes_every_edge_once(spark, tmp_path):
    """Thirty layers, each with one edge to the end: rows written stay in proportion to the edges."""
    pairs = [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [(f"c{i:02}", "end") for i in range(30)]
    before = set(Path(shared_root(spark)).rglob("level-*"))
    assert levels(spark, pairs)["end"] == 30
    written = [p for p in Path(shared_root(spark)).rglob("level-*") if p not in before and p.is_dir()]
    rows = sum(spark.read.option("recursiveFileLookup", "true").parquet(str(p)).count() for p in written)
    assert rows < 4 * len(pairs)


def test_a_long_cycle_takes_few_rounds(spark):
    """Rounds grow with the logarithm of the cycle, in whichever order its nodes are named."""
    rng = random.Random(8)
    names = [f"n{i:04}" for i in range(2_000)]
    rng.shuffle(names)
    pairs = [*zip(names, names[1:] + names[:1]), (names[5], names[3]), (names[700], "out"), ("in", names[9])]
    folders = lambda: {p.parent for p in Path(shared_root(spark)).rglob("_SUCCESS")}
    before = folders()
    found = levels(spark, pairs)
    assert {found[n] for n in names} == {1} and found["in"] == 0 and found["out"] == 2
    assert len(folders() - before) < 60, len(folders() - before)


def test_level_sizes(spark):
    levelled = graph.levels(*make(spark, [("a", "c"), ("b", "c"), ("c", "d")]))
    assert {r["level"]: r["nodes"] for r in graph.level_sizes(levelled).collect()} == {0: 2, 1: 1, 2: 1}
    assert graph.largest_level(levelled).first()["largest"] == 2


def test_roles_and_neighbours(spark):
    nodes, edges = make(spark, [("a", "b"), ("b", "c"), ("a", "c")], extra=["z"])
    roles = {r["id"]: (r["role"], r["in_degree"]) for r in graph.node_roles(nodes, edges).collect()}
    assert roles == {"a": ("source", 0), "b": ("intermediate", 1), "c": ("sink", 2), "z": ("source", 0)}
    near = {(r["id"], r["direction"], r["neighbour"]) for r in graph.neighbours(nodes, edges).collect()}
    assert {n for n in near if n[0] in "bz"} == {("b", "upstream", "a"), ("b", "downstream", "c"), ("z", "isolated", None)}
    assert graph.graph_size(nodes, edges).first()[:] == (4, 3)


def test_pairs_by_labels(spark):
    rng = random.Random(9)
    pairs = list({(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(60)})
    nodes, edges = make(spark, pairs, extra=["alone"])
    ids = sorted({n for p in pairs for n in p}) + ["alone", "unknown"]
    behind = {n: {b for a, b in pairs if a == n} for n in ids}
    for _ in ids:
        for n in ids:
            behind[n] |= {m for b in behind[n] for m in behind[b]}
    found = graph.Reachability.build(nodes, edges)
    asked = spark.createDataFrame([(a, b) for a in ids for b in ids], "source string, target string")
    assert {(r["source"], r["target"]): r["reaches"] for r in found.depends(asked).collect()} == {(a, b): b in behind[a] for a in ids for b in ids}
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(25)]
    assert graph.Reachability.build(*make(spark, chain)).labels.count() == 25  # one per node, not one per pair


def test_reach_ends_on_cycles(spark):
    _, edges = make(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("x", "c")])
    start = spark.createDataFrame([("c",)], "id string")
    found = {r["id"]: r["steps"] for r in graph.reach(edges, start, "upstream").collect()}
    assert found == {"b": 1, "x": 1, "a": 2}
    start = spark.createDataFrame([("a",), ("x",)], "id string")
    found = {(r["start"], r["id"]): r["steps"] for r in graph.reach(edges, start, "downstream").collect()}
    assert found == {("a", "b"): 1, ("a", "c"): 2, ("x", "c"): 1}
    assert graph.reach(edges, start.limit(0)).count() == 0

"""Colour classes and semi-synchronous label propagation against plain loops over each graph."""

import random
from collections import Counter

import pytest

from sparkloom.operators import communities

K = ["sample_id"]
NODE, EDGE = "sample_id string, node_id string, node_seq long", "sample_id string, src string, dst string"


def graphs() -> dict[str, tuple[list[str], list[tuple[str, str]]]]:
    rng = random.Random(5)
    ids = [f"n{i}" for i in rng.sample(range(100), 24)]
    out = {
        "path": (ids[:9], list(zip(ids[:8], ids[1:9]))),
        "even ring": (ids[:8], list(zip(ids[:8], ids[1:8] + ids[:1]))),
        "odd ring": (ids[:7], list(zip(ids[:7], ids[1:7] + ids[:1]))),
        "star": (ids, [(ids[0], x) for x in ids[1:]]),
        "clique": (ids[:6], [(a, b) for a in ids[:6] for b in ids[:6] if a != b]),
        "two triangles": (ids[:7], [(ids[a], ids[b]) for a, b in ((0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3))]),
        "alone": (ids[:3], []),
        "loops, repeats, strangers": (ids[:4], [(ids[0], ids[0]), (ids[0], ids[1]), (ids[1], ids[0]), (ids[0], ids[1]), (ids[2], "stranger")]),
    }
    for i in range(6):
        out[f"random {i}"] = (ids, [tuple(rng.sample(ids, 2)) for _ in range(12 + 9 * i)])
    return out


def plain(ids, edges, rounds=None):
    near = {x: set() for x in ids}
    for a, b in edges:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    colour = {}
    for x in sorted(ids, key=lambda x: (-len(near[x]), ids.index(x))):
        used = {colour.get(y) for y in near[x]}
        colour[x] = next(c for c in range(len(ids)) if c not in used)
    label = {x: i for i, x in enumerate(ids)}
    while rounds != 0:
        before = dict(label)
        for x in sorted(ids, key=colour.get):
            votes = Counter(label[y] for y in near[x])
            best = {v for v, n in votes.items() if n == max(votes.values())}
            if best and label[x] not in best:
                label[x] = max(best)
        rounds = None if rounds is None else rounds - 1
        if label == before:
            break
    return colour, {x: ids[v] for x, v in label.items()}


@pytest.fixture(scope="module")
def tables(spark):
    nodes = [(g, x, i) for g, (ids, _) in graphs().items() for i, x in enumerate(ids)]
    edges = [(g, *e) for g, (_, some) in graphs().items() for e in some]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def by_graph(df, value):
    out = {}
    for r in df.collect():
        assert out.setdefault(r["sample_id"], {}).setdefault(r["node_id"], r[value]) == r[value]
    return out


def test_colours_of_the_greedy_walk(tables):
    assert by_graph(communities.colour_classes(*tables, K), "colour") == {g: plain(*some)[0] for g, some in graphs().items()}


@pytest.mark.parametrize("rounds", [0, 1, None])
def test_labels(tables, rounds):
    assert by_graph(communities.semi_synchronous(*tables, K, rounds), "label") == {g: plain(*some, rounds)[1] for g, some in graphs().items()}


def test_empty_tables_and_further_columns(spark, tables):
    none, no_edge = spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)
    assert communities.colour_classes(none, no_edge, K).count() == communities.semi_synchronous(none, no_edge, K).count() == 0
    nodes, edges = (t.where("sample_id = 'two triangles'") for t in tables)
    wide = nodes.selectExpr("*", "7 AS colour", "'x' AS label", "1 AS other"), edges.selectExpr("*", "'x' AS node_id", "2 AS weight")
    assert by_graph(communities.semi_synchronous(*wide, K), "label")["two triangles"] == plain(*graphs()["two triangles"])[1]

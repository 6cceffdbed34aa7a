"""Greedy clusters against taking the symbols one after the other."""

import random

import pytest

from marketframe.operators.allocation import correlation_clusters


def greedy(edges):
    near = {}
    for a, b in sorted(edges):
        near.setdefault(a, []).append(b)
    taken, out = set(), set()
    for a in sorted(near):
        if a in taken:
            continue
        members = [a, *[b for b in near[a] if b not in taken]]
        if len(members) > 1:
            taken.update(members)
            out |= {(m, a) for m in members}
    return out


def both(pairs):
    return {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b}


@pytest.mark.parametrize("nodes,number", [(12, 14), (60, 90), (60, 500), (20_000, 50_000)])
def test_random_graphs(spark, nodes, number):
    rng = random.Random(nodes + number)
    edges = both({(f"s{rng.randrange(nodes):05d}", f"s{rng.randrange(nodes):05d}") for _ in range(number)})
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in edges] + [("s00000", "x", 0.2), ("x", "s00000", 0.2)], "a string, b string, corr double")
    assert {(r.asset_id, r.cluster) for r in correlation_clusters(pairs).collect()} == greedy(edges)


def test_chain_groups_and_nothing(spark):
    chain = both({(f"c{n:02d}", f"c{n + 1:02d}") for n in range(9)})
    other = both({("a", "b"), ("b", "c"), ("a", "z")})
    rows = [(a, b, 0.8, "r1") for a, b in chain] + [(a, b, 0.8, "r2") for a, b in other] + [("a", "a", 1.0, "r3")]
    pairs = spark.createDataFrame(rows, "a string, b string, corr double, run string")
    got = {(r.run, r.asset_id, r.cluster) for r in correlation_clusters(pairs, group="run").collect()}
    assert got == {("r1", *x) for x in greedy(chain)} | {("r2", *x) for x in greedy(other)}
    assert correlation_clusters(pairs.limit(0)).count() == 0

"""Ranked search against scores of all pairs."""

import collections
import math
import random
import re

import numpy as np
import pytest

from marketframe.llm import ranked_search as search

from . import brute
from .conftest import BENCHMARK, as_sorted, frame, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def expected(docs, items, k=20):
    counts = [collections.Counter(TERM.findall(brute.lower(t))) for _, t in docs]
    n = sum(1 for c in counts if c)
    every = sum(sum(c.values()) for c in counts)
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        terms = TERM.findall(brute.lower(text))
        scored = []
        for (doc_id, _), c in zip(docs, counts):
            m = 75 + (25 * sum(c.values()) * n) // every if every else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [*BENCHMARK, (11, "same text other the a 12 5 日本語 x́ and the the the"), (None, "word two"), (12, "!!! ... \x00")]


@pytest.mark.parametrize("shard_bytes,item_bytes,first", [(16_000_000, 4_000_000, 256), (1, 60, 1), (20_000, 1, 4)])
def test_ranked(spark, docs, rows, monkeypatch, shard_bytes, item_bytes, first):
    monkeypatch.setattr(search, "FIRST_READ", first)
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, rank int, score long")
    got = search.ranked(docs, items, shard_bytes=shard_bytes, item_bytes=item_bytes)
    assert as_sorted(got) == expected(rows, ITEMS)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_and_frequent_terms(spark):
    rng = random.Random(2)
    rows = [(n // 2, rng.choice(["alpha beta", "beta alpha", "alpha", "beta gamma delta", "common " * 5])) for n in range(400)]
    rows += [(1000 + n, "common " + prose(rng, 5)) for n in range(50)]
    items = [(1, "alpha beta"), (2, "common"), (3, "gamma gamma alpha"), (4, "nowhere")]
    frame_of = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 7, 20, 1000):
        assert as_sorted(search.ranked(frame(spark, rows).repartition(4), frame_of, k=k, shard_bytes=300)) == expected(rows, items, k)


def test_nothing(spark, docs, nothing, benchmark):
    assert search.ranked(nothing, benchmark).count() == 0
    assert search.ranked(docs, benchmark.where("false")).count() == 0


def test_reading_stops_when_all_is_resolved():
    rng = np.random.default_rng(1)
    size = 20_000
    # a rare term decides; the list of the frequent one need not be read to its end
    rare, common = np.arange(30), np.arange(size)
    count = np.concatenate([np.full(30, 50), np.concatenate([np.full(30, 60), rng.integers(1, 3, size - 30)])])
    lists = search.Lists(np.full(size, 100), np.repeat([0, 1], [30, size]), np.concatenate([rare, common]), count, 2, size, 100 * size)
    lists.owner = owner = _Watched(lists.owner)
    found, score = search.resolve(lists, np.array([0, 1]), np.array([9000, 40]), 20)
    assert len(found) == 30 and (score == score[0]).all()
    assert owner.furthest < size / 2


class _Watched:
    """An array that remembers how far it was read."""

    def __init__(self, values):
        self.values, self.furthest = values, 0

    def __getitem__(self, place):
        self.furthest = max(self.furthest, int(place.stop))
        return self.values[place]

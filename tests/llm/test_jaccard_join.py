"""The similarity join against comparing all pairs."""

import itertools
import random

import numpy as np
import pytest

from marketframe.llm import jaccard_join as join
from marketframe.llm import similar

from . import brute
from .conftest import as_sorted, frame, prose


def shingle_set(text, length):
    words = brute.BLACK.findall(brute.lower(text))
    return frozenset(tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))) if words else frozenset()


def expected(rows, rule=join.RULE):
    sets = [shingle_set(t, rule.words) for _, t in rows]
    different = list({s: None for s in sets if s})
    root = list(range(len(different)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(different)), 2):
        x, y = different[a], different[b]
        if min(len(x), len(y)) * rule.over >= max(len(x), len(y)) * rule.under and rule.over * len(x & y) >= rule.under * len(x | y):
            root[find(a)] = find(b)
    where = {s: find(n) for n, s in enumerate(different)}
    least = {}
    for (doc_id, _), s in zip(rows, sets):
        if s and doc_id is not None:
            least[where[s]] = min(doc_id, least.get(where[s], doc_id))
    return sorted(((doc_id, len(s), least.get(where[s]) if s else doc_id) for (doc_id, _), s in zip(rows, sets)), key=repr)


def edited(rng, text, edits):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), edits):
        words[at] = rng.choice(words) if rng.random() < 0.7 else prose(rng, 1) + "x"
    return " ".join(words)


def test_edges(spark, docs, rows, nothing):
    got = join.similar_groups(docs)
    assert as_sorted(got) == expected(rows)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert join.similar_groups(nothing).count() == 0


@pytest.mark.parametrize("block", [4, 256])
@pytest.mark.parametrize("rule", [join.RULE, similar.RULE, join.Rule(1, 1, 2)])
def test_edited_copies(spark, monkeypatch, rule, block):
    """Copies of one text with one to five edits, few of which link: they need every step of the join."""
    monkeypatch.setattr(join, "BLOCK", block)
    rng = random.Random(4)
    base, other, line = prose(rng, 150), prose(rng, 40), prose(rng, 12)
    texts = [edited(rng, base, rng.choice([1, 1, 2, 2, 3, 4, 5])) for _ in range(60)]
    texts += [edited(rng, other, n % 4) for n in range(20)] + [other] * 30
    texts += [f"{line} {prose(rng, n % 15)}" for n in range(40)]  # a frequent line in short texts
    texts += [" ".join(base.split(" ")[n:]) for n in range(0, 40, 3)]  # chains: each links with its neighbours only
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert as_sorted(join.similar_groups(frame(spark, rows).repartition(3), rule)) == expected(rows, rule)


def test_missing_ids_and_copies(spark):
    rng = random.Random(6)
    a, b = prose(rng, 30), prose(rng, 30)
    rows = [(None, a), (None, a), (9, b), (None, b), (3, b + " "), (3, b.upper()), (4, "one"), (5, "ONE"), (6, "one two"), (7, ""), (8, None), (None, " ")]
    assert as_sorted(join.similar_groups(frame(spark, rows))) == expected(rows)


def test_needed_first_shingles():
    """No linked pair shares fewer of its first shingles than the bound that lets a set stay."""
    rng = np.random.default_rng(3)
    for rule in (join.RULE, similar.RULE):
        for _ in range(300):
            size = int(rng.integers(1, 120))
            base = rng.permutation(10_000)[: size + 40]
            a = np.sort(base[:size])
            b = np.sort(np.concatenate([a[rng.random(size) < 0.93], base[size : size + rng.integers(0, 8)]]))
            common = len(np.intersect1d(a, b))
            if not len(b) or not rule.linked(common, len(a), len(b)):
                continue
            wanted, need = join.first_needed(rule, np.array([len(a), len(b)]))
            met = len(np.intersect1d(a[: wanted[0]], b[: wanted[1]]))
            assert met >= need.max()


def test_common_counts():
    rng = np.random.default_rng(5)
    left = [np.unique(rng.integers(0, 9000, n)) for n in (0, 5, 8000, 1)]
    right = [np.unique(rng.integers(0, 9000, n)) for n in (7000, 0, 3)]
    got = join.common_counts(left, right)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert join.common_counts([], right).shape == (0, 3)

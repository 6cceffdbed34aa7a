"""The near-duplicate stage finds copies with real edits."""

import itertools
import random

import corpus_pipeline
from marketframe.llm import similar

from . import brute
from .conftest import frame, prose


def shingle_set(text):
    words = brute.BLACK.findall(brute.lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_groups_of_edited_copies(spark, rows):
    rng = random.Random(5)
    texts = [t for _, t in rows if t is None or len(t) < 50_000]
    for edits in (1, 3, 6, 9, 20):
        words = prose(rng, 300).split(" ")
        texts.append(" ".join(words))
        for _ in range(6):
            other = list(words)
            for at in rng.sample(range(300), edits):
                other[at] = prose(rng, 1) + "x"
            texts.append(" ".join(other))
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    docs = frame(spark, list(enumerate(texts))).repartition(3)
    got = {r.doc_id: r.component_id for r in similar.groups(docs).collect()}
    assert got == dict(enumerate(root))
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == set(root)


def test_stage_follows_fingerprints_too(spark):
    """Texts of equal fingerprints whose sets of shingles differ: a repeated passage decides, the rest is different."""
    rng = random.Random(9)
    texts = ["alpha beta gamma " * 900 + prose(rng, 40) for _ in range(2)] + [prose(rng, 200)]
    assert 10 * len(shingle_set(texts[0]) & shingle_set(texts[1])) < 8 * len(shingle_set(texts[0]) | shingle_set(texts[1]))
    docs = frame(spark, list(enumerate(texts)))
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == {0, 2}

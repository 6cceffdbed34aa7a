"""The near-duplicate stage decides by row, not by doc_id."""

import random

import corpus_pipeline

from .conftest import as_sorted, frame, prose


def test_repeated_and_missing_ids(spark):
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (2, c), (None, d), (None, d), (None, d), (None, a), (5, c), (6, None), (None, ""), (7, b)]
    out = corpus_pipeline.keep_one_of_group(spark, frame(spark, rows).repartition(3), "")
    assert as_sorted(out.select("doc_id", "text")) == sorted([(1, a), (2, b), (2, c), (None, d), (6, None)], key=repr)

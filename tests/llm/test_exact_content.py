"""Strings that are nearly equal are told apart by their bytes."""

import random

from marketframe.llm import suffix_dedup

from . import brute
from .conftest import as_sorted


def test_frequent_strings_are_compared_by_bytes(spark):
    rng = random.Random(3)
    bodies, rows = [], []
    for n in range(6):
        text = bytearray("".join(rng.choices("abcdefgh", k=200)), "ascii")
        text[8 * 19] = ord("k")
        text[8 * 24] = ord("K")
        other = bytearray(text)
        other[8 * 19] ^= 0x20
        other[8 * 24] ^= 0x20
        bodies += [bytes(text), bytes(other)]
        rows += [(2 * n, text.decode()), (2 * n + 1, other.decode())]
    assert len(suffix_dedup.Strings(bodies, 200).rows) == len(bodies)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_sorted(suffix_dedup.deduplicated(docs, often=1)) == brute.repeats(rows)

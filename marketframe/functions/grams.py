"""Runs of bytes as whole numbers, for joining texts with dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Longest run that is used; it fits a 64-bit number together with its length.
GRAM_BYTES = 5
#: Bits of the filter that says which runs are wanted: its size is the same for any number of them.
FILTER_BITS = 24
STEP_BYTES = 1_000_000


def gram_ids(texts: list[bytes], sizes: list[int], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, id) of the different runs of these lengths in each text; with ``wanted`` those that pass
    this filter. An id holds the length and the bytes of the run."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join([*texts, bytes(GRAM_BYTES)]), np.uint8)
    total = int(lengths.sum())
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)  # bytes up to the end of the text
    owners, found = [], []
    for size in sizes:
        value = np.zeros(total, np.int64)
        for k in range(size):
            value = value << 8 | raw[k : k + total]
        place = np.flatnonzero(left >= size if wanted is None else (left >= size) & passes(wanted, value | size << 40))
        owner = np.searchsorted(np.cumsum(lengths), place, "right")
        order = np.lexsort((value[place], owner))
        owner, value = owner[order], value[place][order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        owners.append(owner[new])
        found.append(value[new] | size << 40)
    return np.concatenate(owners), np.concatenate(found)


def _bit(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def passes(wanted: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = _bit(ids)
    return (wanted[bit >> 3] >> (bit & 7) & 1).astype(bool)


def filter_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter for all ids (first column) of a task."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_bit(batch.column(0).to_numpy(zero_copy_only=False))] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])


def rows_of_grams(sizes: list[int], wanted=None):
    """Function from batches of (row, text as bytes) to rows (row, gram); ``wanted`` is a broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            begin = held = 0
            for end in range(1, len(texts) + 1):
                held += len(texts[end - 1])
                if held >= STEP_BYTES or end == len(texts):
                    owner, ids = gram_ids(texts[begin:end], sizes, keep)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + begin)), pa.array(ids)], names=["row", "gram"])
                    begin, held = end, 0

    return run

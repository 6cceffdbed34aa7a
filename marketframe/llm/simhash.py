"""SimHash near-duplicates by anchor-point covering.

Every 64-bit word lies near a codeword of a covering code: two Golay blocks of 23 bits (covering radius 3), one
Hamming block of 15 bits (radius 1) and 3 bits as they are. The codewords are the anchors. Two fingerprints that
differ in at most two bits have a word between them that differs from each in at most one, and the anchor of that
word lies within the covering radius plus one of both. So each fingerprint is replicated to the anchors of the 65
words within one bit of it (about 19 different ones), and fingerprints meet at an anchor exactly if they link.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import discard, read, stored, utf8

SEED = 42
SHINGLE_WORDS = 3
#: Generator polynomial of the binary Golay code.
GOLAY = 0b101011100011
FLIPS = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority bits of the XXH64 values of a text's word shingles, repeats included; zero without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (a signed long with the same bits) of every row; a missing text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", utf8().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


@functools.cache
def _decoders() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Golay syndromes of the low 12 and high 11 bits, and the error pattern of each syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    low = np.array([remainder(w) for w in range(1 << 12)], np.int64)
    high = np.array([remainder(w << 12) for w in range(1 << 11)], np.int64)
    error = np.zeros(1 << 11, np.uint64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                pattern = 1 << a | 1 << b | 1 << c
                error[low[pattern & 4095] ^ high[pattern >> 12]] = pattern
    error[0] = 0
    return low, high, error


def anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of each 64-bit word."""
    low, high, error = _decoders()
    out = words & np.uint64(0xE000000000000000)
    for shift in (0, 23):
        block = words >> np.uint64(shift) & np.uint64(0x7FFFFF)
        part = block.astype(np.int64)
        out |= (block ^ error[low[part & 4095] ^ high[part >> 12]]) << np.uint64(shift)
    block = words >> np.uint64(46) & np.uint64(0x7FFF)
    syndrome = np.zeros(block.shape, np.uint64)
    for bit in range(15):
        syndrome ^= (block >> np.uint64(bit) & np.uint64(1)) * np.uint64(bit + 1)
    block = np.where(syndrome > 0, block ^ (np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1))), block)
    return out | block << np.uint64(46)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            reached = np.sort(anchors(fps[:, None] ^ FLIPS[None, :]), axis=1)
            fresh = np.ones(reached.shape, bool)
            fresh[:, 1:] = reached[:, 1:] != reached[:, :-1]
            rows, _ = np.nonzero(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(reached[fresh].view(np.int64)), pa.array(fps[rows].view(np.int64))], names=["anchor", "fp"])


def _link(anchor: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compare the fingerprints of whole anchors: each one and the smallest that it reaches there, where they differ.

    Fingerprints at an anchor link if a word within one bit of both decodes to it.
    """
    several = np.zeros(len(fps), bool)
    several[1:] = anchor[1:] == anchor[:-1]
    several[:-1] |= several[1:]
    anchor, fps = anchor[several], fps[several]
    owners, words = [], []
    for at in range(0, len(fps), 8192):
        between = fps[at : at + 8192, None] ^ FLIPS[None, :]
        rows, flips = np.nonzero(anchors(between) == anchor[at : at + 8192, None])
        owners.append(rows + at)
        words.append(between[rows, flips])
    if not owners:
        return fps, fps
    owner, word = np.concatenate(owners), np.concatenate(words)
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sizes = np.diff(np.append(first, len(word)))
    shared = np.repeat(sizes > 1, sizes)
    owner, word = owner[shared], word[shared]
    label = fps.copy()
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(first, len(word)))
        while True:
            least = np.repeat(np.minimum.reduceat(label[owner], first), sizes)
            new = label.copy()
            np.minimum.at(new, owner, least)
            if (new == label).all():
                break
            label = new
    far = label != fps
    return fps[far], label[far]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each anchor; rows arrive sorted by anchor, the last anchor of a batch waits for the next batch."""
    held_anchor = held_fps = np.empty(0, np.uint64)

    def out(anchor: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _link(anchor, fps)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        anchor = np.concatenate([held_anchor, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
        fps = np.concatenate([held_fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(anchor):
            continue
        cut = int(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))[-1])
        yield out(anchor[:cut], fps[:cut])
        held_anchor, held_fps = anchor[cut:], fps[cut:]
    yield out(held_anchor, held_fps)


def links(fps: DataFrame) -> DataFrame:
    """Links between different fingerprints at two or fewer differing bits, as pairs (a, b) that join the same
    components as all such pairs: at every anchor each fingerprint and the smallest that it reaches there.

    ``fps`` has distinct fingerprints in column fp. Rows grow as the fingerprints (about 19 for each), whatever
    the size of the groups; no pair of a group is made.
    """
    placed = fps.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    met = placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long")
    return met.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge: node, root.

    Large-star and small-star rounds in turn; each works with one minimum per node, aggregated before the shuffle,
    and is stored, so a lost executor repeats one round at most. Only two numbers a round reach the driver.
    """
    state = None
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current = stored(current, "links")
    while True:
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored before it is joined: only a join of two plain shuffles can split the edges of a hub
        nearest = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(nearest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before, current = current, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(before, nearest, large, least)
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a missing or empty text has the
    fingerprint zero and links like any other. component_id is the smallest doc_id reachable over links of two or
    fewer bits; rows without a doc_id take part in groups but never name one (a group of only such rows has a
    missing component_id). Repeated rows fall into one group; other columns are not read. Equal fingerprints are
    folded before anything is compared, so a group of exact copies costs one fingerprint.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash_neardup": op7_simhash_neardup}
SQL: dict[str, str] = {}

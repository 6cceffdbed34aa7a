"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, turned to their principal axes and rotated so that the signs lose least
(iterative quantisation, learned on a bounded sample). A code is split into substrings and each substring is an index
of its own. If a code lies within a Hamming radius r of a query's, at least one of m substrings lies within r // m;
so probing all substring values that near retrieves every code within r. Those are ranked by their float vectors.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm.common import read, stored

#: Vectors (those with the smallest hash of vec_id) that rotation and radius are learned from at most.
SAMPLE_ROWS = 20_000
#: Sample vectors whose neighbours choose the radius, and the share of them it has to retrieve.
TRIALS = 200
TARGET = 0.97
SUBSTRINGS = 4
#: Queries that one pass over the index answers.
BLOCK_QUERIES = 10_000
INDEX_ROWS = 20_000


class Codes(NamedTuple):
    """Learned binary codes: ``bits`` signs of the rotated vector, low bit first, in ``substrings`` parts."""

    dim: int
    mean: np.ndarray
    turn: np.ndarray
    radius: int
    substrings: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        signs = (x - self.mean) @ self.turn > 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def parts(self) -> list[tuple[int, int]]:
        """First bit and width of each substring."""
        cuts = [self.bits * n // self.substrings for n in range(self.substrings + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def learn(sample: np.ndarray, k: int, bits: int = 64, rounds: int = 30, substrings: int = SUBSTRINGS, target: float = TARGET, trials: int = TRIALS) -> Codes:
    """Fit rotation and radius. The radius is the least that retrieves ``target`` of the ``k`` nearest of some sample
    vectors within the sample; equal vectors count once."""
    sample = np.unique(sample, axis=0)
    dim = sample.shape[1]
    bits = min(bits, dim, 64)
    mean = sample.mean(axis=0)
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    projected = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
        rotation = (u @ v).T
    codes = Codes(dim, mean, axes @ rotation, bits, min(substrings, bits))
    code = codes.encode(sample)
    near: list[np.ndarray] = []
    for n in range(0, len(sample), max(1, len(sample) // trials)):
        distance = ((sample - sample[n]) ** 2).sum(axis=1)
        distance[n] = np.inf
        best = np.argsort(distance, kind="stable")[: min(k, len(sample) - 1)]
        near.append(np.bitwise_count(code[best] ^ code[n]))
    found = np.sort(np.concatenate(near)) if near else np.empty(0)
    radius = int(found[min(len(found) - 1, int(np.ceil(target * len(found))))]) if len(found) else bits
    return codes._replace(radius=radius)


@functools.cache
def _masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``radius`` ones."""
    if radius >= width:
        return np.arange(1 << width)
    return np.array([sum(1 << b for b in c) for n in range(radius + 1) for c in itertools.combinations(range(width), n)], np.int64)


class Index:
    """Substring indexes of some codes: rows sorted by each substring, with the first row of each value."""

    def __init__(self, codes: Codes, code: np.ndarray):
        self.codes, self.code = codes, code
        self.tables = []
        for low, width in codes.parts():
            value = (code >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.tables.append((low, width, order, np.searchsorted(value[order], np.arange((1 << width) + 1))))

    def within(self, query: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code differs from ``query`` in at most ``radius`` bits."""
        marked = np.zeros(len(self.code), bool)
        each = radius // len(self.tables)
        for low, width, order, first in self.tables:
            value = int(query >> np.uint64(low) & np.uint64((1 << width) - 1))
            probes = _masks(width, each) ^ value
            begin, end = first[probes], first[probes + 1]
            some = np.flatnonzero(end > begin)
            size = end[some] - begin[some]
            rows = np.arange(int(size.sum())) + np.repeat(begin[some] - (np.cumsum(size) - size), size)
            marked[order[rows]] = True
        rows = np.flatnonzero(marked)
        return rows[np.bitwise_count(self.code[rows] ^ query) <= radius]


def vectors(rows: pa.RecordBatch, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (doubles) of the rows (vec_id, embedding) that take part: an id, ``dim`` finite components, not
    all zero. Without ``dim`` the most frequent length counts."""
    ids, lists = rows.column(0), rows.column(1)
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if dim is None:
        there = lengths[lengths > 0]
        if not len(there):
            return np.empty(0, np.int64), np.empty((0, 0))
        dim = int(np.bincount(there).argmax())
    good = np.flatnonzero((lengths == dim) & ids.is_valid().to_numpy(zero_copy_only=False))
    flat = lists.take(pa.array(good)).flatten().cast(pa.float64()).fill_null(np.nan)
    x = flat.to_numpy(zero_copy_only=False).reshape(len(good), dim)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return ids.take(pa.array(good[fine])).cast(pa.int64()).to_numpy(zero_copy_only=False), x[fine]


def index(rows: DataFrame, codes: Codes) -> DataFrame:
    """Code and vector of every row that takes part: vec_id, code, embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = vectors(batch, codes.dim)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), codes.dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(codes.encode(x).view(np.int64)), lists], names=["vec_id", "code", "embedding"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, code long, embedding array<double>")


def _best(query: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` nearest of each query: by distance, then id."""
    order = np.lexsort((ids, distance, query))
    q = query[order]
    first = np.searchsorted(q, q, "left")
    return order[np.arange(len(q)) - first < k]


def _search(codes: Codes, questions, k: int, radius: int):
    """The ``k`` nearest of what a task's rows (vec_id, code, embedding, place) hold for each query, as rows (query_id,
    vec_id, place, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_code, query_x = questions.value
        none = np.empty(0, np.int64)
        top = (none, none, none, np.empty(0))
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_ROWS):
                part = batch.slice(at, INDEX_ROWS)
                ids, places = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), codes.dim)
                table = Index(codes, part.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
                found = [top]
                for n in range(len(query_ids)):
                    rows = table.within(query_code[n], radius)
                    rows = rows[ids[rows] != query_ids[n]]
                    distance = np.sqrt(((x[rows] - query_x[n]) ** 2).sum(axis=1))
                    if len(rows) > 4 * k:
                        bound = np.partition(distance, k - 1)[k - 1]
                        near = distance <= bound
                        rows, distance = rows[near], distance[near]
                    found.append((np.full(len(rows), n), ids[rows], places[rows], distance))
                top = tuple(np.concatenate(c) for c in zip(*found))
                best = _best(top[0], top[1], top[3], k)
                top = tuple(c[best] for c in top)
        columns = [pa.array(query_ids[top[0]]) if len(top[0]) else pa.array([], pa.int64()), *map(pa.array, top[1:])]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "place", "score"])

    return run


def query_blocks(rows: DataFrame, codes: Codes, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries of (vec_id, code, embedding) in blocks of ``size``."""
    ids, code, x = [], [], []
    for row in rows.toLocalIterator():
        ids.append(row.vec_id)
        code.append(row.code)
        x.append(row.embedding)
        if len(ids) == size:
            yield np.array(ids), np.array(code, np.int64).view(np.uint64), np.array(x)
            ids, code, x = [], [], []
    if ids:
        yield np.array(ids), np.array(code, np.int64).view(np.uint64), np.array(x)


def nearest(rows: DataFrame, queries: str, k: int = 10, sample_rows: int = SAMPLE_ROWS, block_queries: int = BLOCK_QUERIES, target: float = TARGET) -> DataFrame:
    """The ``k`` nearest rows of each row of ``rows`` (vec_id, embedding) for which the SQL condition ``queries`` holds:
    query_id, rank (from 1), vec_id, score (Euclidean distance in double precision), ties to the smaller vec_id.

    Rows whose id is missing or whose vector is missing, zero, of another length than most, or holds a missing or
    non-finite component take no part. Candidates are all other rows but those with the query's own id; a repeated row
    is a candidate each time. Queries with one id are one query, its distance to a candidate is the smallest of theirs. Queries that find fewer than ``k`` within the radius are asked again without one, so
    each gets ``k`` rows, or all there are. Other columns are not read.

    The index is stored once and never shuffled: each slice of it is probed for a block of queries and keeps the
    ``k`` best of each, a task merges its slices, one window over queries ranks what tasks found.
    """
    spark = rows.sparkSession
    order = [F.xxhash64("vec_id"), "vec_id"]
    sample = rows.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").orderBy(*order).limit(sample_rows).toArrow()
    schema = "query_id long, rank int, vec_id long, score double"
    taken = vectors(sample.combine_chunks().to_batches()[0] if sample.num_rows else pa.RecordBatch.from_pylist([], sample.schema))[1]
    if not len(taken):
        return spark.createDataFrame([], schema)
    codes = learn(taken, k, target=target)
    table = stored(index(rows, codes).withColumn("place", F.monotonically_increasing_id()), "codes")
    found = None
    for block in query_blocks(table.where(queries), codes, block_queries):
        few = block
        for radius in (codes.radius, codes.bits):
            if not len(few[0]):
                break
            ask = spark.sparkContext.broadcast(few)
            got = table.mapInArrow(_search(codes, ask, k, radius), "query_id long, vec_id long, place long, score double")
            got = stored(got.groupBy("query_id", "vec_id", "place").agg(F.min("score").alias("score")), "nearest")
            if radius < codes.bits:
                enough = {r.query_id for r in got.groupBy("query_id").count().where(f"count >= {k}").select("query_id").toLocalIterator()}
                asked = spark.createDataFrame([(i,) for i in {int(i) for i in few[0]} - enough], "query_id long")
                got = got.join(asked, "query_id", "left_anti")
                again = np.array([i not in enough for i in few[0]], bool)
                few = tuple(part[again] for part in few)
            found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], schema)
    # vectors of one id may be queries of several blocks
    found = found.groupBy("query_id", "vec_id", "place").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id", "place")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


QUERIES = {"op4_ann": op4_ann}
SQL: dict[str, str] = {}

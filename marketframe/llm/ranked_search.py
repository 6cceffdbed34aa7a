"""Ranked lexical search by reading impact-sorted lists in order (no random access, NRA).

The documents are indexed in shards of some megabytes: for each query term of a block of items the postings of the
shard's documents. Counts of documents and terms are summed over all shards. A shard then orders each list by falling
impact and answers every item by sequential reads: each document has a score interval, from what was read of it to that
plus the next impact of every list where it was not yet met. Reading goes on until all documents whose interval
reaches the lowest place have one exact score, so members, ties and scores are final. A task carries the lowest place
of an item from shard to shard; the best of all tasks compete at last.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import chunks, read, stored, utf8
from marketframe.llm.tokens import word_bytes, words
from marketframe.operators.ranking import top_k

K = 20
#: Bytes of documents that one shard indexes.
SHARD_BYTES = 16_000_000
#: Bytes of item texts that are searched together; their terms are what is broadcast.
ITEM_BYTES = 4_000_000
#: Entries of each list that are read at first; later reads double.
FIRST_READ = 256
#: Parameters of the length normalisation, in per cent.
SLOPE = 25
SATURATION = 12
SCALE = 1_000_000_000


class Queries:
    """Items of one block: the different terms of all, and of each item its terms with their numbers."""

    def __init__(self, texts: list[bytes]):
        w = words(texts, word_bytes("alnum"))
        self.terms, number = np.unique(w.hash, return_inverse=True)
        cuts = np.searchsorted(w.owner, np.arange(1, len(texts)))
        self.items = [np.unique(part, return_counts=True) for part in np.split(number, cuts)]


def postings(texts: list[bytes], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each text, and of the wanted terms: term, text, occurrences)."""
    w = words(texts, word_bytes("alnum"))
    sizes = np.bincount(w.owner, minlength=len(texts))
    if not len(terms) or not len(w.hash):
        none = np.empty(0, np.int64)
        return sizes, none, none, none
    place = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
    hit = terms[place] == w.hash
    pair, count = np.unique(w.owner[hit] * len(terms) + place[hit], return_counts=True)
    return sizes, pair % len(terms), pair // len(terms), count


def _index(terms: np.ndarray, kind: pa.DataType, shard_bytes: int):
    """One row per shard: its documents, their numbers of terms, the postings as arrays, and the bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = documents = 0

        def out() -> pa.RecordBatch:
            ids, sizes, term, owner, count = zip(*held)
            raw = [np.concatenate(x) for x in (sizes, term, owner, count)]
            packed = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(raw, ("<i8", "<i4", "<i4", "<i4"))]
            flat = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), *packed], names=["ids", "sizes", "term", "owner", "count"])

        for part, texts in chunks(batches):
            sizes, term, owner, count = postings(texts, terms)
            ids = part.column(0)
            held.append((ids.cast(kind), sizes, term, owner + documents, count))
            size += sum(map(len, texts))
            documents += part.num_rows
            if size >= shard_bytes:
                yield out()
                held, size, documents = [], 0, 0
        if held:
            yield out()

    return run


def _statistics(number: int):
    """Sums of a task: documents that hold a term (by its number), documents with terms (-1), terms (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(number, np.int64)
        some = every = 0
        for batch in batches:
            for sizes, term in zip(batch.column(0), batch.column(1)):
                sizes = np.frombuffer(sizes.as_py(), "<i8")
                df += np.bincount(np.frombuffer(term.as_py(), "<i4"), minlength=number)
                some += int((sizes > 0).sum())
                every += int(sizes.sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, [-1, -2])), pa.array(np.append(df[there], [some, every]))], names=["term", "n"])

    return run


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)


def impacts(count: np.ndarray, size: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What one occurrence in the item of a term adds to a score, by its occurrences in a document of ``size`` terms,
    before the weight."""
    length = 100 - SLOPE + (SLOPE * size * documents) // max(terms, 1)
    return (SCALE * count) // (1000 * count + SATURATION * length)


class Lists:
    """The impact-sorted lists of one shard."""

    def __init__(self, sizes: np.ndarray, term: np.ndarray, owner: np.ndarray, count: np.ndarray, number: int, documents: int, terms: int):
        impact = impacts(count, sizes[owner], documents, terms)
        order = np.lexsort((owner, -impact, term))
        self.owner, self.impact = owner[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(number + 1))
        self.documents = len(sizes)


def resolve(lists: Lists, terms: np.ndarray, factors: np.ndarray, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of all documents of the shard that have a score above 0 and are among its ``k`` best or tie
    with the last of them; those that cannot reach ``least`` may be missing.

    ``terms`` are the item's terms, ``factors`` their weights times their occurrences there.
    """
    begin, end = lists.first[terms], lists.first[terms + 1]
    there = (end > begin) & (factors > 0)
    begin, end, factors = begin[there], end[there], factors[there]
    lower = np.zeros(lists.documents, np.int64)
    at, step = begin.copy(), FIRST_READ
    while len(begin):
        for t in np.flatnonzero(at < end):
            stop = min(at[t] + step, end[t])
            owner = lists.owner[at[t] : stop]
            lower[owner] += factors[t] * lists.impact[at[t] : stop]
            at[t] = stop
        step *= 2
        # the next entry of a list bounds what it still holds for the documents that it has not shown yet
        bound = np.where(at < end, factors * lists.impact[np.minimum(at, len(lists.impact) - 1)], 0)
        upper = lower + bound.sum()
        for t in np.flatnonzero(bound):
            upper[lists.owner[begin[t] : at[t]]] -= bound[t]
        lowest = least
        if lists.documents >= k:
            lowest = max(lowest, int(np.partition(lower, lists.documents - k)[lists.documents - k]))
        open_ = (upper >= max(lowest, 1)) & (upper > lower)
        if not open_.any():
            break
    found = np.flatnonzero(lower >= max(least, 1))
    if len(found) > k:
        lowest = np.partition(lower[found], len(found) - k)[len(found) - k]
        found = found[lower[found] >= lowest]
    return found, lower[found]


def _search(queries: Queries, df: np.ndarray, documents: int, terms: int, k: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights(df, documents)
        scored = [(t, weight[t] * n) for t, n in queries.items]
        best: list[tuple[np.ndarray, pa.Array]] = [(np.empty(0, np.int64), pa.array([], kind))] * len(scored)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values
                sizes, term, owner, count = (np.frombuffer(batch.column(1 + i)[row].as_py(), t).astype(np.int64) for i, t in enumerate(("<i8", "<i4", "<i4", "<i4")))
                if not len(term):
                    continue
                lists = Lists(sizes, term, owner, count, len(queries.terms), documents, terms)
                for i, (t, factors) in enumerate(scored):
                    score, held = best[i]
                    least = int(score[k - 1]) if len(score) >= k else 0
                    found, new = resolve(lists, t, factors, k, least)
                    if len(found):
                        score, held = np.concatenate([score, new]), pa.concat_arrays([held, ids.take(pa.array(found)).cast(kind)])
                        # equal scores at the last place all stay until the whole is known
                        order = np.argsort(-score, kind="stable")
                        order = order[score[order] >= score[order[min(k, len(order)) - 1]]]
                        best[i] = score[order], held.take(pa.array(order))
        for i, (score, held) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i)), held, pa.array(score)], names=["item", "doc_id", "score"])

    return run


def _item_blocks(items: DataFrame, item_bytes: int) -> Iterator[list]:
    """Rows of items by blocks of about ``item_bytes`` bytes of text, one block at the driver at a time."""
    held, size = [], 0
    for row in items.select("item_id", utf8().alias("text")).toLocalIterator():
        if held and size + len(row.text) > item_bytes:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row.text)
    if held:
        yield held


def ranked(docs: DataFrame, items: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``k`` rows of ``docs`` with the highest score above 0 for each row of ``items``: item_id, rank, doc_id, score;
    fewer where fewer have one. Equal scores rank by doc_id, rows without one first.

    Terms are runs of digits, letters and non-ASCII characters with A-Z lower-cased, compared by their 64-bit hashes; a
    missing text has none. Each row of either table stands for itself, also a repeated one or one without an id (equal
    rows of ``docs`` take ranks of their own, equal items repeat their results). Without documents or items the result is
    empty. Other columns are not read. For each block of ``item_bytes`` bytes of item texts the documents are read once;
    what is broadcast are the terms of a block, what is stored their postings.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = spark.createDataFrame([], docs.select("doc_id").schema).toArrow().schema.field(0).type
    name = items.schema["item_id"].dataType.simpleString()
    texts = docs.select("doc_id", utf8().alias("text"))
    out = spark.createDataFrame([], f"item_id {name}, rank int, doc_id {kind}, score long")
    for block in _item_blocks(items, item_bytes):
        queries = Queries([r.text for r in block])
        number = len(queries.terms)
        schema = f"ids array<{kind}>, sizes binary, term binary, owner binary, count binary"
        index = stored(texts.mapInArrow(_index(queries.terms, arrow, shard_bytes), schema), "postings")
        sums = index.select("sizes", "term").mapInArrow(_statistics(number), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        sums = {r.term: r.n for r in sums.collect()}  # one row per different term of the block
        df = np.array([sums.get(t, 0) for t in range(number)], np.int64)
        search = _search(queries, df, sums.get(-1, 0), sums.get(-2, 0), k, arrow)
        found = index.mapInArrow(search, f"item long, doc_id {kind}, score long")
        best = top_k(found, ["item"], [F.desc("score"), F.asc("doc_id")], k, "rank")
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], f"item long, item_id {name}")
        out = out.unionByName(stored(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
QUERIES = {"op13_ranked_search": op13_ranked_search}
SQL: dict[str, str] = {
    "op13_ranked_search": f"""
with docs as (select row_number() over () as r, doc_id, text from documents),
items as (select row_number() over () as i, item_id, text from benchmark),
occurring as (select r, {_TERMS} as t from docs),
tfs as (select r, t, count(*)::bigint as tf from occurring group by r, t),
sizes as (select r, sum(tf)::bigint as n from tfs group by r),
total as (select count(*)::bigint as nn, sum(n)::bigint as ll from sizes),
dfs as (select t, count(*) as df from tfs group by t),
weights as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as w from dfs, total),
lengths as (select r, 75 + (25 * n * nn) // ll as m from sizes, total),
wanted as (select i, t, count(*)::bigint as c from (select i, {_TERMS} as t from items) group by i, t),
scores as (
    select i, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
    from wanted join weights using (t) join tfs using (t) join lengths using (r) group by i, r
), placed as (
    select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id) as rank from scores join docs using (r) where score > 0
)
select item_id, rank::integer as rank, doc_id, score from placed join items using (i) where rank <= 20
"""
}

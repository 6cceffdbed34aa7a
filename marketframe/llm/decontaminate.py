"""Benchmark decontamination with suffix arrays of the training text.

Each shard of documents (a slice of an Arrow batch) gets a suffix array over its words: the suffixes whose first
words begin some test suffix are sorted by their words. Every test suffix is then found in it by binary search, its
longest verbatim match extended from there. Suffixes that begin with words no test item has are never sorted, they
cannot match.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.llm import tokens
from marketframe.llm.common import CHUNK_BYTES, chunks, read, utf8

WINDOW = 10
#: Words by which suffixes are chosen for sorting.
LEAD = 3
#: Bytes of test text that one pass over the documents searches for; more takes further passes.
BLOCK_BYTES = 8_000_000
FILTER_BITS = 20


class Tests(NamedTuple):
    """Test suffixes of one block, sorted: a window starts at each."""

    keys: np.ndarray  # words of the window as fixed-width byte strings, padded by zeros
    size: np.ndarray  # words of the window
    item: np.ndarray  # position in ``items``
    at: np.ndarray  # word offset in its item
    items: list[str]
    leads: list[tuple[int, np.ndarray, np.ndarray]]  # words, sorted hashes, bitmap


def packed(rows: np.ndarray) -> np.ndarray:
    """Rows of hashes as byte strings that compare as the rows do."""
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * rows.shape[1]}").ravel()


def bitmap(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return out


def test_suffixes(ids: list, texts: list[bytes], window: int = WINDOW) -> Tests:
    """Windows of a block of test items: ``window`` consecutive words, or all words of a shorter item."""
    w = tokens.words(texts, tokens.word_bytes("alnum"))
    counts = np.bincount(w.owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    at = np.arange(len(w.hash)) - first[w.owner] if len(w.hash) else w.owner
    size = np.minimum(counts, window)[w.owner] if len(w.hash) else w.owner
    starts = np.flatnonzero(at + size <= counts[w.owner]) if len(w.hash) else w.owner
    rows = np.zeros((len(starts), window), np.uint64)
    for k in range(window):
        there = k < size[starts]
        rows[there, k] = w.hash[starts[there] + k]
    order = np.lexsort(rows.T[::-1])
    rows, starts = rows[order], starts[order]
    sizes = size[starts]
    leads = []
    for n in range(1, LEAD + 1):
        chosen = sizes >= LEAD if n == LEAD else sizes == n
        if chosen.any():
            code = rows[chosen, 0].copy()
            for k in range(1, n):
                code = tokens.mix(code * tokens.MULTIPLIER + rows[chosen, k])
            code = np.unique(code)
            leads.append((n, code, bitmap(code)))
    return Tests(packed(rows) if len(rows) else np.empty(0, "S8"), sizes, w.owner[starts], at[starts], [str(i) for i in ids], leads)


def suffix_array(w: tokens.Words, tests: Tests, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of a shard whose suffixes may match, in the order of their first ``window`` words, and these."""
    some = np.zeros(len(w.hash), bool)
    for n, codes, bits in tests.leads:
        code, whole = tokens.grams(w, n)
        near = np.flatnonzero(bits[(code >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & whole)
        found = np.searchsorted(codes, code[near])
        some[near[codes[np.minimum(found, len(codes) - 1)] == code[near]]] = True
    at = np.flatnonzero(some)
    rows = np.zeros((len(at), window), np.uint64)
    for k in range(window):
        there = at + k < len(w.hash)
        there[there] = w.owner[at[there] + k] == w.owner[at[there]]
        rows[there, k] = w.hash[at[there] + k]
    order = np.lexsort(rows.T[::-1])
    return at[order], packed(rows[order]) if len(at) else np.empty(0, f"S{8 * window}")


def occurrences(keys: np.ndarray, tests: Tests, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the suffix array, test suffix) of every occurrence of every window, by binary search."""
    if not len(keys) or not len(tests.keys):
        none = np.empty(0, np.int64)
        return none, none
    low = np.searchsorted(keys, tests.keys, "left")
    high = np.searchsorted(keys, tests.keys, "right")
    for n in range(1, window):  # a shorter window is a prefix: up to the last suffix that begins with it
        short = np.flatnonzero(tests.size == n)
        if len(short):
            rows = np.frombuffer(tests.keys[short].tobytes(), ">u8").reshape(len(short), window).copy()
            rows[:, n:] = np.uint64(0xFFFFFFFFFFFFFFFF)
            high[short] = np.searchsorted(keys, packed(rows), "right")
    many = high - low
    test = np.repeat(np.arange(len(many)), many)
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + low[test]
    return place, test


def search(texts: list[bytes], tests: Tests, window: int = WINDOW):
    """For each text: hit marks of its words, items (positions) that have occurring windows, and the longest match as
    (words, item position, word offset in the text)."""
    w = tokens.words(texts, tokens.word_bytes("alnum"))
    n_words = np.bincount(w.owner, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    positions, keys = suffix_array(w, tests, window)
    place, test = occurrences(keys, tests, window)
    at, size = positions[place], tests.size[test]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    hit = np.split(np.cumsum(cover)[:-1] > 0, np.cumsum(n_words)[:-1])
    owner, item = w.owner[at], tests.item[test]
    # windows that follow each other in the text and in the item make one longer match
    diagonal = at - tests.at[test]
    order = np.lexsort((at, diagonal, item, owner))
    o, i, d, a, s = owner[order], item[order], diagonal[order], at[order], size[order]
    new = np.ones(len(a), bool)
    new[1:] = (o[1:] != o[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)
    starts = np.flatnonzero(new)
    lasts = np.append(starts[1:], len(a))[: len(starts)] - 1
    length = a[lasts] - a[starts] + s[lasts]
    longest: dict[int, tuple[int, int, int]] = {}
    items: dict[int, set[int]] = {}
    for text, number, words, begin in zip(o[starts].tolist(), i[starts].tolist(), length.tolist(), a[starts].tolist()):
        items.setdefault(text, set()).add(number)
        best = (words, -number, -(begin - int(first[text])))
        if best > longest.get(text, (0, 0, 0)):
            longest[text] = best
    return hit, items, {t: (n, -i, -b) for t, (n, i, b) in longest.items()}


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Test items in blocks of at most ``size`` bytes (a longer item alone), each brought to the driver for its pass."""
    ids: list = []
    texts: list[bytes] = []
    held = 0
    for row in benchmark.select("item_id", utf8().alias("text")).orderBy("item_id").toLocalIterator():
        if held + len(row.text) > size and texts:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(bytes(row.text))
        held += len(row.text)
    yield ids, texts


def _pass(df: DataFrame, carried: list[str], ids: list, texts: list[bytes], window: int, chunk: int, last: bool, text: str) -> DataFrame:
    """Search the texts (in column ``text``) for one block; marks, items and longest match of earlier blocks are taken along.
    After the last block texts and marks are left out."""
    tests = df.sparkSession.sparkContext.broadcast(test_suffixes(ids, texts, window))
    later = "_marks" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tests.value
        names = [*carried, "n_words", "n_hit", "items", "longest_words", "longest_item", "longest_at"]
        names += [] if last else ["_marks"]
        names += [] if last or text in carried else [text]
        for batch, values in chunks(batches, chunk, text):
            hit, items, longest = search(values, held, window)
            found = [{held.items[i] for i in items.get(r, ())} for r in range(len(values))]
            best = [longest.get(r, (0, None, None)) for r in range(len(values))]
            best = [(n, None if i is None else held.items[i], a) for n, i, a in best]
            if later:
                before = {name: batch.column(name).to_pylist() for name in ("_marks", "items", "longest_words", "longest_item", "longest_at")}
                for r, marks in enumerate(hit):
                    hit[r] = marks | np.unpackbits(np.frombuffer(before["_marks"][r], np.uint8), count=len(marks)).astype(bool)
                    found[r].update(before["items"][r])
                    if before["longest_words"][r] >= best[r][0]:
                        best[r] = (before["longest_words"][r], before["longest_item"][r], before["longest_at"][r])
            columns = [
                *(batch.column(n) for n in range(len(carried))),
                pa.array([len(marks) for marks in hit], pa.int64()),
                pa.array([int(marks.sum()) for marks in hit], pa.int64()),
                pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                pa.array([b[0] for b in best], pa.int64()),
                pa.array([b[1] for b in best], pa.string()),
                pa.array([b[2] for b in best], pa.int64()),
            ]
            if not last:
                columns.append(pa.array([np.packbits(marks).tobytes() for marks in hit], pa.binary()))
                columns += [] if text in carried else [batch.column(text)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    added = "n_words long, n_hit long, items array<string>, longest_words long, longest_item string, longest_at long"
    added += "" if last else ", _marks binary"
    kept = [] if last or text in carried else [df.schema[text]]
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in carried), *T.StructType.fromDDL(added), *kept]))


def matches(docs: DataFrame, benchmark: DataFrame, carried: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id (or the columns ``carried``), n_words, n_hit, items, longest_words,
    longest_item, longest_at.

    Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. A window is ``window``
    consecutive words of an item of ``benchmark`` (item_id, text); an item with fewer words, but not none, is one
    window. A word of a document is hit if it lies in an occurrence of a window; ``items`` are the ids of the items
    with occurring windows, sorted as strings; the longest match is given with its item and word offset. Missing
    texts have no words, a missing item_id is called "None", equal item_ids count as one item, repeated documents
    are searched each, an empty benchmark hits nothing; other columns are not read. ``text`` names the column of texts;
    if it is among ``carried`` it goes to Python once.

    The benchmark is taken in blocks of ``block_bytes``, so what a task holds of it is bounded; each block is one
    more Python step over the documents, and no text is shuffled.
    """
    carried = carried or ["doc_id"]
    found = docs.select(*carried, *([] if text in carried else [text]))
    waiting = blocks(benchmark, block_bytes)
    block = next(waiting)
    while block:
        following = next(waiting, None)
        found = _pass(found, carried, *block, window, chunk_bytes, following is None, text)
        block = following
    return found


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.col("items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


QUERIES = {"op6_decontamination": op6_decontamination}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL: dict[str, str] = {
    "op6_decontamination": f"""
with items as (select item_id, {_WORDS} as w from benchmark),
sized as (select item_id, w, least(len(w), 10) as n from items where len(w) > 0),
wins as (select distinct item_id, n, array_to_string(w[k : k + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as k from sized)),
docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
places as (select r, n, k, array_to_string(w[k : k + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from docs, (select distinct n from wins))),
hits as (select r, k, n, item_id from places join wins using (n, g)),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from (select distinct r, k, n from hits)) group by r),
found as (select r, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct r, item_id::varchar as i from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated from docs left join words using (r) left join found using (r)
"""
}

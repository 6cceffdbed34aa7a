"""Removal of byte strings that occur more than once, by a distributed, sampled suffix array.

Only suffixes that can take part in a repeat are sorted. Every string of ``length`` bytes has an anchor, the place of
the smallest hash among its 32-byte substrings, and equal strings have their anchors at equal offsets. So

1. the anchors of all texts are found and the hashes that occur once are dropped with their strings;
2. what is left becomes one record per anchor: the bytes of all strings that it serves;
3. sampled splitters range-partition the records by the leading bytes of their anchor's suffix. Equal leading bytes
   fall into one bucket, so no repeat crosses a boundary;
4. each bucket sorts the suffixes from the anchors to the right and, reversed, to the left by multikey quicksort. The
   longest common prefixes of neighbours divide both orders into intervals of suffixes that agree over a depth; two
   strings with their anchor at offset o are equal if they share an interval of depth o to the left and one of depth
   length - o to the right.

The leading bytes of an anchor that occurs very often would be one bucket. Its strings are sorted by all their bytes
instead: tasks fold the records of a slice of texts to the different strings in them and send these, sorted and packed,
to the buckets of splitters between whole strings; a bucket sorts what it got in the same way, and its answer goes back
to the slices. So a passage that a third of all texts share is one string per slice in any bucket, and no row or join
is made per occurrence.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import chunks, discard, read, stored, utf8
from marketframe.llm.tokens import MULTIPLIER, mix

LENGTH = 200
SEED_BYTES = 32
#: An anchor that occurs more often has its strings sorted by all their bytes.
OFTEN = 256
#: Strings of one slice of texts and of one bucket of strings, and how many of a slice are looked at for splitters.
SLICE_STRINGS = 60_000
BUCKET_STRINGS = 120_000
SLICE_SAMPLE = 64
SAMPLE = 20_000
#: Strings that a bucket sorts at a time: a task holds a few copies of their bytes.
SORTED_STRINGS = 20_000
#: Bytes of joined text in one vectorised step; positions in it take 20 bits.
STEP = 1 << 18
#: Bytes of the records of a bucket, and how many records it works on at a time.
BUCKET_BYTES = 12_000_000
BUCKET_RECORDS = 8_000


def loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    size = len(raw)
    padded = np.zeros(size + 16, np.uint8)
    padded[:size] = raw
    out = np.empty((size + 7) // 8 * 8, np.uint64)
    for shift in range(8):
        out[shift::8] = padded[shift : shift + len(out)].view(">u8")
    return out[:size]


def factors(number: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, number + 1, dtype=np.uint64) * MULTIPLIER + np.uint64(seed)) | np.uint64(1)


def weighted(eight: np.ndarray, size: int, number: int, seed: int) -> np.ndarray:
    """Hash of the ``8 * number`` bytes from each of the first ``size`` positions on."""
    out = np.zeros(size, np.uint64)
    for k, factor in enumerate(factors(number, seed)):
        out += eight[8 * k : 8 * k + size] * factor
    return mix(out)


def anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, anchor, first string, last string) of the runs of strings with one anchor, over joined texts that
    end at ``ends``; strings that cross an end are left out."""
    none = np.empty(0, np.int64)
    windows = len(raw) - length + 1
    if windows < 1:
        return none.astype(np.uint64), none, none, none
    seeds = len(raw) - SEED_BYTES + 1
    span = length - SEED_BYTES + 1
    code = weighted(loads(raw), seeds, SEED_BYTES // 8, 1)
    key = (code >> np.uint64(20) << np.uint64(20)) | np.arange(seeds, dtype=np.uint64)
    blocks = -(-seeds // span)
    padded = np.full(blocks * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:seeds] = key
    square = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(square, axis=1).ravel()
    least = np.minimum(ahead[:windows], behind[span - 1 : span - 1 + windows])
    at = (least & np.uint64(0xFFFFF)).astype(np.int64)
    starts = np.arange(windows)
    whole = starts + length <= ends[np.searchsorted(ends, starts, "right")]
    new = np.ones(windows, bool)
    new[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], windows) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    return code[at[first]], at[first], first, last


def steps(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """Joined pieces of texts for ``anchors``: bytes, ends, the text of each piece and its offset there. Pieces of one
    long text overlap so that each string lies in exactly one."""
    parts: list[bytes] = []
    owners: list[int] = []
    offsets: list[int] = []
    held = 0
    for number, text in enumerate(texts):
        if len(text) < length:
            continue
        for offset in range(0, len(text) - length + 1, STEP - length + 1):
            piece = text[offset : offset + STEP]
            if held + len(piece) > STEP and parts:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), owners, offsets
                parts, owners, offsets, held = [], [], [], 0
            parts.append(piece)
            owners.append(number)
            offsets.append(offset)
            held += len(piece)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), owners, offsets


def _find(length: int):
    """Rows of anchors: seed, the text's two digests, place = anchor, offsets of the anchor in its first and last
    string, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            one = batch.column(0).to_numpy(zero_copy_only=False)
            two = batch.column(1).to_numpy(zero_copy_only=False)
            for raw, ends, owners, offsets in steps(texts, length):
                seed, at, first, last = anchors(raw, ends, length)
                piece = np.searchsorted(ends, at, "right")
                begins = np.concatenate([[0], ends[:-1]])
                owner = np.array(owners)[piece]
                place = at - begins[piece] + np.array(offsets)[piece]
                packed = (place << 16) | ((at - last) << 8) | (at - first)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(one[owner]), pa.array(two[owner]), pa.array(packed)], names=["seed", "one", "two", "place"])

    return run


def _records(length: int):
    """Cut the records of a text's repeated anchors (kind 0) and say how many texts are equal, if several are (kind 2).
    Records of anchors that occur often are gathered in slices of texts (kind 1): the different bodies, and who has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "one", "two", "first", "left", "body", "owners", "bodies"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
        rows: list[tuple] = []
        held = 0
        owners: list[tuple[int, int, int, int]] = []
        bodies: dict[bytes, int] = {}
        strings = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        def slice_row() -> tuple:
            name = hashlib.md5(b"%d %d %d" % owners[0][:3]).digest()[:8]
            return 1, int.from_bytes(name, "little", signed=True), strings, None, None, None, np.array(owners, np.int64).tobytes(), list(bodies)

        for batch in batches:
            for one, two, copies, text, places in zip(*(batch.column(i) for i in range(5))):
                one, two, text = one.as_py(), two.as_py(), text.as_py()
                if copies.as_py() > 1:
                    rows.append((2, one, two, copies.as_py(), None, None, None, None))
                    held += 100
                for place in places.as_py():
                    often, place = place & 1, place >> 1
                    at, low, high = place >> 16, place >> 8 & 255, place & 255
                    first = at - high
                    body = text[first : at - low + length]
                    if not often:
                        rows.append((0, one, two, first, high, body, None, None))
                        held += 300
                        continue
                    if body not in bodies:
                        bodies[body] = len(bodies)
                        strings += len(body) - length + 1
                    owners.append((one, two, first, bodies[body]))
                    if strings >= SLICE_STRINGS or len(owners) >= SLICE_STRINGS:
                        rows.append(slice_row())
                        held += 50 * len(owners) + 400 * len(bodies)
                        owners, bodies, strings = [], {}, 0
                if held > 4_000_000:
                    yield out()
                    rows.clear()
                    held = 0
        if owners:
            rows.append(slice_row())
        if rows:
            yield out()

    return run


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of numbers. Each round sorts the groups of rows that are equal so far by their next number and
    goes on with the groups that are still equal."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(len(order), np.int64)
    active = np.arange(len(order))  # places in ``order`` whose group has several rows
    value = words[order, 0]
    for depth in range(1, words.shape[1] + 1):
        if not len(active):
            break
        new = np.ones(len(active), bool)
        new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        number = np.cumsum(new)
        several = np.bincount(number)[number] > 1
        active, group = active[several], number[several]
        if depth == words.shape[1] or not len(active):
            break
        value = words[order[active], depth]
        inner = np.lexsort((value, group))
        order[active] = order[active][inner]
        value = value[inner]
    return order


def common_bytes(words: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before from its beginning on; the first row shares none."""
    out = np.zeros(len(words), np.int64)
    if len(words) > 1:
        xor = words[1:] ^ words[:-1]
        different = xor != 0
        place = np.where(different.any(axis=1), different.argmax(axis=1), words.shape[1])
        last = xor[np.arange(len(xor)), np.minimum(place, words.shape[1] - 1)]
        same = np.zeros(len(xor), np.int64)
        for byte in range(7, 0, -1):
            same += last >> np.uint64(8 * byte) == 0
        out[1:] = 8 * place + np.where(place < words.shape[1], same, 0)
    return out


def repeated(bodies: list[bytes], left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, offset of the anchor) of the strings in ``bodies`` that occur there twice or more.

    A record's anchor lies ``left`` bytes from its start; it serves strings in which the anchor's offset is between
    ``left + length - len(body)`` and ``left``.
    """
    n = len(bodies)
    ahead = -(-length // 8)
    sizes = np.array([len(b) for b in bodies])
    low = left + length - sizes
    right = np.zeros((n, 8 * ahead), np.uint8)
    back = np.zeros((n, 8 * ahead), np.uint8)
    for row, body in enumerate(bodies):
        x = int(left[row])
        suffix = np.frombuffer(body, np.uint8, len(body) - x, x)
        right[row, : len(suffix)] = suffix
        if x:
            back[row, :x] = np.frombuffer(body, np.uint8, x)[::-1]
    forward = right.view(">u8").astype(np.uint64)
    backward = back.view(">u8").astype(np.uint64)
    order = multikey_order(forward)
    shared = common_bytes(forward[order])
    order_back = multikey_order(backward)
    shared_back = common_bytes(backward[order_back])
    records, offsets = [], []
    interval = np.empty(n, np.int64)
    interval_back = np.empty(n, np.int64)
    for offset in range(int(low.min()), int(left.max()) + 1):
        there = np.flatnonzero((low <= offset) & (left >= offset))
        if len(there) < 2:
            continue
        interval[order] = np.cumsum(shared < length - offset)
        interval_back[order_back] = np.cumsum(shared_back < offset)
        value = interval[there] * (n + 1) + interval_back[there]
        sort = np.argsort(value, kind="stable")
        value = value[sort]
        equal = value[1:] == value[:-1]
        twice = np.zeros(len(value), bool)
        twice[1:] = equal
        twice[:-1] |= equal
        records.append(there[sort[twice]])
        offsets.append(np.full(int(twice.sum()), offset))
    if not records:
        none = np.empty(0, np.int64)
        return none, none
    return np.concatenate(records), np.concatenate(offsets)


def spans(record: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges that strings from ``start`` on cover: (record, from, to), joined within each record."""
    order = np.lexsort((start, record))
    record, start = record[order], start[order]
    new = np.ones(len(record), bool)
    new[1:] = (record[1:] != record[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(record))[: len(first)] - 1
    return record[first], start[first], start[last] + length


def _bucket(length: int):
    """Sort a whole bucket and name the byte ranges of its repeats in their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["one", "two", "from", "to"]
        got = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if got is None:
            return
        # buckets hold whole groups of equal leading bytes, so they may be worked on in slices between groups
        lead = got.column("lead").to_pylist()
        order = np.array(sorted(range(len(lead)), key=lead.__getitem__))
        got = got.take(pa.array(order))
        lead = [lead[i] for i in order]
        bodies, left = got.column("body").to_pylist(), got.column("left").to_numpy()
        one, two, first = (got.column(c).to_numpy() for c in ("one", "two", "first"))
        begin = 0
        while begin < len(lead):
            end = min(begin + BUCKET_RECORDS, len(lead))
            while end < len(lead) and lead[end] == lead[end - 1]:
                end += 1
            record, offset = repeated(bodies[begin:end], left[begin:end], length)
            record, low, high = spans(record + begin, left[record + begin] - offset, length)
            yield pa.RecordBatch.from_arrays([pa.array(one[record]), pa.array(two[record]), pa.array(first[record] + low), pa.array(first[record] + high)], names=names)
            begin = end

    return run


class Strings:
    """The different strings of some bodies, sorted, and where they are."""

    def __init__(self, bodies: list[bytes], length: int):
        many = np.array([len(b) - length + 1 for b in bodies])
        self.record = np.repeat(np.arange(len(bodies)), many)
        self.place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        begins = np.cumsum([0, *map(len, bodies)])[:-1]
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        matrix = np.lib.stride_tricks.sliding_window_view(raw, length)[begins[self.record] + self.place]
        order, new = sorted_strings(matrix)
        self.rows = matrix[order[new]]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1


def sorted_strings(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes by multikey quicksort, and which of them differ from the one before in that order."""
    size, length = matrix.shape
    if length % 8:
        matrix = np.pad(matrix, ((0, 0), (0, -length % 8)))
    words = np.ascontiguousarray(matrix).view(">u8").astype(np.uint64)
    order = multikey_order(words)
    new = np.ones(size, bool)
    for begin in range(1, size, 4096):
        some = order[begin - 1 : begin + 4096]
        new[begin : begin + 4096] = (words[some[1:]] != words[some[:-1]]).any(axis=1)
    return order, new


def places_of(splitters: Sequence[bytes], rows: np.ndarray) -> list[int]:
    """Where each splitter goes in sorted strings, with their begin and end."""
    return [0, *(bisect.bisect_left(range(len(rows)), s, key=lambda i: rows[i].tobytes()) for s in splitters), len(rows)]


def occur_twice(parts: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Which strings of sorted parts, one after the other, occur twice or more in all parts, or are known to. A range of
    strings is sorted at a time."""
    begins = np.cumsum([0, *map(len, parts)])
    ranges = -(-int(begins[-1]) // SORTED_STRINGS)
    some = sorted({r.tobytes() for p in parts for r in p[:: max(1, SORTED_STRINGS // 16)]} | {p[-1].tobytes() for p in parts if len(p)}) if ranges > 1 else []
    splitters = sorted({some[n * len(some) // ranges] for n in range(1, ranges)}) if some else []
    cuts = np.array([places_of(splitters, p) for p in parts])
    out = np.zeros(begins[-1], bool)
    for n in range(len(splitters) + 1):
        at = np.concatenate([np.arange(a, b) + begin for (a, b), begin in zip(cuts[:, n : n + 2], begins)])
        if not len(at):
            continue
        order, new = sorted_strings(np.concatenate([p[a:b] for p, (a, b) in zip(parts, cuts[:, n : n + 2])]))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        out[at] = (np.bincount(number, weights=1 + known[at]) > 1)[number]
    return out


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bodies in batch.column(0):
                rows = Strings(bodies.as_py(), length).rows
                some = rows[:: max(1, len(rows) // SLICE_SAMPLE)]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in some], pa.binary())], names=["string"])

    return run


def _ask(length: int, splitters: list[bytes]):
    """The different strings of each slice: a row (slice, bucket, strings, known) for every bucket that has any; known
    are those that the slice itself has twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(1, window_log=24)).compress
        for batch in batches:
            for name, owners, bodies in zip(batch.column(0), batch.column(1), batch.column(2)):
                strings = Strings(bodies.as_py(), length)
                copies = np.bincount(np.frombuffer(owners.as_py(), np.int64).reshape(-1, 4)[:, 3])
                known = np.bincount(strings.number, weights=copies[strings.record]) > 1
                cuts = places_of(splitters, strings.rows)
                some = [n for n in range(len(cuts) - 1) if cuts[n] < cuts[n + 1]]
                packed = [pack(strings.rows[cuts[n] : cuts[n + 1]].tobytes()) for n in some]
                flags = [np.packbits(known[cuts[n] : cuts[n + 1]]).tobytes() for n in some]
                columns = [pa.array([name.as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(packed, pa.binary()), pa.array(flags, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "bucket", "strings", "known"])

    return run


def _answer(length: int):
    """Which strings of a bucket occur twice or more, for each slice in the order in which it asked."""

    def run(asked: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        parts = [np.frombuffer(unpack(s.as_py()), np.uint8).reshape(-1, length) for s in asked.column("strings")]
        sizes = [len(p) for p in parts]
        known = np.concatenate([np.unpackbits(np.frombuffer(k.as_py(), np.uint8), count=n) for k, n in zip(asked.column("known"), sizes)])
        flags = [np.packbits(f).tobytes() for f in np.split(occur_twice(parts, known), np.cumsum(sizes)[:-1])]
        return pa.table({"slice": asked.column("slice"), "bucket": asked.column("bucket"), "number": pa.array(sizes, pa.int64()), "twice": pa.array(flags, pa.binary())})

    return run


def _owned(length: int):
    """Byte ranges of the repeated strings of each slice in its texts: one row per text of (owners, bodies, answers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owners, bodies, answers in zip(*(batch.column(i) for i in range(3))):
                strings = Strings(bodies.as_py(), length)
                answers = sorted(answers.as_py(), key=lambda a: a["bucket"])
                twice = np.concatenate([np.unpackbits(np.frombuffer(a["twice"], np.uint8), count=a["number"]) for a in answers]).astype(bool)
                there = twice[strings.number]
                record, low, high = spans(strings.record[there], strings.place[there], length)
                one, two, first, body = np.frombuffer(owners.as_py(), np.int64).reshape(-1, 4).T
                begin, end = np.searchsorted(record, body, "left"), np.searchsorted(record, body, "right")
                owner = np.repeat(np.arange(len(one)), end - begin)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + begin[owner]
                if not len(owner):
                    continue
                # texts follow each other, ranges of a text are joined
                text = np.cumsum(np.concatenate([[False], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))[owner]
                low, high = (first[owner] + low[at]) + (text << 40), (first[owner] + high[at]) + (text << 40)
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order])
                new = np.concatenate([[True], low[1:] > high[:-1]])
                last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
                low, high = low[new], high[last]
                text, where = np.unique(low >> 40, return_index=True)
                ranges = pa.StructArray.from_arrays([pa.array(low & (1 << 40) - 1), pa.array(high & (1 << 40) - 1)], ["from", "to"])
                ranges = pa.ListArray.from_arrays(pa.array(np.append(where, len(low)), pa.int32()), ranges)
                head = np.unique(np.cumsum(np.concatenate([[False], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])), return_index=True)[1][text]
                yield pa.RecordBatch.from_arrays([pa.array(one[head]), pa.array(two[head]), ranges], names=["one", "two", "ranges"])

    return run


def _hot_ranges(slices: DataFrame, length: int) -> DataFrame:
    """Byte ranges of the strings that occur twice or more in all slices (slice, owners, bodies, strings): one, two,
    ranges."""
    spark = slices.sparkSession
    total = slices.agg(F.sum("strings").alias("n")).first().n or 0
    buckets = -(-total // BUCKET_STRINGS)
    sampled = slices.select("bodies").mapInArrow(_sample(length), "string binary").orderBy(F.xxhash64("string")).limit(SAMPLE) if buckets > 1 else None
    some = sorted(bytes(r.string) for r in sampled.collect()) if buckets > 1 else []
    splitters = sorted({some[n * len(some) // buckets] for n in range(1, buckets)}) if some else []
    asked = slices.select("slice", "owners", "bodies").mapInArrow(_ask(length, splitters), "slice long, bucket int, strings binary, known binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer(length), "slice long, bucket int, number long, twice binary")
    answers = answered.groupBy("slice").agg(F.collect_list(F.struct("bucket", "number", "twice")).alias("answers"))
    both = slices.join(answers, "slice").select("owners", "bodies", "answers")
    return both.mapInArrow(_owned(length), "one long, two long, ranges array<struct<from: long, to: long>>")


def joined_spans(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges; ranges that touch are one run."""
    out: list[list[int]] = []
    for begin, end in sorted(zip(begins, ends)):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for begin, end in runs:
        parts.append(text[at:begin])
        at = end
    return b"".join([*parts, text[at:]])


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without bytes of UTF-8 characters that lie in them only in part."""
    out = []
    for begin, end in runs:
        while begin < end and text[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        out.append((begin, end))
    return out


def removed(length: int, keep: bool = False):
    """Column function of (copies, text, ranges) of :func:`removals`: n_removed, n_spans, kept_sha256; with ``keep`` also
    kept (UTF-8 bytes; a character that is removed only in part stays), removed_from and removed_to. NULL for no text."""
    kinds = [("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    kinds += [("kept", pa.binary()), ("removed_from", pa.list_(pa.int64())), ("removed_to", pa.list_(pa.int64()))] * keep
    schema = "n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary, removed_from array<long>, removed_to array<long>" if keep else ""

    def one(copies: int | None, text: bytes | None, ranges: list[dict] | None) -> dict | None:
        if text is None:
            return None
        if (copies or 1) > 1 and len(text) >= length:
            runs = [(0, len(text))]
        else:
            runs = joined_spans([r["from"] for r in ranges or []], [r["to"] for r in ranges or []])
        kept = without(text, runs)
        out = {"n_removed": sum(b - a for a, b in runs), "n_spans": len(runs), "kept_sha256": hashlib.sha256(kept).hexdigest()}
        if keep:
            out |= {"kept": without(text, whole_characters(text, runs)), "removed_from": [a for a, _ in runs], "removed_to": [b for _, b in runs]}
        return out

    @F.arrow_udf(schema)
    def run(copies: pa.Array, text: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array([one(c.as_py(), t.as_py(), r.as_py()) for c, t, r in zip(copies, text, ranges)], pa.struct(kinds))

    return run


def identity(text: Column) -> list[Column]:
    """Two digests that name a text."""
    return [F.xxhash64(text).alias("one"), F.crc32(text).alias("two")]


def removals(docs: DataFrame, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """For every different text of ``docs`` that has repeats: one, two (its digests), copies (how many texts are equal, if
    several are) and ranges (bytes of strings that occur elsewhere; they may overlap). See :func:`removed`.

    Two scans of ``docs``. Texts move once, to their anchors, records of repeated anchors once or twice; equal texts are
    folded first. What is here afterwards is the stored result; each step's tables and shuffles go with the next.
    """
    spark = docs.sparkSession
    text = docs.select(utf8().alias("text")).where(F.octet_length("text") >= length)
    rows = text.select(*identity(F.col("text")), "text")
    found = rows.mapInArrow(_find(length), "seed long, one long, two long, place long")
    # counts are stored before they are joined: only a join of two plain shuffles can split a frequent key
    counts = stored(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "seeds")
    places = found.join(counts, "seed").select("one", "two", (F.col("place") * 2 + (F.col("n") > often).cast("int")).alias("place"))
    places = places.groupBy("one", "two").agg(F.collect_set("place").alias("places"))
    folded = rows.groupBy("one", "two").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    cut = folded.join(places, ["one", "two"]).select("one", "two", "copies", "text", "places")
    schema = "kind int, one long, two long, first long, left int, body binary, owners binary, bodies array<binary>"
    records = stored(cut.mapInArrow(_records(length), schema), "suffixes", "kind")
    discard(counts)

    rare = records.where("kind = 0").withColumn("lead", F.expr(f"substring(body, left + 1, {SEED_BYTES})"))
    size = rare.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * 300 // BUCKET_BYTES))
    ranges = rare.select("one", "two", "first", "left", "body", "lead").repartitionByRange(buckets, "lead").mapInArrow(_bucket(length), "one long, two long, from long, to long")
    ranges = ranges.select("one", "two", F.array(F.struct("from", "to")).alias("ranges"))
    slices = records.where("kind = 1").select(F.col("one").alias("slice"), F.col("two").alias("strings"), "owners", "bodies")
    ranges = ranges.unionByName(_hot_ranges(slices, length)).withColumn("copies", F.lit(None).cast("long"))
    several = records.where("kind = 2").select("one", "two", F.col("first").alias("copies"))
    ranges = ranges.unionByName(several, allowMissingColumns=True)
    out = stored(ranges.groupBy("one", "two").agg(F.max("copies").alias("copies"), F.flatten(F.collect_list("ranges")).alias("ranges")), "repeats")
    discard(records)
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if it lies in a string of ``length`` bytes (of a text as UTF-8; a missing text is empty) that also
    starts at another place of any text, the same one included. All copies go, also the first; strings never cross
    texts and are judged on the input. Texts shorter than ``length`` stay whole. Repeated rows are two places each. A
    missing doc_id stays missing; other columns are not read.
    """
    found = removals(docs, length, often).withColumn("found", F.lit(True))
    rows = docs.select("doc_id", utf8().alias("text"))
    some = rows.select("doc_id", *identity(F.col("text")), "text").join(found, ["one", "two"], "left")
    cut = removed(length)("copies", F.when(F.col("found"), F.col("text")), "ranges")
    some = some.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("found").isNull(), F.sha2("text", 256)).alias("whole"), cut.alias("cut")
    )
    return some.select(
        "doc_id",
        "n_bytes",
        F.coalesce("cut.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut.n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("cut.kept_sha256", "whole").alias("kept_sha256"),
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
SQL: dict[str, str] = {}

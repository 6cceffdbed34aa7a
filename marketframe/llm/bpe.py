"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The frequent words of the corpus are compiled into an automaton that shares suffixes; its arcs carry numbers whose
sum along a word is the word's place, which points at the word's token ids. Tasks map the compiled file into
memory and walk it for the different words of many texts at once. Words that the automaton does not hold are merged by
the vocabulary's merge ranks, also many at once, so every word gets the ids the tokenizer file defines. A task remembers
what it resolved, so a repeated word costs one look-up in a table of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import chunks, read, stored, utf8
from marketframe.llm.tokens import word_bytes, words

#: Words that the automaton holds at most; its size and that of the broadcast are bounded by this.
LEXICON_WORDS = 50_000
#: Words longer than this (in UTF-8 bytes) are left to the merges.
LEXICON_BYTES = 64
#: Encoded words that a task remembers, and words it counts before it passes them on.
MEMO_WORDS = 200_000
COUNT_WORDS = 300_000
#: Characters of text whose words are resolved together.
CHUNK_CHARS = 500_000
#: Words of up to so many bytes are merged many at once, longer ones one by one with a heap.
SHORT_WORD = 48
NO_RANK = 1 << 62
NO_MERGE = np.int32(2**31 - 1)

#: Characters whose composition, case and class are settled; a text with others is normalised by the library.
UNUSUAL = regex.compile("[^\t\n\r -~ -ž‐-‧‰-⁞€]")


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Vocabulary:
    """Word splitting, exact merges and token strings of a tokenizer file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["unk_token"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("this tokenizer file is not byte-level BPE with word ends and plain joining of tokens")
        ids: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = {ids[a] << 20 | ids[b]: n for n, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        characters = byte_characters()
        self.bytes = {c: b for b, c in enumerate(characters)}
        self.of_byte = [ids[c] for c in characters]
        self.of_last = [ids[c + model["end_of_word_suffix"]] for c in characters]
        self.ranks = PairRanks(self.pairs)
        self.id_texts = {i: str(i) for i in self.tokens}

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special strings."""
        if UNUSUAL.search(text) is None:
            return self.pattern.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        split = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(self.bytes[c] for c in word).decode("utf-8") for word, _ in split]

    def parts(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """Words between special strings, and the special strings' ids."""
        if "<|" not in text:
            yield None, self.words(text)
            return
        for piece in self.at_special.split(text):
            if piece in self.special:
                yield self.special[piece], []
            elif piece:
                yield None, self.words(piece)

    def merge(self, word: str) -> list[int]:
        """Token ids of a word: always the pair of lowest rank first, the leftmost of equals."""
        raw = word.encode("utf-8")
        ids = [self.of_byte[b] for b in raw[:-1]]
        ids.append(self.of_last[raw[-1]])
        get, merged = self.pairs.get, self.merged
        size = len(ids)
        following = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = [(get(a << 20 | b, NO_RANK), i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        heapq.heapify(heap)
        while heap and heap[0][0] < NO_RANK:
            rank, i, a, b = heapq.heappop(heap)
            j = following[i]
            if ids[i] != a or j >= size or ids[j] != b:
                continue
            ids[i], ids[j] = merged[rank], -1
            after = following[i] = following[j]
            if after < size:
                before[after] = i
                heapq.heappush(heap, (get(ids[i] << 20 | ids[after], NO_RANK), i, ids[i], ids[after]))
            if before[i] >= 0:
                h = before[i]
                heapq.heappush(heap, (get(ids[h] << 20 | ids[i], NO_RANK), h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]


    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """What ``merge`` gives for each of these words (not empty): in each round every word merges its leftmost pair
        of lowest rank."""
        out: list[list[int]] = [[]] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.flatnonzero(length > SHORT_WORD):
            out[n] = self.merge(words[n].decode("utf-8"))
        merged = np.array(self.merged, np.int32)
        low = 0
        for high in (4, 8, 12, 16, 24, SHORT_WORD):
            row = np.flatnonzero((length > low) & (length <= high))
            low = high
            if not len(row):
                continue
            raw = np.frombuffer(b"".join(words[n].ljust(high, b"\0") for n in row.tolist()), np.uint8).reshape(-1, high)
            inside = np.arange(high) < length[row, None]
            ids = np.where(inside, np.array(self.of_byte, np.int32)[raw], -1)
            last = length[row] - 1
            at = np.arange(len(row))
            ids[at, last] = np.array(self.of_last, np.int32)[raw[at, last]]
            rank = np.full((len(row), high), NO_MERGE)
            rank[:, :-1] = self.ranks.get(ids[:, :-1], ids[:, 1:])
            columns = np.arange(high - 1)
            while len(row):
                best = rank.argmin(axis=1)
                at = np.arange(len(row))
                least = rank[at, best]
                done = least == NO_MERGE
                if done.any():
                    for n, values in zip(row[done].tolist(), ids[done].tolist()):
                        out[n] = values[: values.index(-1)] if values[-1] < 0 else values
                    ids, rank, row, best, least = (x[~done] for x in (ids, rank, row, best, least))
                    at = np.arange(len(row))
                    if not len(row):
                        break
                ids[at, best] = merged[least]
                # what follows the merged pair moves up by one
                source = columns + (columns > best[:, None])
                ids[:, :-1], rank[:, :-1] = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, columns + (columns >= best[:, None]), 1)
                ids[:, -1], rank[:, -1] = -1, NO_MERGE
                following = np.minimum(best + 1, high - 1)
                rank[at, best] = np.where(best < high - 1, self.ranks.get(ids[at, best], ids[at, following]), NO_MERGE)
                inner = np.flatnonzero(best > 0)
                rank[inner, best[inner] - 1] = self.ranks.get(ids[inner, best[inner] - 1], ids[inner, best[inner]])
        return out


class PairRanks:
    """Ranks of pairs of ids in tables that are looked up for many pairs at once."""

    def __init__(self, pairs: dict[int, int]):
        keys = np.fromiter(pairs, np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.tables = []
        seed = 1
        while len(keys) or not self.tables:
            self.factor = np.uint64(0x9E3779B97F4A7C15)
            place = self._place(keys, seed)
            _, first = np.unique(place, return_index=True)  # pairs whose place is taken go to the next table
            table = np.full(1 << 18, -1, np.int64), np.full(1 << 18, NO_MERGE)
            table[0][place[first]], table[1][place[first]] = keys[first], ranks[first]
            self.tables.append((seed, *table))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, seed = keys[rest], ranks[rest], seed + 2

    def _place(self, keys: np.ndarray, seed: int) -> np.ndarray:
        return ((keys.astype(np.uint64) + np.uint64(seed)) * (self.factor + np.uint64(seed << 20)) >> np.uint64(46)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        keys[(left < 0) | (right < 0)] = -2
        out = np.full(keys.shape, NO_MERGE)
        for seed, known, ranks in self.tables:
            place = self._place(keys, seed)
            hit = known[place] == keys
            out[hit] = ranks[place[hit]]
        return out


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Compile (word, ids) into the automaton's bytes. Words are added in order; a finished suffix that an earlier
    word already has is shared with it."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    path: list[tuple[list, list[tuple[int, int]]]] = [([False], [])]
    previous = b""

    def settle(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            key = (final[0], tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append((final[0], arcs))
            path[-1][1].append((previous[len(path) - 1], register[key]))

    for word, _ in entries:
        common = len(os.path.commonprefix([word, previous]))
        settle(common)
        for _ in word[common:]:
            path.append(([False], []))
        path[-1][0][0] = True
        previous = word
    settle(0)
    states.append((path[0][0][0], path[0][1]))
    below = np.zeros(len(states), np.int64)
    first = np.zeros(len(states) + 1, np.int32)
    labels, targets, outputs = [], [], []
    for n, (final, arcs) in enumerate(states):
        passed = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            outputs.append(passed)
            passed += int(below[target])
        below[n] = passed
        first[n + 1] = len(labels)
    final = np.array([f for f, _ in states], np.uint8)
    ids = [i for _, i in entries]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    flat = np.array([x for i in ids for x in i], np.int32)
    head = np.array([len(states), len(labels), len(ids), len(flat)], np.int64)
    arrays = (head, first, np.array(targets, np.int32), np.array(outputs, np.int32), starts, flat, final, np.array(labels, np.uint8))
    return b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The compiled automaton, mapped into memory."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(compiled)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, words, flat = (int(x) for x in np.frombuffer(self.map, np.int64, 4))
        at = 32
        views = []
        for kind, size in ((np.int32, states + 1), (np.int32, arcs), (np.int32, arcs), (np.int32, words + 1), (np.int32, flat)):
            views.append(memoryview(np.frombuffer(self.map, kind, size, at)))
            at += size * 4
        self.first, self.targets, self.outputs, self.starts, self.ids = views
        self.final = self.map[at : at + states]
        self.labels = self.map[at + states : at + states + arcs]
        self.root = states - 1
        # arcs leave a state in order of their labels, so (state, label) is sorted over all arcs
        self.arcs = np.repeat(np.arange(states), np.diff(np.array(self.first))) << 8 | np.frombuffer(self.labels, np.uint8)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, or -1: all words walk the automaton a byte at a time."""
        targets, outputs, final, arcs = np.array(self.targets), np.array(self.outputs), np.frombuffer(self.final, np.uint8), self.arcs
        length = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(length) - length
        raw = np.frombuffer(b"".join(words), np.uint8)
        out = np.full(len(words), -1, np.int64)
        row, state, place, depth = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64), 0
        while len(row):
            ended = length[row] == depth
            out[row[ended]] = np.where(final[state[ended]] == 1, place[ended], -1)
            row, state, place = row[~ended], state[~ended], place[~ended]
            key = state << 8 | raw[begin[row] + depth]
            arc = np.minimum(np.searchsorted(arcs, key), max(len(arcs) - 1, 0))
            there = arcs[arc] == key if len(arcs) else np.zeros(len(row), bool)
            arc = arc[there]
            row, state, place = row[there], targets[arc].astype(np.int64), place[there] + outputs[arc]
            depth += 1
        return out

    def get_many(self, words: list[bytes]) -> list[list[int] | None]:
        return [self.ids[self.starts[p] : self.starts[p + 1]].tolist() if p >= 0 else None for p in self.places(words).tolist()]

    def get(self, word: bytes) -> list[int] | None:
        return self.get_many([word])[0]


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each run of letters, digits and non-ASCII characters occurs in all texts, A-Z lower-cased: hash, n, and
    word where the run occurs twice or more in one step of a task. A run has rows from several tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_bytes("alnum")
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        strings: dict[int, str] = {}

        def out() -> pa.RecordBatch:
            code, where = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
            names = [strings.get(c) for c in code.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n), pa.array(names, pa.string())], names=["hash", "n", "word"])

        for _, texts in chunks(batches):
            w = words(texts, table)
            code, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            often = np.flatnonzero((n > 1) & (w.end[first] - w.start[first] <= LEXICON_BYTES))
            joined = b"\n".join(texts)
            for c, a, b in zip(code[often].tolist(), w.start[first[often]].tolist(), w.end[first[often]].tolist()):
                strings[c] = joined[a:b].lower().decode("utf-8")
            hashes.append(code)
            counts.append(n)
            if sum(map(len, hashes)) > COUNT_WORDS:
                yield out()
                hashes, counts, strings = [], [], {}
        if hashes:
            yield out()

    return docs.select(utf8().alias("text")).mapInArrow(count, "hash long, n long, word string")


def lexicon(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> bytes:
    """The automaton of the most frequent words of ``docs``: all above the least count that at most ``most`` reach."""
    rows = stored(word_counts(docs), "words")
    counts = stored(rows.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1"), "counts")
    level = F.floor(F.log2("n") * 32)
    found, least = 0, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred levels
        found += row["count"]
        if found > most:
            break
        least = row.level
    top = counts.where(level >= least).select("hash") if least is not None else counts.limit(0).select("hash")
    # at most ``most`` hashes: few enough to go to every task
    named = rows.where("word is not null").join(F.broadcast(top), "hash").select("word").distinct().collect()
    vocabulary_ = vocabulary(path)
    known = sorted({w for r in named for w in vocabulary_.words(r.word)})
    raw = [w.encode("utf-8") for w in known]
    return compile_lexicon(zip(raw, vocabulary_.merge_many(raw)))


class Encoder:
    """Ids of whole texts from the mapped automaton, with merges for the words it lacks."""

    def __init__(self, path: str, compiled: bytes):
        self.vocabulary = vocabulary(path)
        self.lexicon = Lexicon(compiled)
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def _resolve(self, words: list[str]) -> None:
        """Remember ids and token strings of these words, each joined by one space."""
        raw = [w.encode("utf-8") for w in words]
        found = self.lexicon.get_many(raw)
        missing = [n for n, ids in enumerate(found) if ids is None]
        for n, ids in zip(missing, self.vocabulary.merge_many([raw[n] for n in missing])):
            found[n] = ids
        numbers, tokens = self.vocabulary.id_texts, self.vocabulary.tokens
        for word, ids in zip(words, found):
            self.ids[word] = " ".join([numbers[i] for i in ids])
            self.tokens[word] = " ".join([tokens[i] for i in ids])

    def encode_many(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, decimal ids and token strings of each text, each joined by one space."""
        parts = [list(self.vocabulary.parts(text)) for text in texts]
        if len(self.ids) >= MEMO_WORDS:
            self.ids, self.tokens = {}, {}
        new: set[str] = set()
        for pieces in parts:
            for _, words in pieces:
                new.update(words)
        self._resolve([w for w in new if w not in self.ids])
        out = []
        ids_of, tokens_of = self.ids.__getitem__, self.tokens.__getitem__
        for pieces in parts:
            ids: list[str] = []
            tokens: list[str] = []
            for special, words in pieces:
                if special is not None:
                    ids.append(str(special))
                    tokens.append(self.vocabulary.tokens[special])
                ids.extend(map(ids_of, words))
                tokens.extend(map(tokens_of, words))
            joined = " ".join(ids)
            out.append((joined.count(" ") + 1 if joined else 0, joined, " ".join(tokens)))
        return out


def slices(texts: list[str], size: int) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters; a longer text is a run of its own."""
    some: list[str] = []
    held = 0
    for text in texts:
        if some and held + len(text) > size:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some


def encoded(docs: DataFrame, path: str, words: int = LEXICON_WORDS, ids: bool = False, decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; also ids
    (array) and decoded (text) where asked for.

    ``path`` is a byte-level BPE file with word ends that every executor has. Special strings in a text become their
    ids, no others are added; decoding keeps them. A missing text is empty: no tokens, the digests of nothing. A
    missing doc_id stays missing, repeated rows are encoded each, other columns are not read. Two scans: one counts
    words (pre-aggregated in the tasks), one encodes; texts are never shuffled. The broadcast automaton holds
    ``words`` words of at most ``LEXICON_BYTES`` bytes, whatever the corpus.
    """
    compiled = docs.sparkSession.sparkContext.broadcast(lexicon(docs, path, words))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Encoder(path, compiled.value)
        for batch in batches:
            counts, ids_digests, decoded_digests, ids_list, decoded_list = [], [], [], [], []
            texts = (t for part in slices([x or "" for x in batch.column(1).to_pylist()], CHUNK_CHARS) for t in kept.encode_many(part))
            for n, numbers, tokens in texts:
                counts.append(n)
                ids_digests.append(hashlib.sha256(numbers.encode()).hexdigest())
                decoded_digests.append(hashlib.sha256(tokens.encode("utf-8")).hexdigest())
                if ids:
                    ids_list.append(np.array(numbers.split(), np.int32))
                if decoded:
                    decoded_list.append(tokens)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded_digests, pa.string())]
            columns += [pa.array(ids_list, pa.list_(pa.int32()))] * ids + [pa.array(decoded_list, pa.string())] * decoded
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * decoded)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * ids + ", decoded string" * decoded
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_bpe_encoding": op3_bpe_encoding}
SQL: dict[str, str] = {}

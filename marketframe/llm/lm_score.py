"""Stupid-backoff language-model scores of documents, with counts from all documents.

The plan is a join of exploded n-grams with count tables partitioned by hash, in packed form: an n-gram row of
(hash, document) would take many times the texts' own bytes. Documents fall into groups of some megabytes; a group
sends each of its different n-grams once (sorted hashes, their counts in the group) to the partition of the hash,
which sums over all groups and answers with the totals in the same order. The group then looks its n-grams up and
sums per document. So what is gathered follows the input, a frequent n-gram is one entry per group, and no task holds
more than a group or a hash partition.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import tokens
from marketframe.llm.common import read, utf8

ORDER = 2
ALPHA = 0.4
#: Longer n-grams that occur less often back off, so a document's own single occurrences do not carry it.
MIN_COUNT = 2
GROUP_BYTES = 8_000_000
#: Bytes of text whose n-grams one hash partition sums. A group has a row for each partition that it has n-grams of.
PART_BYTES = 32_000_000
#: Entry whose count is the number of words.
ALL_WORDS = np.uint64(1)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def codes(w: tokens.Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order its n-grams' hashes by first word, and which lie in one text."""
    out = []
    for n in range(1, order + 1):
        code, whole = tokens.grams(w, n)
        out.append((tokens.mix(code ^ np.uint64(n << 60)), whole))
    return out


def _parts(number: int) -> np.ndarray:
    """First hash of each of ``number`` equal ranges."""
    return np.array([(p << 64) // number for p in range(number)], np.uint64)


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [t.as_py() for t in column]


def _ask(parts: int, order: int):
    """Different n-grams of a group: a row for each hash partition that it has any of."""

    def ask(group: pa.Table) -> pa.Table:
        w = tokens.words(_texts(group.column("_text")), tokens.word_bytes("black"))
        found = [code[whole] for code, whole in codes(w, order)]
        value, count = np.unique(np.concatenate(found), return_counts=True)
        value, count = np.append(ALL_WORDS, value), np.append(len(w.hash), count)
        sort = np.argsort(value, kind="stable")
        value, count = value[sort], count[sort].astype(np.uint64)
        cuts = np.append(np.searchsorted(value, _parts(parts)), len(value))
        some = np.flatnonzero(np.diff(cuts))
        return pa.table(
            {
                "_part": pa.array(some, pa.int64()),
                "_group": pa.array(np.full(len(some), group.column("_group")[0].as_py()), pa.int64()),
                "_grams": pa.array([pack_sorted(value[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()),
                "_counts": pa.array([pack(count[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()),
            }
        )

    return ask


def _total(part: pa.Table) -> pa.Table:
    """Counts over all groups of one hash partition, for each group in the order in which it asked."""
    asked = [unpack_sorted(x.as_py()) for x in part.column("_grams")]
    given = [unpack(x.as_py()) for x in part.column("_counts")]
    value, where = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(len(value), np.uint64)
    np.add.at(total, where, np.concatenate(given))
    answers = np.split(total[where], np.cumsum([len(a) for a in asked])[:-1])
    return pa.table({"_group": part.column("_group"), "_part": part.column("_part"), "_totals": pa.array([pack(a) for a in answers], pa.binary())})


def _score(carried: list[str], order: int, alpha: float, min_count: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _texts(docs.column("_text"))
        w = tokens.words(texts, tokens.word_bytes("black"))
        grams = codes(w, order)
        value = np.unique(np.concatenate([code[whole] for code, whole in grams]))
        value = np.sort(np.append(ALL_WORDS, value))
        rows = sorted(zip(answers.column("_part").to_pylist(), answers.column("_totals").to_pylist()))
        total = np.concatenate([unpack(data) for _, data in rows])
        if len(total) != len(value):
            raise ValueError("the n-grams of a group differ from those it asked for")
        words = float(total[np.searchsorted(value, ALL_WORDS)])
        n = len(w.hash)
        counts = []
        for code, whole in grams:
            count = np.zeros(n, np.float64)
            count[: len(code)][whole] = total[np.searchsorted(value, code[whole])]
            counts.append(count)
        n_words = np.bincount(w.owner, minlength=len(texts))
        at = np.arange(n) - (np.cumsum(n_words) - n_words)[w.owner] if n else np.empty(0, np.int64)
        longest = np.minimum(at + 1, order)
        with np.errstate(divide="ignore"):
            logs = np.log(counts[0]) - math.log(words or 1) + (longest - 1) * math.log(alpha)
        level = np.ones(n, np.int64)
        for k in range(2, order + 1):  # longer n-grams override shorter ones
            seen = np.flatnonzero((longest >= k) & (np.roll(counts[k - 1], k - 1) >= min_count))
            start = seen - k + 1
            logs[seen] = np.log(counts[k - 1][start]) - np.log(counts[k - 2][start]) + (longest[seen] - k) * math.log(alpha)
            level[seen] = k
        out = {name: docs.column(name) for name in carried}
        out["n_words"] = pa.array(n_words, pa.int64())
        out["n_backoff"] = pa.array(np.bincount(w.owner[level < longest], minlength=len(texts)), pa.int64())
        out["log_score"] = pa.array(np.bincount(w.owner, weights=logs, minlength=len(texts)), pa.float64())
        return pa.table(out)

    return score


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_backoff, log_score, mean_score.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; n-grams up to ``order`` are counted
    over all documents. A word's score is count(n-gram) / count(its first n-1 words) for the longest n-gram ending
    there that occurs ``min_count`` times or more, times ``alpha`` for each order given up; at last count(word) /
    number of words. log_score sums the natural logarithms, mean_score divides by n_words, n_backoff counts words
    scored by less than the longest n-gram. A text without words (also a missing one) has log_score 0 and no
    mean_score; repeated rows count and are scored each; other columns are not read.

    Documents are dealt to groups by id, text and place in the input, so that repeated rows spread; one very long text
    makes its group larger by itself.
    """
    rows = docs.select("doc_id", utf8().alias("_text"))
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    groups = max(1, math.ceil(size / group_bytes))
    parts = max(1, math.ceil(size / PART_BYTES))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("doc_id", "_text", F.monotonically_increasing_id()), F.lit(groups))).repartition(groups, "_group")
    asked = rows.groupBy("_group").applyInArrow(_ask(parts, order), "_part long, _group long, _grams binary, _counts binary")
    answers = asked.groupBy("_part").applyInArrow(_total, "_group long, _part long, _totals binary")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_backoff long, log_score double"
    scored = rows.groupBy("_group").cogroup(answers.groupBy("_group")).applyInArrow(_score(["doc_id"], order, alpha, min_count), schema)
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_score", 5).alias("log_score"), F.round("mean_score", 7).alias("mean_score"))


QUERIES = {"op2_lm_score": op2_lm_score}
SQL: dict[str, str] = {
    "op2_lm_score": """
with docs as (
    select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), words as (
    select r, unnest(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as w,
           generate_subscripts(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1) as i
    from docs
), pairs as (
    select r, i, w, lag(w) over (partition by r order by i) as p from words
), uni as (select w, count(*)::double as c from words group by w),
bi as (select p, w, count(*)::double as c from pairs where p is not null group by p, w),
total as (select count(*)::double as n from words),
scored as (
    select r, p is not null and coalesce(bi.c, 0) < 2 as backed,
           case when bi.c >= 2 then ln(bi.c) - ln(prev.c) when p is null then ln(uni.c) - ln(n) else ln(uni.c) - ln(n) + ln(0.4) end as s
    from pairs join uni using (w) cross join total left join bi using (p, w) left join uni as prev on prev.w = pairs.p
), sums as (select r, count(*) as n_words, count(*) filter (backed) as n_backoff, sum(s) as log_score from scored group by r)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_backoff, 0) as n_backoff, round(coalesce(log_score, 0), 5) as log_score, round(log_score / n_words, 7) as mean_score
from docs left join sums using (r)
"""
}

"""Text operators against brute force, the tokenizers library and SQL, on a table full of edge cases."""

import hashlib
import random


import duckdb
import numpy as np
import pandas as pd
import pytest
import public_tokenizers
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketframe.llm import bpe, decontaminate, lm_score, quality, simhash, suffix_dedup, token_counts

from . import brute
from .conftest import BENCHMARK, as_sorted, prose

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_token_counts(docs, rows, nothing):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = []
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert as_sorted(token_counts.token_counts(docs, BYTE_BPE)) == sorted(want, key=repr)
    assert as_sorted(token_counts.token_counts(docs, BYTE_BPE, piece_chars=100, call_chars=1000)) == sorted(want, key=repr)
    assert token_counts.token_counts(nothing, BYTE_BPE).count() == 0


def test_pieces_encode_as_the_whole(rows):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    for _, text in rows:
        parts = list(token_counts.pieces((text or "")[:20_000], 40))
        assert "".join(parts) == (text or "")[:20_000]
        assert [i for p in parts for i in tokenizer.encode(p).ids] == tokenizer.encode((text or "")[:20_000]).ids


def test_bpe_equals_the_library(docs, rows, nothing):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert as_sorted(bpe.encoded(docs, WORD_BPE, words=200, ids=True, decoded=True)) == sorted(want, key=repr)
    assert bpe.encoded(nothing, WORD_BPE).count() == 0


def test_lexicon_is_exact_and_shares_suffixes():
    stems = ["walk", "talk", "call", "form", "warm"]
    words = [s + e for s in stems for e in ("", "s", "ed", "ing", "er", "ers")]
    lexicon = bpe.Lexicon(bpe.compile_lexicon((w.encode(), [n, n + 1]) for n, w in enumerate(words)))
    assert all(lexicon.get(w.encode()) == [n, n + 1] for n, w in enumerate(words))
    assert [lexicon.get(w) for w in (b"", b"wal", b"walke", b"walkx", b"zz")] == [None] * 5
    assert len(lexicon.final) < 25 < len({w[:n] for w in words for n in range(len(w) + 1)})
    assert bpe.Lexicon(bpe.compile_lexicon([])).get(b"a") is None


def test_merges_agree_for_long_words():
    vocabulary = bpe.vocabulary(WORD_BPE)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for word in ("thethethe" * 3, "thandenwhere" * 40, "x" * 500):
        assert vocabulary.merge(word) == tokenizer.encode(word).ids


def test_merges_of_many_words_agree():
    vocabulary = bpe.vocabulary(WORD_BPE)
    rng = random.Random(9)
    words = [prose(rng, 1) for _ in range(3000)] + ["".join(rng.choices("abcé日", k=n)) for n in range(1, 60)] + ["a", "é", "!!!", "aaaa" * 12, "aaaa" * 13]
    assert vocabulary.merge_many([w.encode() for w in words]) == [vocabulary.merge(w) for w in words]
    assert vocabulary.merge_many([]) == []


@pytest.mark.parametrize("often", [2, 256])
def test_suffix_dedup(docs, rows, nothing, often):
    short = [r for r in rows if len(r[1] or "") < 50_000]
    some = docs.where("text is null or length(text) < 50000")
    assert as_sorted(suffix_dedup.deduplicated(some, often=often)) == brute.repeats(short)
    assert as_sorted(suffix_dedup.deduplicated(some, length=41, often=often)) == brute.repeats(short, 41)
    assert suffix_dedup.deduplicated(nothing).count() == 0


def test_suffix_dedup_over_the_steps_of_a_long_text(spark):
    rng = np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(97, 123, 1_200_000)))
    at = [suffix_dedup.STEP - 100, 700_000, 2 * suffix_dedup.STEP - 350]
    frame = spark.createDataFrame([(1, text)] + [(n, "#" + text[a : a + 250] + "#") for n, a in enumerate(at, 2)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.deduplicated(frame).collect()}
    assert got == {1: (750, 3), 2: (250, 1), 3: (250, 1), 4: (250, 1)}


def test_multikey_order_and_common_bytes():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (300, 32)).astype(np.uint8)
    words = rows.view(">u8").astype(np.uint64)
    order = suffix_dedup.multikey_order(words)
    plain = [bytes(r) for r in rows]
    assert [plain[i] for i in order] == sorted(plain)
    shared = suffix_dedup.common_bytes(words[order])
    for n in range(1, 300):
        a, b = plain[order[n - 1]], plain[order[n]]
        assert shared[n] == next((k for k in range(32) if a[k] != b[k]), 32)


def test_decontamination(docs, rows, nothing, benchmark):
    want = brute.contamination(rows, BENCHMARK)
    columns = ["doc_id", "n_words", "n_hit", "items"]
    assert as_sorted(decontaminate.matches(docs, benchmark).select(columns)) == want
    assert as_sorted(decontaminate.matches(docs, benchmark, block_bytes=1).select(columns)) == want
    assert as_sorted(decontaminate.matches(docs, benchmark, window=3).select(columns)) == brute.contamination(rows, BENCHMARK, 3)
    assert decontaminate.matches(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.matches(nothing, benchmark).count() == 0


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "x y one two three four five z one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "zero one two three four five six")], "item_id long, text string")
    row = decontaminate.matches(docs, items, window=3).first()
    assert (row.longest_words, row.longest_item, row.longest_at, row.n_hit) == (5, "7", 2, 8)


def test_simhash(docs, rows, nothing):
    assert as_sorted(simhash.near_duplicates(docs)) == brute.components(rows)
    assert simhash.near_duplicates(nothing).count() == 0


def test_anchors_cover_and_lose_no_link(spark):
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    assert np.bitwise_count(simhash.anchors(words) ^ words).max() <= 7
    chain = [words[:30]]
    for _ in range(6):
        step = chain[-1].copy()
        for _ in range(2):
            step ^= np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)
        chain.append(step)
    fps = np.unique(np.concatenate([*chain, words]))
    got = simhash.components(simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")))
    roots = {r.node: r.root for r in got.collect()}
    label = {int(x): int(x) for x in fps.view(np.int64)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    while True:
        new = {}
        for n, x in enumerate(fps.view(np.int64).tolist()):
            new[x] = min(label[int(y)] for y in fps.view(np.int64)[near[n]])
        if new == label:
            break
        label = new
    assert {x: roots.get(x, x) for x in label} == label


def test_lm_scores_equal_sql(docs, rows, nothing):
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(lm_score.SQL["op2_lm_score"]).fetchall()
    for size in (8_000_000, 20_000):
        got = lm_score.lm_scores(docs, group_bytes=size)
        got = got.select("doc_id", "n_words", "n_backoff", F.round("log_score", 5), F.round("mean_score", 7))
        assert as_sorted(got) == sorted(want, key=repr)
    assert lm_score.lm_scores(nothing).count() == 0


def test_lm_backs_off_over_three_orders(spark):
    docs = spark.createDataFrame([(1, "a b c a b c a b"), (2, "a b d")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.lm_scores(docs, order=3).collect()}
    # a: 4 of 11; b after a: 4/4; d: seen once, so the unigram after two orders given up
    want = np.log(4 / 11) + np.log(4 / 4) + 2 * np.log(0.4) + np.log(1 / 11)
    assert got[2].log_score == pytest.approx(want)
    assert got[2].n_backoff == 1


def test_quality_held_out(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    got = quality.op8_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.5) == got.predicted.astype(bool)).all()
    assert (got.predicted == got.quality).mean() > 0.95
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_quality_edges(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(n, n % 2, "x") for n in range(1, 90)] + [(None, 1, "x"), (5, None, "x"), (5, 0, "x")], "doc_id long, quality int, score string")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(nothing, labels).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    labels = spark.createDataFrame([(n, 1) for n in range(1, 90)], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(quality.held_out(), 0).otherwise(F.col("quality")).cast("int"))
    assert as_sorted(quality.quality_scores(docs, labels)) == as_sorted(quality.quality_scores(docs, other))


def test_estimated_prior():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (2000, 3))
    unlabelled = np.concatenate([rng.normal(2, 1, (1400, 3)), rng.normal(-2, 1, (600, 3))])
    assert quality.estimated_prior(positive, unlabelled) == pytest.approx(0.7, abs=0.06)


def test_suffix_dedup_of_a_hot_passage(spark, monkeypatch):
    """Thousands of texts share passages, each in surroundings of its own, over several slices and buckets of strings."""
    monkeypatch.setattr(suffix_dedup, "SLICE_STRINGS", 20_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_STRINGS", 30_000)
    rng = random.Random(8)
    passage, line = prose(rng, 80), prose(rng, 45)
    rows = [(n, f"{prose(rng, n % 40)} {passage if n % 3 else line} {prose(rng, (n * 7) % 30)}{'' if n % 50 else passage}") for n in range(3000)]
    rows += [(5000, passage), (5001, passage[:199]), (5002, passage[5:205] + "\x00"), (5003, passage[5:205] + "\x00")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_sorted(suffix_dedup.deduplicated(frame)) == brute.repeats(rows)

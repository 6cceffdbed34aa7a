"""The corpus pipeline against brute-force versions of its stages, and its registration."""

import hashlib
import itertools

import numpy as np
import public_tokenizers
from conftest import SMALL
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from marketframe.llm import quality
from marketframe.llm.common import read, stored

from . import brute
from .conftest import BENCHMARK, as_sorted
from .test_similar import shingle_set


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def similar_rows(rows):
    """Groups of rows whose sets of five-word shingles have a similarity of 0.8 or more, over any number of links."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if root[a] != root[b] and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y):
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    groups = {}
    for row, r in zip(rows, root):
        groups.setdefault(r, []).append(row)
    return list(groups.values())


def check_stages(spark, docs, benchmark, labels, folder):
    columns = docs.columns
    kept = rows_of(docs)
    model = quality.learn(docs.select("doc_id", "text"), labels)
    x = quality.features([(t or "").encode() for _, t in kept])
    scores = model.score(model.mean + np.clip((x - model.mean) / model.scale, -8, 8) * model.scale)
    kept = [row for row, s in zip(kept, scores) if s >= 0.5]
    out = stored(corpus_pipeline.keep_quality(spark, docs, folder), "t")
    assert sorted(rows_of(out), key=repr) == sorted(kept, key=repr)
    assert out.columns == columns

    out = stored(dict(corpus_pipeline.STAGES)["near_duplicates"](spark, out, folder), "t")
    got = rows_of(out)
    left = list(got)
    for group in similar_rows(kept):
        # one row of each group stays, of those with the smallest id; rows without one come last
        least = min((i is None, i or 0) for i, _ in group)
        first = [row for row in left if row in group]
        assert len(first) == 1 and (first[0][0] is None, first[0][0] or 0) == least
        left.remove(first[0])
    assert not left
    assert out.columns == columns

    kept = [(i, None if t is None else brute.whole_characters(t, runs)) for (i, t), (_, runs) in zip(got, brute.repeat_runs([t for _, t in got]))]
    out = stored(corpus_pipeline.remove_repeats(spark, out, folder), "t")
    assert sorted(rows_of(out), key=repr) == sorted(kept, key=repr)
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None and r.n_chars is not None)
    assert out.columns == columns

    hits = {}
    for row, found in zip(kept, [brute.contamination([row], benchmark)[0] for row in kept]):
        hits[row] = found[2]
    kept = [row for row in kept if not hits[row]]
    out = stored(corpus_pipeline.remove_benchmark(spark, out, folder), "t")
    assert sorted(rows_of(out), key=repr) == sorted(kept, key=repr)
    assert out.columns == columns

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in kept:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), ids))
    out = corpus_pipeline.encode(spark, out, folder)
    assert as_sorted(out.select("doc_id", "n_tokens", "ids_sha256", "ids")) == sorted(want, key=repr)
    return want


def test_pipeline_on_documents(spark):
    benchmark = [tuple(r) for r in read(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    want = check_stages(spark, read(spark, SMALL, "documents"), benchmark, read(spark, SMALL, "labels"), SMALL)
    got = corpus_pipeline.run(spark, SMALL)
    assert as_sorted(got.select("doc_id", "n_tokens", "ids_sha256", "ids")) == sorted(want, key=repr)


def test_pipeline_on_edge_cases(spark, docs, benchmark, tmp_path):
    folder = str(tmp_path)
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(n, 1, 0) for n in range(50, 90)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    check_stages(spark, docs.where("text is null or length(text) < 50000"), BENCHMARK, labels, folder)


def test_pipeline_on_nothing(spark, nothing, benchmark, tmp_path):
    folder = str(tmp_path)
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.count() == 0


def test_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None

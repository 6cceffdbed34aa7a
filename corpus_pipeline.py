"""Cleaning of a document table for training: quality, near-duplicates, repeated passages, benchmark text, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever these are; columns that a stage adds for
itself never clash with them. Missing ids and texts, empty tables and repeated rows pass as each stage says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import bpe, decontaminate, quality, similar, simhash, suffix_dedup
from marketframe.llm.common import read, stored, utf8


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns c0, c1, ... and, beside them, doc_id and text."""
    names = [f"c{n}" for n in range(len(docs.columns))]
    inner = docs.toDF(*names)
    place = {name: names[docs.columns.index(name)] for name in ("doc_id", "text")}
    return inner.withColumns({name: F.col(column) for name, column in place.items()}), names


def _text(docs: DataFrame) -> str:
    return f"c{docs.columns.index('text')}"


def _restored(inner: DataFrame, docs: DataFrame) -> DataFrame:
    return inner.select(*[F.col(f"c{n}").alias(name) for n, name in enumerate(docs.columns)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from the labels of this data, does not reject."""
    inner, names = _numbered(docs)
    model = quality.learn(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return _restored(quality.scored(inner, model, names, _text(docs)).where("predicted = 1"), docs)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str, find: Callable[[DataFrame], DataFrame] = simhash.near_duplicates) -> DataFrame:
    """Of each group of near-duplicates one row: the smallest doc_id, rows without one last, then by text and the other
    columns. Rows are told apart by all their columns, so ids may repeat or be missing."""
    inner, names = _numbered(docs)
    values = [F.col(c).cast("string") for c in names]
    missing = [F.col(c).isNull() for c in names]
    inner = inner.withColumns({"one": F.xxhash64(F.lit(1), *values, *missing), "two": F.xxhash64(F.lit(2), *missing, *values)})
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64(utf8()).alias("text"), "one", "two")
    groups = find(inner.select(row.alias("doc_id"), "text"))
    first = groups.where("doc_id.one = component_id.one and doc_id.two = component_id.two").select("doc_id.one", "doc_id.two").distinct()
    kept = inner.join(first, ["one", "two"], "left_semi").groupBy("one", "two").agg(F.first(F.struct(*names)).alias("row"))
    return _restored(kept.select("row.*"), docs)


def alike(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable) over the links of both operators: fingerprints that differ in
    two or fewer bits, and five-word shingles with a similarity of 0.8 or more. ``doc_id`` names a row, it is never
    missing; equal rows come once."""
    near = simhash.near_duplicates(docs).select("doc_id", F.col("component_id").alias("print")).distinct()
    both = stored(similar.groups(docs).distinct().join(near, "doc_id"), "alike")
    # groups of the exact join that fingerprints connect: an edge from each to the smallest with the same fingerprint group
    least = both.groupBy("print").agg(F.min("component_id").alias("b"))
    edges = both.select("print", F.col("component_id").alias("a")).distinct().join(least, "print").where("a <> b").select("a", "b")
    roots = simhash.components(edges)
    return both.join(roots, both.component_id == roots.node, "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that are alike by operator 7 or by similarity one row, as above."""
    return keep_one_of_group(spark, docs, sf_dir, alike)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the characters that lie wholly in strings of 200 bytes occurring elsewhere; n_chars follows."""
    inner, names = _numbered(docs)
    found = suffix_dedup.removals(docs.select("doc_id", "text")).withColumn("found", F.lit(True))
    place = {name: f"c{docs.columns.index(name)}" for name in ("text", "n_chars") if name in docs.columns}
    joined = inner.withColumns(dict(zip(("one", "two"), suffix_dedup.identity(utf8())))).join(found, ["one", "two"], "left")
    cut = suffix_dedup.removed(suffix_dedup.LENGTH, keep=True)("copies", F.when(F.col("found"), utf8()), "ranges")
    joined = joined.withColumn("cut", cut).withColumn("kept", F.col("cut.kept").cast("string"))
    changed = {place["text"]: F.coalesce("kept", "text")}
    if "n_chars" in place:
        column = F.col(place["n_chars"])
        changed[place["n_chars"]] = F.when(F.col("kept").isNull(), column).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return _restored(joined.withColumns(changed), docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    inner, names = _numbered(docs)
    return _restored(decontaminate.matches(inner, read(spark, sf_dir, "benchmark"), names, text=_text(docs)).where("n_hit = 0"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_similar),
    ("repeats", remove_repeats),
    ("benchmark", remove_benchmark),
    ("tokens", encode),
]

#: SQL can express neither the learned model nor the fingerprints; tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}

"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; the rest is unlabelled web text. A linear model minimises the
non-negative unbiased risk: prior * loss of positives + max(0, loss of unlabelled as negatives - prior * loss of
positives as negatives). The class prior is estimated from both samples, the model is fitted on bounded samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.llm import tokens
from marketframe.llm.common import chunks, read, utf8

#: Rows of each sample (positives, unlabelled) that the model is fitted on at most.
SAMPLE_ROWS = 12_000
STEPS = 600
BLOCK = 256
_SINGLE = b" \n.,;:!?'\"()-/|#%&*$@<>=_+[]{}\\~^"
_CLASSES = len(_SINGLE) + 6


def _classes() -> np.ndarray:
    """Class of each byte: lower case, upper case, digit, non-ASCII, control, other, then single characters."""
    out = np.full(256, 5, np.int64)
    out[:32] = 4
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 3
    for n, byte in enumerate(_SINGLE):
        out[byte] = 6 + n
    return out


CLASSES = _classes()
NAMES = 2 * _CLASSES + 12


def features(texts: list[bytes]) -> np.ndarray:
    """Row of features of each text: shares of byte classes in the whole text and the largest in any block of it, word
    and line statistics. An empty text has zeros."""
    n = len(texts)
    out = np.zeros((n, NAMES))
    sizes = np.array([len(t) for t in texts])
    if not sizes.sum():
        return out
    raw = np.frombuffer(b"".join(texts), np.uint8)
    kind = CLASSES[raw]
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = np.repeat(first, sizes) + place // BLOCK
    counts = np.bincount(block * _CLASSES + kind, minlength=int(blocks.sum()) * _CLASSES).reshape(-1, _CLASSES).astype(float)
    filled = np.flatnonzero(sizes)
    whole = np.add.reduceat(counts, first[filled])
    out[filled, :_CLASSES] = whole / sizes[filled, None]
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), BLOCK / 2)
    out[filled, _CLASSES : 2 * _CLASSES] = np.maximum.reduceat(share, first[filled])
    out[:, : 2 * _CLASSES] = np.log1p(100 * out[:, : 2 * _CLASSES])

    w = tokens.words(texts, tokens.word_bytes("black"))
    at = 2 * _CLASSES
    n_words = np.bincount(w.owner, minlength=n)
    some = np.maximum(n_words, 1)
    if len(w.hash):
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.owner[1:] == w.owner[:-1])
        starts = np.flatnonzero(~same)
        runs = np.diff(np.append(starts, len(same)))
        longest = np.ones(n)
        np.maximum.at(longest, w.owner[starts], runs)
        twice = np.zeros(len(w.hash), bool)
        twice[2:] = (w.hash[2:] == w.hash[:-2]) & (w.owner[2:] == w.owner[:-2])
        frequent = np.zeros(n)
        order = np.lexsort((w.hash, w.owner))
        h, o = w.hash[order], w.owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        edges = np.flatnonzero(new)
        np.maximum.at(frequent, o[edges], np.diff(np.append(edges, len(h))))
        distinct = np.bincount(o[edges], minlength=n)
        length = (w.end - w.start).astype(float)
        mean = np.bincount(w.owner, weights=length, minlength=n) / some
        square = np.bincount(w.owner, weights=length**2, minlength=n) / some
        out[:, at] = np.log1p(n_words)
        out[:, at + 1] = np.bincount(w.owner[same], minlength=n) / some
        out[:, at + 2] = np.log(longest)
        out[:, at + 3] = np.bincount(w.owner[twice], minlength=n) / some
        out[:, at + 4] = np.log((distinct + 1) / (some + 1))
        out[:, at + 5] = frequent / some
        out[:, at + 6] = np.log1p(mean)
        out[:, at + 7] = np.log1p(np.sqrt(np.maximum(square - mean**2, 0)))
        longest_word = np.zeros(n)
        np.maximum.at(longest_word, w.owner, length)
        out[:, at + 8] = np.log1p(longest_word)
    lines = [t.split(b"\n") for t in texts]
    out[:, at + 9] = [np.log1p(len(x)) for x in lines]
    out[:, at + 10] = [1 - len(set(x)) / len(x) for x in lines]
    out[:, at + 11] = np.log1p(sizes)
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(((x - self.mean) / self.scale) @ self.weights + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _descend(gradient, size: int, steps: int, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam from zero; the last entry is the bias."""
    at, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        g = gradient(at[:-1], at[-1])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        at = at - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return at[:-1], float(at[-1])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS) -> float:
    """Share of positives in the unlabelled sample: the least ratio of unlabelled to positive mass above a score.

    Scores that separate positives from unlabelled are fitted on each half and applied to the other. Above any score
    the unlabelled mass is at least prior times the positive mass, and it comes close where hardly any negative is.
    Only scores that half of the positives or more exceed count, with the mass of one deviation added.
    """

    def scores(p, u, other_p, other_u):
        def gradient(w, b):
            sp, su = sigmoid(p @ w + b), sigmoid(u @ w + b)
            dp, du = (sp - 1) / len(p), su / len(u)
            return np.append(p.T @ dp + u.T @ du + (0.01 + 4 / len(p)) * w, dp.sum() + du.sum())

        w, b = _descend(gradient, p.shape[1], steps // 2)
        return other_p @ w + b, other_u @ w + b

    halves = [(positive[i::2], unlabelled[i::2]) for i in (0, 1)]
    if min(len(x) for half in halves for x in half) < 1:
        return 0.5
    ratios = []
    for (p, u), (other_p, other_u) in zip(halves, halves[::-1]):
        p, u = (np.sort(x) for x in scores(p, u, other_p, other_u))
        cuts = np.quantile(p, np.linspace(0, 0.5, 51))
        above_p = 1 - np.searchsorted(p, cuts) / len(p)
        above_u = 1 - np.searchsorted(u, cuts) / len(u)
        ratio = (above_u + np.sqrt(above_u * (1 - above_u) / len(u))) / np.maximum(above_p, 1e-9)
        ratios.append(ratio.min())
    return float(np.clip(np.mean(ratios), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = STEPS, shrink: float = 1e-3) -> Model:
    """Minimise the non-negative risk; without positives or unlabelled rows every score is one half."""
    size = positive.shape[1] if positive.ndim == 2 else NAMES
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(size), np.ones(size), np.zeros(size), 0.0, 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    positive, unlabelled = np.clip((positive - mean) / scale, -8, 8), np.clip((unlabelled - mean) / scale, -8, 8)
    prior = estimated_prior(positive, unlabelled, steps) if prior is None else prior

    def gradient(w, b):
        p, u = positive @ w + b, unlabelled @ w + b
        # the part that stands for negatives: unlabelled as negative, less the positives in it
        rest = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        ps, us = sigmoid(p), sigmoid(u)
        negative_p, negative_u = -prior * ps / len(p), us / len(u)
        if rest >= 0:
            dp, du = prior * (ps - 1) / len(p) + negative_p, negative_u
        else:  # it has gone below zero: step back along it
            dp, du = -negative_p, -negative_u
        return np.append(positive.T @ dp + unlabelled.T @ du + (shrink + 2 / len(positive)) * w, dp.sum() + du.sum())

    w, b = _descend(gradient, size, steps)
    return Model(mean, scale, w, b, prior)


def _features_of(docs: DataFrame) -> DataFrame:
    """One row of features (as bytes) per doc_id of doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in features(texts)], pa.binary())], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x binary").groupBy("doc_id").agg(F.max("x").alias("x"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model on at most ``sample_rows`` trusted positives and as many unlabelled rows.

    Labels are taken only from rows that are not held out; a document is a trusted positive if all its labels say 1.
    Samples are the rows with the smallest hash of doc_id, so they do not depend on how the table is laid out.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    given = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    positive = given.where("quality = 1").select("doc_id").orderBy(*order).limit(sample_rows)
    ids = docs.select("doc_id").where("doc_id is not null").where(~held_out())
    unlabelled = ids.join(given.select("doc_id"), "doc_id", "left_anti").distinct().orderBy(*order).limit(sample_rows)
    chosen = positive.withColumn("kind", F.lit(1)).unionByName(unlabelled.withColumn("kind", F.lit(0)))
    picked = [(r.doc_id, r.kind) for r in chosen.collect()]
    samples = {}
    for kind in (1, 0):
        keys = docs.sparkSession.createDataFrame([(i,) for i, k in picked if k == kind], docs.select("doc_id").schema)
        rows = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(keys), "doc_id", "left_semi")
        values = [np.frombuffer(r.x) for r in _features_of(rows).orderBy("doc_id").collect()]
        samples[kind] = np.array(values).reshape(len(values), NAMES)
    return fit(samples[1], samples[0])


def scored(docs: DataFrame, model: Model, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """The given columns of every row (doc_id by default) with score and predicted (1 if the score is 0.5 or more).

    ``text`` names the column of texts; if it is among the columns it goes to Python once. Only the whole text is looked at; a missing text is empty, and empty texts get the score of their features.
    """
    columns = columns or ["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch, texts in chunks(batches, text=text):
            x = features(texts)
            score = model.score(model.mean + np.clip((x - model.mean) / model.scale, -8, 8) * model.scale)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(score)], names=[*columns, "score"])

    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("score", T.DoubleType())])
    out = docs.select(*columns, *([] if text in columns else [text])).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` has doc_id and quality (0 or 1). Rows with crc32(doc_id as text) mod 3 = 1 are held out: neither their
    labels nor their texts are learned from. A missing doc_id is not held out and has no label; labels without a
    doc_id or a quality are not used. Without positives or unlabelled rows every score is one half.
    """
    return scored(docs, learn(docs, labels, sample_rows)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}

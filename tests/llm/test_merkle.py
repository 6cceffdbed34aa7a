"""The manifest against a plain tree."""

import hashlib
import zlib

import pytest
from compare import compare, connect
from conftest import SMALL
from pyspark.sql import functions as F

from marketframe.llm import merkle

from .conftest import CLASHES, as_sorted, prose

LOWER = str.maketrans(merkle._UPPER, merkle._LOWER)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Root, and the way of each node: pairs of left and right siblings."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for n, i in enumerate(at):
            run = runs[i // 8]
            ways[n].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            at[n] = i // 8
        nodes = [digest(*run) for run in runs]
    return nodes[0], ways


def expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    later = {}
    for lang in langs:
        def changed(row):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None
            return (row[0], row[1].translate(LOWER), *row[2:]) if hit else row
        trees[lang] = sorted(((r[0] is not None, r[0] or 0, leaf(r), leaf(changed(r)), r[0]) for r in trees[lang]))
    subs = [climb([x[2] for x in trees[lang]]) for lang in langs]
    root, above = climb([s for s, _ in subs])
    out = []
    for lang, (subroot, ways), more in zip(langs, subs, above):
        for (_, _, own, start, doc_id), way in zip(trees[lang], ways):
            way = way + more
            for left, right in way:
                start = digest(left, start, right)
            out.append((doc_id, own, subroot, root, digest(*(a + b for a, b in way)), start, start == root))
    return sorted(out, key=repr)


def table(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in [*CLASHES, "key", "pos", "level0", "payload", "part", "copies", "path"] if c != "doc_id")
    extra = schema.count(",") - 4
    return spark.createDataFrame([(*r, *["x"] * extra) for r in rows], schema)


def manifest(docs):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(docs, {"text": F.when(third, F.translate("text", merkle._UPPER, merkle._LOWER)).otherwise(F.col("text"))})


@pytest.fixture(scope="module")
def many(rows):
    import random

    rng = random.Random(3)
    out = [(i, t, (None, "en", "")[n % 3], ("s", None)[n % 2], None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    out += [(1000 + n, prose(rng, 3).title(), "en", "web", 7) for n in range(1200)]  # three rounds of blocks
    out += [(5000 + n, f"Text {n}", f"l{n:02d}é"[: 2 + n % 3], "web", n) for n in range(90)]  # many languages, some of one row
    out += [out[-1]] * 20 + [(None, None, None, None, None)] * 9 + [(7, "Tie", "en", "a", 1), (7, "Tie", "en", "b", 1)]
    return out


def test_manifest_equals_plain_tree(spark, many):
    got = manifest(table(spark, many).repartition(3))
    assert as_sorted(got) == expected(many)


@pytest.mark.parametrize("number", [1, 2, 8, 9, 64, 65, 512, 513])
def test_sizes(spark, number):
    rows = [(n, f"Row {n}", "en", "s", 5) for n in range(number)]
    assert as_sorted(manifest(table(spark, rows))) == expected(rows)


def test_nothing_and_unchanged(spark, many):
    assert manifest(table(spark, [])).count() == 0
    assert merkle.manifest(table(spark, many[:40])).where("not verified").count() == 0


def test_query_equals_sql(spark):
    df = merkle.op11_merkle_manifest(spark, SMALL)
    res = connect(SMALL).execute(merkle.SQL["op11_merkle_manifest"])
    assert compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description]) == ""

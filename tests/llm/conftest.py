import random

import pytest

#: Columns that operators use inside; an input may have them too.
CLASHES = ["n_words", "score", "seed", "one", "two", "place", "digest", "body", "n", "kind", "row", "c0", "fp", "anchor", "kept", "_text", "_group", "_bytes", "predicted", "items"]


def prose(rng: random.Random, words: int) -> str:
    parts = ["th", "en", "sol", "mar", "ti", "qué", "über", "and", "lo", "ve", "ra", "ck"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


def edge_rows() -> list[tuple[int | None, str | None]]:
    """Missing and empty values, repeated rows, ties, very long texts, repeats within and across texts."""
    rng = random.Random(7)
    passage = prose(rng, 60)
    long = prose(rng, 60_000)
    near = prose(rng, 300).split(" ")
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "Word"), (6, "two words"), (None, "no id " * 50), (None, None),
        (7, prose(rng, 40) + " " + passage + " " + prose(rng, 30)), (8, passage + " " + prose(rng, 50)), (9, prose(rng, 20) + passage[:-1]),
        (10, long), (11, long[300_000:300_400] + prose(rng, 10)), (12, "ab" * 400), (13, "é" * 300), (14, "\x00" * 250 + "x"),
        (15, "<|endoftext|> plain <|startoftext|> İΣ ﬁ 日本語 x́ ½ 12,5"), (16, "x" * 5000), (17, "HE SAID!! NO!! " * 60),
    ]
    rows += [(20, passage)] * 2 + [(21, "same text " * 30), (22, "same text " * 30), (22, "same text " * 30), (22, "other " + passage)]
    for n in range(30, 40):
        words = list(near)
        words[(n * 37) % 300] = f"edit{n}"
        rows.append((n, " ".join(words)))
    rows += [(n, prose(rng, rng.randint(5, 120))) for n in range(50, 90)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    full = [(i, t, None, "s", None if t is None else len(t), *(["x"] * len(CLASHES))) for i, t in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in BENCHMARK], "item_id long, text string, n_words string")


BENCHMARK = [(1, " ".join(edge_rows()[9][1].split(" ")[3:20])), (2, "two words"), (3, None), (4, ""), (10, "no id no id no id no id no id no id"), (10, "A"), (5, "never there at all in any of these texts of ours today")]


def as_sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

"""Token counts of whole texts: only lengths leave the Arrow function."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm.common import read

#: A text longer than this is encoded in pieces.
PIECE_CHARS = 65_536
#: Characters given to the encoder in one call.
CALL_CHARS = 1_000_000
#: Between two ASCII letters a single space always begins a new pre-token, so both sides encode as they would together.
SAFE = re.compile("[A-Za-z] [A-Za-z]")


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` before a space between two letters, at the first such place after ``limit`` characters."""
    start = 0
    while len(text) - start > limit:
        found = SAFE.search(text, start + limit)
        if found is None:
            break
        yield text[start : found.start() + 1]
        start = found.start() + 1
    yield text[start:] if start else text


def _counter(path: str, piece_chars: int, call_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            lengths = [0] * batch.num_rows
            owners: list[int] = []
            held: list[str] = []
            chars = 0

            def flush() -> None:
                for owner, encoded in zip(owners, tokenizer.encode_batch_fast(held, add_special_tokens=False)):
                    lengths[owner] += len(encoded)

            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                for piece in pieces(text.as_py() or "", piece_chars):
                    owners.append(row)
                    held.append(piece)
                    chars += len(piece)
                    if chars >= call_chars:
                        flush()
                        owners, held, chars = [], [], 0
            flush()
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024, piece_chars: int = PIECE_CHARS, call_chars: int = CALL_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    The tokenizer file at ``path`` must be there on every executor. Special strings inside a text count as the
    library counts them by default. A missing text is empty and has no tokens; a missing doc_id stays missing;
    repeated rows are counted each; other columns are not read. There is no shuffle: the file splits are balanced
    by bytes, and inside a task the encoder gets ``call_chars`` characters at a time, long texts in pieces cut at
    places that no token crosses.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = rows.mapInArrow(_counter(path, piece_chars, call_chars), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_token_counts": op9_token_counts}
SQL: dict[str, str] = {}

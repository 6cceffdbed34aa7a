"""Table access, shared scratch tables and byte-balanced chunks for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step of a Python task works on at a time.
CHUNK_BYTES = 1_000_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's setting, or a local one for a session that runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="marketframe-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Setting that removes the shuffles of a query when it ends; otherwise they stay until the driver's memory fills up.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once to the shared folder (in a folder for each value of the columns ``by``) and read again, so that
    later steps neither repeat nor lose it. Its shuffles are removed: nothing reads them any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that everything needed from has been stored itself."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def utf8(text: str = "text") -> Column:
    """Bytes of a text column; a missing text is empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices of about ``size`` bytes of text, with the texts as UTF-8 (a missing one is empty);
    one longer text is a slice of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        start, held = 0, 0
        values: list[bytes] = []
        for row in range(batch.num_rows):
            value = column[row].as_py() or b""
            if values and held + len(value) > size:
                yield batch.slice(start, row - start), values
                start, held, values = row, 0, []
            values.append(value)
            held += len(value)
        if values:
            yield batch.slice(start, batch.num_rows - start), values

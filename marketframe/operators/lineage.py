"""Cutting lineage where an expensive intermediate result is used several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from marketframe.session import checkpoint_folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; the files survive the
    loss of executors, and the steps that follow read them instead of recomputing the plan.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def sized(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read again, for tables that aggregation made small: the
    planner knows the size of files, so it broadcasts a small table by itself and shuffles a large one."""
    path = f"{checkpoint_folder(df.sparkSession)}/sized-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session settings the library assumes, for callers that start their own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "marketframe", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session pinned to UTC with ANSI arithmetic and adaptive execution.

    On a cluster leave ``master`` unset and pass no ``spark.sql.shuffle.partitions``: the
    submitted configuration decides. Anything in ``conf`` wins over the defaults.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local runs exchange task results over loopback only
            builder = (
                builder.config("spark.driver.host", "127.0.0.1")
                .config("spark.driver.bindAddress", "127.0.0.1")
                .config("spark.ui.enabled", "false")
                .config("spark.driver.memory", os.environ.get("MARKETFRAME_DRIVER_MEMORY", "8g"))
            )
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder for stream and lineage checkpoints, shared by all executors: the one in spark.checkpoint.dir.

    A session of one process may go without the setting and gets a folder of its own; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="marketframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder

"""Session settings used by tests and bench; on a cluster the given session is used as it is."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", app: str = "guidemill", memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Call sites are captured for every column call otherwise; that dominates building large expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a single-process local session without the setting gets a temporary folder; on a cluster, whose executors
    would each write to their own disk, a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="guidemill-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()

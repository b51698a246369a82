"""Intermediate tables in the folder that driver and executors share.

They are kept while the driver runs, as results are read lazily. When it ends, a folder on a local file system is
removed; in other stores the folder of an ended application may be removed at any time.
"""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_removed_at_exit: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and the master is local, /tmp/checkpoints becomes the session's."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this application's folder that nothing else has."""
    own = f"{shared_folder(spark)}/quire-{spark.sparkContext.applicationId}"
    local = own.removeprefix("file://")
    if local.startswith("/") and local not in _removed_at_exit:
        _removed_at_exit.add(local)
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is written once and read by whatever follows; its lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

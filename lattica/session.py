"""Session defaults and the one way intermediate results are written out.

Nothing here is a global: every operator works on the session of the DataFrame it is given.
"""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings that the operators are written for. All are ordinary Spark settings, so a cluster that has its own
# values keeps them; ``build_session`` is for tests and local runs.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "lattica", cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder. A cluster session that names none is an error,
    because a folder on the driver's own disk would be lost or invisible to the executors.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(_application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-lattica-")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage, survives the loss of executors, keeps column pruning and file statistics for later joins.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote for the frames, once nothing that is still to be computed reads it."""
    for df in frames:
        if df is not None and hasattr(df, "stored_path"):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

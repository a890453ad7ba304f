"""Session defaults for tests, bench and local runs.

On a cluster the operator's own session is used as it is; nothing here is
required by the operators except UTC as session zone and a checkpoint folder,
which :func:`ensure_checkpoint_dir` only sets where the session names none.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "noticeboard", cpus: str | int = "*", partitions: int = 8, checkpoints: str | None = None) -> SparkSession:
    """A session on this machine; ``checkpoints`` names the folder of stored steps, a new temporary one where it is left out."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.checkpoint.dir", checkpoints or tempfile.mkdtemp(prefix="noticeboard-checkpoints-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; set one only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="noticeboard-checkpoints-"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder, for tables that a job writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns worked out once, here.

    The row mark keeps the optimiser from pushing a later filter below them, where every use of a column would be written out and worked
    out again: a payload parsed once a field, a kernel run once more.
    """
    return df.withColumn("_settled", F.monotonically_increasing_id()).filter("_settled >= 0").drop("_settled")


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, so that a lost executor loses no result."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()

"""What the operators share: the folder for intermediate tables and ways to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset and driver and executors are one process (tests,
    a local shell) a fresh local folder is made and set; elsewhere that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no one else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts lineage, so a lost executor costs the reading of a file and not the work
    before it, and what is computed once stays fixed for all its readers.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, columns_bytes, limit: int) -> bool:
    """Whether the sum of ``columns_bytes`` (a Column of bytes a row) over ``df`` is within ``limit``."""
    n = df.agg(F.sum(columns_bytes).alias("n")).first()["n"]
    return (n or 0) <= limit

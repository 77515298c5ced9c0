"""Cut a plan at a table in shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .files import qualified, remove


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, the warehouse stands in.  On a cluster that must be a folder that all machines see, so one in the
    driver's own file system is refused.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and qualified(spark, top).startswith("file:"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share; {top} is the driver's own")
    return f"{top.rstrip('/')}/breathline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Several outputs can then start from it without repeating the work before it.  A lost executor costs a
    re-read of the table, and columns still prune, which a checkpoint of whole rows does not allow.  The tables stay
    until :func:`release`, since the frame returned reads them whenever it runs.
    """
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all tables this application has written with :func:`materialise`."""
    remove(spark, shared_folder(spark))

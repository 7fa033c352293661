"""Tables that steps leave for later steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one below the warehouse.

    Without either a run on a cluster would write to each machine's own disk, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.split(":")[0] in ("file", warehouse):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{warehouse}/_shared"


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a table written once below the shared folder.

    Later steps read it in place of working it out again, and a lost executor costs no more than its tasks.
    """
    spark = frame.sparkSession
    path = new_folder(spark, "stored")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)

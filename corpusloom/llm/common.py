"""What the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the query contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where the session names none, one below the warehouse.

    Where that would be each machine's own disk, on a cluster, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.split(":")[0] in ("file", warehouse):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{warehouse}/_shared"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The frame as a table written once in the shared folder; later steps read it, not what it came from."""
    path = scratch(frame.sparkSession, "cut")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def numbered(frame: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """Adds each row's place in a total order, from 0: sorted by range, then counted on from the partitions before.

    Only one count a partition goes to every task.
    """
    low = (1 << 33) - 1  # an id's lower 33 bits are its row's place in its partition
    placed = cut(
        frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(low)))
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents' columns once more under names that clash with none, and these names."""
    names = [f"_col_{i}" for i in range(len(docs.columns))]
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in ("doc_id", "text", "lang", "source")], *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]), names


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written in decimal, modulo n: the folds of the contracts. A null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n

"""Stored indexes of chunks that all retrieval of a run reads: postings for BM25 and hash vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, inverted
from ..sources.tables import new_folder, shared_folder


def there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written in full: its marker is one row, written last."""
    try:
        return not spark.read.schema("done int").parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


@dataclass
class Indexes:
    """Both indexes of chunk_id, text below a folder, each built when it is first asked for and used again from then on.

    One run at a time may build in a folder. A build that was cut off has no marker and is written anew.
    """

    chunks: DataFrame
    folder: str

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    def built(self, kind: str, write) -> str:
        path = f"{self.folder}/{kind}"
        if not there(self.spark, f"{path}-done"):
            write(path)
            self.spark.range(1).select(F.lit(1).alias("done")).write.mode("overwrite").parquet(f"{path}-done")
        return path

    def postings(self) -> inverted.Index:
        return inverted.Index(self.spark, self.built("postings", lambda path: inverted.write(self.chunks, path)))

    def vectors(self) -> DataFrame:
        """chunk_id, vec: signed token counts by hash bucket."""
        return self.spark.read.parquet(self.built("vectors", lambda path: index.hash_counts(self.chunks).write.mode("overwrite").parquet(path)))


def of(chunks: DataFrame | Indexes) -> Indexes:
    """Indexes of chunks that have none, in a new folder."""
    return chunks if isinstance(chunks, Indexes) else Indexes(chunks, new_folder(chunks.sparkSession, "indexes"))


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """One hash of the names, sizes and times of a table's files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "path", "length", "modificationTime"))), "\n"), 256)).first()[0]


def of_table(spark: SparkSession, path: str, chunk_id: str, text: str = "text") -> Indexes:
    """Indexes of a Parquet table in the shared folder, used again by all later runs while the table's files stay as they are."""
    chunks = spark.read.parquet(path).select(F.col(chunk_id).alias("chunk_id"), F.col(text).alias("text"))
    return Indexes(chunks, f"{shared_folder(spark)}/indexes/{files_fingerprint(spark, path)[:32]}-{chunk_id}-{text}")

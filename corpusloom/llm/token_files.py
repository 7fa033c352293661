"""Token counts by separator scan over flat, unindexed token files.

A token file is a run of little-endian 16-bit ids in which one id ends each document; nothing says where documents begin.
The scan cuts files into blocks of fixed length, finds the separators of a block with one vectorised comparison, and
reduces the block to its first partial document, its whole documents and its last partial document. A prefix scan over
the small table of blocks then stitches the partial documents together.

Results for odd input: null and empty texts are documents of no tokens; tokens after the last separator of a file count
as no document; an empty file and an empty table have none; repeated rows are documents of their own; a long text is
many blocks, each scanned by itself.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

END = 0
WIDTH = 2
#: Tokens in a block.
BLOCK = 1 << 16


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def word_ids(text: str | None) -> np.ndarray:
    """Ids from 1 to 65535 of the words of a text: crc32 of the word, folded."""
    return np.array([zlib.crc32(w) % 65535 + 1 for w in (text or "").encode("utf-8", "surrogatepass").split()], "<u2")


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes one token file per task into a folder that all machines share; returns file, ordinal and doc_id of each document.

    A task that runs again writes a file of another name, and only the files of the tasks that counted are listed.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _opened(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        at = 0
        end = np.array([END], "<u2")
        with fs.open_output_stream(f"{path}/{name}") as out:
            for batch in it:
                for t in batch.column(1):
                    out.write(np.concatenate([word_ids(t.as_py()), end]).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), batch.column(0)], names=["file", "ordinal", "doc_id"])
                at += n

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return cut(rows.mapInArrow(batches, f"file string, ordinal long, doc_id {id_type}"))


def blocks(files: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """file, at: one row for each block of the named files (column file), from their lengths alone."""

    def lengths(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _opened(folder)
        for batch in it:
            names = batch.column(0).to_pylist()
            sizes = [fs.get_file_info(f"{path}/{n}").size // WIDTH for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "tokens"])

    sized = files.select("file").distinct().mapInArrow(lengths, "file string, tokens long").where("tokens > 0")
    return sized.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / block))).alias("at"))


def count(files: DataFrame, folder: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """file, ordinal from 0, n_tokens of every document in the named files of a folder."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _opened(folder)
        for batch in it:
            rows = []
            for name, at in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{path}/{name}") as f:
                    ids = np.frombuffer(f.read_at(block * WIDTH, at * block * WIDTH), "<u2")
                ends = np.flatnonzero(ids == end)
                whole = np.diff(ends) - 1
                rows.append((name, at, len(ids), len(ends), int(ends[0]) if len(ends) else len(ids), int(len(ids) - ends[-1] - 1) if len(ends) else len(ids), whole.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))],
                names=["file", "at", "n", "ends", "head", "tail", "whole"],
            )

    rows = blocks(files, folder, block).repartition("file", "at").mapInArrow(scan, "file string, at long, n long, ends long, head long, tail long, whole array<long>")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # The open document's length at a block's start: all since the last separator, as a difference of running sums.
    stitched = (
        rows.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("open_at", F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("seen") + F.col("n") - F.col("tail"))).over(before), F.lit(0)))
        .where("ends > 0")
        .withColumn("lengths", F.concat(F.array(F.col("head") + F.col("seen") - F.col("open_at")), "whole"))
    )
    return stitched.select("file", "first", F.posexplode("lengths").alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")


def count_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, file, ordinal of every document: writes the token files, scans them and names what it found."""
    listed = write(docs, folder)
    # Both sides grow with the documents: merged by file, whatever their sizes look like.
    return listed.join(count(listed, folder).hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "ordinal")

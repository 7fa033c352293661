"""Documents from upload to index: a log of states, the registry over it, and versions of an index that are switched by a log.

Logs are Parquet folders that are only appended to, so a job that runs again adds rows and loses none, and readers see either
the old or the new last row. An index is written below its fingerprint before the row that makes it the active one.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import files
from ..sources.tables import stored
from . import indexes

# States in their order, chunking presets (size, overlap) and bounds, depths of retrieval.
STATES = ("uploaded", "splitting", "embedding", "indexing", "ready", "failed")
CHUNKING = {"small": (500, 50), "medium": (1000, 100), "large": (1500, 200)}
CHUNK_BOUNDS = ((100, 4000), (0, 1000))
RETRIEVAL = {"low": 3, "balanced": 5, "high": 8}
RETRIEVAL_BOUNDS = (1, 20)
MISSING_FILE = "Stored file not found on disk."

LOG = "doc_id string, status string, message string, stored_path string, updated_at timestamp"
MANIFEST = "doc_id string, stored_path string, length long, modified timestamp, part string, key string"
#: Parts of a version, paths that a read is told by name, and versions among which the last one with the same settings is sought.
MOST_PARTS = 16
LISTED = 1000
LOOKED_BACK = 32

VERSIONS = "version string, source string, activated_at timestamp"
CHUNKS = "chunk_id string, chunk_index int, doc_id string, block_type string, title string, section string, content string"


def chunking_values(mode: str, size: int | None = None, overlap: int | None = None) -> tuple[int, int]:
    """Size and overlap of a preset, or those given where the mode is custom."""
    if mode in CHUNKING:
        return CHUNKING[mode]
    if mode != "custom" or size is None or overlap is None:
        raise ValueError("custom chunking needs a size and an overlap")
    (least, most), (low, high) = CHUNK_BOUNDS
    if not least <= size <= most or not low <= overlap <= high or overlap >= size:
        raise ValueError(f"chunk size {size} or overlap {overlap} is out of bounds")
    return size, overlap


def chunking_mode(size: Column, overlap: Column) -> Column:
    """The preset that has these values, else custom."""
    out = F.lit("custom")
    for name, (s, o) in CHUNKING.items():
        out = F.when((size == s) & (overlap == o), name).otherwise(out)
    return out


def retrieval_depth(mode: str, custom: int | None = None) -> int:
    if mode in RETRIEVAL:
        return RETRIEVAL[mode]
    if custom is None or not RETRIEVAL_BOUNDS[0] <= custom <= RETRIEVAL_BOUNDS[1]:
        raise ValueError("custom retrieval needs a depth from 1 to 20")
    return custom


def registry(log: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """Each document's last state, without those deleted: doc_id, status, message, stored_path, created_at, updated_at.

    Of states of the same time the later one in STATES holds, a deletion before all. With there (stored_path of the files there are), a ready document
    whose file is gone has failed.
    """
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in (*STATES, "deleted")]), F.col("status")), F.lit(0))
    last = F.struct("updated_at", place.alias("place"), "status", "message", "stored_path")
    rows = log.groupBy("doc_id").agg(F.max(last).alias("last"), F.min("updated_at").alias("created_at"))
    rows = rows.select("doc_id", "last.status", "last.message", "last.stored_path", "created_at", "last.updated_at").where("status <> 'deleted'")
    if there is None:
        return rows
    gone = (F.col("status") == "ready") & F.col("_there").isNull()
    rows = rows.join(there.select("stored_path", F.lit(True).alias("_there")).distinct(), "stored_path", "left")
    return rows.select("doc_id", F.when(gone, "failed").otherwise(F.col("status")).alias("status"), F.when(gone, MISSING_FILE).otherwise(F.col("message")).alias("message"), "stored_path", "created_at", "updated_at")


def ready(log: DataFrame, there: DataFrame) -> DataFrame:
    """Ready documents whose file is there."""
    return registry(log).where("status = 'ready'").join(there.select("stored_path").distinct(), "stored_path", "left_semi")


def block_counts(blocks: DataFrame) -> DataFrame:
    """Per document: all blocks, those of each type, and those read by OCR (by type or by flag)."""
    kind = lambda k: F.count_if(F.col("block_type") == k).alias(f"{k}_blocks")
    ocr = (F.coalesce(F.col("block_type"), F.lit("")) == "ocr_text") | F.coalesce(F.col("ocr"), F.lit(False))
    return blocks.groupBy("doc_id").agg(F.count("*").alias("total_blocks"), kind("text"), kind("table"), kind("image"), F.count_if(ocr).alias("ocr_blocks"))


def logged(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{store}/log")


def record(docs: DataFrame, store: str, status: str, message: str | None = None) -> None:
    """Appends a state for each of docs (doc_id, stored_path)."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(status).alias("status"), F.lit(message).cast("string").alias("message"), F.col("stored_path").cast("string").alias("stored_path"), F.current_timestamp().alias("updated_at"))
    rows.write.mode("append").parquet(f"{store}/log")


def delete(spark: SparkSession, store: str, doc_ids: list[str] | None = None) -> None:
    """Marks documents (all where none are named) as deleted. Files stay: the next index is built from ready documents only."""
    there = registry(logged(spark, store))
    record(there if doc_ids is None else there.where(F.col("doc_id").isin(doc_ids)), store, "deleted")


def settings_key(source: str, size: int, overlap: int) -> str:
    return f"{source}-{size}-{overlap}"


def present(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """doc_id, stored_path, length, modified of a folder's files, without those deleted since they were last written."""
    doc_id, _ = files.file_names()
    found = files.scanned(spark, folder).select(doc_id.alias("doc_id"), F.col("path").alias("stored_path"), "length", F.col("modificationTime").alias("modified"))
    out = deleted(spark, store)
    if out is None:
        return found
    again = F.col("modified") <= F.col("deleted_at")
    return found.join(out, "doc_id", "left").where(F.col("deleted_at").isNull() | ~again).drop("deleted_at")


def build(spark: SparkSession, folder: str, store: str, source: str = "uploaded", mode: str = "medium", size: int | None = None, overlap: int | None = None, with_indexes: bool = True) -> str:
    """Makes a folder's files a version of the index and the active one; returns the version.

    Only files that the last version with the same settings doesn't have at their size and time are read and chunked, into a part
    of their own; the version's manifest says which part holds each document, so versions share the parts that stay. Parts beyond
    MOST_PARTS are copied into one. Documents deleted since their file was written stay out. A version with the same files and
    settings is used again as it stands. Documents without text are recorded as failed. No file to index is an error.
    """
    size, overlap = chunking_values(mode, size, overlap)
    key = settings_key(source, size, overlap)
    found = stored(present(spark, folder, store))
    if found.isEmpty():
        raise ValueError(f"nothing to index in {folder}")
    version = version_of(found, key)
    if not written(spark, store, version):
        before = last_manifest(spark, store, key)
        same = ["doc_id", "stored_path", "length", "modified"]
        fresh = found if before is None else found.join(before, same, "left_anti")
        parts = [found.where("false").withColumn("part", F.lit(""))] if before is None else [before.join(found, same, "left_semi")]
        fresh = stored(fresh)
        if not fresh.isEmpty():
            part = version_of(fresh, key)
            add_part(spark, folder, store, part, fresh, size, overlap)
            parts.append(fresh.withColumn("part", F.lit(part)))
        manifest = stored(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0])
        names = [r["part"] for r in manifest.select("part").distinct().limit(MOST_PARTS + 1).collect()]
        if len(names) > MOST_PARTS:
            part = version_of(found, f"{key}-merged")
            chunks_of(spark, store, manifest).withColumn("part", F.lit(part)).write.mode("overwrite").parquet(f"{store}/parts/{part}")
            manifest = manifest.withColumn("part", F.lit(part))
        manifest.withColumn("key", F.lit(key)).write.mode("overwrite").parquet(f"{store}/versions/{version}/manifest")
        if with_indexes:
            both = indexes_of(spark, store, version)
            both.postings(), both.vectors()
    if chunks_of(spark, store, manifest_of(spark, store, version)).isEmpty():
        raise ValueError(f"nothing to index in {folder}")
    activate(spark, store, version, source)
    return version


def add_part(spark: SparkSession, folder: str, store: str, part: str, fresh: DataFrame, size: int, overlap: int) -> None:
    """Reads and chunks the fresh files into a part, and records their states.

    Up to LISTED paths are named to the read; for more, the folder is read from their earliest time on and joined with them.
    """
    record(fresh, store, "uploaded")
    paths = [r["stored_path"] for r in fresh.select("stored_path").limit(LISTED + 1).collect()]
    since = fresh.agg(F.min("modified")).first()[0]
    read = files.read_blocks(spark, paths) if len(paths) <= LISTED else files.read_blocks(spark, folder, since=since).join(fresh, "doc_id", "left_semi")
    blocks = files.clean_blocks(files.titled(read))
    chunking.chunk(blocks, size, overlap).withColumn("part", F.lit(part)).write.mode("overwrite").parquet(f"{store}/parts/{part}")
    indexed = spark.read.schema(CHUNKS + ", part string").parquet(f"{store}/parts/{part}").select("doc_id").distinct()
    record(fresh.join(indexed, "doc_id", "left_semi"), store, "ready")
    record(fresh.join(indexed, "doc_id", "left_anti"), store, "failed", "No text to index.")


def version_of(found: DataFrame, key: str) -> str:
    """One hash of the settings and of all files' paths, sizes and times."""
    n, total = found.agg(F.count("*"), F.sum(F.xxhash64("stored_path", "length", "modified").cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{key}|{n}|{total}".encode()).hexdigest()


def manifest_of(spark: SparkSession, store: str, version: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{store}/versions/{version}/manifest").drop("key")


def last_manifest(spark: SparkSession, store: str, key: str) -> DataFrame | None:
    """The manifest of the version with these settings that was active last; none where there was none."""
    log = log_or_none(spark, f"{store}/active", VERSIONS)
    if log is None:
        return None
    for row in log.where("version is not null").groupBy("version").agg(F.max("activated_at").alias("at")).orderBy(F.desc("at")).limit(LOOKED_BACK).collect():
        rows = spark.read.schema(MANIFEST).parquet(f"{store}/versions/{row['version']}/manifest")
        if rows.select("key").first()["key"] == key:
            return rows.drop("key")
    return None


def chunks_of(spark: SparkSession, store: str, manifest: DataFrame) -> DataFrame:
    """The chunks of a manifest's documents out of its parts, which are MOST_PARTS at most and one."""
    names = [r["part"] for r in manifest.select("part").distinct().collect()]
    if not names:
        return spark.createDataFrame([], CHUNKS)
    rows = spark.read.schema(CHUNKS + ", part string").parquet(*[f"{store}/parts/{n}" for n in names])
    return rows.join(manifest.select("doc_id", "part"), ["doc_id", "part"], "left_semi").select(*[c.split()[0] for c in CHUNKS.split(", ")])


def indexes_of(spark: SparkSession, store: str, version: str) -> indexes.Indexes:
    """Postings and vectors of a version's chunks, beside its manifest."""
    chunks = chunks_of(spark, store, manifest_of(spark, store, version)).select("chunk_id", F.col("content").alias("text"))
    return indexes.Indexes(chunks, f"{store}/versions/{version}")


def log_or_none(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """A log, none where nothing was ever appended."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def deleted(spark: SparkSession, store: str) -> DataFrame | None:
    """doc_id and deleted_at of documents whose last state is a deletion; none where there is no log yet."""
    log = log_or_none(spark, f"{store}/log", LOG)
    if log is None:
        return None
    last = log.groupBy("doc_id").agg(F.max_by("status", "updated_at").alias("status"), F.max("updated_at").alias("deleted_at"))
    return last.where("status = 'deleted'").select("doc_id", "deleted_at")


def written(spark: SparkSession, store: str, version: str) -> bool:
    """Whether a version was active before: it became so after it was written in full."""
    log = log_or_none(spark, f"{store}/active", VERSIONS)
    return log is not None and not log.where(F.col("version") == version).isEmpty()


def activate(spark: SparkSession, store: str, version: str | None, source: str) -> None:
    """Makes a version the active one; none clears the index."""
    row = spark.range(1).select(F.lit(version).cast("string").alias("version"), F.lit(source).alias("source"), F.current_timestamp().alias("activated_at"))
    row.write.mode("append").parquet(f"{store}/active")


def clear(spark: SparkSession, store: str) -> None:
    activate(spark, store, None, "none")


def active(spark: SparkSession, store: str) -> tuple[DataFrame, str]:
    """The chunks of the active version and their collection; an empty table and "none" where there is none."""
    log = log_or_none(spark, f"{store}/active", VERSIONS)
    if log is not None:
        # One row: the pointer.
        last = log.agg(F.max_by(F.struct("version", "source"), "activated_at").alias("v")).select("v.*").first()
        if last["version"]:
            return chunks_of(spark, store, manifest_of(spark, store, last["version"])), last["source"]
    return spark.createDataFrame([], CHUNKS), "none"


def stages(log: DataFrame) -> DataFrame:
    """Each document's states in order with the seconds that each lasted; null for the last."""
    order = Window.partitionBy("doc_id").orderBy("updated_at", F.array_position(F.array(*[F.lit(s) for s in (*STATES, "deleted")]), F.col("status")))
    return log.select("doc_id", F.row_number().over(order).alias("place"), "status", (F.lead("updated_at").over(order).cast("double") - F.col("updated_at").cast("double")).alias("seconds"))

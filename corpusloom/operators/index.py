"""Index build: postings, document lengths, term and corpus statistics, hash embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

DIMENSION = 64
#: Chunks whose tokens are hashed at a time.
COUNTED = 1024


def term_frequency(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf of chunk_id, text."""
    return chunks.select("chunk_id", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, n_tokens, n_distinct; chunks without tokens too."""
    tokens = tx.tokens(F.col("text"))
    return chunks.select("chunk_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """n_chunks, n_tokens, avg_tokens in one row."""
    n = F.size(tx.tokens(F.col("text"))).cast("long")
    return chunks.select(n.alias("n")).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_tokens"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """term, df. Terms are made distinct within each chunk's row, so that one shuffle of partial counts is enough."""
    return chunks.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df, n):
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(chunks: DataFrame, n_chunks: int) -> DataFrame:
    """term, df, idf."""
    return document_frequency(chunks).withColumn("idf", idf(F.col("df"), F.lit(n_chunks)))


def bucket_of(token: bytes, dimension: int = DIMENSION) -> tuple[int, int]:
    """(bucket, sign) of a token from its SHA-1: the number modulo the dimension; bit 1 is the sign."""
    number = int.from_bytes(hashlib.sha1(token).digest(), "big")
    return number % dimension, -1 if number >> 1 & 1 else 1


def hash_counts(chunks: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """chunk_id, vec: signed token counts by hash bucket, zeros for a chunk without tokens.

    A chunk's tokens are counted in their row, and a token is hashed once for some chunks; vectors alone are shuffled, for rows of one id.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(first, COUNTED)
                tokens = batch.column(1)
                codes = tokens.flatten().dictionary_encode()
                bucket, sign = np.array([bucket_of(t, dimension) for t in codes.dictionary.cast(pa.binary()).to_pylist()], np.int64).reshape(-1, 2).T
                at = codes.indices.to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
                sums = np.bincount(row * dimension + bucket[at], sign[at], batch.num_rows * dimension).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in sums.reshape(-1, dimension).T)], names=names)

    names = ["chunk_id", *(f"_{i}" for i in range(dimension))]
    schema = f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names[1:])
    rows = chunks.select("chunk_id", tx.cased_tokens(F.col("text")).alias("tokens")).mapInArrow(counted, schema)
    return rows.groupBy("chunk_id").agg(*[F.sum(c).alias(c) for c in names[1:]]).select("chunk_id", F.array(*names[1:]).alias("vec"))


def norm(vec):
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(vec):
    """The vector at length 1; a zero vector stays."""
    n = norm(vec)
    return F.transform(vec, lambda x: F.when(n > 0, x / n).otherwise(x))


def hash_embedding(chunks: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    return hash_counts(chunks, dimension).select("chunk_id", unit(F.col("vec")).alias("vec"))


def validated(vectors: DataFrame, dimension: int) -> DataFrame:
    """Fails at run time where a vector has another length."""
    return vectors.where(F.assert_true(F.size("vec") == dimension, F.lit(f"vectors need {dimension} numbers")).isNull())

"""Batch retrieval: BM25 and cosine top-k for all queries at once, fusion, deduplication and filters.

Scores are rounded before they order anything, and a chunk's id ends every order, so that ranks are the same on every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import new_folder, stored
from . import index, inverted

K1, B = 1.5, 0.75
RRF_K, RRF_WEIGHT = 60, 0.5
#: Bytes of the vectors of one side of a block pair, scores of a product at a time, and rows that a block has at least
#: before more blocks are made for the sake of more tasks.
BLOCK_BYTES = 16 << 20
PRODUCT = 1 << 22
LEAST_ROWS = 1024


def ranked(hits: DataFrame, k: int, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best of each query with their ranks from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), tie)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, chunk_id, score of all chunks that share a term with a query.

    The texts are split once: only tokens that occur in some query leave the scan, with their chunk's length, and one row
    a chunk without a term, from which the number of chunks and their mean length are taken.
    """
    asked = queries.select("query_id", F.explode(tx.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    # The length is worked out below the explode, once a chunk.
    split = chunks.select("chunk_id", tx.tokens(F.col("text")).alias("_t")).select("chunk_id", "_t", F.size("_t").alias("dl"))
    exploded = split.select("chunk_id", "dl", F.explode(F.concat("_t", F.array(F.lit(None).cast("string")))).alias("term"))
    wanted = asked.select(F.col("term").alias("_w")).distinct().unionAll(asked.sparkSession.createDataFrame([(None,)], "_w string"))
    kept = exploded.join(wanted, exploded["term"].eqNullSafe(wanted["_w"]), "left_semi")
    postings = stored(kept.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf")))
    n, average = postings.where("term is null").agg(F.sum("tf"), F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).first()
    n, average, postings = n or 0, average or 0.0, postings.where("term is not null")
    stats_by_term = postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", index.idf(F.col("df"), F.lit(n)))
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average)) * F.col("qf")
    return postings.join(asked.join(stats_by_term, "term"), "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def bm25_topk(chunks: DataFrame | inverted.Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, chunk_id, score, from a stored index; chunks that have none yet get one for this call."""
    found = chunks if isinstance(chunks, inverted.Index) else inverted.write(chunks, new_folder(chunks.sparkSession, "index"))
    return ranked(inverted.scores(found, queries, k).where("score > 0"), k).select("query_id", "rank", "chunk_id", "score")


def blocks_of(frame: DataFrame, key: str, rows: int, least: int = 1) -> tuple[DataFrame, int]:
    """The frame with a block number by the hash of its key, and the number of blocks of about so many rows."""
    n = frame.count()
    blocks = max(1, -(-n // rows), min(least, -(-n // LEAST_ROWS)))
    return frame.withColumn("_block", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(0)), F.lit(blocks)).cast("int")), blocks


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, chunk_id, score: cosine of chunk_id, vec with query_id, vec; 0 where either is a zero vector.

    Blocks of the stated queries meet blocks of rows in a join by both block numbers: each pair is one group, whose two sides
    are at most about `block_bytes` and whose matrix product runs some queries at a time. A group passes on its k best of each
    query, and the window takes the k best of these. Nothing goes through the driver but two counts and the vectors' length.
    """
    double = lambda f, key: f.select(F.col(key), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    one = vectors.select(F.size("vec")).first()
    kinds = [vectors.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()]
    if one is None:
        return queries.join(vectors.select("chunk_id"), F.lit(False)).select("query_id", F.lit(0).alias("rank"), "chunk_id", F.lit(0.0).alias("score"))
    rows = max(1, block_bytes // (8 * max(1, one[0])))
    v, v_blocks = blocks_of(double(vectors, "chunk_id"), "chunk_id", rows, vectors.sparkSession.sparkContext.defaultParallelism)
    q, q_blocks = blocks_of(double(queries, "query_id"), "query_id", rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.select("chunk_id", "vec", F.col("_block").alias("_v"), every(q_blocks).alias("_q"))
    q = q.select("query_id", "vec", F.col("_block").alias("_q"), every(v_blocks).alias("_v"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = left.column("chunk_id").combine_chunks(), right.column("query_id").combine_chunks()
        names = ["query_id", "chunk_id", "score"]
        if not len(ids) or not len(asked):
            return pa.table([asked.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], names=names)
        x, y = (t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (left, right))
        order = pc.sort_indices(ids)  # rows by id, so that of equal scores the lower place is the lower id
        ids, x = ids.take(order), x[order.to_numpy()]
        far = np.linalg.norm(x, axis=1)
        take, scores, of = [], [], []
        step = max(1, PRODUCT // len(x))
        for at in range(0, len(y), step):
            some = y[at : at + step]
            down = np.outer(np.linalg.norm(some, axis=1), far)
            s = np.divide(some @ x.T, down, out=np.zeros_like(down), where=down > 0)
            for i, line in enumerate(np.round(s, 9)):
                near = np.arange(len(line))
                if len(line) > k:
                    near = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k])
                near = near[np.argsort(-line[near], kind="stable")[:k]]
                take.append(near)
                scores.append(s[i, near])
                of.append(np.full(len(near), at + i))
        return pa.table([asked.take(pa.array(np.concatenate(of))), ids.take(pa.array(np.concatenate(take))), pa.array(np.concatenate(scores))], names=names)

    pairs = v.groupBy("_q", "_v").cogroup(q.groupBy("_q", "_v")).applyInArrow(best, f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")
    return ranked(pairs, k).select("query_id", "rank", "chunk_id", "score")


def inner_product_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Inner product of vectors normalised to 32-bit length 1 at build and at query time."""
    short = lambda frame, key: frame.select(key, F.transform(index.unit(F.transform("vec", lambda x: x.cast("float").cast("double"))), lambda x: x.cast("float")).alias("vec"))
    return dense_topk(short(vectors, "chunk_id"), short(queries, "query_id"), k)


def depth(k: int) -> int:
    """Candidates that each retriever gives to fusion."""
    return max(k, 3 * k, 20)


def dedupe(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first hit of each document in a ranked list, ranked anew."""
    first = Window.partitionBy("query_id", F.coalesce(F.col(key).cast("string"), F.col("chunk_id").cast("string"))).orderBy("rank")
    once = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, weight: float = RRF_WEIGHT, constant: int = RRF_K, key: str = "doc_id") -> DataFrame:
    """Weighted reciprocal ranks of two lists of query_id, rank, chunk_id, doc_id, score, one hit for each document.

    The better-ranked chunk stands for its document, dense first.
    """
    lists = [dedupe(h, key).select("query_id", "rank", "chunk_id", "doc_id", "score", F.lit(i).alias("list")) for i, h in enumerate((dense, sparse))]
    both = lists[0].unionAll(lists[1])
    one = lambda i, c: F.max(F.when(F.col("list") == i, F.col(c)))
    fused = both.groupBy("query_id", F.coalesce(F.col(key).cast("string"), F.col("chunk_id").cast("string")).alias("_key")).agg(
        (F.coalesce(weight / (constant + one(0, "rank")), F.lit(0.0)) + F.coalesce(weight / (constant + one(1, "rank")), F.lit(0.0))).alias("score"),
        F.min_by(F.struct("chunk_id", "doc_id"), F.struct("rank", "list")).alias("_best"),
        one(0, "score").alias("dense_score"),
        one(1, "score").alias("sparse_score"),
    )
    fused = fused.select("query_id", "_best.chunk_id", "_best.doc_id", "score", "dense_score", "sparse_score").withColumn("_tie", F.col("chunk_id").cast("string"))
    return ranked(fused, k, tie="_tie").drop("_tie")


def post_filter(hits: DataFrame, predicate, k: int) -> DataFrame:
    """Filters the 8 k best and then cuts to k: fewer than k may be left. The filter must not move below the ranking."""
    kept = hits.where(F.col("rank") <= 8 * k).where(predicate)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)


def active_only(hits: DataFrame, active: DataFrame, key: str = "doc_id") -> DataFrame:
    return hits.join(active.select(key).distinct(), key, "left_semi")

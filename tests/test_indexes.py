"""Stored indexes: exact top-k from blocks, no scan of texts, products of blocks, and use again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import inverted, retrieve
from corpusloom.plans import indexes


def corpus(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(300)])
    weights = 1 / np.arange(1, 301)
    texts = [" ".join(["the", *rng.choice(words, rng.integers(0, 40), p=weights / weights.sum())]) for _ in range(n)]
    return spark.createDataFrame([*enumerate(texts), (n, ""), (n + 1, None), (n + 2, "rare rare rare")], "chunk_id long, text string")


def plain(chunks, queries, k):
    hits = retrieve.ranked(retrieve.bm25_scores(chunks, queries).where("score > 0"), k)
    return {(r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in hits.collect()}


def found(index, queries, k):
    return {(r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in retrieve.bm25_topk(index, queries, k).collect()}


@pytest.fixture(scope="module")
def chunks(spark):
    return corpus(spark).cache()


def test_topk_equals_all_scores(spark, chunks, tmp_path, monkeypatch):
    texts = ["the w0 w1", "w250 the w0 w3 w5", "rare the", "nothing of these", "", "w299 w298 the the", "w7"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    index = inverted.write(chunks, str(tmp_path / "small"), block=16)
    for k, head in ((1, 4), (5, 1), (50, 4)):
        monkeypatch.setattr(inverted, "HEAD", head)
        assert found(index, queries, k) == plain(chunks, queries, k)
    assert found(inverted.write(chunks.where("false"), str(tmp_path / "none")), queries, 5) == set()


def test_late_terms_are_looked_up(spark, tmp_path, monkeypatch):
    """One rare word and a word of all chunks: the second is read for the candidates of the first alone."""
    n = 3000
    chunks = spark.range(n).select(F.col("id").alias("chunk_id"), F.concat(F.lit("all "), F.when(F.col("id") % 300 == 0, "seldom seldom ").otherwise(""), F.repeat(F.lit("x "), (F.col("id") % 7).cast("int"))).alias("text"))
    queries = spark.createDataFrame([(1, "seldom all")], "query_id long, query string")
    index = inverted.write(chunks, str(tmp_path / "i"), block=32)
    want = plain(chunks, queries, 5)
    seen = []
    real = inverted.stored
    monkeypatch.setattr(inverted, "stored", lambda f: seen.append(real(f)) or seen[-1])
    assert found(index, queries, 5) == want
    assert "chunk_id" in seen[-1].columns and 5 <= seen[-1].count() <= 10  # candidates: only chunks with the rare word


def test_blocks_are_bounded_and_a_frequent_word_is_dealt_out(spark, chunks, tmp_path):
    index = inverted.write(chunks, str(tmp_path / "i"), block=4)
    blocks = index.blocks()
    assert blocks.agg(F.max("n")).first()[0] <= 24
    terms = {r.term: r for r in index.terms().collect()}
    assert terms["the"].df == 600 and terms["the"].salts > 1
    assert blocks.where("term = 'the'").groupBy("salt").count().agg(F.max("count")).first()[0] <= inverted.TOGETHER * 20
    row = blocks.where("n > 1").first()
    assert row.bound == max(row.parts) and len(row.chunk_ids) == len(row.parts) == row.n


def test_search_reads_no_text(spark, chunks, tmp_path):
    table = str(tmp_path / "table")
    chunks.withColumnRenamed("chunk_id", "doc_id").write.parquet(table)
    mine = indexes.of_table(spark, table, "doc_id")
    queries = spark.createDataFrame([(1, "the w3")], "query_id long, query string")
    hits = retrieve.bm25_topk(mine.postings(), queries, 5)
    plan = hits._jdf.queryExecution().optimizedPlan().toString() + hits._jdf.queryExecution().executedPlan().toString()
    assert table not in plan and "text" not in plan
    # The same files: the same folder, and nothing written again.
    again = indexes.of_table(spark, table, "doc_id")
    written = lambda: spark.read.parquet(f"{mine.folder}/postings/stats").select("_metadata.file_modification_time").first()
    at = written()
    assert again.folder == mine.folder and again.postings().stats().n_chunks == 603 and written() == at
    chunks.limit(5).withColumnRenamed("chunk_id", "doc_id").write.mode("append").parquet(table)
    other = indexes.of_table(spark, table, "doc_id")
    assert other.folder != mine.folder and other.postings().stats().n_chunks == 608
    assert other.vectors().count() == 603


def test_many_queries_meet_all_rows_in_blocks(spark):
    """100,000 queries: no block of either side is above its bytes, and no row goes through the driver."""
    rng = np.random.default_rng(3)
    n, q, dim = 500, 100_000, 4
    x = np.round(rng.normal(size=(n, dim)), 1)
    y = np.round(rng.normal(size=(40, dim)), 1)
    y[0] = 0
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "chunk_id long, vec array<double>")
    forty = F.array(*[F.array(*[F.lit(v) for v in row]) for row in y.tolist()])
    queries = spark.range(q).select(F.col("id").alias("query_id"), F.element_at(forty, (F.col("id") % 40 + 1).cast("int")).alias("vec"))
    hits = retrieve.dense_topk(vectors, queries, 3, block_bytes=1 << 19)
    got = hits.groupBy(F.col("query_id") % 40, "rank").agg(F.count("*").alias("n"), F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b"), F.min("score").alias("s")).collect()
    down = np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1))
    s = np.round(np.divide(y @ x.T, down, out=np.zeros_like(down), where=down > 0), 9)
    want = {(i, r + 1): (int(j), s[i, j]) for i in range(40) for r, j in enumerate(np.lexsort((np.arange(n), -s[i]))[:3])}
    assert len(got) == 120
    for r in got:
        j, score = want[r[0], r["rank"]]
        assert (r.n, r.a, r.b) == (q // 40, j, j) and abs(r.s - score) < 1e-8
    assert retrieve.dense_topk(vectors.where("false"), queries, 3).count() == 0 and retrieve.dense_topk(vectors, queries.where("false"), 3).count() == 0

"""Reranking policies, context packing and citations over hits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# Thresholds of the rerank cascade.
MIN_CANDIDATES, HIGH_SCORE, CLEAR_GAP = 4, 0.75, 0.2


def rerank_by_score(hits: DataFrame, k: int) -> DataFrame:
    """The first k, and only these, sorted by score; equal scores keep their order."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "rank")
    return hits.where(F.col("rank") <= k).withColumn("pre_rank", F.col("rank")).withColumn("rank", F.row_number().over(order))


def rerank_with(hits: DataFrame, k: int, scorer: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """The first k of each query (query_id, query, rank, chunk_id, content, score) in the order of a model's scores of (query, content).

    A query whose scorer fails, or gives another number of scores or one that is no number, keeps its order (reranked false); the
    others are not touched by it. Adds rerank_score, pre_rank and reranked. A group is k rows at most.
    """
    out = T.StructType([*hits.schema, T.StructField("rerank_score", T.DoubleType()), T.StructField("pre_rank", T.IntegerType()), T.StructField("reranked", T.BooleanType())])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", kind="stable").reset_index(drop=True)
        frame["pre_rank"] = frame["rank"].astype(int)
        try:
            scores = [float(s) for s in scorer(list(zip(frame["query"], frame["content"])))]
            if len(scores) != len(frame) or any(s != s for s in scores):
                raise ValueError("a score for each pair is needed")
        except Exception:  # noqa: BLE001 - whatever fails in a model, the retrieval's order stands
            return frame.assign(rerank_score=None, reranked=False)
        frame["rerank_score"] = scores
        order = frame["rerank_score"].round(9).sort_values(ascending=False, kind="stable").index
        frame = frame.loc[order].reset_index(drop=True)
        return frame.assign(rank=range(1, len(frame) + 1), reranked=True)

    return hits.where(F.col("rank") <= k).groupBy("query_id").applyInPandas(one, out)


def score_stats(hits: DataFrame) -> DataFrame:
    """query_id, n_hits, top, gap: squashed best score and its lead over the second."""
    both = hits.withColumn("_s", tx.squashed(F.col("score"))).withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("_s"), "rank")))
    # Two rows a query are enough for top and gap.
    return both.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.max("_s").alias("top"), F.round(F.greatest(F.lit(0.0), F.max("_s") - F.max(F.when(F.col("_r") == 2, F.col("_s")))), 4).alias("gap"))


def cascade(n: Column, top: Column, gap: Column, complexity: Column, mode: Column, cross_encoder: bool = True, enabled: bool = True) -> Column:
    """strategy/reason of the first rule that holds."""
    out = F.when(n == 0, "skipped/no_candidates")
    if not cross_encoder:
        return out.otherwise("score_only/configured_non_cross_encoder")
    if not enabled:
        return out.otherwise("cross_encoder/cascade_disabled_legacy")
    return (
        out.when(complexity == "simple_extractive", "score_only/simple_extractive_skip")
        .when(n < MIN_CANDIDATES, "score_only/few_candidates_skip")
        .when((top >= HIGH_SCORE) & (gap >= CLEAR_GAP), "score_only/high_confidence_clear_gap_skip")
        .when(mode == "advanced", "cross_encoder/advanced_strict_allow_cross_encoder")
        .when(complexity.isin("normal", "complex") & (gap.isNull() | (gap < CLEAR_GAP)), "cross_encoder/ambiguous_scores_use_cross_encoder")
        .otherwise("score_only/score_only_default")
    )


def confidence(hits: DataFrame, scores: tuple[str, ...] = ("score", "dense_score", "sparse_score")) -> DataFrame:
    """query_id, confidence: the best of all scores, squashed."""
    return hits.groupBy("query_id").agg(F.array_max(F.array(*[F.max(tx.squashed(F.col(s))) for s in scores])).alias("confidence"))


def is_table(content: Column) -> Column:
    body = F.regexp_replace(content, r"^\s+", "")
    return (F.char_length(body) - F.char_length(F.replace(body, F.lit("|"), F.lit(""))) >= 4) & F.contains(body, F.lit("\n"))


def pack(hits: DataFrame, most: int = 5, max_chars: int = 4000, least: int = 80) -> DataFrame:
    """query_id, slot, chunk_id, content, truncated: what fits into the context, in rank order.

    A chunk that fits goes in; else one with too little room ends it, a table is passed over, and any other is cut at a
    boundary and ends it. hits: query_id, rank, chunk_id, content (block_type optional); a query's hits are few.
    """
    table = is_table(F.col("content"))
    if "block_type" in hits.columns:
        table = table | (F.lower("block_type") == "table")
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    once = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    listed = once.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content", F.char_length("content").alias("n"), table.alias("is_table")))).alias("h"))
    kind = dict(listed.dtypes)["h"].split("chunk_id:")[1].split(",")[0]
    slot = f"struct<chunk_id:{kind},content:string,truncated:boolean>"
    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("ended"), F.array().cast(f"array<{slot}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        room = max_chars - acc["used"]
        cut = tx.truncated(x["content"], room)
        full = acc["ended"] | (F.size(acc["out"]) >= most)
        add = lambda content, flag: F.concat(acc["out"], F.array(F.struct(x["chunk_id"].alias("chunk_id"), content.alias("content"), F.lit(flag).alias("truncated"))))
        state = lambda used, ended, out: F.struct(used.cast("int").alias("used"), ended.alias("ended"), out.cast(f"array<{slot}>").alias("out"))
        return (
            F.when(full, acc)
            .when(x["n"] <= room, state(acc["used"] + x["n"], F.lit(False), add(x["content"], False)))
            .when(room < least, state(acc["used"], F.lit(True), acc["out"]))
            .when(x["is_table"], acc)
            .when(F.char_length(cut) < least, state(acc["used"], F.lit(True), acc["out"]))
            .otherwise(state(acc["used"] + F.char_length(cut), F.lit(True), add(cut, True)))
        )

    packed = listed.select("query_id", F.posexplode(F.aggregate("h", zero, step, lambda acc: acc["out"])).alias("slot", "s"))
    return packed.select("query_id", (F.col("slot") + 1).alias("slot"), "s.chunk_id", "s.content", "s.truncated")


def fitting_prefix(hits: DataFrame, max_chars: int) -> DataFrame:
    """The ranks before the running length passes the budget."""
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("chars", F.sum(F.char_length("content")).over(so_far)).where(F.col("chars") <= max_chars)


def citations(hits: DataFrame, most: int = 5, snippet: int = 360) -> DataFrame:
    """query_id, place, chunk_id, snippet of the first distinct chunks."""
    first = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.min_by("content", "rank").alias("content"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= most)
    return placed.select("query_id", "place", "chunk_id", F.substring("content", 1, snippet).alias("snippet"))


def citation_line(place: Column, title: Column, source: Column, doc_id: Column, chunk_id: Column, section: Column, page: Column) -> Column:
    """A numbered line; a section or page that is not there is left out."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    head = F.concat(F.lit("["), place.cast("string"), F.lit("] "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")))
    named = [F.concat(F.lit(f"{n}="), text(c)) for n, c in (("source", source), ("doc_id", doc_id), ("chunk_id", chunk_id))]
    return F.concat_ws(" | ", head, *named, F.concat(F.lit("section="), F.nullif(section, F.lit(""))), F.concat(F.lit("page="), page.cast("string")))

"""Retrieval and behavior metrics, grouped summaries, paired deltas and latency percentiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..sources.tables import stored
from . import judge


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n_gold, n_ranked, hit, mrr, ndcg of query_id, rank, key against query_id, key; each gold counts once."""
    found = ranked.join(gold.distinct(), ["query_id", "key"]).groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    scored = found.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    sizes = queries.select("query_id").distinct().join(gold.groupBy("query_id").agg(F.count("*").alias("n_gold")), "query_id", "left")
    sizes = sizes.join(ranked.groupBy("query_id").agg(F.count("*").alias("n_ranked")), "query_id", "left").na.fill(0, ["n_gold", "n_ranked"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_gold", "n_ranked").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    joined = sizes.join(scored, "query_id", "left")
    none = F.col("n_gold") == 0
    return joined.select(
        "query_id", "n_gold", "n_ranked",
        F.when(none, None).otherwise(F.col("first").isNotNull()).alias("hit"),
        F.when(none, None).otherwise(F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("mrr"),
        F.when(none, None).otherwise(F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6)).alias("ndcg"),
    )


def gold_overlap(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, overlap: the share of a query's gold keys among its cited keys."""
    both = gold.distinct().join(cited.select("query_id", "key", F.lit(1).alias("_c")).distinct(), ["query_id", "key"], "left")
    return both.groupBy("query_id").agg(F.round(F.count("_c") / F.count("*"), 6).alias("overlap"))


def category_summary(rows: DataFrame) -> DataFrame:
    """Per mode and category: count, averages without nulls, and rates of the boolean columns; where the rows have hit, mrr and
    ndcg, their means over the rows that have gold sources."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(f"{c}_rate")
    return rows.groupBy("mode", "category").agg(
        F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), rate("retried"), rate("abstained"), rate("cited"),
        *[F.round(F.avg(F.col(c).cast("double")), 6).alias("hit_rate" if c == "hit" else f"avg_{c}") for c in ("hit", "mrr", "ndcg") if c in rows.columns],
    )


def behavior(expected: Column, status: Column, loops: Column, stop_reason: Column) -> dict[str, Column]:
    """abstain_match: whether the run abstained where it was expected, and only there; retry_used: a second loop, or a stop reason that names a retry."""
    abstained = F.lower(F.coalesce(status, F.lit("answered"))).isin("abstained", "insufficient_evidence")
    again = F.coalesce(loops > 1, F.lit(False)) | F.coalesce(F.lower(stop_reason).contains("retry"), F.lit(False))
    return {"abstain_match": F.coalesce(expected == "abstain", F.lit(False)) == abstained, "retry_used": again}


def term_metrics(answer: Column, reference: Column, context: Column) -> dict[str, Column]:
    """keyword_hit: whether answer and reference share a term, null without a reference; groundedness_proxy: the share of the
    answer's terms in the context, null without a context."""
    a, none = judge.terms(answer), F.lit("")
    share = tx.let(a, lambda t: F.when(F.size(t) > 0, F.round(F.size(F.array_intersect(t, judge.terms(context))) / F.size(t), 6)).otherwise(0.0))
    return {
        "keyword_hit": F.when(tx.stripped(F.coalesce(reference, none)) != "", F.arrays_overlap(a, judge.terms(reference))),
        "groundedness_proxy": F.when(F.coalesce(context, none) != "", share),
    }


def with_branches(direct: DataFrame, branches: DataFrame) -> DataFrame:
    """All direct rows, and the branches of compared runs whose example and mode have no direct row; both with the same columns."""
    return direct.unionByName(branches.join(direct.select("example_id", "mode").distinct(), ["example_id", "mode"], "left_anti"))


def paired_delta(rows: DataFrame, base: str = "standard", other: str = "advanced") -> DataFrame:
    """n_pairs and mean differences of other less base, of examples that have both; the last row of an example counts."""
    last = Window.partitionBy("example_id", "mode").orderBy(F.desc("seq"))
    once = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    sides = once.groupBy("example_id").agg(*[F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{m}_{c}") for m in (base, other) for c in ("latency_ms", "confidence")], F.count_distinct("mode").alias("modes"))
    return sides.where("modes = 2").agg(
        F.count("*").alias("n_pairs"),
        F.round(F.avg(F.col(f"{other}_latency_ms") - F.col(f"{base}_latency_ms")), 6).alias("latency_delta"),
        F.round(F.avg(F.col(f"{other}_confidence") - F.col(f"{base}_confidence")), 6).alias("confidence_delta"),
    )


SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95}


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by, n, max and the exact quantiles of a value by linear interpolation; nulls don't count, a group of nulls has n 0.

    Equal values are counted first; the distinct ones are sorted by range over all groups, so that a group of any size is spread
    over tasks, and each knows from the counts of the ranges before it which ranks its rows hold. Only the rows around a quantile
    go on.
    """
    counted = rows.groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    sizes = counted.groupBy("g").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("n"), F.max("v").alias("max"))
    # A row's partition is read again after the write, so that its number stays what it was.
    placed = stored(counted.where("v is not null").repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("part", "g").agg(F.sum("c").alias("in_part"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.withColumn("start", F.coalesce(F.sum("in_part").over(earlier), F.lit(0))).drop("in_part")
    within = Window.partitionBy("part", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("end", F.sum("c").over(within)).withColumnRenamed("g", "_g").withColumnRenamed("part", "_p")
    ranked = ranked.join(parts, F.col("_g").eqNullSafe(F.col("g")) & (F.col("_p") == F.col("part"))).select("_g", "v", (F.col("start") + F.col("end") - F.col("c")).alias("first"), (F.col("start") + F.col("end")).alias("until"))
    out = ranked.join(sizes, F.col("_g").eqNullSafe(F.col("g")), "right")
    found = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("n") - 1)
        at_rank = lambda r: F.max(F.when((F.col("first") <= r) & (r < F.col("until")), F.col("v")))
        low, high = at_rank(F.floor(at)), at_rank(F.ceil(at))
        part = F.max(at - F.floor(at))
        found.append((low * (1 - part) + high * part).alias(name))
    near = F.lit(False)
    for share in shares.values():
        at = F.lit(share) * (F.col("n") - 1)
        for r in (F.floor(at), F.ceil(at)):
            near = near | ((F.col("first") <= r) & (r < F.col("until")))
    return out.where(F.coalesce(near, F.col("n") == 0)).groupBy("g").agg(F.max("n").alias("n"), F.max("max").alias("max"), *found).withColumnRenamed("g", by)


def latency_percentiles(attempts: DataFrame, by: str, value: str, overall: str | None = None) -> DataFrame:
    """Group, n, p50, p90, p95, max with linear interpolation, 2 decimals; overall names one more row, of all attempts."""
    rows = attempts.select(F.col(by).alias(by), F.col(value).alias("_v"))
    if overall is not None:
        rows = rows.withColumn(by, F.explode(F.array(F.col(by), F.lit(overall))))
    out = quantiles(rows, by, "_v", SHARES)
    # Of the number itself, not of its shortest decimal form, which may end in a 5 that the number does not reach.
    short = lambda c: F.signum(c) * F.floor(F.abs(F.col(c)) * 100 + 0.5) / 100
    return out.select(by, "n", *[short(c).alias(c) for c in (*SHARES, "max")])


def captured(rows: DataFrame, predict: Callable[[dict], dict], columns: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, those that a predictor gives for each row, status and error.

    A row whose predictor fails, or gives other columns or types, stands as an error row (status error, no values) beside the
    good ones of its batch; a row's own status stays if the predictor gives one.
    """
    schema = T.StructType.fromDDL(columns)
    names = [f.name for f in schema if f.name != "status"]
    arrow = pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    found = dict(predict(row))
                    if set(found) - {"status"} != set(names):
                        raise ValueError(f"a predictor gives {sorted(names)}")
                    pa.array([{n: found.get(n) for n in schema.names}], arrow)
                    out.append([*(row[k] for k in keep), *(found[n] for n in names), str(found.get("status") or "answered"), None])
                except Exception as e:  # noqa: BLE001 - any failure of a predictor is one row's error
                    out.append([*(row[k] for k in keep), *(None for _ in names), "error", " ".join(f"{type(e).__name__}: {e}".split())[:240]])
            yield pd.DataFrame(out, columns=[*keep, *names, "status", "error"], dtype=object)

    fields = [rows.schema[k] for k in keep] + [T.StructField(f.name, f.dataType) for f in schema if f.name != "status"]
    return rows.mapInPandas(run, T.StructType([*fields, T.StructField("status", T.StringType()), T.StructField("error", T.StringType())]))


def error_rows(rows: DataFrame) -> DataFrame:
    """The rows of an evaluation with the fixed fields of those that failed: no answer, nothing retrieved, stop reason evaluation_error."""
    bad = F.col("status") == "error"
    fixed = {"answer": F.lit(""), "stop_reason": F.lit("evaluation_error"), "retrieved_count": F.lit(0), "selected_count": F.lit(0), "confidence": F.lit(None), "loop_count": F.lit(None), "latency_ms": F.lit(None), "grounded_score": F.lit(0.0)}
    return rows.withColumns({c: F.when(bad, v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in fixed.items() if c in rows.columns})

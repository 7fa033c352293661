"""Rankings and counts out of the traces of runs: what the last retrieval and the last reranking of each run returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selectors

FIELDS = ("chunk_id", "doc_id", "source", "path", "title", "section")
SCORES = ("dense_score", "sparse_score", "rerank_score")
DOC = ", ".join([*[f"{c}: string" for c in FIELDS], *[f"{c}: double" for c in SCORES], "content: string"])
STEP = f"array<struct<step: string, count: int, chunk_size: int, chunk_overlap: int, retrieved_count: int, selected_count: int, chunk_ids: array<string>, docs: array<struct<{DOC}>>, retrieved_docs: array<struct<{DOC}>>, reranked_docs: array<struct<{DOC}>>, selected_context_docs: array<struct<{DOC}>>>>"
STRATEGIES = ("dense", "bm25", "hybrid", "hybrid_rerank")


#: Names of the timings that a retrieval has.
TIMINGS = ("retrieval_total_ms", "dense_retrieve_ms", "sparse_retrieve_ms", "hybrid_merge_ms")


def whole_ms(value: Column, default: Column | int = 0) -> Column:
    """A time as a whole number of at least 0; what is no number, a truth value included, is the default."""
    kind = F.schema_of_variant(value)
    number = F.when(kind == "BOOLEAN", None).when(kind == "STRING", F.try_variant_get(value, "$", "string").try_cast("long")).otherwise(F.try_variant_get(value, "$", "double").cast("long"))
    return F.greatest(F.lit(0), F.coalesce(number, F.lit(default).cast("long") if isinstance(default, int) else default))


def timings(payload: Column) -> Column:
    """Struct of all timings of a retrieval out of a JSON object, 0 where one is missing, and whether all were there."""
    v = F.try_parse_json(payload)
    there = F.lit(True)
    for name in TIMINGS:
        there = there & F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    return F.struct(*[whole_ms(F.try_variant_get(v, f"$.{n}", "variant")).alias(n) for n in TIMINGS], there.alias("breakdown_available"))


def step(name: str, **fields: Column) -> Column:
    """A step of a trace as JSON; fields that are null are left out."""
    return F.to_json(F.struct(F.lit(name).alias("step"), *[c.alias(k) for k, c in fields.items()]))


def completed(trace: Column, total_ms: Column | int = 0) -> Column:
    """The steps (JSON texts, in order; null: none) with a last one that says completed, its status and time.

    One that ends the trace already gets what it lacks and keeps all else that it says; a time that is no number becomes total_ms.
    """
    trace = F.coalesce(trace, F.array().cast("array<string>"))
    total = F.greatest(F.lit(0), F.coalesce((F.lit(total_ms) if isinstance(total_ms, int) else total_ms).cast("long"), F.lit(0)))
    fields = F.from_json(F.get(trace, F.size(trace) - 1), "map<string,variant>")
    text = lambda k: F.try_variant_get(F.try_element_at(fields, F.lit(k)), "$", "string")
    ended = F.coalesce(F.lower(F.trim(text("step"))) == "completed", F.lit(False))
    ms = whole_ms(F.try_element_at(fields, F.lit("total_ms")), total)
    rest = F.map_filter(fields, lambda k, v: k != "total_ms")
    added = F.map_from_entries(F.filter(F.array(F.struct(F.lit("status"), F.parse_json(F.lit('"success"'))), F.struct(F.lit("total_ms"), F.parse_json(ms.cast("string")))), lambda e: (e["col1"] == "total_ms") | ~F.map_contains_key(rest, "status")))
    mended = F.concat(F.slice(trace, 1, F.greatest(F.lit(0), F.size(trace) - 1)), F.array(F.to_json(F.map_concat(rest, added))))
    return F.when(ended, mended).otherwise(F.concat(trace, F.array(step("completed", status=F.lit("success"), total_ms=total))))


def as_list(trace: Column) -> Column:
    """The steps as one JSON list."""
    return F.concat(F.lit("["), F.array_join(trace, ","), F.lit("]"))


def steps(traces: DataFrame) -> DataFrame:
    """One row a step of traces (run_id, trace: a JSON list of steps), with its number; a trace that is no JSON has none."""
    return traces.select("run_id", F.posexplode(F.from_json("trace", STEP)).alias("step_no", "s")).select("run_id", "step_no", "s.*")


def documents(rows: DataFrame) -> DataFrame:
    """One row for each document that a step names: run_id, step_no, kind (retrieve, rerank, select), doc_no, fields, scores.

    A loop step holds lists of all three kinds; each step of retrieval without documents stands with none (doc_no null).
    """
    loop, none = F.col("step") == "loop", F.expr(f"cast(array() as array<struct<{DOC}>>)")
    lists = F.array(
        F.struct(F.lit("retrieve").alias("kind"), F.when(F.col("step") == "retrieve", F.coalesce("docs", none)).when(loop, F.coalesce("retrieved_docs", none)).alias("docs")),
        F.struct(F.lit("rerank").alias("kind"), F.when(F.col("step") == "rerank", F.col("docs")).when(loop, F.col("reranked_docs")).alias("docs")),
        F.struct(F.lit("select").alias("kind"), F.when(F.col("step") == "context_select", F.col("docs")).when(loop, F.col("selected_context_docs")).alias("docs")),
    )
    parts = rows.select("run_id", "step_no", F.explode(lists).alias("l")).where("l.docs is not null")
    return parts.select("run_id", "step_no", "l.kind", F.posexplode_outer("l.docs").alias("doc_no", "d")).select("run_id", "step_no", "kind", "doc_no", "d.*")


def rankings(docs: DataFrame) -> DataFrame:
    """run_id, strategy, rank and the six fields as written (empty where there is none): the distinct sources of each strategy.

    dense and bm25 order the documents of the last retrieval by their score; hybrid are those of the last retrieval that has
    any source, in their order, or all sources of a run without one, as first seen; hybrid_rerank those of the last reranking
    that has any. Equal scores keep the order of the step. Documents without any field count for nothing.
    """
    per_run = Window.partitionBy("run_id")
    last = F.max(F.when(F.col("kind") == "retrieve", F.col("step_no"))).over(per_run)
    named = F.concat(*[selectors.normal(F.col(c)) for c in FIELDS]) != ""
    known = lambda kind: F.max(F.when((F.col("kind") == kind) & named, F.col("step_no"))).over(per_run)
    marked = docs.withColumns({"_last": last, "_hybrid": known("retrieve"), "_rerank": known("rerank")}).where(named)
    here = (F.col("kind") == "retrieve") & (F.col("step_no") == F.col("_last"))
    scored = lambda c: F.when(here & F.col(c).isNotNull(), F.struct((-F.col(c)).alias("s"), F.lit(0).alias("n"), F.col("doc_no").alias("d")))
    placed = lambda rule: F.when(rule, F.struct(F.lit(0.0).alias("s"), F.col("step_no").alias("n"), F.col("doc_no").alias("d")))
    hybrid = F.when(F.col("_hybrid").isNull(), F.lit(True)).otherwise((F.col("kind") == "retrieve") & (F.col("step_no") == F.col("_hybrid")))
    reranked = (F.col("kind") == "rerank") & (F.col("step_no") == F.col("_rerank"))
    keys = {"dense": scored("dense_score"), "bm25": scored("sparse_score"), "hybrid": placed(hybrid), "hybrid_rerank": placed(reranked)}
    entries = F.array(*[F.struct(F.lit(name).alias("strategy"), key.alias("place")) for name, key in keys.items()])
    rows = marked.select("run_id", *FIELDS, F.inline(entries)).where("place is not null")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "strategy").orderBy("place")))
    # The selectors' rule for equal sources, which compares normal forms.
    found = selectors.sources(ranked.withColumn("example_id", F.struct("run_id", "strategy")).drop("run_id", "strategy", "place"))
    return found.select("example_id.run_id", "example_id.strategy", "rank", *[f"said.{c}" for c in FIELDS])


def counts(rows: DataFrame) -> DataFrame:
    """Per run: the last counts of retrieved and selected documents and the last chunk settings; 0 and null where no step names them."""
    loop, step = F.col("step") == "loop", F.col("step")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("step_no")))
    retrieved = F.when(step == "retrieve", F.col("count")).when(loop, F.col("retrieved_count"))
    selected = F.when(step == "context_select", F.col("count")).when(loop, F.col("selected_count"))
    setting = lambda c: F.when((step == "retrieve") | loop, F.col(c))
    return rows.groupBy("run_id").agg(
        F.coalesce(last(retrieved), F.lit(0)).alias("retrieved_count"), F.coalesce(last(selected), F.lit(0)).alias("selected_count"),
        last(setting("chunk_size")).alias("chunk_size"), last(setting("chunk_overlap")).alias("chunk_overlap"),
    )


def first_sources(chunk_ids: DataFrame, sources: DataFrame) -> DataFrame:
    """run_id, place, chunk_id and the first source (by number) of a run with that chunk; null fields where there is none."""
    first = sources.groupBy("run_id", "chunk_id").agg(F.min_by(F.struct("doc_id", "source"), "number").alias("s"))
    return chunk_ids.join(first, ["run_id", "chunk_id"], "left").select("run_id", "place", "chunk_id", "s.doc_id", "s.source")


def strategy_summary(metrics: DataFrame) -> DataFrame:
    """strategy, n, hit_rate, avg_mrr, avg_ndcg of runs that have the strategy."""
    mean = lambda c, name: F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 6).alias(name)
    return metrics.groupBy("strategy").agg(F.count("*").alias("n"), mean("hit", "hit_rate"), mean("mrr", "avg_mrr"), mean("ndcg", "avg_ndcg"))

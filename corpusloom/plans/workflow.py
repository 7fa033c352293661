"""The three query modes as transforms over a batch of queries: standard, advanced and compare.

Models are injected: an answerer is a function from a frame with query and context to a column. The default answers
with the sentence of the context that shares most words with the query, which is deterministic and runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, extract, index, judge, rank, replies, retrieve, traces
from ..sources.tables import stored
from . import indexes
from .indexes import Indexes

Answer = Callable[[Column, Column], Column]  # of query and context
Model = Callable[[Column], Column]  # of a prompt
Translate = Callable[[Column, Column], Column]  # of answer and language

MAX_LOOPS = 1
FAST_CONFIDENCE = 0.95
#: What a model is asked, unless a plan is given another template; names are filled in.
ANSWER_PROMPT = "Question: $question\nAnswer in: $language\nUse only this context:\n$context\nReply with a JSON object of answer, confidence and status."
# The messages of no evidence.
INSUFFICIENT = {"vi": "Không đủ thông tin từ tài liệu để trả lời", "en": "Insufficient evidence to provide a grounded answer."}


def best_sentence(query: Column, context: Column) -> Column:
    """The first of the context's sentences with the most words of the query."""
    score = lambda wanted: F.array_max(F.transform(chunking.sentences(context), lambda s, i: F.struct(F.size(F.array_intersect(judge.terms(s), wanted)).alias("n"), (-i).alias("i"), s.alias("s"))))
    return tx.let(tx.let(judge.terms(query), score), lambda best: F.when(best["n"] > 0, best["s"]))


def insufficient(language: Column) -> Column:
    return F.when(language == "vi", INSUFFICIENT["vi"]).otherwise(INSUFFICIENT["en"])


def retrieve_hybrid(chunks: DataFrame | Indexes, queries: DataFrame, k: int) -> DataFrame:
    """Fused hits of all queries; the per-query limit cuts afterwards, so that the bound k prunes the ranking."""
    n, found = retrieve.depth(k), indexes.of(chunks)
    doc = lambda h: h.withColumn("doc_id", F.col("chunk_id"))
    asked = index.hash_counts(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text"))).withColumnRenamed("chunk_id", "query_id")
    return retrieve.fuse(doc(retrieve.dense_topk(found.vectors(), asked, n)), doc(retrieve.bm25_topk(found.postings(), queries, n)), k)


def retrieve_rewrites(chunks: DataFrame | Indexes, rewrites: DataFrame, k: int) -> DataFrame:
    """One list of hits for each query out of those of all its rewrites (query_id, place, rewrite): a chunk's scores add up."""
    one = rewrites.select("query_id", F.to_json(F.struct("query_id", "place")).alias("key"), F.col("rewrite").alias("query"))
    hits = retrieve_hybrid(chunks, one.select(F.col("key").alias("query_id"), "query"), k).withColumnRenamed("query_id", "key")
    sums = hits.join(one.select("key", "query_id"), "key").groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"), F.max("dense_score").alias("dense_score"), F.max("sparse_score").alias("sparse_score"))
    return retrieve.ranked(sums.withColumn("doc_id", F.col("chunk_id")).withColumn("_tie", F.col("chunk_id").cast("string")), k, tie="_tie").drop("_tie")


def analysed(queries: DataFrame) -> DataFrame:
    """Adds language, class and limits to query_id, query."""
    q = queries.withColumn("query", tx.normalized_query(F.col("query")))
    q = stored(q.select("query_id", "query", tx.language(F.col("query")).alias("language"), tx.complexity(F.col("query")).alias("complexity")))
    return q.select("*", *judge.budget(F.col("complexity")))


def listed(hits: DataFrame, order: str, *fields: str, name: str) -> DataFrame:
    """query_id and its few hits in order, as documents of a trace's step."""
    text = [F.col(c).cast("string").alias(c) if c in ("chunk_id", "doc_id") else F.col(c) for c in fields]
    return hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*text).alias("d")))), lambda x: x["d"]).alias(name))


def standard(chunks: DataFrame | Indexes, queries: DataFrame, answer: Answer | None = None, rewrites: DataFrame | None = None, translate: Translate | None = None, model: Model | None = None, prompt: str = ANSWER_PROMPT) -> DataFrame:
    """query_id, query, language, complexity, policy, answer, context, lead, n_docs, n_citations, confidence, status, grounded, grounding,
    fast_path, language_mismatch, and the trace's steps and documents.

    lead: the first context's chunk. A simple question is answered by rule out of the first context where the rules find an answer
    that can be trusted (fast_path says which, or why not); all others by the model. rewrites (query_id, place, rewrite) take the
    queries' place in retrieval. An answer in another language than the question's goes through translate, if there is one.
    model: replies to the filled prompt; its reply's answer, status and confidence hold (no confidence: the retrieval's).
    """
    found, q = indexes.of(chunks), analysed(queries)
    hits = retrieve_hybrid(found, q, judge.BASE[0]) if rewrites is None else retrieve_rewrites(found, rewrites, judge.BASE[0])
    hits = hits.join(q.select("query_id", "hybrid_top_k", "rerank_top_k", "context_top_k"), "query_id").where(F.col("rank") <= F.col("hybrid_top_k"))
    hits = stored(hits)
    stats, sure = rank.score_stats(hits), rank.confidence(hits, ("score",))
    text = found.chunks.select("chunk_id", F.col("text").alias("content"))
    reranked = rank.rerank_by_score(hits.where("rank <= rerank_top_k"), judge.BASE[1])
    chosen = reranked.where("rank <= context_top_k").join(text, "chunk_id")
    packed = stored(rank.pack(chosen, judge.BASE[2], judge.BASE[3]).join(hits.select("query_id", "chunk_id", "doc_id", "score", "dense_score", "sparse_score"), ["query_id", "chunk_id"]))
    context = packed.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "content"))), lambda x: x["content"]).alias("contexts"), F.count("*").alias("n_docs"), F.min_by("chunk_id", "slot").cast("string").alias("lead"),
        F.min_by(extract.best_score(F.col("score"), F.col("dense_score"), F.col("sparse_score")), "slot").alias("lead_score"),
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "chunk_id"))), lambda x: x["chunk_id"]).alias("citations"),
    )
    docs = [listed(hits, "rank", "chunk_id", "doc_id", "rank", "score", "dense_score", "sparse_score", name="retrieved_docs"), listed(reranked, "rank", "chunk_id", "doc_id", "rank", "score", "dense_score", "sparse_score", name="reranked_docs"), listed(packed, "slot", "chunk_id", "doc_id", "content", name="selected_docs")]
    rows = q
    for part in (stats, sure, context, *docs):
        rows = rows.join(part, "query_id", "left")
    rows = rows.withColumns({"context": F.coalesce(F.array_join("contexts", "\n"), F.lit("")), "n_docs": F.coalesce("n_docs", F.lit(0))})
    policy = rank.cascade(F.coalesce("n_hits", F.lit(0)), F.col("top"), F.col("gap"), F.col("complexity"), F.lit("standard"), cross_encoder=False)
    rows = rows.withColumn("policy", policy).withColumn("_fast", extract.extractive(F.col("query"), F.get("contexts", F.lit(0)), F.col("language"), F.col("lead_score")))
    if model is None:
        said = F.struct((answer or best_sentence)(F.col("query"), F.col("context")).alias("answer"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("confidence"))
    else:
        filled = replies.rendered(F.lit(prompt), {"question": F.col("query"), "language": F.col("language"), "context": F.col("context")})
        rows = stored(rows.withColumn("_reply", F.when(~F.col("_fast.used") & (F.col("n_docs") > 0), model(filled))))
        said = F.when(F.col("n_docs") > 0, replies.structured_answer(F.col("_reply")))
    rows = stored(rows.withColumn("_said", F.when(~F.col("_fast.used"), said)))
    rows = rows.withColumns({"status": F.col("_said.status"), "answer": F.when(F.col("_fast.used"), F.col("_fast.answer")).otherwise(F.col("_said.answer")), "confidence": F.when(F.col("_fast.used"), FAST_CONFIDENCE).otherwise(F.coalesce("_said.confidence", "confidence")), "fast_path": F.when(F.col("n_docs") > 0, F.col("_fast.reason")).otherwise("no_context")})
    return stored(judged(stored(rows), translate))


def judged(rows: DataFrame, translate: Translate | None = None) -> DataFrame:
    """Adds language_mismatch, grounded, grounding and the trace's steps to query, answer, status (null: answered), context, n_docs,
    citations; a missing answer abstains."""
    status = F.when(F.col("answer").isNull(), "insufficient_evidence").otherwise(F.coalesce("status", F.lit("answered")))
    rows = spoken(rows.withColumn("status", status), translate)
    rows = rows.withColumn("answer", F.coalesce("answer", insufficient(F.col("language"))))
    rows = rows.withColumn("grounded", F.when(F.col("status") != "insufficient_evidence", tx.overlap_score(F.col("answer"), F.col("context"))).otherwise(0.0))
    n = F.when(F.col("status") != "insufficient_evidence", F.coalesce(F.array_size("citations"), F.lit(0))).otherwise(0)
    rows = stored(rows.withColumn("n_citations", n).withColumn("grounding", judge.grounding(F.col("status"), F.col("answer"), F.col("grounded"), F.col("n_docs"), n)))
    said = F.col("status") != "insufficient_evidence"
    trace = F.array_compact(F.array(
        traces.step("retrieve", query=F.col("query"), response_language=F.col("language"), top_k=F.col("hybrid_top_k"), rerank_top_n=F.col("rerank_top_k"), query_complexity=F.col("complexity"), count=F.coalesce(F.size("retrieved_docs"), F.lit(0)), chunk_ids=F.col("retrieved_docs.chunk_id"), docs=F.col("retrieved_docs")),
        traces.step("rerank", count=F.coalesce(F.size("reranked_docs"), F.lit(0)), policy=F.col("policy"), docs=F.col("reranked_docs")),
        traces.step("context_select", count=F.col("n_docs"), docs=F.col("selected_docs")),
        traces.step("generate", status=F.col("status"), fast_path_reason=F.col("fast_path"), confidence=F.col("confidence")),
        F.when(said, traces.step("language_guard", response_language=F.col("language"), language_mismatch=F.col("language_mismatch"))),
        F.when(said, traces.step("grounding_check", grounded_score=F.col("grounded"), grounding_reason=F.substring_index("grounding", "/", 1), hallucination_detected=F.col("grounding").endswith("/true"), citation_count=F.col("n_citations"))),
    ))
    return rows.select(
        "query_id", "query", "language", "complexity", "policy", "answer", "context", "lead", "n_docs", "n_citations",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "status", "grounded", "grounding", "fast_path", "language_mismatch",
        trace.alias("steps"), "retrieved_docs", "reranked_docs", "selected_docs",
    )


def spoken(rows: DataFrame, translate: Translate | None) -> DataFrame:
    """Adds language_mismatch; an answer in another language than its question's is said again by translate, if that says anything."""
    wrong = lambda: F.when(F.col("status") == "insufficient_evidence", F.lit(False)).otherwise(F.coalesce(tx.language_mismatch(F.col("answer"), F.col("language")), F.lit(False)))
    rows = rows.withColumn("language_mismatch", wrong())
    if translate is None:
        return rows
    again = F.nullif(tx.stripped(translate(F.col("answer"), F.col("language"))), F.lit(""))
    rows = stored(rows.withColumn("answer", F.when(F.col("language_mismatch"), F.coalesce(again, F.col("answer"))).otherwise(F.col("answer"))))
    return rows.withColumn("language_mismatch", wrong())


def guarded(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Answers that the critique wants refined, refined; those that say more than their context, cut back to what it holds.

    Adds status, fallback and stop_reason of the final answer, which is grounded anew.
    """
    language, relevant = F.col("language"), F.col("critique_category") != "no_evidence"
    refine = F.col("critique_should_refine") & (F.col("status") != "insufficient_evidence")
    rows = rows.withColumn("_refine", refine).withColumn("answer", F.when(refine, judge.refined(F.col("answer"), F.col("critique_missing"), F.col("lead"), language)).otherwise(F.col("answer")))
    score = lambda: F.when(F.col("status") != "insufficient_evidence", tx.overlap_score(F.col("answer"), F.col("context"))).otherwise(0.0)
    rows = stored(rows.withColumn("grounded", F.when(F.col("_refine"), score()).otherwise(F.col("grounded"))))
    ground = judge.grounding(F.col("status"), F.col("answer"), F.col("grounded"), F.col("n_docs"), F.col("n_citations"))
    wrong = ground.endswith("/true")
    ask = judge.asks_strict_refine(F.col("query"), F.col("complexity"), F.col("n_citations"), F.col("grounded"), wrong, strict)
    # The strict form without a model abstains; the cautious one takes its place where there is any context.
    fallback = relevant & ask & (F.col("n_docs") > 0)
    careful = judge.cautious(F.substring_index("context", "\n", 1), language, insufficient(language))
    rows = rows.withColumn("fallback", fallback).withColumn("answer", F.when(fallback, careful).otherwise(F.col("answer")))
    rows = stored(rows.withColumn("grounded", F.when(F.col("fallback"), tx.overlap_score(F.col("answer"), F.col("context"))).otherwise(F.col("grounded"))))
    final = judge.grounding(F.col("status"), F.col("answer"), F.col("grounded"), F.col("n_docs"), F.col("n_citations"))
    status = judge.advanced_status(relevant, F.col("grounded"), F.col("n_citations"), F.col("n_docs"), final.endswith("/true"))
    stop = (
        F.when(F.col("critique_should_retry"), "max_loop_reached").when(~relevant, "no_relevant_context").when(F.col("fallback"), "cautious_fallback")
        .when(F.col("_refine"), "refined_with_context").otherwise("grounded")
    )
    return rows.withColumns({"grounding": final, "status": status, "stop_reason": stop}).drop("_refine")


def next_rewrites(again: DataFrame, tried: DataFrame, fan_out: int) -> DataFrame:
    """query_id, place, rewrite: the first rewrites of each query that no loop has asked yet; none ends the query's loops."""
    better = judge.better_queries(F.col("query"), F.col("critique_missing"))
    more = F.array(*[F.concat(F.col("query"), F.lit(f" {x}")) for x in judge.REWRITE_ENDS])
    focus = F.transform(F.filter(F.slice(F.split("critique_missing", ","), 1, 2), lambda x: x != ""), lambda x: F.concat(F.col("query"), F.lit(" focus on "), x))
    rewrites = again.select("query_id", F.posexplode(judge.distinct_rewrites(F.concat(better, more, focus))).alias("n", "rewrite")).withColumn("low", F.lower("rewrite"))
    fresh = rewrites.join(tried, ["query_id", "low"], "left_anti")
    return stored(fresh.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).where(F.col("place") <= fan_out).select("query_id", "place", "rewrite", "low"))


def advanced(
    chunks: DataFrame | Indexes, queries: DataFrame, answer: Answer | None = None, max_loops: int = MAX_LOOPS, first: DataFrame | None = None,
    fan_out: int = 1, critic: Callable[[Column, Column, Column], Column] | None = None, translate: Translate | None = None,
    gate: Callable[[Column], Column] | None = None, model: Model | None = None, strict: bool = False,
) -> DataFrame:
    """The standard rows of the queries that pass the gate, criticised; those that ask for it run again with rewrites of their query.

    Each further loop takes only the rows that still ask and have a rewrite that was not asked yet, `fan_out` of them a query, whose
    hits are fused. first: the standard rows of the same queries, if there are any. critic: a model's critique, asked where the
    policy says so, that is merged into the rules' own. gate: a model's reply to a query on whether it needs retrieval, asked where
    the policy says so; what can't be read leaves the rules' decision. strict: the policies ask models wherever there is one.
    """
    found = indexes.of(chunks)
    ruled = queries.withColumn("_rule", tx.gate_reason(F.col("query")))
    asked = judge.asks_model_gate(F.col("query"), tx.complexity(F.col("query")), F.col("_rule"), strict)
    # A model's replies are written once, as the rows that pass and those that don't are read apart.
    gated = ruled if gate is None else stored(ruled.withColumn("_gate", F.when(asked, gate(F.col("query")))))
    gated = gated.withColumn("gate", judge.gate(F.col("query"), F.col("_rule"), asked, None if gate is None else F.col("_gate")))
    go = gated.where("gate.need")
    rows = standard(found, go.select("query_id", "query"), answer, translate=translate, model=model) if first is None else first.join(go.select("query_id"), "query_id", "left_semi")
    rows = rows.withColumns({"loops": F.lit(1), "earlier": F.array().cast("array<string>")})
    tried = stored(rows.select("query_id", F.lower("query").alias("low")))
    done = None
    for loop in range(max_loops + 1):
        rows = stored(criticised(rows, loop, max_loops, critic, strict))
        rows = rows.withColumn("earlier", F.concat("earlier", F.array(loop_step(loop + 1))))
        ask = rows.where("critique_should_retry")
        fresh = None if loop == max_loops or ask.isEmpty() else next_rewrites(ask, tried, fan_out)
        again = None if fresh is None else rows.where("critique_should_retry").join(fresh.select("query_id").distinct(), "query_id", "left_semi")
        stay = rows if again is None else rows.join(again.select("query_id"), "query_id", "left_anti")
        done = stay if done is None else done.unionByName(stay)
        if again is None or again.isEmpty():
            break
        tried = tried.unionByName(fresh.select("query_id", "low"))
        before = again.select("query_id", "earlier")
        named = fresh.where("place = 1").select("query_id", F.col("rewrite").alias("query"))
        rows = standard(found, named, answer, rewrites=fresh.select("query_id", "place", "rewrite"), translate=translate, model=model).withColumn("loops", F.lit(loop + 2)).join(before, "query_id")
    out = guarded(done, strict)
    if translate is not None:
        wrong = F.coalesce(tx.language_mismatch(F.col("answer"), F.col("language")), F.lit(False))
        out = spoken(stored(out.withColumn("_was", wrong)), translate)
        out = out.withColumn("stop_reason", F.when((F.col("stop_reason") == "grounded") & F.col("_was") & ~F.col("language_mismatch"), "language_refined").otherwise(F.col("stop_reason")))
    trace = traces.as_list(traces.completed(F.concat("earlier", F.array(traces.step("final", status=F.col("status"), stop_reason=F.col("stop_reason"), grounded_score=F.col("grounded"), citation_count=F.col("n_citations"))))))
    out = out.select("query_id", "language", "answer", "n_docs", "n_citations", F.col("critique_confidence").alias("confidence"), "status", "grounded", "grounding", "loops", "fallback", "stop_reason", trace.alias("trace"))
    refused = gated.where("not gate.need")
    language = tx.language(F.col("query"))
    return out.unionByName(refused.select(
        "query_id", language.alias("language"), insufficient(language).alias("answer"), F.lit(0).cast("long").alias("n_docs"), F.lit(0).alias("n_citations"), F.lit(0.0).alias("confidence"),
        F.lit("insufficient_evidence").alias("status"), F.lit(0.0).alias("grounded"), F.lit("insufficient_evidence/false").alias("grounding"), F.lit(0).alias("loops"), F.lit(False).alias("fallback"), F.col("gate.reason").alias("stop_reason"),
        traces.as_list(traces.completed(F.array(traces.step("gate", reason=F.col("gate.reason"), strategy=F.col("gate.strategy"), retrieve=F.lit(False))))).alias("trace"),
    ))


def criticised(rows: DataFrame, loop: int, max_loops: int, critic: Callable[[Column, Column, Column], Column] | None, strict: bool = False) -> DataFrame:
    """Adds the critique of each row: the rules' own, and a model's over it where there is one and the policy asks for it."""
    own = judge.critique(F.col("query"), F.when(F.col("status") != "insufficient_evidence", F.col("answer")).otherwise(""), F.col("context"), F.col("n_docs"), F.lit(loop), F.lit(max_loops))
    rows = rows.drop(*[c for c in rows.columns if c.startswith("critique_")]).withColumns({f"critique_{k}": v for k, v in own.items()})
    if critic is None:
        return rows.withColumn("critique_strategy", F.lit("rules"))
    asks = judge.asks_model_critic(F.col("query"), F.col("complexity"), F.col("n_citations"), F.col("grounded"), F.char_length("answer"), F.col("confidence"), strict)
    rows = stored(rows.withColumn("_said", F.when(asks, critic(F.col("query"), F.col("answer"), F.col("context")))))
    c = lambda k: F.col(f"critique_{k}")
    missing = F.filter(F.split(c("missing"), ","), lambda x: x != "")
    merged = judge.merged_critique(
        {"grounded": c("category") == "grounded", "enough_evidence": c("category") != "no_evidence", "conflict": c("conflict"), "missing": missing, "should_retry": c("should_retry"), "should_refine": c("should_refine"), "better_queries": F.array().cast("array<string>"), "confidence": c("confidence"), "note": c("category")},
        F.col("_said"), F.lit(loop), F.lit(max_loops),
    )
    held = {"conflict": merged["conflict"], "should_retry": merged["should_retry"], "should_refine": merged["should_refine"], "confidence": merged["confidence"], "missing": F.array_join(merged["missing"], ",")}
    return rows.withColumns({f"critique_{k}": v for k, v in held.items()}).withColumn("critique_strategy", F.when(F.col("_said").isNotNull(), "model").otherwise("rules")).drop("_said")


def loop_step(loop: int) -> Column:
    """The step of a loop: what it asked, found and chose, and what the critique said of it."""
    return traces.step(
        "loop", loop=F.lit(loop), query=F.col("query"), retrieved_count=F.coalesce(F.size("retrieved_docs"), F.lit(0)), retrieved_docs=F.col("retrieved_docs"), reranked_count=F.coalesce(F.size("reranked_docs"), F.lit(0)),
        reranked_docs=F.col("reranked_docs"), selected_count=F.col("n_docs"), selected_context_docs=F.col("selected_docs"), generated_status=F.col("status"), fast_path_reason=F.col("fast_path"),
        critique_strategy=F.col("critique_strategy"), critique_category=F.col("critique_category"), should_retry=F.col("critique_should_retry"), grounding_lexical_score=F.col("grounded"), query_complexity=F.col("complexity"),
    )


def compare(chunks: DataFrame | Indexes, queries: DataFrame) -> DataFrame:
    """Both modes of each query, their scores, deltas and the verdict. Advanced starts from the standard rows."""
    def side(frame: DataFrame, name: str) -> DataFrame:
        h, m = F.col("grounding").endswith("/true"), tx.language_mismatch(F.col("answer"), F.col("language"))
        six = (F.col("n_citations"), F.col("grounded"), F.col("status"), h, m, F.col("fallback"))
        s = F.struct(F.col("n_citations").alias("citations"), "status", h.alias("hallucination"), judge.branch_score(*six, F.col("confidence")).alias("score"), judge.weak(*six).alias("weak"), "grounded", "confidence")
        return stored(frame.select("query_id", s.alias(name)))

    chunks = indexes.of(chunks)
    first = standard(chunks, queries)
    both = side(first.withColumn("fallback", F.lit(False)), "standard").join(side(advanced(chunks, queries, first=first), "advanced"), "query_id")
    fields = lambda n: {k: F.col(f"{n}.{k}") for k in ("citations", "status", "hallucination", "score", "weak")}
    delta = lambda k: F.round(F.col(f"advanced.{k}") - F.col(f"standard.{k}"), 6)
    verdict = judge.winner(fields("standard"), fields("advanced"))
    return both.select("query_id", F.col("standard.score").alias("standard_score"), F.col("advanced.score").alias("advanced_score"), delta("confidence").alias("confidence_delta"), delta("grounded").alias("grounded_delta"), verdict.alias("winner"))


def response(rows: DataFrame) -> DataFrame:
    """The standard rows with their trace as one JSON list that ends with completed."""
    trace = traces.as_list(traces.completed(F.concat("steps", F.array(traces.step("timing_summary", query_complexity=F.col("complexity"), fast_path_reason=F.col("fast_path"), **{n: F.lit(0) for n in traces.TIMINGS})))))
    return rows.select("query_id", "query", "language", "complexity", "policy", "answer", "n_docs", "n_citations", "confidence", "status", "grounded", "grounding", "fast_path", "language_mismatch", trace.alias("trace"))


def trace_rankings(responses: DataFrame) -> DataFrame:
    """query_id, strategy, rank, chunk_id of the documents that the responses' traces name."""
    found = traces.rankings(traces.documents(traces.steps(responses.select(F.col("query_id").alias("run_id"), "trace"))))
    return found.select(F.col("run_id").alias("query_id"), "strategy", "rank", "chunk_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def inputs(spark: SparkSession, sf_dir: str) -> tuple[Indexes, DataFrame]:
        chunks = indexes.of_table(spark, f"{sf_dir}/documents.parquet", "doc_id")
        asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
        return chunks, asked

    return {
        "workflow_standard": lambda spark, d: response(standard(*inputs(spark, d))),
        "workflow_rankings": lambda spark, d: trace_rankings(response(standard(*inputs(spark, d)))),
        "workflow_advanced": lambda spark, d: advanced(*inputs(spark, d)),
        "workflow_compare": lambda spark, d: compare(*inputs(spark, d)),
    }

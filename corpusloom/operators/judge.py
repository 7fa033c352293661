"""Grounding, critique, budgets, compare verdicts and answer status as column rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import stored
from . import replies

# Limits of the simple and the normal class (retrieved, reranked, context chunks, characters, tokens).
BUDGETS = {"simple_extractive": (3, 3, 2, 1600, 384), "normal": (5, 5, 3, 3000, 768)}
BASE = (8, 6, 4, 4000, 2048)
COMPLEX_TOKENS = 1536
BUDGET_FIELDS = ("hybrid_top_k", "rerank_top_k", "context_top_k", "context_max_chars", "max_tokens")


def budget(complexity: Column, base: tuple[int, ...] = BASE, dynamic: bool = True, locked: bool = False) -> list[Column]:
    """The five limits of a query by its class; none above its base, none below 1; locked keeps retrieval at the base."""
    out = []
    hybrid = None
    for i, name in enumerate(BUDGET_FIELDS):
        value = F.lit(base[i])
        if dynamic and not (locked and i < 2):
            target = F.lit(COMPLEX_TOKENS if name == "max_tokens" else base[i])
            for kind, limits in BUDGETS.items():
                target = F.when(complexity == kind, limits[i]).otherwise(target)
            value = F.greatest(F.lit(1), F.least(F.lit(base[i]), target))
        if i == 0:
            hybrid = value
        if i == 1:
            value = F.least(value, hybrid)
        out.append(value.alias(name))
    return out


def grounding(status: Column, answer: Column, score: Column, contexts: Column, citations: Column) -> Column:
    """reason/hallucination of an answer by its overlap with the context."""
    blank = tx.stripped(F.coalesce(answer, F.lit(""))) == ""
    yes, no = "/true", "/false"
    return (
        F.when(status == "insufficient_evidence", "insufficient_evidence" + no)
        .when(blank & ((contexts > 0) | (citations > 0)), "empty_answer" + yes)
        .when(blank, "empty_answer" + no)
        .when(contexts == 0, "no_selected_context" + yes)
        .when((citations > 0) & (score >= 0.12), "strong_overlap_with_citations" + no)
        .when((citations > 0) & (score >= 0.02), "weak_overlap_with_citations" + no)
        .when((citations > 0) & (score >= 0.005), "very_low_overlap_with_citations" + no)
        .when(citations > 0, "almost_no_overlap_even_with_citations" + yes)
        .when(tx.generic(answer), "generic_answer_without_citations" + yes)
        .when(score >= 0.12, "strong_overlap_without_citations" + no)
        .when(score >= 0.04, "weak_overlap_without_citations" + no)
        .otherwise("low_overlap_without_citations" + yes)
    )


def terms(text: Column) -> Column:
    """Distinct lower-case tokens of more than two characters."""
    return F.filter(F.array_distinct(tx.tokens(text)), lambda t: F.char_length(t) > 2)


def critique(query: Column, answer: Column, context: Column, n_docs: Column, loop: Column, max_loops: Column) -> dict[str, Column]:
    """Category and decisions on a draft answer against the context's text."""
    q, a, c = terms(query), terms(answer), terms(context)
    low, body = F.lower(query), F.lower(context)
    abstain, retry = F.contains(low, F.lit("force abstain")), F.contains(low, F.lit("force retry"))
    missing = F.slice(F.array_sort(F.array_except(F.array_intersect(q, c), a)), 1, 5)
    seen = tx.share(a, c)
    category = (
        F.when(abstain | (tx.stripped(context) == "") | (tx.share(q, c) <= 0), "no_evidence")
        .when(seen < 0.02, "hallucination")
        .when(seen < 0.12, "weak_evidence")
        .when(F.size(missing) > 0, "incomplete_answer")
        .otherwise("grounded")
    )
    conflict = (n_docs > 1) & ((F.contains(body, F.lit("however")) & F.contains(body, F.lit("therefore"))) | F.contains(body, F.lit("conflict")))
    again = (retry | ((category == "no_evidence") & (loop < max_loops))) & ~abstain
    sure = (
        F.when(abstain, 0.0)
        .when((category == "grounded") & conflict, 0.65)
        .when(category == "grounded", 0.82)
        .when(category == "incomplete_answer", 0.62)
        .when(category == "weak_evidence", 0.42)
        .when(category == "hallucination", 0.28)
        .when(again, 0.35)
        .otherwise(0.2)
    )
    return {
        "category": category,
        "missing": F.array_join(missing, ","),
        "conflict": conflict,
        "should_retry": again,
        "should_refine": category.isin("weak_evidence", "incomplete_answer", "hallucination") & ~abstain,
        "confidence": sure,
    }


# What a rewrite ends with.
REWRITE_ENDS = ("with grounded evidence", "with source citations")


def better_queries(query: Column, missing: Column) -> Column:
    """Queries for another pass: one for evidence and one for each of the first two missing words."""
    aspects = F.filter(F.slice(F.split(missing, ","), 1, 2), lambda x: x != "")
    return F.concat(F.array(F.concat(query, F.lit(" supporting evidence"))), F.transform(aspects, lambda x: F.concat(query, F.lit(" "), x, F.lit(" details"))))


def distinct_rewrites(rewrites: Column, most: int = 4) -> Column:
    """Trimmed rewrites without those that differ from an earlier one in case only; the first few."""
    trimmed = F.filter(F.transform(rewrites, tx.stripped), lambda r: r != "")
    pairs = F.transform(trimmed, lambda r: F.struct(F.lower(r).alias("low"), r.alias("r")))
    first = lambda ps: F.filter(ps, lambda p, i: F.array_position(ps["low"], p["low"]) == i + 1)
    return F.slice(F.transform(tx.let(pairs, first), lambda p: p["r"]), 1, most)


# Words of requests that always get the strict path, and of vague ones.
HIGH_RISK_TERMS = (
    "legal advice", "attorney", "luật sư", "tu van phap ly", "tư vấn pháp lý", "medical advice", "chẩn đoán", "chan doan",
    "kê đơn", "ke don", "điều trị", "dieu tri", "đầu tư", "dau tu", "financial advice", "tax advice", "thuế", "thue",
    "compliance", "trách nhiệm pháp lý", "trach nhiem phap ly",
)
AMBIGUOUS_PATTERN = r"(?i)\b(?:help|assist|gợi ý|goi y|khuyên|khuyen|nên làm gì|nen lam gi|advice)\b"
INTERPRETATION_PATTERN = r"(?i)\b(?:interpret|analysis|analyze|đánh giá|danh gia|phân tích|phan tich)\b"


def high_risk(query: Column) -> Column:
    """Whether a query (null: empty) names a field of risk or asks for an interpretation."""
    query = F.coalesce(query, F.lit(""))
    low = F.lower(tx.stripped(query))
    out = tx.any_match(query, (INTERPRETATION_PATTERN,))
    for term in HIGH_RISK_TERMS:
        out = out | F.contains(low, F.lit(term))
    return out


def asks_model_gate(query: Column, complexity: Column, reason: Column, strict: bool = False) -> Column:
    """Whether a model is to decide on retrieval: never where the rules were sure, else for strict, risky, complex or vague queries."""
    sure = reason.isin("empty_query", "forced_retrieval", "small_talk", "small_talk_short")
    query = F.coalesce(query, F.lit(""))
    body = tx.stripped(query)
    vague = (body != "") & ((F.size(F.split(body, r"\s+")) <= 2) | tx.any_match(query, (AMBIGUOUS_PATTERN,)))
    return ~sure & (F.lit(strict) | high_risk(query) | (complexity == "complex") | vague)


def gate(query: Column, reason: Column, asked: Column, reply: Column | None) -> Column:
    """Struct of need, reason and strategy: what a model's reply says where it is asked and can be read, else the rules' reason."""
    by_rule = F.struct(reason.isin("default_retrieval", "forced_retrieval").alias("need"), reason.alias("reason"), F.lit("heuristic").alias("strategy"))
    if reply is None:
        return by_rule
    said = replies.gate_said(F.when(asked, reply))
    return F.coalesce(F.when(said.isNotNull(), F.struct(said["need"].alias("need"), said["reason"].alias("reason"), F.lit("llm").alias("strategy"))), by_rule)


def asks_model_critic(query: Column, complexity: Column, citations: Column, score: Column, length: Column, confidence: Column, strict: bool = False) -> Column:
    """Whether a model is to criticise an answer: strict, risky, uncited, badly grounded, complex, long or unsure ones."""
    weak_ground = F.coalesce(score < 0.06, F.lit(False))
    return F.lit(strict) | high_risk(query) | (citations <= 0) | weak_ground | (complexity == "complex") | (length >= 420) | F.coalesce(confidence < 0.35, F.lit(False))


def asks_strict_refine(query: Column, complexity: Column, citations: Column, score: Column, hallucination: Column, strict: bool = False) -> Column:
    """Whether an answer that says more than its context is to be refined strictly."""
    return hallucination & (F.lit(strict) | high_risk(query) | (complexity == "complex") | (citations <= 0) | F.coalesce(score < 0.035, F.lit(False)))


def refined(answer: Column, missing: Column, lead: Column, language: Column) -> Column:
    """The draft with its missing aspects and the source that supports it named, in the language of the answer."""
    aspects = F.array_join(F.slice(F.filter(F.split(missing, ","), lambda x: x != ""), 1, 3), ", ")
    vi = language == "vi"
    # The two notes, with their line ends as written.
    cover = F.when(vi, "\\n\\nBổ sung nội dung: ").otherwise("\\n\\nAdditional coverage: ")
    note = F.when(vi, "\\n\\nGhi chú bằng chứng: được hỗ trợ bởi ").otherwise("\\n\\nEvidence note: supported by ")
    return F.concat(tx.stripped(answer), F.when(aspects != "", F.concat(cover, aspects, F.lit("."))).otherwise(""), F.when(lead.isNotNull(), F.concat(note, lead, F.lit("."))).otherwise(""))


def cautious(context: Column, language: Column, otherwise: Column) -> Column:
    """The beginning of the first context in a sentence that promises little; without one, what stands for no evidence."""
    lead = tx.stripped(F.substring(F.replace(tx.stripped(context), F.lit("\n"), F.lit(" ")), 1, 220))
    # The two templates.
    vi = F.concat(F.lit("Theo ngữ cảnh hiện có, thông tin liên quan là: "), lead, F.lit("\n\nLưu ý: Bằng chứng còn hạn chế, cần đối chiếu thêm trong tài liệu."))
    en = F.concat(F.lit("Based on the available context, relevant information is: "), lead, F.lit("\n\nNote: evidence is limited and may need additional verification."))
    return F.when(F.coalesce(lead, F.lit("")) == "", otherwise).when(language == "vi", vi).otherwise(en)


# Bounds of the semantic score of grounding.
SEMANTIC_LEAST, SEMANTIC_WEIGHT = 0.58, 0.35
LONG_ANSWER, LOW_CONFIDENCE, LOW_LEXICAL = 320, 0.35, 0.04
SEMANTIC_CONTEXTS = 6


def semantic_policy(mode: Column, complexity: Column, lexical: Column, citations: Column, length: Column, confidence: Column, fast_path: Column, policy: str = "adaptive", modes: tuple[str, ...] = ("advanced", "compare")) -> Column:
    """Struct of use and reason: whether a model's likeness is asked for beside the lexical score, and why.

    modes are those that may ask a model; policy is adaptive, strict, or one of off, lexical and lexical_only.
    """
    say = lambda use, reason: F.struct(F.lit(use).alias("use"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    allowed = mode.isin(*modes)
    off = F.concat(mode, F.lit("_semantic_disabled"))
    body = F.when(fast_path, say(False, "fast_path_lexical_only"))
    if policy in ("off", "lexical", "lexical_only"):
        return body.otherwise(say(False, "policy_lexical_only"))
    if policy == "strict":
        return body.when(allowed, say(True, "strict_policy")).otherwise(say(False, off))
    risks = F.concat_ws(
        ",", F.when(citations <= 0, "no_citations"), F.when(length >= LONG_ANSWER, "long_answer"),
        F.when(confidence < LOW_CONFIDENCE, "low_retrieval_confidence"), F.when(lexical < LOW_LEXICAL, "low_lexical_score"),
    )
    plain = mode == "standard"
    body = body.when(plain & complexity.isin("simple", "simple_extractive"), say(False, "standard_simple_lexical_only")).when(plain & ~allowed, say(False, off))
    body = body.when(plain & (complexity == "complex"), say(True, "standard_complex_semantic_allowed"))
    body = body.when(plain & (risks != ""), say(True, F.concat(F.lit("standard_normal_risky:"), risks))).when(plain, say(False, "standard_normal_lexical_ok"))
    return body.when(allowed, say(True, F.concat(mode, F.lit("_semantic_allowed")))).otherwise(say(False, off))


def blended(lexical: Column, semantic: Column) -> Column:
    """The lexical score, raised by a model's likeness where that is sure enough; never lower than it was."""
    mixed = (1 - SEMANTIC_WEIGHT) * lexical + SEMANTIC_WEIGHT * semantic
    return F.when(semantic >= SEMANTIC_LEAST, F.round(F.greatest(lexical, F.least(F.lit(1.0), mixed)), 4)).otherwise(lexical)


def semantic_likeness(rows: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id and semantic: the largest cosine of the answer's vector with those of its first contexts that have text, 0 to 1;
    null where there is no answer or no context.

    embed gives key, vec of key, text and sees each distinct text once, whatever number of rows hold it.
    """
    contexts = F.slice(F.filter(F.transform("contexts", tx.stripped), lambda c: c != ""), 1, SEMANTIC_CONTEXTS)
    pairs = rows.select("query_id", tx.stripped(F.col("answer")).alias("a"), F.explode(contexts).alias("c")).where("a <> ''")
    key = lambda c: F.sha2(c.cast("binary"), 256)
    pairs = stored(pairs.select("query_id", "a", "c", key(F.col("a")).alias("ka"), key(F.col("c")).alias("kc")))
    texts = pairs.select(F.col("ka").alias("key"), F.col("a").alias("text")).unionAll(pairs.select("kc", "c")).groupBy("key").agg(F.any_value("text").alias("text"))
    vectors = stored(embed(texts).select("key", "vec"))
    both = pairs.select("query_id", "ka", "kc").join(vectors.select(F.col("key").alias("ka"), F.col("vec").alias("va")), "ka").join(vectors.select(F.col("key").alias("kc"), F.col("vec").alias("vc")), "kc")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vc"), F.col("vc")))
    cosine = F.when(norms > 0, dot(F.col("va"), F.col("vc")) / norms).otherwise(0.0)
    return both.groupBy("query_id").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max(cosine))), 4).alias("semantic"))


def with_semantic(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], use: Column) -> DataFrame:
    """Rows of query_id, answer, contexts, grounded with semantic and the blended score, for those that use says; others keep theirs."""
    asked = rows.where(use)
    out = rows.join(semantic_likeness(asked, embed), "query_id", "left")
    return out.withColumn("grounded", F.when(F.col("semantic").isNotNull(), blended(F.col("grounded"), F.col("semantic"))).otherwise(F.col("grounded")))


def merged_critique(own: dict[str, Column], said: Column, loop: Column, max_loops: Column) -> dict[str, Column]:
    """A model's critique over the rules' own: what its JSON object says holds where it can be read, each field by itself.

    Booleans may be written as words, numbers are none; lists keep their texts; an empty list stands for none said. In the last loop nothing is
    retried. said that holds no object leaves all as it was.
    """
    v = F.try_parse_json(replies.json_object(said))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    word = lambda k: F.when(kind(k).isin("BOOLEAN", "STRING"), F.lower(tx.stripped(F.try_variant_get(v, f"$.{k}", "string"))))
    flag = lambda k, old: F.when(word(k).isin("true", "1", "yes", "y"), True).when(word(k).isin("false", "0", "no", "n"), False).otherwise(old)
    texts = lambda k: F.filter(F.transform(F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), F.array().cast("array<string>")), tx.stripped), lambda x: x != "")
    some = lambda k, old: F.when(F.size(texts(k)) > 0, texts(k)).otherwise(old)
    number = F.try_variant_get(v, "$.confidence", "double")
    return {
        "grounded": flag("grounded", own["grounded"]), "enough_evidence": flag("enough_evidence", own["enough_evidence"]), "conflict": flag("has_conflict", own["conflict"]),
        "missing": some("missing_aspects", own["missing"]), "should_retry": flag("should_retry_retrieval", own["should_retry"]) & (loop < max_loops),
        "should_refine": flag("should_refine_answer", own["should_refine"]), "better_queries": some("better_queries", own["better_queries"]),
        "confidence": F.coalesce(number, own["confidence"]),
        "note": F.coalesce(F.nullif(F.try_variant_get(v, "$.note", "string"), F.lit("")), own["note"]),
    }


def branch_score(citations: Column, grounded: Column, status: Column, hallucination: Column, mismatch: Column, fallback: Column, confidence: Column) -> Column:
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0))))
    return F.round(
        1.8 * F.least(citations, F.lit(4))
        + 3.2 * unit(grounded)
        + F.when(status == "answered", 1.4).when(status == "partial", 0.5).when(status == "insufficient_evidence", -1.4).otherwise(0.0)
        + F.when(hallucination, -3.0).otherwise(0.9)
        + F.when(mismatch, -1.2).otherwise(0.35)
        + F.when(fallback, -0.9).otherwise(0.25)
        - F.when(citations <= 0, 0.8).otherwise(0.0)
        + 0.2 * unit(confidence),
        4,
    )


def weak(citations: Column, grounded: Column, status: Column, hallucination: Column, mismatch: Column, fallback: Column) -> Column:
    return (status == "insufficient_evidence") | (citations <= 0) | hallucination | mismatch | fallback | (F.coalesce(grounded, F.lit(0.0)) < 0.08)


def winner(s: dict[str, Column], a: dict[str, Column]) -> Column:
    """standard, advanced, both_weak or tie, by the first rule that holds. Keys: citations, status, hallucination, score, weak."""
    none = "insufficient_evidence"
    gap = a["score"] - s["score"]
    return (
        F.when((s["status"] == none) & (a["status"] != none) & (a["citations"] > 0), "advanced")
        .when((a["status"] == none) & (s["status"] != none) & (s["citations"] > 0), "standard")
        .when(s["hallucination"] & ~a["hallucination"], "advanced")
        .when(a["hallucination"] & ~s["hallucination"], "standard")
        .when(s["weak"] & a["weak"], "both_weak")
        .when((a["citations"] <= 0) & (gap > 0) & (s["citations"] > 0), "standard")
        .when(F.abs(gap) <= 0.35, "tie")
        .when(gap > 0, "advanced")
        .otherwise("standard")
    )


def advanced_status(relevant: Column, score: Column, citations: Column, contexts: Column, hallucination: Column) -> Column:
    """answered, partial or insufficient_evidence of an advanced answer."""
    partial = (score >= 0.02) | ((citations > 0) & (contexts > 0) & ~hallucination)
    return F.when(~relevant, "insufficient_evidence").when(score >= 0.12, "answered").when(partial, "partial").otherwise("insufficient_evidence")


def needs_ocr(text: Column, images: Column, min_chars: int = 100) -> Column:
    """The first rule by which a page's text layer is not to be trusted, else none."""
    body = tx.stripped(F.coalesce(text, F.lit("")))
    n = F.char_length(body)
    found = tx.tokens(body)
    alnum = F.char_length(F.regexp_replace(body, r"[^\p{L}\p{N}]", ""))
    ratio = F.when(n > 0, alnum / n).otherwise(0.0)
    unique = F.when(F.size(found) > 0, F.size(F.array_distinct(found)) / F.size(found)).otherwise(0.0)
    return (
        F.when(n < min_chars, "short_text")
        .when(F.contains(body, F.lit("�")), "replacement_characters")
        .when((images > 0) & (F.size(found) <= max(6, min_chars // 30)), "few_tokens_with_images")
        .when((images > 0) & (ratio < 0.45), "low_alnum_with_images")
        .when((F.size(found) >= 12) & (unique < 0.25), "repetitive")
        .otherwise("none")
    )

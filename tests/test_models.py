"""Failing models, exact quantiles, semantic likeness, merged critiques and composed letters, against plain loops."""

import json
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import evaluate, judge, rank


def test_letters_compose_like_unicode(spark):
    letters = [chr(c) for c in range(0xC0, 0x1EFA) if unicodedata.category(chr(c)) in ("Lu", "Ll")]
    rows = [f"x{v}y {v}" for c in letters for v in {unicodedata.normalize("NFD", c), c}]
    rows += ["ậ", "ậ", "ậ", "ậ", "ợ", "ợ", "", "́lone\n\n", "plain\n", "học máy", "học máy\n"]
    # What composes and is composed already, or has marks that no letter takes, stays.
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", tx.composed(F.col("t")).alias("c")).collect()
    wrong = [(rows[r.i], r.c) for r in got if r.c != unicodedata.normalize("NFC", rows[r.i]) and not any(unicodedata.normalize("NFC", c) != c for c in rows[r.i])]
    assert not wrong
    assert spark.range(1).select(tx.composed(F.lit(None).cast("string"))).first()[0] is None
    assert spark.range(1).select(tx.language(tx.normalized_query(F.lit(unicodedata.normalize("NFD", "học máy"))))).first()[0] == "vi"


def test_quantiles_of_groups_of_any_size(spark):
    rng = np.random.default_rng(2)
    rows = [(g, None if rng.random() < 0.05 else float(v)) for g, n in (("big", 4000), ("one", 1), ("two", 2), (None, 50)) for v in rng.integers(0, 900, n) / 4]
    rows += [("big", 7.0)] * 2000 + [("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.95, "e": 1.0}
    got = {r.g: r for r in evaluate.quantiles(frame, "g", "v", shares).collect()}
    for g in ("big", "one", "two", None, "none"):
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g].n == len(v)
        for name, share in shares.items():
            assert (got[g][name] is None) == (not v) and (not v or abs(got[g][name] - np.quantile(v, share)) < 1e-9)
    told = {r.g: r for r in evaluate.latency_percentiles(frame, "g", "v", overall="all").collect()}
    assert told["all"].n == sum(x is not None for _, x in rows) and told["all"]["max"] == max(x for _, x in rows if x is not None)


def test_a_failing_row_leaves_the_others(spark):
    def predict(row):
        if row["id"] == 3:
            raise RuntimeError("no\n model")
        if row["id"] == 4:
            return {"answer": 5, "confidence": 0.1}
        if row["id"] == 5:
            return {"answer": "x"}
        return {"answer": f"a{row['id']}", "confidence": row["id"] / 10, **({"status": "partial"} if row["id"] == 6 else {})}

    frame = spark.createDataFrame([(i, "q") for i in range(8)], "id long, q string").coalesce(1)
    rows = evaluate.captured(frame, predict, "answer string, confidence double", ("id",))
    got = {r.id: r for r in evaluate.error_rows(rows.withColumn("stop_reason", F.lit("done"))).collect()}
    assert len(got) == 8 and (got[3].status, got[3].answer, got[3].stop_reason, got[3].error) == ("error", "", "evaluation_error", "RuntimeError: no model")
    assert got[4].status == got[5].status == "error" and (got[6].status, got[7].answer, got[7].confidence, got[7].stop_reason, got[7].error) == ("partial", "a7", 0.7, "done", None)
    assert evaluate.captured(frame.where("false"), predict, "answer string, confidence double", ("id",)).count() == 0


def test_a_failing_scorer_keeps_the_order(spark):
    def scorer(pairs):
        if pairs[0][0] == "fails":
            raise RuntimeError("down")
        if pairs[0][0] == "short":
            return [1.0]
        return [float("nan") if q == "nan" else float(len(c)) for q, c in pairs]

    names = ["good", "fails", "short", "nan"]
    rows = [(q, name, r, f"c{r}", "x" * n, 1.0 / r) for q, name in enumerate(names) for r, n in ((1, 2), (2, 9), (3, 2), (4, 50))]
    hits = spark.createDataFrame(rows, "query_id int, query string, rank int, chunk_id string, content string, score double")
    got = {}
    for r in rank.rerank_with(hits, 3, scorer).orderBy("query_id", "rank").collect():
        got.setdefault(names[r.query_id], []).append((r.chunk_id, r.pre_rank, r.reranked, r.rerank_score))
    assert got["good"] == [("c2", 2, True, 9.0), ("c1", 1, True, 2.0), ("c3", 3, True, 2.0)]
    for name in ("fails", "short", "nan"):
        assert got[name] == [(f"c{i}", i, False, None) for i in (1, 2, 3)]


def test_semantic_likeness_is_the_best_of_six(spark):
    vectors = {"a": [1.0, 0.0], "b": [1.0, 1.0], "c": [0.0, 2.0], "z": [0.0, 0.0], "n": [-1.0, 0.0]}
    seen = []

    def embed(texts):
        seen.append(texts)
        table = F.create_map(*[x for k, v in vectors.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        return texts.select("key", F.element_at(table, F.col("text")).alias("vec"))

    rows = [(1, " a ", ["c", " ", "b"]), (2, "a", ["c"] * 6 + ["a"]), (3, "", ["a"]), (4, "a", []), (5, "a", ["z"]), (6, "a", ["n"]), (7, "a", ["a"])]
    frame = spark.createDataFrame([(*r, 0.1) for r in rows], "query_id int, answer string, contexts array<string>, grounded double")
    got = {r.query_id: (r.semantic, r.grounded) for r in judge.with_semantic(frame, embed, F.col("query_id") < 7).collect()}
    assert got == {1: (0.7071, 0.3125), 2: (0.0, 0.1), 3: (None, 0.1), 4: (None, 0.1), 5: (0.0, 0.1), 6: (0.0, 0.1), 7: (None, 0.1)}
    assert seen[0].count() == 5  # each text once


def test_a_model_critique_over_the_rules(spark):
    own = {"grounded": True, "enough_evidence": True, "conflict": False, "missing": ["m"], "should_retry": False, "should_refine": True, "better_queries": ["b"], "confidence": 0.4, "note": "rule"}
    said = [
        json.dumps({"grounded": "No", "enough_evidence": 0, "has_conflict": True, "missing_aspects": [" x ", "", 5], "should_retry_retrieval": "yes", "should_refine_answer": False, "better_queries": [], "confidence": "0.9", "note": "said"}),
        "I think ```json\n{\"should_retry_retrieval\": true, \"missing_aspects\": \"x\", \"confidence\": \"high\", \"note\": \"\"}\n```", "no object", None,
    ]
    frame = spark.createDataFrame([(i, s, loop) for i, s in enumerate(said) for loop in (1, 2)], "i int, s string, loop int")
    columns = {k: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in own.items()}
    merged = judge.merged_critique(columns, F.col("s"), F.col("loop"), F.lit(2))
    got = {(r["i"], r["loop"]): {k: r[k] for k in own} for r in frame.select("i", "loop", *[c.alias(k) for k, c in merged.items()]).collect()}
    first = {"grounded": False, "enough_evidence": True, "conflict": True, "missing": ["x", "5"], "should_retry": True, "should_refine": False, "better_queries": ["b"], "confidence": 0.9, "note": "said"}
    assert got[0, 1] == first and got[0, 2] == first | {"should_retry": False}
    assert got[1, 1] == own | {"should_retry": True} and got[2, 1] == got[3, 2] == own

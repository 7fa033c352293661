"""Modes from question to trace: answers by rule, traces that give the documents back, loops over rewrites, critics and languages."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import judge, traces
from corpusloom.plans import indexes, workflow

CHUNKS = [
    ("Law_chunk_0", "Điều 5. Phạm vi áp dụng\nĐiều này quy định phạm vi của luật."),
    ("cats_chunk_0", "the cat sat on the mat all day long. it was a red mat."),
    ("cats_chunk_1", "a cat and a dog are animals that live in the house."),
    ("dogs_chunk_0", "dogs bark loudly at night and sleep by day."),
    ("zoo_chunk_0", "supporting evidence about elephants is kept in the zoo archive."),
]


@pytest.fixture(scope="module")
def found(spark):
    return indexes.of(spark.createDataFrame(CHUNKS, "chunk_id string, text string"))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_standard_answers_by_rule_and_traces(spark, found):
    rows = workflow.standard(found, asked(spark, "Tên của Điều 5 là gì?", "where did the cat sit on the mat", "qqq zzz"))
    got = {r.query_id: r for r in rows.collect()}
    assert got[0].fast_path == "title_article_match" and got[0].answer == "Tên của Điều 5 là: Phạm vi áp dụng." and got[0].confidence == 0.95
    assert not got[1].fast_path.endswith("_match") and "cat sat on the mat" in got[1].answer
    response = workflow.response(rows)
    trace = {r.query_id: json.loads(r.trace) for r in response.collect()}
    for i, t in trace.items():
        names = [s["step"] for s in t]
        assert names[:4] == ["retrieve", "rerank", "context_select", "generate"] and names[-2:] == ["timing_summary", "completed"]
        assert ("language_guard" in names) == (got[i].status != "insufficient_evidence") and t[-1]["total_ms"] == 0 and set(traces.TIMINGS) <= set(t[-2])
    # The trace gives back what was retrieved, in its order and as it was written.
    ranked = {}
    for r in workflow.trace_rankings(response).orderBy("query_id", "strategy", "rank").collect():
        ranked.setdefault((r.query_id, r.strategy), []).append(r.chunk_id)
    for r in got.values():
        assert ranked.get((r.query_id, "hybrid"), []) == [d.chunk_id for d in r.retrieved_docs or []]
        assert ranked.get((r.query_id, "hybrid_rerank"), []) == [d.chunk_id for d in r.reranked_docs or []]
    assert "Law_chunk_0" in ranked[0, "hybrid"]


def test_loops_ask_each_rewrite_once(spark, found):
    rows = workflow.advanced(found, asked(spark, "force retry where did the cat sit", "hello"), max_loops=4)
    got = {r.query_id: r for r in rows.collect()}
    steps = json.loads(got[0].trace)
    loops = [s for s in steps if s["step"] == "loop"]
    queries = [s["query"].lower() for s in loops]
    assert len(loops) == got[0].loops == 5 and len(set(queries)) == 5 and queries[1].endswith("supporting evidence")
    assert steps[-1]["step"] == "completed" and got[0].stop_reason == "max_loop_reached"
    assert got[1].loops == 0 and [s["step"] for s in json.loads(got[1].trace)] == ["gate", "completed"]
    one = {r.query_id: r for r in workflow.advanced(found, asked(spark, "force retry where did the cat sit"), max_loops=1).collect()}
    assert one[0].loops == 2


def test_rewrites_are_fused(spark, found):
    rewrites = spark.createDataFrame([(0, 1, "the cat on the mat"), (0, 2, "elephants in the zoo")], "query_id long, place int, rewrite string")
    hits = [r.chunk_id for r in workflow.retrieve_rewrites(found, rewrites, 3).orderBy("rank").collect()]
    assert {"cats_chunk_0", "zoo_chunk_0"} <= set(hits)
    alone = workflow.retrieve_rewrites(found, rewrites.where("place = 1"), 5).select("rank", "chunk_id")
    plain = workflow.retrieve_hybrid(found, asked(spark, "the cat on the mat"), 5).select("rank", "chunk_id")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, plain.collect()))


def test_critic_and_translation(spark, found):
    critic = lambda q, a, c: F.lit('{"should_refine_answer": true, "missing_aspects": ["tail"], "confidence": 0.11}')
    refined = workflow.advanced(found, asked(spark, "compare where the cat and the dog sit and why"), critic=critic, max_loops=0).first()
    assert refined.confidence == pytest.approx(0.11) and json.loads(refined.trace)[0]["critique_strategy"] == "model" and "tail." in refined.answer
    vietnamese = "Con mèo nằm ở đâu trên tấm thảm"
    english = lambda q, c: F.lit("A red cat is sleeping on our small mat at home")
    wrong = workflow.standard(found, asked(spark, vietnamese + " cat mat"), english).first()
    assert wrong.language == "vi" and wrong.language_mismatch
    right = workflow.standard(found, asked(spark, vietnamese + " cat mat"), english, translate=lambda a, l: F.lit("Con mèo nằm trên tấm thảm đỏ của nhà")).first()
    assert not right.language_mismatch and right.answer.startswith("Con mèo")
    kept = workflow.standard(found, asked(spark, vietnamese + " cat mat"), english, translate=lambda a, l: F.lit(" ")).first()
    assert kept.language_mismatch and kept.answer == wrong.answer


def test_a_model_gate_decides_where_it_is_asked(spark, found):
    texts = ["thanks", "cat mat", "legal advice on cats in the house", "which animals live in the house with people now", "dog sleep"]
    said = lambda q: F.when(q.contains("legal"), '{"need_retrieval": false, "reason": "out_of_scope"}').when(q == "cat mat", '{"need_retrieval": true}').when(q == "dog sleep", "hm").otherwise('{"need_retrieval": false}')
    rows = {r.query_id: r for r in workflow.advanced(found, asked(spark, *texts), gate=said, max_loops=0).collect()}
    # Sure rules and queries without a cause to ask keep their rule; what can't be read leaves it as it was.
    assert [rows[i].loops for i in range(5)] == [0, 1, 0, 1, 1]
    gates = {i: json.loads(rows[i].trace)[0] for i in (0, 2)}
    assert (rows[0].stop_reason, gates[0]["strategy"]) == ("small_talk", "heuristic") and (rows[2].stop_reason, gates[2]["strategy"]) == ("out_of_scope", "llm")
    strict = {r.query_id: r for r in workflow.advanced(found, asked(spark, *texts), gate=said, max_loops=0, strict=True).collect()}
    assert [strict[i].loops for i in range(5)] == [0, 1, 0, 0, 1] and strict[3].stop_reason == "llm_gate"


def test_a_model_answers_a_filled_prompt(spark, found):
    reply = lambda p: F.when(p.contains("Question: cat mat sat"), F.concat(F.lit('{"confidence": 0.3, "status": "partial", "answer": "the cat sat on the mat"}'), F.lit(""))).when(p.contains("dogs bark"), "dogs bark loudly at night").otherwise('{"answer": "nothing there", "status": "insufficient_evidence"}')
    rows = {r.query_id: r for r in workflow.standard(found, asked(spark, "cat mat sat", "dogs bark when", "elephants zoo archive", "qqq zzz", "Tên của Điều 5 là gì?"), model=reply).collect()}
    assert (rows[0].answer, rows[0].status, rows[0].confidence) == ("the cat sat on the mat", "partial", 0.3) and rows[0].grounded > 0.5 and rows[0].n_citations > 0
    assert (rows[1].answer, rows[1].status) == ("dogs bark loudly at night", "answered") and rows[1].confidence > 0
    assert (rows[2].answer, rows[2].status, rows[2].n_citations, rows[2].grounded) == ("nothing there", "insufficient_evidence", 0, 0.0)
    assert rows[4].fast_path == "title_article_match" and rows[4].confidence == 0.95
    if rows[3].n_docs == 0:
        assert rows[3].status == "insufficient_evidence" and rows[3].answer == workflow.INSUFFICIENT["en"]


def test_policies_agree_with_plain_rules(spark):
    texts = ["", None, "why", "tư vấn pháp lý cho công ty của tôi", "please help me with the cats", "which animals live in the house", "phân tích dữ liệu của nhà", "reanalysis of old house records"]
    rows = [(t, c, n, s, size, f, h) for t in texts for c in ("complex", "normal") for n, s, size, f, h in ((0, None, 0, None, True), (2, 0.05, 10, 0.9, True), (2, 0.02, 10, None, False), (2, 0.5, 420, 0.5, True), (1, 0.5, 419, 0.34, True), (1, 0.5, 9, 0.35, True))]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, c string, n int, s double, size int, f double, h boolean")
    risky = lambda t: "pháp lý" in t or "phân tích" in t
    vague = lambda t: t != "" and (len(t.split()) <= 2 or "help" in t)
    for strict in (False, True):
        got = frame.select("i", judge.asks_model_gate(F.col("q"), F.col("c"), F.lit("default_retrieval"), strict).alias("g"), judge.asks_model_critic(F.col("q"), F.col("c"), F.col("n"), F.col("s"), F.col("size"), F.col("f"), strict).alias("m"), judge.asks_strict_refine(F.col("q"), F.col("c"), F.col("n"), F.col("s"), F.col("h"), strict).alias("r"))
        for i, g, m, r in got.collect():
            t, c, n, s, size, f, h = rows[i]
            t, hard = t or "", c == "complex"
            assert g == (strict or risky(t) or hard or vague(t)), rows[i]
            assert m == (strict or risky(t) or n <= 0 or (s is not None and s < 0.06) or hard or size >= 420 or (f is not None and f < 0.35)), rows[i]
            assert r == (h and (strict or risky(t) or hard or n <= 0 or (s is not None and s < 0.035))), rows[i]


def test_traces_end_with_completed(spark):
    rows = [
        (['{"step":"retrieve"}'], 5, [{"step": "retrieve"}, {"step": "completed", "status": "success", "total_ms": 5}]),
        (['{"step":" Completed ","total_ms":"12","x":[1,{"y":"ü"}]}'], 5, [{"step": " Completed ", "total_ms": 12, "x": [1, {"y": "ü"}], "status": "success"}]),
        (['{"step":"completed","status":"bad","total_ms":true}'], 7, [{"step": "completed", "status": "bad", "total_ms": 7}]),
        ([], -3, [{"step": "completed", "status": "success", "total_ms": 0}]), (None, None, [{"step": "completed", "status": "success", "total_ms": 0}]),
    ]
    frame = spark.createDataFrame([(i, t, m) for i, (t, m, _) in enumerate(rows)], "i int, t array<string>, m long")
    for r in frame.select("i", traces.as_list(traces.completed(F.col("t"), F.col("m"))).alias("x")).collect():
        assert json.loads(r.x) == rows[r.i][2]
    given = ['{"retrieval_total_ms":5,"dense_retrieve_ms":"7","sparse_retrieve_ms":true,"hybrid_merge_ms":null}', "{}", None]
    got = spark.createDataFrame([(g,) for g in given], "g string").select(traces.timings(F.col("g")).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in got] == [(5, 7, 0, 0, True), (0, 0, 0, 0, False), (0, 0, 0, 0, False)]

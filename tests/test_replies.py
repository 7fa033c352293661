"""Values of model replies, conversations as lines, and the metrics of a run, on small odd input."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evaluate, replies


def test_coercion(spark):
    rows = [(" Yes ", "1.5", "12"), ("N", "x", "-3"), ("maybe", None, "12.7"), (None, "", None), ("0", " 2 ", "9 ")]
    t = spark.createDataFrame(rows, "b string, f string, i string")
    got = t.select(replies.to_bool(F.col("b"), True), replies.to_double(F.col("f"), 0.5), replies.non_negative(F.col("i"), 4)).collect()
    assert [tuple(r) for r in got] == [(True, 1.5, 12), (False, 0.5, 0), (True, 0.5, 4), (True, 0.5, 4), (False, 2.0, 9)]


def test_ratio(spark):
    rows = [("1", "3"), ("1", "0"), ("-1", "2"), ("x", "2"), (None, "2"), ("NaN", "2"), ("2", "NaN"), ("2", "-1"), ("2", None)]
    got = spark.createDataFrame(rows, "p string, w string").select(replies.ratio(F.col("p"), F.col("w"))).collect()
    assert [r[0] for r in got] == [0.333333, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_note_category(spark):
    notes = {" Grounded: all held": "grounded", "no_evidence:": "no_evidence", "grounded": None, "other: x": None, "x grounded: y": None, "": None, None: None}
    got = spark.createDataFrame([(n,) for n in notes], "n string").select(replies.note_category(F.col("n"))).collect()
    assert [r[0] for r in got] == list(notes.values())


def test_history_lines(spark):
    kept = spark.createDataFrame([(1, 2, "assistant", " b\n"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 1, "user", "z")], "conv_id int, turn int, role string, text string")
    all_of = spark.createDataFrame([(1,), (1,), (2,)], "conv_id int")
    assert dict(map(tuple, replies.history_lines(kept, all_of).collect())) == {1: "1. User: a\n2. User: a\n3. Assistant: b", 2: "(empty)"}
    assert replies.history_lines(kept.limit(0), all_of.limit(0)).count() == 0


def test_behavior_and_terms(spark):
    runs = [("abstain", "Abstained", 1, None), ("abstain", None, 2, ""), ("answer", "insufficient_evidence", None, "Max_Retry"), (None, "answered", None, None)]
    t = spark.createDataFrame(runs, "e string, s string, n int, r string")
    got = t.select(*evaluate.behavior(F.col("e"), F.col("s"), F.col("n"), F.col("r")).values()).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, True), (True, False)]
    texts = [("The cat sat", "a CAT", "the dog"), ("of it", "cat", "cat"), ("cat", " ", ""), (None, None, None)]
    got = spark.createDataFrame(texts, "a string, r string, c string").select(*evaluate.term_metrics(F.col("a"), F.col("r"), F.col("c")).values()).collect()
    assert [tuple(r) for r in got] == [(True, 0.333333), (False, 0.0), (None, None), (None, None)]


def test_branches_without_a_direct_run(spark):
    schema = "example_id int, mode string, run string"
    direct = spark.createDataFrame([(1, "standard", "d"), (1, "standard", "d2")], schema)
    branches = spark.createDataFrame([(1, "standard", "c"), (1, "advanced", "c"), (2, "standard", "c")], schema)
    got = sorted(map(tuple, evaluate.with_branches(direct, branches).collect()))
    assert got == [(1, "advanced", "c"), (1, "standard", "d"), (1, "standard", "d2"), (2, "standard", "c")]


def test_json_in_replies(spark):
    replies_of = {
        '{"answer": " yes ", "status": "partial"}': ('{"answer": " yes ", "status": "partial"}', ("yes", "partial")),
        'Sure:\n```json\n{"answer": "a"}\n```\nbye {': ('{"answer": "a"}', ("a", "answered")),
        "```\nnot json\n```\n[1, 2]": ("[1, 2]", ("```\nnot json\n```\n[1, 2]", "answered")),
        'x {"answer": "{\\"answer\\": \\"in\\"}"} y': ('{"answer": "{\\"answer\\": \\"in\\"}"}', ("in", "answered")),
        '{"answer": 3}': ('{"answer": 3}', ('{"answer": 3}', "answered")),
        "just words": (None, ("just words", "answered")),
        "} broken {": (None, ("} broken {", "answered")),
        " ": (None, ("Insufficient evidence to answer reliably.", "insufficient_evidence")),
        None: (None, ("Insufficient evidence to answer reliably.", "insufficient_evidence")),
    }
    t = spark.createDataFrame([(r,) for r in replies_of], "r string")
    got = t.select(replies.json_payload(F.col("r")), replies.structured_answer(F.col("r"))).collect()
    assert [(a, tuple(b)[:2]) for a, b in got] == list(replies_of.values())
    kinds = spark.createDataFrame([("[1]",), ('{"a": 1}',), ("7",)], "r string").select(replies.json_object(F.col("r")), replies.json_list(F.col("r"))).collect()
    assert [tuple(r) for r in kinds] == [(None, "[1]"), ('{"a": 1}', None), (None, None)]


def test_states_and_confidence_of_replies(spark):
    none = ("Insufficient evidence to answer reliably.", "insufficient_evidence", 0.0)
    said = {
        '{"answer": " a ", "status": "partial", "confidence": 0.25}': ("a", "partial", 0.25),
        '{"answer": "a", "confidence": " 1e-1 "}': ("a", "answered", 0.1),
        '{"answer": "a", "confidence": 1}': ("a", "answered", 1.0),
        '{"answer": "a", "confidence": true}': ("a", "answered", 1.0),
        '{"answer": "a", "confidence": null}': ("a", "answered", None),
        '{"answer": "", "status": "insufficient_evidence"}': ("", "insufficient_evidence", None),
        '```json\n{"answer": "{\\"answer\\": \\" in \\"}", "confidence": 0.5}\n```': ("in", "answered", 0.5),
        "words": ("words", "answered", None),
        " ": none,
        None: none,
    }
    # What breaks a rule is taken as it stands.
    broken = ['{"answer": "a", "status": "done"}', '{"answer": "a", "status": null}', '{"answer": "a", "status": 1}', '{"answer": "a", "confidence": "high"}', '{"answer": "a", "confidence": "1d"}', '{"answer": "a", "confidence": [1]}', '{"answer": null}', '{"status": "partial"}', "{}"]
    said |= {b: (b, "answered", None) for b in broken}
    rows = spark.createDataFrame(list(enumerate(said)), "i int, r string").select("i", replies.structured_answer(F.col("r")).alias("s")).collect()
    assert {r.i: tuple(r.s) for r in rows} == dict(enumerate(said.values()))
    gates = {'{"need_retrieval": false, "reason": " chat "}': (False, "chat"), 'so {"need_retrieval": true, "reason": ""} x': (True, "llm_gate"), '{"need_retrieval": true, "reason": 3}': (True, "llm_gate"), '{"need_retrieval": "true"}': None, "{}": None, "yes": None, None: None}
    rows = spark.createDataFrame(list(enumerate(gates)), "i int, r string").select("i", replies.gate_said(F.col("r")).alias("s")).collect()
    assert {r.i: r.s and tuple(r.s) for r in rows} == dict(enumerate(gates.values()))

"""Filters, files to index, states, traces and query files, on small odd input."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import judge, replies, retrieve, scope, traces
from corpusloom.plans import lifecycle
from corpusloom.sources import files

REQUEST = "query_id int, doc_ids array<string>, filenames array<string>, file_types array<string>, uploaded_after string, uploaded_before string, include_ocr boolean"
HIT = "query_id int, doc_id string, source string, file_name string, file_type string, block_type string, ocr boolean, uploaded_at string, created_at string"


def test_filters_in_normal_form(spark):
    rows = [(1, [" b", "a", "b", "", None], ["x/Y.MD", "y.md"], [".PDF", "pdf", "."], "2024-01-02T03:00:00+02:00", "2024-01-02", None), (2, [], None, [" "], "later", "", None)]
    a, b = scope.normalized(spark.createDataFrame(rows, REQUEST)).withColumn("any", scope.any_filter()).orderBy("query_id").collect()
    assert (a.doc_ids, a.filenames, a.file_types, a["any"]) == (["a", "b"], ["y.md"], ["pdf"], True)
    assert (a.uploaded_after.hour, a.uploaded_before.hour) == (1, 0)
    assert b[1:] == (None,) * 6 + (False,)


def test_filtered_hits(spark):
    hits = [
        (1, "a", "https://h/p/One.MD", None, None, "text", None, "2024-01-02T00:00:00Z", None), (1, "b", None, None, None, None, None, None, None),
        (2, "a", "x", "d/Two.txt", ".MD", "OCR_TEXT", False, None, "2024-01-01"), (2, "c", None, "Two.txt", None, "text", True, "", "2024-01-03"), (None, "z", None, None, None, None, None, None, None),
    ]
    t = spark.createDataFrame(hits, HIT)
    ask = lambda *r: sorted(tuple(x)[:2] for x in scope.filtered(t, spark.createDataFrame([r], REQUEST)).where("query_id is not null").collect())
    two = [(2, "a"), (2, "c")]
    assert ask(1, None, ["ONE.md"], None, None, None, None) == [(1, "a"), *two]
    assert ask(1, None, None, ["md"], "2024-01-02", "2024-01-02", False) == [(1, "a"), *two]
    assert ask(1, None, None, None, "2024-01-02T00:00:01", None, None) == two
    assert ask(2, None, ["two.txt"], ["txt"], None, None, None) == [(1, "a"), (1, "b"), (2, "c")]
    assert ask(2, None, None, None, None, "2024-01-01", True) == [(1, "a"), (1, "b"), (2, "a")]
    assert ask(1, ["b"], None, None, None, None, None) == [(1, "b"), *two]
    seeded = scope.filtered(t, spark.createDataFrame([(1, ["b"], None, None, None, None, None)], REQUEST), "seeded")
    assert seeded.columns == t.columns and sorted(r.doc_id for r in seeded.collect()) == ["a", "c", "z"]
    assert scope.filtered(t.limit(0), spark.createDataFrame([], REQUEST)).count() == scope.empty_hits(t).count() == 0


def test_registry(spark):
    log = spark.sql("""select * from values ('a', 'uploaded', null, 'p/a', timestamp'2024-01-01'), ('a', 'ready', null, 'p/a', timestamp'2024-01-01'), ('b', 'ready', null, 'p/b', timestamp'2024-01-02'),
        ('c', 'ready', null, 'p/c', timestamp'2024-01-01'), ('c', 'deleted', null, 'p/c', timestamp'2024-01-02'), ('d', 'failed', 'why', null, timestamp'2024-01-01') as t(doc_id, status, message, stored_path, updated_at)""")
    there = spark.createDataFrame([("p/a",), ("p/a",), ("p/c",)], "stored_path string")
    got = {r.doc_id: (r.status, r.message) for r in lifecycle.registry(log, there).collect()}
    assert got == {"a": ("ready", None), "b": ("failed", lifecycle.MISSING_FILE), "d": ("failed", "why")}
    assert [r.doc_id for r in lifecycle.ready(log, there).collect()] == ["a"]
    assert lifecycle.registry(log.limit(0), there).count() == 0
    assert [(r.place, r.status, r.seconds) for r in lifecycle.stages(log).where("doc_id = 'c'").orderBy("place").collect()] == [(1, "ready", 86400.0), (2, "deleted", None)]


def test_build_activate_delete_clear(spark, tmp_path):
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    (raw / "sub").mkdir(parents=True)
    (raw / "0123456789_one.md").write_text("# Head\n\nSome words here.\n", encoding="utf-8")
    (raw / "sub" / "two.txt").write_text("Other words.\n\nMore of them.", encoding="utf-8")
    (raw / "empty.txt").write_text(" \n", encoding="utf-8")
    (raw / "left.bin").write_bytes(b"\0")
    assert lifecycle.active(spark, store)[0].count() == 0 and lifecycle.active(spark, store)[1] == "none"
    first = lifecycle.build(spark, str(raw), store, with_indexes=False)
    chunks, source = lifecycle.active(spark, store)
    assert source == "uploaded" and chunks.select("doc_id").distinct().count() == 2
    names = {r.file_name: (r.doc_id, r.file_type) for r in files.listing(spark, str(raw)).collect()}
    assert set(names) == {"one.md", "two.txt", "empty.txt"} and names["one.md"][1] == "md"
    states = {r.doc_id: r.status for r in lifecycle.registry(lifecycle.logged(spark, store)).collect()}
    assert states == {names["one.md"][0]: "ready", names["two.txt"][0]: "ready", names["empty.txt"][0]: "failed"}
    assert lifecycle.build(spark, str(raw), store, with_indexes=False) == first
    lifecycle.delete(spark, store, [names["two.txt"][0]])
    second = lifecycle.build(spark, str(raw), store, with_indexes=False)
    assert second != first and [r.doc_id for r in lifecycle.active(spark, store)[0].select("doc_id").distinct().collect()] == [names["one.md"][0]]
    lifecycle.clear(spark, store)
    assert lifecycle.active(spark, store)[0].count() == 0
    lifecycle.delete(spark, store)
    with pytest.raises(ValueError):
        lifecycle.build(spark, str(raw), store)


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    raw.mkdir()
    for i in range(100):
        (raw / f"f{i:02}.txt").write_text(f"words of file number{i}")
    seen = []
    real = files.read_blocks
    monkeypatch.setattr(files, "read_blocks", lambda spark, what, *a, **k: seen.append(what) or real(spark, what, *a, **k))
    first = lifecycle.build(spark, str(raw), store, with_indexes=False)
    assert len(seen.pop()) == 100
    (raw / "f07.txt").write_text("these words changed")
    (raw / "f08.txt").unlink()
    second = lifecycle.build(spark, str(raw), store)
    assert second != first and [p.rsplit("/", 1)[-1] for p in seen.pop()] == ["f07.txt"]
    manifest = lifecycle.manifest_of(spark, store, second)
    assert manifest.count() == 99 and sorted(r["count"] for r in manifest.groupBy("part").count().collect()) == [1, 98]
    chunks, _ = lifecycle.active(spark, store)
    got = {r.doc_id: r.content for r in chunks.collect()}
    assert len(got) == 99 and any("changed" in c for c in got.values()) and not any("number7" == c.split()[-1] for c in got.values())
    both = lifecycle.indexes_of(spark, store, second)
    asked = spark.createDataFrame([(1, "changed words")], "query_id int, query string")
    hit = retrieve.bm25_topk(both.postings(), asked, 1).first()
    assert "changed" in got[hit.chunk_id.rsplit("_chunk_", 1)[0]] and both.vectors().count() == 99
    # The same files again: the version before, with nothing read. Other settings: all files are chunked anew.
    assert lifecycle.build(spark, str(raw), store) == second and not seen
    monkeypatch.setattr(lifecycle, "LISTED", 5)
    lifecycle.build(spark, str(raw), store, mode="small", with_indexes=False)
    assert seen.pop() == str(raw) and lifecycle.active(spark, store)[0].count() == 99
    # Many small changes: the parts become one.
    monkeypatch.setattr(lifecycle, "MOST_PARTS", 1)
    (raw / "new.txt").write_text("one more")
    last = lifecycle.build(spark, str(raw), store, with_indexes=False)
    assert lifecycle.manifest_of(spark, store, last).select("part").distinct().count() == 1 and lifecycle.active(spark, store)[0].count() == 100


def test_a_deletion_ends_with_a_new_upload(spark, tmp_path):
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    raw.mkdir()
    (raw / "a.txt").write_text("first words")
    (raw / "b.txt").write_text("other words")
    lifecycle.build(spark, str(raw), store, with_indexes=False)
    name = next(r.doc_id for r in files.listing(spark, str(raw)).collect() if r.file_name == "a.txt")
    lifecycle.delete(spark, store, [name])
    lifecycle.build(spark, str(raw), store, with_indexes=False)
    assert name not in {r.doc_id for r in lifecycle.active(spark, store)[0].collect()}
    (raw / "a.txt").write_text("first words, uploaded again")
    later = time.time() + 60
    os.utime(raw / "a.txt", (later, later))
    lifecycle.build(spark, str(raw), store, with_indexes=False)
    assert name in {r.doc_id for r in lifecycle.active(spark, store)[0].collect()}
    assert {r.doc_id: r.status for r in lifecycle.registry(lifecycle.logged(spark, store)).collect()}[name] == "ready"


def test_presets():
    assert lifecycle.chunking_values("large") == (1500, 200) and lifecycle.chunking_values("custom", 100, 0) == (100, 0)
    assert lifecycle.retrieval_depth("low") == 3 and lifecycle.retrieval_depth("custom", 20) == 20
    for size, overlap in ((None, 1), (99, 0), (4001, 0), (200, 1001), (200, 200)):
        with pytest.raises(ValueError):
            lifecycle.chunking_values("custom", size, overlap)
    with pytest.raises(ValueError):
        lifecycle.retrieval_depth("custom", 21)


def test_block_counts(spark):
    rows = [("a", "text", None), ("a", "ocr_text", None), ("a", "table", True), ("b", None, None)]
    got = {r[0]: tuple(r)[1:] for r in lifecycle.block_counts(spark.createDataFrame(rows, "doc_id string, block_type string, ocr boolean")).collect()}
    assert got == {"a": (3, 1, 1, 0, 2), "b": (1, 0, 0, 0, 0)}


def test_traces(spark):
    doc = lambda c, **k: {"chunk_id": c, **k}
    looped = [
        {"step": "retrieve", "count": 3, "chunk_size": 500, "docs": [doc("x_chunk_1", dense_score=1), doc("X_chunk_1"), doc(None, source="s//a.md")]},
        {"step": "rerank", "docs": [doc("r_chunk_0"), {}]},
        {"step": "context_select", "count": 2, "docs": [doc("x_chunk_1", content="c")]},
        {"step": "loop", "retrieved_count": 5, "chunk_overlap": 7, "retrieved_docs": [doc("b_chunk_0", dense_score=1, sparse_score=2), doc("a_chunk_0", dense_score=3), doc("c_chunk_0", dense_score=1)], "reranked_docs": []},
    ]
    bare = [{"step": "retrieve", "chunk_ids": ["k"]}, {"step": "rerank", "docs": [doc("k_chunk_0")]}]
    t = spark.createDataFrame([(1, json.dumps(looped)), (2, json.dumps(bare)), (3, "no JSON"), (4, None)], "run_id int, trace string")
    rows = traces.steps(t)
    ranked = {}
    for r in traces.rankings(traces.documents(rows)).orderBy("run_id", "strategy", "rank").collect():
        ranked.setdefault((r.run_id, r.strategy), []).append(r.chunk_id)
    abc = ["b_chunk_0", "a_chunk_0", "c_chunk_0"]
    assert ranked == {(1, "dense"): ["a_chunk_0", "b_chunk_0", "c_chunk_0"], (1, "bm25"): ["b_chunk_0"], (1, "hybrid"): abc, (1, "hybrid_rerank"): ["r_chunk_0"], (2, "hybrid"): ["k_chunk_0"], (2, "hybrid_rerank"): ["k_chunk_0"]}
    assert {r.run_id: tuple(r)[1:] for r in traces.counts(rows).collect()} == {1: (5, 2, 500, 7), 2: (0, 0, None, None)}
    ids = spark.createDataFrame([(1, 0, "k"), (1, 1, "m")], "run_id int, place int, chunk_id string")
    sources = spark.createDataFrame([(1, "k", 4, "late", "s"), (1, "k", 2, "first", "s")], "run_id int, chunk_id string, number int, doc_id string, source string")
    assert [tuple(r)[2:] for r in traces.first_sources(ids, sources).orderBy("place").collect()] == [("k", "first", "s"), ("m", None, None)]


def test_query_files(spark, tmp_path):
    items = [" one ", {"query": "two", "id": "q2"}, {"text": "three", "label": 7}, {"query": ""}, 5, "", {"query": 5}, "last"]
    want = [("file_01", "one"), ("q2", "two"), ("7", "three"), ("file_08", "last")]
    for name, body in (("a.json", json.dumps(items)), ("b.json", json.dumps({"queries": items})), ("c.jsonl", "\n\n".join(json.dumps(i) for i in items))):
        (tmp_path / name).write_text(body)
        assert [(r.query_id, r.query) for r in files.read_queries(spark, str(tmp_path / name)).collect()] == want, name
    (tmp_path / "d.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        files.read_queries(spark, str(tmp_path / "d.json"))


def test_replies(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(replies.rendered(F.lit("$a ${b}$$ $c ${a $ab\n$"), {"a": F.lit("$b"), "b": F.lit(None).cast("string")})) == "$b $ $c ${a $ab\n$"
    assert one(replies.short_error(F.lit(" a \n b "))) == "a b" and len(one(replies.short_error(F.lit("x" * 241)))) == 240
    assert one(replies.reply_latency(F.lit('{"latency_ms": -3}'))) == 0 and one(replies.reply_latency(F.lit('{"mode": "standard", "standard": {"latency_ms": 1}}'))) is None
    assert one(replies.reply_latency(F.lit('{"mode": "compare", "latency_ms": "x", "advanced": {"latency_ms": 9.5}}'))) == 9
    assert one(judge.blended(F.lit(0.9), F.lit(0.6))) == 0.9 and one(judge.blended(F.lit(0.1), F.lit(0.57))) == 0.1 and one(judge.blended(F.lit(0.1), F.lit(1.0))) == 0.415


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b", ["x"]), (2, None, [])], "id int, t string, l array<string>")
    files.write_report(rows, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/results").count() == 2
    assert [tuple(r) for r in spark.read.option("header", "true").csv(f"{tmp_path}/summary").orderBy("id").collect()] == [("1", "a,b"), ("2", None)]

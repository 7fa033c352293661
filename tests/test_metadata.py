"""Metadata of blocks and chunks, question files, summaries and chunk settings, against plain loops and odd input."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, evaluate
from corpusloom.sources import files

BLOCKS = "doc_id string, path string, block_index int, block_type string, title string, section string, content string, is_heading boolean, metadata map<string,string>"


def plain_union(members):
    out = {}
    for m in members:
        for k, v in (m or {}).items():
            if out.get(k) is None:
                out[k] = v
    return out


def test_block_metadata_by_precedence(spark):
    rows = [
        ("d", "up/Note.MD", 0, "text", None, None, "a", False, {"lang": "vi", "page": "3", "file_name": "own.md", "x": "block"}),
        ("d", "up/Note.MD", 1, "image", None, None, "b", False, None), ("d", "up/Note.MD", 2, "text", None, None, "c", False, {"ocr": "True", "block_type": "ocr_text", "x": None}),
    ]
    got = {r.block_index: r.metadata for r in files.with_metadata(spark.createDataFrame(rows, BLOCKS), {"x": "base", "page": "9", "filename": "Given.md"}).collect()}
    own = {"doc_id": "d", "source": "up/Note.MD", "filename": "Given.md", "file_extension": ".md", "file_type": "md", "ocr": "false"}
    assert got[0] == own | {"block_index": "0", "lang": "vi", "page": "3", "file_name": "own.md", "x": "block", "block_type": "text"}
    assert got[1] == own | {"block_index": "1", "page": None, "file_name": "Note.MD", "x": "base", "block_type": "image"}
    assert got[2] == own | {"block_index": "2", "page": None, "file_name": "Note.MD", "x": None, "block_type": "ocr_text", "ocr": "true"}
    bare = files.with_metadata(spark.createDataFrame(rows, BLOCKS).drop("metadata")).where("block_index = 0").first().metadata
    assert bare["filename"] == "Note.MD" and "x" not in bare


def test_metadata_unite_in_groups_and_stay_in_windows(spark):
    meta = [{"a": "1", "k": None}, {"a": "2", "b": "3", "k": "late"}, None, {"c": "4"}]
    rows = [("d", "p/f.txt", i, "text", "T", "S", " ".join(f"w{i}x{j}" for j in range(30)), False, m) for i, m in enumerate(meta)]
    rows += [("d", "p/f.txt", 4, "table", "T", "S", "| a | b |", False, {"a": "table", "file_name": "f.txt"})]
    frame = spark.createDataFrame(rows, BLOCKS)
    got = chunking.chunk(frame, size=40, overlap=5).orderBy("chunk_index").collect()
    union = plain_union(meta)
    assert len(got) > 3
    for r in got[:-1]:
        assert {k: r.metadata[k] for k in union} == union and r.metadata["chunk_index"] == str(r.chunk_index) and r.metadata["heading_context_injected"] == "true"
        assert int(r.metadata["heading_context_prefix_length"]) == len("Title: T. Section: S.\n\n")
    assert got[-1].metadata["a"] == "table" and got[-1].metadata["file_type"] == "" and got[-1].metadata["filename"] == "f.txt" and "b" not in got[-1].metadata
    assert "metadata" not in chunking.chunk(frame.drop("metadata")).columns
    plain = [tuple(r) for r in chunking.chunk(frame.drop("metadata"), size=40, overlap=5).orderBy("chunk_index").collect()]
    assert plain == [tuple(r)[:7] for r in got]


def test_chunk_settings(spark):
    frame = spark.createDataFrame([], BLOCKS)
    for size, overlap, cap in ((0, 0, None), (10, -1, None), (10, 10, None), (10, 1, 0)):
        with pytest.raises(ValueError):
            chunking.chunk(frame, size, overlap, cap)


def test_questions_name_the_bad_line(spark, tmp_path):
    good = {"id": "q1", "question": "Why?", "expected_behavior": "answer", "category": "simple", "gold_sources": ["a"]}
    path = tmp_path / "q.jsonl"
    path.write_text("\n".join([json.dumps(good), "", json.dumps(good | {"id": "q2", "category": "vietnamese"} | {"gold_sources": None})]) + "\n")
    got = {r.id: r for r in files.read_questions(spark, str(path)).collect()}
    assert set(got) == {"q1", "q2"} and got["q2"].gold_sources == []
    for bad in ("no json", json.dumps(good | {"id": " "}), json.dumps(good | {"category": "other"}), json.dumps(good | {"expected_behavior": "guess"}), json.dumps({k: v for k, v in good.items() if k != "question"})):
        path.write_text("\n".join([json.dumps(good), "", bad, bad]))
        with pytest.raises(ValueError, match="line 3 "):
            files.read_questions(spark, str(path)).collect()
    path.write_text("\n \n")
    with pytest.raises(ValueError, match="no questions"):
        files.read_questions(spark, str(path))


def test_titles_that_are_given_stay(spark):
    rows = [("d", "p", 0, "text", "Given", None, "Head", True, None), ("d", "p", 1, "text", "", None, "x", False, None), ("e", "p", 0, "text", None, None, "Other", True, None)]
    got = {(r.doc_id, r.block_index): r.title for r in files.titled(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got == {("d", 0): "Given", ("d", 1): "Head", ("e", 0): "Other"}


def test_summaries(spark, tmp_path):
    rows = spark.createDataFrame([("a", "standard", "simple", 10, 0.5, True, False, True, True, 1.0, 0.5), ("b", "standard", "simple", 20, None, False, False, True, None, None, None)], "example_id string, mode string, category string, latency_ms int, confidence double, retried boolean, abstained boolean, cited boolean, hit boolean, mrr double, ndcg double")
    got = evaluate.category_summary(rows.withColumn("hit", F.col("hit").cast("int"))).first()
    assert (got.n, got.avg_latency_ms, got.retried_rate, got.hit_rate, got.avg_mrr, got.avg_ndcg) == (2, 15.0, 0.5, 1.0, 1.0, 0.5)
    files.write_report(rows, str(tmp_path / "r"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "r/summary"))
    assert back.columns == list(files.SUMMARY) and len(files.SUMMARY) == 35 and back.where("example_id = 'a' and mode = 'standard'").first().latency_ms == "10"

import zipfile

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, evaluate, index, judge, rank, retrieve
from corpusloom.sources import files
from corpusloom.streaming import events


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_text(spark):
    t = F.col("t")
    assert one(spark, tx.tokens(t), t="Ä b_1, c-d") == ["ä", "b_1", "c", "d"]
    assert one(spark, tx.cleaned(t), t=" a \r\n\r\n\n\nb\t\nc ") == "a\n\nb\nc"
    assert one(spark, tx.paragraphs(t), t="a\n \n b\n\n\nc") == ["a", "b", "c"]
    assert one(spark, tx.keywords(t), t="The cats and 7 42 cats of x") == ["cats", "42"]
    assert one(spark, tx.trigrams(t), t="ab cd") == ["abc", "bcd"]
    assert one(spark, tx.language(t), t="học máy") == "vi"
    assert one(spark, tx.language(t), t="plain words") == "en"
    assert one(spark, tx.gate_reason(t), t="hello thanks") == "small_talk"
    assert one(spark, tx.complexity(t), t="Compare A and B") == "complex"
    assert one(spark, tx.complexity(t), t="What is a token") == "simple_extractive"
    assert len(one(spark, tx.truncated(t, F.lit(12)), t="x" * 30)) == 12


def test_bm25_and_fusion(spark):
    chunks = spark.createDataFrame([(1, "red apple"), (2, "green pear pear"), (3, ""), (4, "red pear")], "chunk_id long, text string")
    queries = spark.createDataFrame([(7, "pear"), (8, "nothing here")], "query_id long, query string")
    hits = retrieve.bm25_topk(chunks, queries, 5).collect()
    assert [(h.query_id, h.chunk_id) for h in hits] == [(7, 2), (7, 4)]
    mk = lambda ids: spark.createDataFrame([(1, i + 1, c, c, 1.0) for i, c in enumerate(ids)], "query_id long, rank int, chunk_id string, doc_id string, score double")
    fused = retrieve.fuse(mk("abc"), mk("bcd"), 10, weight=1.0, constant=0).orderBy("rank").collect()
    assert [f.chunk_id for f in fused] == ["b", "a", "c", "d"]
    assert fused[1].sparse_score is None


def test_dense(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0])], "chunk_id long, vec array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "query_id long, vec array<double>")
    got = retrieve.dense_topk(v, q, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, round(r.score, 4)) for r in got] == [(0, 1, 1.0), (0, 2, 0.7071), (0, 0, 0.0), (1, 0, 0.0), (1, 1, 0.0), (1, 2, 0.0)]
    e = index.hash_embedding(spark.createDataFrame([(1, "a b a"), (2, "")], "chunk_id long, text string")).collect()
    assert {r.chunk_id: round(sum(x * x for x in r.vec), 6) for r in e} == {1: 1.0, 2: 0.0}


def test_packing(spark):
    rows = [(1, 1, "t", "|a|b|\n|c|d|" + "x" * 200), (1, 2, "s", "short text " * 4), (2, 1, "l", "word " * 60)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, content string")
    got = {(r.query_id, r.chunk_id): r for r in rank.pack(hits, 4, 120, 40).collect()}
    assert set(got) == {(1, "s"), (2, "l")}
    assert got[2, "l"].truncated and len(got[2, "l"].content) <= 120 and not got[1, "s"].truncated


def test_windows_and_chunks(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = one(spark, chunking.windows(F.col("t"), F.lit(20), 5), t=text)
    assert [g.split()[0] for g in got] == ["w0", "w15", "w30", "w45"] and got[0].split()[-5:] == got[1].split()[:5]
    blocks = spark.createDataFrame([("d", 0, "text", "T", "S", "Head", True), ("d", 1, "text", "T", "S", "a b " * 40, False), ("d", 2, "table", "T", "S", "|a|b|", False)], "doc_id string, block_index int, block_type string, title string, section string, content string, is_heading boolean")
    chunks = chunking.chunk(blocks, 20, 5).orderBy("chunk_index").collect()
    assert all(c.content.startswith("Title: T. Section: S.") and len(c.content.split()) <= 20 for c in chunks)
    assert "Head" in chunks[0].content and chunks[-1].block_type == "table"


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "g"), (2, 1, "g"), (2, 2, "g")], "query_id long, rank int, key string")
    gold = spark.createDataFrame([(1, "g"), (2, "g")], "query_id long, key string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r for r in evaluate.retrieval_metrics(ranked, gold, queries).collect()}
    assert (got[1].hit, got[1].mrr, got[1].ndcg) == (True, 0.333333, 0.5)
    assert got[2].ndcg == 1.0 and got[3].hit is None
    p = evaluate.latency_percentiles(spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "g string, v double"), "g", "v").first()
    assert (p.p50, p.p90, p.max) == (2.5, 3.7, 4.0)


def test_judging(spark):
    b = spark.range(1).select(*judge.budget(F.lit("simple_extractive"))).first()
    assert tuple(b) == (3, 3, 2, 1600, 384)
    g = judge.grounding(F.lit("answered"), F.lit("based on the available context"), F.lit(0.01), F.lit(2), F.lit(0))
    assert one(spark, g, t="") == "generic_answer_without_citations/true"
    c = judge.critique(F.lit("alpha beta"), F.lit("alpha"), F.lit("alpha beta gamma"), F.lit(1), F.lit(0), F.lit(1))
    row = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert (row.category, row.missing) == ("incomplete_answer", "beta")
    assert one(spark, judge.distinct_rewrites(F.col("t")), t=["A b", "a B ", "", "c"]) == ["A b", "c"]


def test_files(spark, tmp_path):
    (tmp_path / "My Doc.md").write_text("# Head\nbody one\n\n|a|b|\n|c|d|\n![x](y.png)\n## Next\ntail", encoding="utf-8")
    (tmp_path / "plain.txt").write_bytes("caf\xe9\n\nzwei".encode("latin-1"))
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{ns}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = files.titled(files.read_blocks(spark, str(tmp_path))).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.block_index):
        by.setdefault(r.file_name, []).append(r)
    assert [(b.block_type, b.section) for b in by["My Doc.md"]] == [("text", "Head"), ("text", "Head"), ("table", "Head"), ("image", "Head"), ("text", "Next"), ("text", "Next")]
    assert by["My Doc.md"][0].title == "Head" and len(by["plain.txt"]) == 2
    assert [b.block_type for b in by["d.docx"]] == ["text", "text", "table"] and by["bad.docx"][0].parser_fallback
    kept = files.read_blocks(spark, str(tmp_path)).where(F.col("file_name").endswith(".txt")).count()
    assert kept == 2


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    spark.sql("select 1L event_id, timestamp'2024-01-01 00:10:00' ts, 1L user_id, 'view' event_type, 2.0D value, '{}' props").write.parquet(str(source))
    events.publish(events.read_events(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(["event: start", "data: a", "data: b", "", ": note", "data: c", ""])], "stream string, n int, line string")
    assert sorted((r.event, r.data) for r in events.parse_frames(lines).collect()) == [("message", "c"), ("start", "a\nb")]

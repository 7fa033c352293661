import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, extract, judge, replies, selectors
from corpusloom.plans import workflow


def one(spark, query, content, score=0.9, language="vi"):
    row = spark.createDataFrame([(query, content, score, language)], "q string, c string, s double, l string")
    return row.select(extract.extractive(F.col("q"), F.col("c"), F.col("l"), F.col("s")).alias("x")).first()["x"]


CASES = [
    ("Tên Điều 2 là gì?", "Điều 2. Giải thích từ ngữ\nCác thuật ngữ được hiểu như sau.", "title_article_match", "Tên của Điều 2 là: Giải thích từ ngữ."),
    ("Điều 5 quy định gì?", "Điều 5. Nguyên tắc\nTổ chức phải tuân thủ.\nViệc xử lý khách quan.\nĐiều 6. Trách nhiệm\nKhác", "article_content_match", "Điều 5 quy định:\nTổ chức phải tuân thủ. Việc xử lý khách quan."),
    ("Định nghĩa dữ liệu cá nhân là gì?", "Mở đầu. Dữ liệu cá nhân là thông tin dưới dạng ký hiệu, chữ viết.", "definition_sentence_match", "Dữ liệu cá nhân là thông tin dưới dạng ký hiệu, chữ viết."),
    ("Mức phạt tối đa là bao nhiêu?", "Về phạt tối đa.\nMức phạt tối đa là 50.000.000 đồng.", "numeric_span_match", "Mức phạt tối đa là 50.000.000 đồng."),
    ("Trích nguyên văn Khoản 2 Điều 10", "Khoản 1 Điều 10: khác.\nKhoản 2 Điều 10: nộp hồ sơ trong 15 ngày.", "clause_article_match", "Khoản 2 Điều 10: nộp hồ sơ trong 15 ngày."),
    ("Trích nguyên văn quy chế thi", "  Quy chế thi gồm ba phần. ", "verbatim_excerpt_match", "Quy chế thi gồm ba phần."),
    ("Điều 99 quy định gì?", "Điều 5. Nguyên tắc xử lý", "not_simple_query", None),
    ("What is this about?", "Some text.", "not_simple_query", None),
    ("anything", "", "no_context", None),
]


@pytest.mark.parametrize("query, content, reason, answer", CASES)
def test_extractive_answers(spark, query, content, reason, answer):
    got = one(spark, query, content)
    assert (got["reason"], got["answer"], got["used"]) == (reason, answer, answer is not None)


def test_extractive_trust(spark):
    assert one(spark, CASES[0][0], CASES[0][1], score=0.001)["reason"] == "title_article_match:low_confidence"
    assert one(spark, "Tên Điều 2 là gì?", "Article 2: Terms.", language="en")["answer"] == "The title of Article 2 is: Terms."
    row = spark.createDataFrame([("What is the title of Article 3?", ["none", "x article 3: Scope of use.\ny"])], "q string, c array<string>")
    assert row.select(extract.exact_title(F.col("q"), F.col("c"), F.lit("en"))).first()[0] == "The title of Article 3 is: Scope of use."


def test_selectors(spark):
    ranked = spark.createDataFrame(
        [(1, 1, "a_chunk_0", None, "docs/a.md", None, "Guide", "Intro"), (1, 2, "a_chunk_1", None, "docs/a.md", None, "Guide", "Use"), (1, 3, "b_chunk_0", None, "docs/b.md", None, "Manual", "Use"), (1, 4, "b_chunk_0", None, "docs/b.md", None, "Manual", "Use")],
        "example_id int, rank int, chunk_id string, doc_id string, source string, path string, title string, section string",
    )
    golds = {
        "doc_id=a": [1, 2], "chunk: A_chunk_1": [2], "title=Guide": [], "title=Manual": [3], "title=Guide|section=Use": [2], '{"doc": "b"}': [3], "source=b.md": [3],
        "path=x/b.md": [], "b.md": [3], "section=Use": [], "docs\\b.md": [3], "a#a_chunk_0": [1], "intro": [1], "nothing": [], "manual#use": [3],
    }
    asked = spark.createDataFrame([(1, g) for g in golds], "example_id int, gold string")
    got = {g: [] for g in golds}
    for r in selectors.matches(asked, ranked).collect():
        got[r.gold].append(r["rank"])
    assert {g: sorted(v) for g, v in got.items()} == golds


def test_greedy_metrics_count_a_gold_once(spark):
    schema = "example_id int, rank int, chunk_id string, doc_id string, source string, path string, title string, section string"
    rows = [(e, k, f"{d}_chunk_{k}", None, None, None, None, None) for e, docs in ((1, "aaa"), (2, "xyb"), (3, "xyz"), (4, "xab")) for k, d in enumerate(docs, 1)]
    golds = spark.createDataFrame([(1, "doc_id=a"), (2, "doc_id=b"), (3, "doc_id=b"), (4, "doc_id=a"), (4, "doc_id=b")], "example_id int, gold string")
    got = {r.example_id: r for r in selectors.greedy_metrics(golds, spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].mrr, got[1].ndcg, got[1].hit) == (1.0, 1.0, True)
    assert (got[2].mrr, got[2].ndcg) == (0.333333, 0.5) and (got[3].hit, got[3].mrr, got[3].ndcg) == (False, 0.0, 0.0)
    assert got[4].mrr == 0.5 and got[4].ndcg == pytest.approx(0.693426, abs=1e-5)


def test_headings_stay_with_what_follows(spark):
    blocks = [(1, 0, "text", "Guide", "Start", "# Start", True), (1, 1, "text", "Guide", "Start", " ".join(f"detail{i}" for i in range(40)), False)]
    frame = spark.createDataFrame(blocks, "doc_id int, block_index int, block_type string, title string, section string, content string, is_heading boolean")
    got = [r.content for r in chunking.chunk(frame, size=12, overlap=3, with_prefix=False).orderBy("chunk_index").collect()]
    assert all(c.strip() != "# Start" for c in got) and "# Start" in got[0] and "detail0" in got[0]


def plain_merge(paragraphs, size, hint):
    """One paragraph after the other."""
    def is_heading(p, hinted):
        n = len(p.split())
        return p.startswith("#") or (hinted and n <= 24) or (p.endswith(":") and n <= 18) or ("\n" not in p and n <= 10 and p[:1].isupper())

    groups = []
    for i, p in enumerate(paragraphs):
        if groups and (sum(len(x.split()) for x in groups[-1]) + len(p.split()) <= size or (len(groups[-1]) == 1 and is_heading(groups[-1][0], hint and i == 1))):
            groups[-1].append(p)
        else:
            groups.append([p])
    out = []
    for g in map("\n\n".join, groups):
        n = len(g.split())
        if out and n < max(1, min(16, size // 4)) and len(out[-1].split()) + n <= size:
            out[-1] += "\n\n" + g
        else:
            out.append(g)
    return out


def test_paragraphs_merge_like_a_plain_loop(spark):
    import random

    rng = random.Random(1)
    made = lambda: [" ".join([rng.choice(["Word", "word", "#"])] + ["w"] * rng.randint(0, 14)) + rng.choice(["", ":", "."]) for _ in range(rng.randint(1, 12))]
    rows = [(made(), rng.randint(4, 40), rng.random() < 0.5) for _ in range(120)]
    frame = spark.createDataFrame(rows, "p array<string>, size int, hint boolean")
    for (p, size, hint), r in zip(rows, frame.select(chunking.merged(F.col("p"), F.col("size"), F.col("hint")).alias("m")).collect()):
        assert r.m == plain_merge(p, size, hint)


def test_refined_and_cautious(spark):
    row = spark.createDataFrame([("draft ", "b,c,d,e", "k1", "en", "line one\nline two", None)], "a string, m string, lead string, l string, c string, n string")
    got = row.select(judge.refined(F.col("a"), F.col("m"), F.col("lead"), F.col("l")).alias("r"), judge.cautious(F.col("c"), F.col("l"), F.lit("none")).alias("c"), judge.cautious(F.col("n"), F.col("l"), F.lit("none")).alias("n"), replies.note_category(F.lit("Weak_evidence: x")).alias("k")).first()
    assert got.r == "draft\\n\\nAdditional coverage: b, c, d.\\n\\nEvidence note: supported by k1."
    assert got.c.startswith("Based on the available context, relevant information is: line one line two\n\n") and got.n == "none" and got.k == "weak_evidence"


def test_workflow_takes_string_ids(spark):
    chunks = spark.createDataFrame([("c1", "the cat sat on the mat. it was red."), ("c2", "dogs bark loudly at night")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "where did the cat sit on the mat"), (2, "hello")], "query_id long, query string")
    got = {r.query_id: r for r in workflow.advanced(chunks, asked).collect()}
    assert got[2].stop_reason == "small_talk" and got[1].n_citations >= 1 and "the cat sat on the mat." in got[1].answer
    assert {r.query_id for r in workflow.compare(chunks, asked).collect()} == {1, 2}

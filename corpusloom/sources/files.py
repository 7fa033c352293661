"""File sources: text, Markdown and DOCX files as blocks, question sets as JSON lines; sinks for indexes and reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

BLOCKS = "path string, block_index int, block_type string, section string, is_heading boolean, content string, parser_fallback boolean"
#: Files that a parser knows.
SUPPORTED = "*.{md,markdown,txt,docx}"
QUESTIONS = "id string, question string, expected_behavior string, reference_answer string, gold_sources array<string>, category string, notes string"
# What is expected of a question, and its categories.
BEHAVIORS = ("answer", "abstain", "retry")
CATEGORIES = ("simple", "multi_hop", "ambiguous", "insufficient_context", "conflicting_sources", "vietnamese")
#: Tried in this order; the last decodes anything.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1258", "latin-1")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decoded(raw: bytes) -> str:
    for name in ENCODINGS[:-1]:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode(ENCODINGS[-1])


def table_text(rows: list[list[str]]) -> str:
    """A Markdown table: short rows are filled, a divider follows the header."""
    width = max(map(len, rows))
    full = [[c.strip() for c in r] + [""] * (width - len(r)) for r in rows]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(full[0]), line(["---"] * width), *map(line, full[1:])])


def text_blocks(text: str) -> list[tuple]:
    return [("text", None, False, p.strip()) for p in re.split(r"\n\s*\n", text.replace("\r\n", "\n")) if p.strip()]


def markdown_blocks(text: str) -> list[tuple]:
    """Headings set the section; image lines and runs of lines with two bars or more are blocks of their own."""
    out: list[tuple] = []
    section, held, kind = None, [], "text"

    def flush() -> None:
        if held:
            out.append((kind, section, False, "\n".join(held).strip()))
            held.clear()

    for line in text.replace("\r\n", "\n").split("\n"):
        s = line.strip()
        now = "table" if s.count("|") >= 2 else "text"
        if not s or re.match(r"#{1,6}\s", s) or s.startswith("![") or now != kind:
            flush()
            kind = now
        if re.match(r"#{1,6}\s", s):
            section = s.lstrip("#").strip()
            out.append(("text", section, True, section))
        elif s.startswith("!["):
            out.append(("image", section, False, s))
        elif s:
            held.append(s)
    flush()
    return [b for b in out if b[3]]


def docx_blocks(raw: bytes) -> list[tuple]:
    """Paragraphs and tables in body order; heading styles set the section."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    joined = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out, section = [], None
    for node in body:
        if node.tag == f"{_W}p":
            text = joined(node).strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            head = style is not None and style.get(f"{_W}val", "").lower().startswith("heading")
            if text:
                section = text if head else section
                out.append(("text", section, head, text))
        elif node.tag == f"{_W}tbl":
            rows = [[joined(c) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            if rows:
                out.append(("table", section, False, table_text(rows)))
    return out


def blocks_of(path: str, raw: bytes) -> list[tuple]:
    """(type, section, heading, content, fallback) of a file by its suffix; a file that its parser can't read is one raw block."""
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        found = docx_blocks(raw) if suffix == "docx" else markdown_blocks(decoded(raw)) if suffix in ("md", "markdown") else text_blocks(decoded(raw))
        return [(*b, False) for b in found]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
        return [("text", None, False, decoded(raw), True)]


def file_names() -> tuple[Column, Column]:
    """The doc_id of a file's path, and the name shown for it: without the ten hexadecimal digits that an upload puts first."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), " ", "_")
    return F.concat(stem, F.lit("_"), F.substring(F.sha1(F.col("path").cast("binary")), 1, 10)), display_name(name)


def display_name(name: Column) -> Column:
    return F.regexp_replace(name, "^[0-9a-fA-F]{10}_(?=.)", "")


def scanned(spark: SparkSession, folder: str | list[str], glob: str = SUPPORTED) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def listing(spark: SparkSession, folder: str, glob: str = SUPPORTED, collection: str = "uploaded") -> DataFrame:
    """A row for each supported file: doc_id, stored_path, file_name, file_type, source_collection, created_at (its modification
    time), uploaded_at (the same, null for other collections). Contents are not read. A missing folder is an error of the read."""
    doc_id, name = file_names()
    at = F.col("modificationTime")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return scanned(spark, folder, glob).select(doc_id.alias("doc_id"), F.col("path").alias("stored_path"), name.alias("file_name"), kind.alias("file_type"), F.lit(collection).alias("source_collection"), at.alias("created_at"), F.when(F.lit(collection) == "uploaded", at).alias("uploaded_at"))


def read_blocks(spark: SparkSession, folder: str | list[str], glob: str = SUPPORTED, since: datetime | None = None) -> DataFrame:
    """One row for each block of the files below a folder, or of a list of files, with doc_id, file_name and the modification time.

    since leaves files of earlier times out; their contents are not read.
    """
    files = scanned(spark, folder, glob)
    files = files if since is None else files.where(F.col("modificationTime") >= F.lit(since))

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            rows = [(t, p, i, *b) for t, p, c in zip(frame["modificationTime"], frame["path"], frame["content"]) for i, b in enumerate(blocks_of(p, c))]
            yield pd.DataFrame(rows, columns=["uploaded_at", "path", "block_index", "block_type", "section", "is_heading", "content", "parser_fallback"])

    blocks = files.select("path", "modificationTime", "content").mapInPandas(parse, f"uploaded_at timestamp, {BLOCKS}")
    doc_id, name = file_names()
    return blocks.select(doc_id.alias("doc_id"), name.alias("file_name"), "uploaded_at", *[c.split()[0] for c in BLOCKS.split(", ")])


def with_metadata(blocks: DataFrame, base: dict[str, str] | None = None) -> DataFrame:
    """Adds each block's metadata (map of texts): the given base, over it the block's own (column metadata, if there is one), over
    both what a block says itself. Names and types that neither has come from the file."""
    none = F.create_map().cast("map<string,string>")
    given = F.create_map(*[F.lit(x) for pair in (base or {}).items() for x in pair]).cast("map<string,string>") if base else none
    blocks = blocks.withColumn("_held", F.coalesce("metadata", none) if "metadata" in blocks.columns else none)
    held = F.col("_held")
    rows = blocks.withColumn("metadata", F.map_zip_with(given, held, lambda k, a, b: F.when(F.map_contains_key(held, k), b).otherwise(a)))
    get = lambda k: F.nullif(F.try_element_at(F.col("metadata"), F.lit(k)), F.lit(""))
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    own = {
        "block_index": F.col("block_index").cast("string"), "doc_id": F.col("doc_id").cast("string"), "source": F.col("path"), "filename": F.coalesce(get("filename"), name), "file_name": F.coalesce(get("file_name"), name),
        "file_extension": F.coalesce(get("file_extension"), suffix), "file_type": F.coalesce(get("file_type"), F.regexp_replace(suffix, r"^\.+", "")), "page": F.try_element_at(held, F.lit("page")),
        "block_type": F.coalesce(get("block_type"), F.col("block_type")), "ocr": F.coalesce(F.lower(get("ocr")).isin("true", "1", "yes"), F.lit(False)).cast("string"),
    }
    said = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
    return rows.withColumn("metadata", F.map_zip_with(F.col("metadata"), said, lambda k, a, b: F.when(F.map_contains_key(said, k), b).otherwise(a))).drop("_held")


def titled(blocks: DataFrame) -> DataFrame:
    """Adds each document's first heading as title; a title that is there stays."""
    if "title" in blocks.columns:
        return titled(blocks.withColumnRenamed("title", "_given")).withColumn("title", F.coalesce(F.nullif(F.col("_given"), F.lit("")), F.col("title"))).drop("_given")
    first = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return blocks.withColumn("title", F.first(F.when(F.col("is_heading"), F.col("content")), ignorenulls=True).over(first))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set. A line that is no object of these fields, or one without an id, a question, or a known behavior and
    category, is an error that names the first such line by its number; an empty set is one too. Blank lines count for nothing."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("place", "line")).where(tx.stripped(F.col("line")) != "")
    row = F.from_json("line", QUESTIONS + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select((F.col("place") + 1).alias("line_no"), row.alias("q")).select("line_no", "q.*")
    text = lambda c: F.coalesce(tx.stripped(F.col(c)), F.lit("")) != ""
    good = F.col("_bad").isNull() & text("id") & text("question") & F.coalesce(F.col("expected_behavior").isin(*BEHAVIORS), F.lit(False)) & F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))
    n, bad = rows.agg(F.count("*"), F.min(F.when(~good, F.col("line_no")))).first()
    if bad is not None:
        raise ValueError(f"line {bad} of {path} is no question")
    if not n:
        raise ValueError(f"no questions in {path}")
    return rows.drop("line_no", "_bad").withColumn("gold_sources", F.coalesce("gold_sources", F.array().cast("array<string>")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, query_set of a query file: JSON lines, a JSON list, or an object with a list named queries; each item a
    string or an object with query or text, and id or label. Items without a text are left out; ids default to file_NN by place.

    A query file is one small document that is read whole.
    """
    text = spark.read.text(path, wholetext=True)
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.when(F.lit(path.lower().endswith(".jsonl")), F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))).otherwise(F.col("value"))
    payload = F.parse_json(listed)
    items = F.coalesce(F.try_variant_get(payload, "$.queries", "array<variant>"), F.try_variant_get(payload, "$", "array<variant>"))
    rows = text.select(items.alias("items"))
    if rows.where("items is null").count():
        raise ValueError(f"no list of queries in {path}")
    rows = rows.select(F.posexplode("items").alias("place", "item"))
    field = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("item", f"$.{n}", "string"), F.lit("")) for n in names])
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    first = F.when(field("query").isNotNull(), F.try_variant_get("item", "$.query", "variant")).otherwise(F.try_variant_get("item", "$.text", "variant"))
    query = tx.stripped(F.coalesce(string(F.col("item")), string(first)))
    default = F.concat(F.lit("file_"), F.format_string("%02d", F.col("place") + 1))
    return rows.select(F.coalesce(tx.stripped(field("id", "label")), default).alias("query_id"), query.alias("query"), F.lit("file").alias("query_set")).where("query <> ''")


def fingerprint(blocks: DataFrame, settings: dict) -> str:
    """One hash of the settings and of all files' names and contents, for deciding whether an index can be used again."""
    row = blocks.agg(F.count("*"), F.sum(F.xxhash64("path", "block_index", "content").cast("decimal(38,0)"))).first()
    text = ",".join(f"{k}={settings[k]}" for k in sorted(settings)) + f"|{row[0]}|{row[1]}"
    return blocks.sparkSession.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


# The columns of a summary.
MODES = ("dense", "bm25", "hybrid", "hybrid_rerank")
SUMMARY = (
    "example_id", "mode", "category", "expected_behavior", "status", "latency_ms", "confidence", "grounded_score", "citation_count", "has_citations", "abstain_match", "retry_used",
    "retrieved_count", "selected_context_count", "chunk_size", "chunk_overlap", "answer_non_empty", "answer_contains_reference_keywords", "cited_gold_source_overlap", "groundedness_proxy",
    "retrieval_hit", "retrieval_mrr", "retrieval_ndcg", *[f"{m}_{c}" for m in MODES for c in ("hit", "mrr", "ndcg")],
)


def summary(rows: DataFrame) -> DataFrame:
    """The rows of an evaluation in the columns of a summary, in their order; those that the rows lack are empty."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in SUMMARY])


def write_report(rows: DataFrame, folder: str) -> None:
    """The rows of an evaluation as JSON lines and as CSV with a header, each in a folder of its own. Rows with an example_id get
    the columns of a summary, any others all columns that CSV can hold."""
    rows.write.mode("overwrite").json(f"{folder}/results")
    flat = summary(rows) if "example_id" in rows.columns else rows.select(*[c for c, t in rows.dtypes if not t.startswith(("array", "map", "struct"))])
    flat.write.mode("overwrite").option("header", "true").csv(f"{folder}/summary")


def report_lines(summary: DataFrame) -> str:
    """A Markdown table of a small summary."""
    rows = summary.collect()
    return table_text([list(summary.columns), *[["" if v is None else str(v) for v in r] for r in rows]])


def clean_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("content", tx.cleaned(F.col("content"))).where("content <> ''")

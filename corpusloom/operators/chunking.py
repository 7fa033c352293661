"""Chunking: block grouping, paragraph and sentence packing, overlap windows.

A document's blocks fold in order, as array functions of one row; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SIZE, OVERLAP = 320, 40
TITLE_CHARS = 72


def stride(window: Column, overlap: int) -> Column:
    return (window - F.least(F.lit(overlap), window - F.greatest(F.lit(1), F.least(F.lit(8), F.floor(window / 4))))).cast("int")


def window_starts(n: Column, window: Column, overlap: int) -> Column:
    """Starts of the windows over n tokens: the last one reaches the end and holds more than one token."""
    step = stride(window, overlap)
    last = F.greatest(F.lit(0), F.ceil((n - window) / step)).cast("int")
    last = F.when((last > 0) & (n - last * step <= 1), last - 1).otherwise(last)
    return F.when(n > 0, F.sequence(F.lit(0), last * step, step)).otherwise(F.array().cast("array<int>"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def windows(text: Column, window: Column, overlap: int) -> Column:
    """Overlapping pieces of the text's words, equal neighbours once."""
    cut = lambda w: F.transform(window_starts(F.size(w), window, overlap), lambda s: F.array_join(F.slice(w, s + 1, window), " "))
    once = lambda pieces: F.filter(pieces, lambda p, i: (i == 0) | (p != F.coalesce(F.get(pieces, i - 1), F.lit(""))))
    return tx.let(tx.let(words(text), cut), once)


def heading(text: Column, hint: Column) -> Column:
    """Whether a paragraph is a heading."""
    n = F.size(words(text))
    line = ~F.contains(text, F.lit("\n"))
    return (n > 0) & (text.startswith("#") | (hint & (n <= 24)) | (text.endswith(":") & (n <= 18)) | (line & (n <= 10) & text.rlike(r"^\p{Lu}")))


def packed(units: Column, size: Column, separator: str) -> Column:
    """Greedy packing of texts up to so many words each; one that is too long stands alone."""
    state = lambda out, open_, n: F.struct(out.alias("out"), open_.alias("open"), n.cast("int").alias("n"))
    zero = state(F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(0))

    def step(acc: Column, u: Column) -> Column:
        n = F.size(words(u))
        fits = acc["open"].isNull() | (acc["n"] + n <= size)
        joined = F.when(acc["open"].isNull(), u).otherwise(F.concat(acc["open"], F.lit(separator), u))
        return F.when(fits, state(acc["out"], joined, acc["n"] + n)).otherwise(state(F.concat(acc["out"], F.array(acc["open"])), u, n))

    return F.aggregate(units, zero, step, lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]))))


def merged(paragraphs: Column, size: Column, hint: Column) -> Column:
    """Paragraphs packed up to the size. A heading that would stand alone takes in the paragraph after it whatever its size;
    what is left under a quarter of the size, 16 words at most, goes to the piece before it if it fits. hint: whether the
    first paragraph is said to be a heading."""
    unit = "struct<t:string,n:int>"
    state = lambda out, t, n, parts: F.struct(out.cast(f"array<{unit}>").alias("out"), t.alias("t"), n.cast("int").alias("n"), parts.cast("int").alias("parts"))
    pair = lambda t, n: F.struct(t.alias("t"), n.cast("int").alias("n")).cast(unit)
    zero = state(F.array(), F.lit(None).cast("string"), F.lit(0), F.lit(0))

    def step(acc: Column, u: Column) -> Column:
        lone = (acc["parts"] == 1) & heading(acc["t"], hint & (F.size(acc["out"]) == 0))
        grown = state(acc["out"], F.concat(acc["t"], F.lit("\n\n"), u["t"]), acc["n"] + u["n"], acc["parts"] + 1)
        closed = state(F.concat(acc["out"], F.array(pair(acc["t"], acc["n"]))), u["t"], u["n"], F.lit(1))
        return F.when(acc["parts"] == 0, state(acc["out"], u["t"], u["n"], F.lit(1))).when((acc["n"] + u["n"] <= size) | lone, grown).otherwise(closed)

    counted = F.filter(F.transform(paragraphs, lambda p: pair(p, F.size(words(p)))), lambda u: u["n"] > 0)
    closed = F.aggregate(counted, zero, step, lambda acc: F.when(acc["parts"] == 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(pair(acc["t"], acc["n"])))))
    least = F.greatest(F.lit(1), F.least(F.lit(16), F.floor(size / 4)))

    def fold(acc: Column, u: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        both = pair(F.concat(last["t"], F.lit("\n\n"), u["t"]), last["n"] + u["n"])
        small = (F.size(acc) > 0) & (u["n"] < least) & (last["n"] + u["n"] <= size)
        return F.when(small, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(u))).cast(f"array<{unit}>")

    return F.transform(F.aggregate(closed, F.array().cast(f"array<{unit}>"), fold), lambda u: u["t"])


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, "\n", " "), r"(?<=[.!?])\s+"), tx.stripped), lambda s: s != "")


def split_long(text: Column, size: Column, overlap: int) -> Column:
    """Pieces of a text over the size: packed sentences if each fits and more than one piece results, else windows."""
    parts = sentences(text)
    grouped = packed(parts, size, " ")
    usable = (F.size(parts) > 1) & ~F.exists(parts, lambda s: F.size(words(s)) > size) & (F.size(grouped) > 1)
    return F.when(usable, grouped).otherwise(windows(text, size, overlap))


def prefix(title: Column, section: Column) -> Column:
    """Title and section in front of a chunk, each cut to 72 characters; a section equal to the title is left out."""
    short = lambda x: F.when(F.char_length(x) > TITLE_CHARS, F.concat(F.regexp_replace(F.substring(x, 1, TITLE_CHARS - 3), r"\s+$", ""), F.lit("..."))).otherwise(x)
    t, s = F.nullif(tx.stripped(title), F.lit("")), F.nullif(tx.stripped(section), F.lit(""))
    parts = F.concat_ws(" ", F.when(t.isNotNull(), F.concat(F.lit("Title: "), short(t), F.lit("."))), F.when(s.isNotNull() & ~s.eqNullSafe(t), F.concat(F.lit("Section: "), short(s), F.lit("."))))
    return F.when(parts != "", F.concat(parts, F.lit("\n\n"))).otherwise("")


def grouped_blocks(blocks: DataFrame, cap: int) -> DataFrame:
    """Merges a document's text blocks in order while the section stays, up to cap characters; other blocks stand alone.

    blocks: doc_id, block_index, block_type, title, section, content, is_heading, and metadata (map of texts) if there is any. A
    heading takes in the block after it. Metadata unite in the blocks' order: a key keeps the value of the first block that has one.
    """
    blocks = blocks if "metadata" in blocks.columns else blocks.withColumn("metadata", F.create_map().cast("map<string,string>"))
    blocks = blocks.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    order = Window.partitionBy("doc_id").orderBy("block_index")
    before = lambda c: F.lag(c).over(order)
    same = F.coalesce("section", F.lit("")) == F.coalesce(before("section"), F.lit(""))
    under = before("is_heading") & ((F.coalesce("section", F.lit("")) == "") | (F.coalesce(before("section"), F.lit("")) == ""))
    joins = (F.col("block_type") == "text") & (before("block_type") == "text") & (same | under)
    runs = blocks.withColumn("_run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order))
    listed = runs.groupBy("doc_id", "_run").agg(F.array_sort(F.collect_list(F.struct("block_index", "content", "is_heading", F.map_entries("metadata").alias("meta")))).alias("b"), F.first("block_type").alias("block_type"), F.max("title").alias("title"), F.max_by("section", "block_index").alias("section"))
    item = "struct<content:string,n:int,lone:boolean,hint:boolean,meta:map<string,string>>"
    make = lambda c, n, lone, hint, meta: F.struct(c.alias("content"), n.cast("int").alias("n"), lone.alias("lone"), hint.alias("hint"), meta.alias("meta"))

    def step(acc: Column, x: Column) -> Column:
        n, meta = F.char_length(x["content"]), F.map_from_entries(x["meta"])
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & ((last["n"] + n + 2 <= cap) | last["lone"])
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(make(F.concat(last["content"], F.lit("\n\n"), x["content"]), last["n"] + n + 2, F.lit(False), last["hint"], F.map_zip_with(last["meta"], meta, lambda k, a, b: F.coalesce(a, b)))))
        return F.when(fits, grown.cast(f"array<{item}>")).otherwise(F.concat(acc, F.array(make(x["content"], n, x["is_heading"], x["is_heading"], meta))).cast(f"array<{item}>"))

    folded = F.aggregate("b", F.array().cast(f"array<{item}>"), step)
    return listed.select("doc_id", "_run", "block_type", "title", "section", F.posexplode(folded).alias("part", "g")).select("doc_id", "_run", "part", "block_type", "title", "section", F.col("g.content").alias("content"), F.coalesce("g.hint", F.lit(False)).alias("is_heading"), F.col("g.meta").alias("metadata"))


def chunk(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, cap: int | None = None, with_prefix: bool = True) -> DataFrame:
    """chunk_id, chunk_index, doc_id, block_type, title, section, content of every chunk, and metadata if the blocks have any."""
    if size <= 0 or overlap < 0 or overlap >= size or (cap is not None and cap <= 0):
        raise ValueError(f"chunk size {size}, overlap {overlap} or cap {cap} is out of bounds")
    with_metadata = "metadata" in blocks.columns
    groups = grouped_blocks(blocks, cap or max(1200, 12 * size))
    head = prefix(F.col("title"), F.col("section")) if with_prefix else F.lit("")
    groups = groups.withColumn("_head", head).withColumn("_head", F.when(F.size(words(F.col("_head"))) < size, F.col("_head")).otherwise(""))
    room = size - F.size(words(F.col("_head")))
    pieces = F.flatten(F.transform(merged(tx.paragraphs(F.col("content")), room, F.col("is_heading")), lambda p: F.when(F.size(words(p)) <= room, F.array(p)).otherwise(split_long(p, room, overlap))))
    text = F.when(F.col("block_type") == "text", pieces).otherwise(F.array("content"))
    rows = groups.select("doc_id", "_run", "part", "block_type", "title", "section", "metadata", "_head", F.posexplode(text).alias("_i", "piece"))
    held = words(F.col("piece"))
    body = F.when(F.size(held) <= room, F.col("piece")).otherwise(F.array_join(F.slice(held, 1, F.greatest(F.lit(1), room)), " "))
    rows = rows.withColumn("content", F.concat("_head", body)).where(tx.stripped(F.col("content")) != "")
    rows = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("_run", "part", "_i")) - 1)
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.format_string("%04d", "chunk_index"), F.lit("_"), F.substring(F.sha1(F.col("content").cast("binary")), 1, 10))
    more = [chunk_metadata().alias("metadata")] if with_metadata else []
    return rows.select(name.alias("chunk_id"), "chunk_index", "doc_id", "block_type", "title", "section", "content", *more)


def chunk_metadata() -> Column:
    """A chunk's metadata: its blocks' own, under the keys that a chunk says itself; names and types have defaults."""
    meta = F.col("metadata")
    get = lambda k: F.nullif(F.try_element_at(meta, F.lit(k)), F.lit(""))
    base = F.element_at(F.split(F.coalesce(get("source"), F.lit("")), "/"), -1)
    suffix = F.coalesce(get("file_extension"), F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1)))
    injected = F.col("_head") != ""
    own = {
        "chunk_index": F.col("chunk_index").cast("string"), "doc_id": F.col("doc_id").cast("string"), "file_name": F.coalesce(get("file_name"), get("filename"), base),
        "filename": F.coalesce(get("filename"), get("file_name"), base), "file_extension": suffix, "file_type": F.coalesce(get("file_type"), F.regexp_replace(suffix, r"^\.+", "")),
        "block_type": F.coalesce(get("block_type"), F.col("block_type")), "ocr": truth(F.try_element_at(meta, F.lit("ocr"))).cast("string"),
        "heading_context_injected": injected.cast("string"), "heading_context_prefix_length": F.char_length("_head").cast("string"),
    }
    said = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
    return F.map_zip_with(meta, said, lambda k, a, b: F.coalesce(b, a))


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "1", "yes"), F.lit(False))

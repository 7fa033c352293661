"""Gold selectors against ranked sources: parsing, the ladder of matches, greedy assignment and the metrics that follow.

golds: example_id, gold. ranked: example_id, rank, chunk_id, doc_id, source, path, title, section; both sides of an example are
small, so they meet in a join on the example; what must be unambiguous is counted over the example's sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of fields in selectors.
ALIASES = {"chunk_id": ("chunk_id", "chunk"), "doc_id": ("doc_id", "doc"), "source": ("source",), "path": ("path",), "title": ("title",), "section": ("section",)}


def normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def normal_path(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(normal(text), F.lit("\\"), F.lit("/")), "/{2,}", "/"), r"^\./", "")


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base(path), r"(?<=.)\.[^.]*$|^\.[^.]*$", "")


def path_like(text: Column) -> Column:
    return F.contains(normal_path(text), F.lit("/")) | F.contains(text, F.lit("\\")) | F.contains(normal_path(text), F.lit("."))


def fields(gold: Column) -> Column:
    """struct of the six fields that a selector names, all null for a plain string: a JSON object or key=value parts."""
    raw = F.trim(gold)
    json = F.when(raw.startswith("{") & raw.endswith("}"), F.from_json(raw, "map<string,string>"))
    pairs = F.transform(F.map_entries(F.coalesce(json, F.expr("cast(map() as map<string,string>)"))), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), F.trim(e["value"]).alias("v")))
    parts = F.transform(F.split(raw, "[|,]"), lambda p: F.struct(F.lower(F.regexp_extract(p, r"^\s*([a-zA-Z_]+)\s*[:=]\s*(.+?)\s*$", 1)).alias("k"), F.trim(F.regexp_extract(p, r"^\s*([a-zA-Z_]+)\s*[:=]\s*(.+?)\s*$", 2)).alias("v")))
    known = [k for names in ALIASES.values() for k in names]
    usable = lambda xs: F.filter(xs, lambda x: x["k"].isin(*known) & (x["v"] != ""))
    listed = F.when(F.size(usable(pairs)) > 0, usable(pairs)).otherwise(usable(parts))
    # The last of several values of one field holds.
    value = lambda names: F.element_at(F.array_append(F.transform(F.filter(F.reverse(listed), lambda x: x["k"].isin(*names)), lambda x: x["v"]), F.lit(None).cast("string")), 1)
    return F.struct(*[value(names).alias(f) for f, names in ALIASES.items()])


def sources(ranked: DataFrame) -> DataFrame:
    """Each example's distinct sources in order, ranked anew, with normal forms, and as they are written in `said`. A missing document is
    read from the chunk's name, a missing path is the source."""
    doc = F.coalesce("doc_id", F.when(F.contains("chunk_id", F.lit("_chunk_")), F.substring_index("chunk_id", "_chunk_", 1)))
    rows = ranked.withColumn("doc_id", doc).withColumn("path", F.coalesce("path", "source"))
    rows = rows.select("example_id", "rank", *[normal(F.col(c)).alias(c) for c in ("chunk_id", "doc_id", "title", "section")], *[normal_path(F.col(c)).alias(c) for c in ("source", "path")], F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("chunk_id", "doc_id", "source", "path", "title", "section")]).alias("said"))
    meta = F.concat_ws("|", "doc_id", "source", "path", "title", "section")
    key = F.when(F.col("chunk_id") != "", F.concat(F.lit("chunk:"), "chunk_id")).otherwise(F.concat(F.lit("meta:"), meta))
    rows = rows.where(F.concat("chunk_id", meta) != "||||").withColumn("_n", F.row_number().over(Window.partitionBy("example_id", key).orderBy("rank"))).where("_n = 1").drop("_n")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("example_id").orderBy("rank")))
    paths = F.array_distinct(F.filter(F.array("source", "path"), lambda p: p != ""))
    rows = rows.withColumn("paths", paths).withColumn("bases", F.array_distinct(F.filter(F.transform("paths", base), lambda b: b != "")))
    alike = lambda *by: F.count("*").over(Window.partitionBy("example_id", *by))
    rows = rows.withColumns({"same_title": alike("title"), "same_section": alike("section"), "same_both": alike("title", "section")})
    lone = rows.select("example_id", "rank", F.explode("bases").alias("b")).withColumn("n", F.count("*").over(Window.partitionBy("example_id", "b"))).where("n = 1")
    return rows.join(lone.groupBy("example_id", "rank").agg(F.collect_list("b").alias("lone_bases")), ["example_id", "rank"], "left").withColumn("lone_bases", F.coalesce("lone_bases", F.array().cast("array<string>")))


def path_matches(expected: Column) -> Column:
    """An equal path; or an equal file name that no other source has, where one side is a file name alone."""
    p = normal_path(expected)
    bare = (p == base(p)) | F.exists("paths", lambda x: x == base(x))
    return (p != "") & (F.array_contains("paths", p) | (bare & F.array_contains("lone_bases", base(p))))


def matches(golds: DataFrame, ranked: DataFrame) -> DataFrame:
    """example_id, gold, gold_no, rank: which sources satisfy which selector.

    By the first field that a selector names: chunk, document, path, title with section, title, section; the last three only
    where no other source has the same. A plain string tries the same ladder, then any name of the source, then name#chunk.
    """
    order = Window.partitionBy("example_id").orderBy("gold")
    asked = golds.select("example_id", "gold").distinct().withColumn("gold_no", F.row_number().over(order)).withColumn("f", fields(F.col("gold")))
    rows = sources(ranked).join(asked, "example_id")
    f = lambda c: F.col(f"f.{c}")
    is_ = lambda c, v: (F.col(c) == normal(v)) & (normal(v) != "")
    title, section = is_("title", f("title")) & (F.col("same_title") == 1), is_("section", f("section")) & (F.col("same_section") == 1)
    structured = (
        F.when(f("chunk_id").isNotNull(), F.col("chunk_id") == normal(f("chunk_id")))
        .when(f("doc_id").isNotNull(), F.col("doc_id") == normal(f("doc_id")))
        .when(f("source").isNotNull() | f("path").isNotNull(), F.when(f("source").isNotNull(), path_matches(f("source"))).otherwise(True) & F.when(f("path").isNotNull(), path_matches(f("path"))).otherwise(True))
        .when(f("title").isNotNull() & f("section").isNotNull(), is_("title", f("title")) & is_("section", f("section")) & (F.col("same_both") == 1))
        .when(f("title").isNotNull(), title)
        .otherwise(section)
    )
    g, gold = F.col("gold"), normal(F.col("gold"))
    left, right = normal(F.substring_index(g, "#", 1)), normal(F.expr("substring(gold, instr(gold, '#') + 1)"))
    halves = F.contains(g, F.lit("#")) & (left != "") & (right != "")
    names = F.array_distinct(F.filter(F.concat(F.array("doc_id", "title", "section", "chunk_id"), F.col("paths"), F.col("bases"), F.transform("paths", stem)), lambda t: t != ""))
    by_name = F.array_contains(names, gold) | F.array_contains(names, normal_path(g))
    by_half = halves & (F.array_contains(names, left) | F.array_contains(names, normal_path(left))) & (F.col("chunk_id") != "") & F.col("chunk_id").startswith(right)
    under = halves & ~F.contains(right, F.lit("chunk")) & ~path_like(left) & (F.col("title") == left) & (F.col("section") == right) & (F.col("same_both") == 1)
    plain = (gold != "") & (
        (F.col("chunk_id") == gold) | (F.col("doc_id") == gold) | (path_like(g) & path_matches(g)) | under
        | ((F.col("title") == gold) & (F.col("same_title") == 1)) | ((F.col("section") == gold) & (F.col("same_section") == 1)) | by_name | by_half
    )
    named = F.coalesce(*[f(c) for c in ALIASES]).isNotNull()
    return rows.where(F.when(named, structured).otherwise(plain)).select("example_id", "gold", "gold_no", "rank")


def greedy_metrics(golds: DataFrame, ranked: DataFrame) -> DataFrame:
    """example_id, n_gold, n_ranked, hit, mrr, ndcg: in rank order each source satisfies the first selector that none has yet."""
    n_gold = golds.select("example_id", "gold").distinct().groupBy("example_id").agg(F.count("*").alias("n_gold"))
    n_ranked = sources(ranked).groupBy("example_id").agg(F.count("*").alias("n_ranked"))
    listed = matches(golds, ranked).groupBy("example_id", "rank").agg(F.array_sort(F.collect_set("gold_no")).alias("g"))
    listed = listed.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("rank", "g"))).alias("rows"))
    state = "struct<seen:array<int>,at:array<int>>"

    def step(acc: Column, x: Column) -> Column:
        new = F.array_except(x["g"], acc["seen"])
        return F.when(F.size(new) > 0, F.struct(F.array_append(acc["seen"], F.get(new, F.lit(0))).alias("seen"), F.array_append(acc["at"], x["rank"]).alias("at")).cast(state)).otherwise(acc)

    at = F.aggregate("rows", F.struct(F.array().cast("array<int>").alias("seen"), F.array().cast("array<int>").alias("at")).cast(state), step, lambda acc: acc["at"])
    joined = n_gold.join(n_ranked, "example_id", "left").join(listed.select("example_id", at.alias("at")), "example_id", "left").na.fill(0, ["n_ranked"])
    gain = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    ideal = gain(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_gold", "n_ranked").cast("int"))))
    found = F.coalesce("at", F.array().cast("array<int>"))
    return joined.select("example_id", "n_gold", "n_ranked", (F.size(found) > 0).alias("hit"), F.round(F.coalesce(1.0 / F.array_min(found), F.lit(0.0)), 6).alias("mrr"), F.round(gain(found) / ideal, 6).alias("ndcg"))

"""Filters on the metadata of hits: their normal forms, the rows they keep, and the collection they may be asked of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

FILTERS = ("doc_ids", "filenames", "file_types", "uploaded_after", "uploaded_before", "include_ocr")


def utc(text: Column) -> Column:
    """An ISO date or time as a timestamp; without an offset it is UTC; null for anything else."""
    t = tx.stripped(text)
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}.*(Z|[+-]\d{2}:\d{2})$"), t).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat(t, F.lit("Z")))
    return full.try_cast("timestamp")


def file_name(path: Column) -> Column:
    """The last part of a path or URL in lower case."""
    inside = F.regexp_replace(tx.stripped(F.coalesce(path, F.lit(""))), "^.*?://", "")
    return F.lower(F.substring_index(F.regexp_replace(inside, "/+$", ""), "/", -1))


def suffix(name: Column) -> Column:
    """The letters after a file name's last dot, empty for names without one or with nothing before or after it."""
    return F.regexp_extract(name, r"^.+\.([^.]+)$", 1)


def word_list(values: Column, form) -> Column:
    """The distinct non-empty values in order, each in its normal form; null where none is left."""
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: form(tx.stripped(x))), lambda x: x != "")))
    return F.when(F.size(kept) > 0, kept)


def normalized(requests: DataFrame) -> DataFrame:
    """The filter columns of requests (lists, times as text, a flag) in normal form; null means no filter."""
    return requests.withColumns(
        {
            "doc_ids": word_list(F.col("doc_ids"), lambda x: x), "filenames": word_list(F.col("filenames"), file_name),
            "file_types": word_list(F.col("file_types"), lambda x: F.regexp_replace(F.lower(x), r"^\.+", "")),
            "uploaded_after": utc(F.col("uploaded_after")), "uploaded_before": utc(F.col("uploaded_before")), "include_ocr": F.col("include_ocr").cast("boolean"),
        }
    )


def any_filter(prefix: str = "") -> Column:
    return F.coalesce(*[F.when(F.col(prefix + c).isNotNull(), True) for c in FILTERS], F.lit(False))


def keeps(prefix: str) -> Column:
    """Whether a hit passes all filters that are given.

    A hit has doc_id, source, file_name, file_type, block_type (strings), ocr (boolean), uploaded_at and created_at (text).
    The name falls back to that of the source, the type to the name's suffix; times are inclusive, a missing time fails.
    """
    f = lambda c: F.col(prefix + c)
    given = lambda c: F.nullif(tx.stripped(F.lower(F.col(c))), F.lit(""))
    name = F.coalesce(file_name(given("file_name")), F.lit(""))
    name = F.when(name != "", name).otherwise(file_name(F.col("source")))
    kind = F.coalesce(F.nullif(F.regexp_replace(given("file_type"), r"^\.", ""), F.lit("")), suffix(name))
    ocr = F.coalesce(F.col("ocr"), F.lit(False)) | F.coalesce(given("block_type") == "ocr_text", F.lit(False))
    at = F.coalesce(utc(F.coalesce(F.nullif(F.col("uploaded_at"), F.lit("")), F.col("created_at"))))
    held = lambda wanted, test: wanted.isNull() | F.coalesce(test, F.lit(False))
    return (
        held(f("doc_ids"), F.array_contains(f("doc_ids"), F.col("doc_id"))) & held(f("filenames"), F.array_contains(f("filenames"), name))
        & held(f("file_types"), F.array_contains(f("file_types"), kind)) & held(f("include_ocr"), ocr == f("include_ocr"))
        & held(f("uploaded_after"), at >= f("uploaded_after")) & held(f("uploaded_before"), at <= f("uploaded_before"))
    )


def filtered(hits: DataFrame, requests: DataFrame, active_source: str = "uploaded") -> DataFrame:
    """The hits that pass the filters of their query_id; a query without a row has none.

    Filters speak of uploaded files: with another collection active, a query with any filter gets no hits.
    requests holds one row a query at most.
    """
    asked = normalized(requests).select("query_id", *[F.col(c).alias(f"_f_{c}") for c in FILTERS])
    joined = hits.join(asked, "query_id", "left")
    rule = keeps("_f_") if active_source == "uploaded" else ~any_filter("_f_")
    return joined.where(rule).select(*hits.columns)


def empty_hits(hits: DataFrame) -> DataFrame:
    """What a retriever without an index returns: no row, in the columns of hits."""
    return hits.where(F.lit(False))
